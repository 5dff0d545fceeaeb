"""Building blocks of the check SQL. They state the definitions plainly, without the plans
the operators use: windows over single rows, joins back, ``quantile_cont``."""

from __future__ import annotations

from .adapters import CUSTOMERS_SQL, TZ, Adapter

RECEIVED = "('1', 'true', 'yes', 'y', 't')"
LOCAL = f"(win_date AT TIME ZONE 'UTC') AT TIME ZONE '{TZ}'"
SEGMENT = """CASE WHEN {n} = 1 THEN 'Novice (1 scan)' WHEN {n} <= 5 THEN 'Active (2-5 scans)'
     ELSE 'Power User (6+ scans)' END"""
RAW_DATE = "TRY_CAST({0} AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"
CLEAN_PRIZE = (
    "CASE WHEN lower(regexp_replace(prize_id, '^\\s+|\\s+$', '', 'g')) IN ('', 'null', 'none', 'nan')"
    " THEN NULL ELSE regexp_replace(prize_id, '^\\s+|\\s+$', '', 'g') END"
)
REGION = """CASE CAST(region_id AS VARCHAR) WHEN '1' THEN 'Georgia' WHEN '2' THEN 'Armenia'
     ELSE coalesce(CAST(region_id AS VARCHAR), 'nan') END"""


def gran(col: str, granularity: str) -> str:
    return f"CAST(date_trunc('{granularity.lower()}', {col}) AS DATE)"


def with_norm(adapter: Adapter, raw_text: bool = False) -> str:
    """CTEs ``scans`` (raw), ``norm`` (derived flags), ``seg`` (plus segment)."""
    source = "SELECT * FROM scans"
    if raw_text:
        source = f"""SELECT * REPLACE ({RAW_DATE.format('win_date')} AS win_date,
            {CLEAN_PRIZE} AS prize_id) FROM scans"""
    return f"""WITH scans AS ({adapter.sql}),
typed AS ({source}),
wins AS (SELECT *, win_date IS NOT NULL AS has_win,
       win_date IS NOT NULL AND prize_id IS NOT NULL AS is_real_prize,
       win_date IS NOT NULL AND prize_id IS NULL AS is_point_win FROM typed),
norm AS (SELECT * EXCLUDE (is_win_received, got),
       CASE WHEN is_real_prize THEN 'real_prize' WHEN is_point_win THEN 'points'
            ELSE 'no_win' END AS win_type,
       got AS is_win_received,
       is_real_prize AND got AS is_real_prize_received,
       is_real_prize AND NOT got AS is_real_prize_pending,
       {REGION} AS region_name
  FROM (SELECT *, coalesce(lower(CAST(is_win_received AS VARCHAR)) IN {RECEIVED}, false)
               OR is_point_win AS got FROM wins)),
seg AS (SELECT n.*, {SEGMENT.format(n="coalesce(c.n, 0)")} AS user_segment FROM norm n
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM norm GROUP BY 1) c
    ON n.customer_id = c.customer_id)"""


def with_work(adapter: Adapter, where: str = "true", source: str = "norm") -> str:
    """Adds ``work``: scanned rows from the start on, with ``win_local``."""
    return f"""{with_norm(adapter)},
work AS (SELECT *, {LOCAL} AS win_local FROM {source}
  WHERE win_date >= TIMESTAMP '{adapter.start}' AND {where})"""


def with_counts(adapter: Adapter, granularity: str, value: str = "count(*)", where: str = "true") -> str:
    """Adds ``counts``: (date, count) for the buckets that exist."""
    return f"""{with_work(adapter)},
counts AS (SELECT {gran('win_local', granularity)} AS date, CAST({value} AS BIGINT) AS count
  FROM work WHERE {where} GROUP BY 1)"""


def with_filled(granularity: str) -> str:
    """CTE ``filled`` over ``counts``."""
    return f"""filled AS (SELECT CAST(g.d AS DATE) AS date, coalesce(c.count, 0) AS count
  FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP,
        INTERVAL 1 {granularity.upper()})) AS d FROM counts) g
  LEFT JOIN counts c ON c.date = CAST(g.d AS DATE))"""


LEADING = """SELECT * FROM filled WHERE date >= coalesce(
  (SELECT min(date) FROM filled WHERE count > 0), (SELECT min(date) FROM filled))"""
TRAILING = "SELECT * FROM {0} WHERE NOT (count = 0 AND date = (SELECT max(date) FROM {0}))"


def series(adapter: Adapter, granularity: str, value: str = "count(*)", where: str = "true") -> str:
    """CTEs ending in ``series``: filled, both trims."""
    return f"""{with_counts(adapter, granularity, value, where)}, {with_filled(granularity)},
led AS ({LEADING}), series AS ({TRAILING.format('led')})"""


def with_cohorts(adapter: Adapter) -> str:
    return f"""{with_norm(adapter)},
loc AS (SELECT *, {LOCAL} AS win_local FROM norm WHERE win_date IS NOT NULL),
firsts AS (SELECT loc.*, f.first_scan FROM loc JOIN
  (SELECT customer_id, min(win_local) AS first_scan FROM loc GROUP BY 1) f USING (customer_id)),
cohorts AS (SELECT cohort_week, CAST(date_diff('day', cohort_week, week) // 7 AS BIGINT)
         AS weeks_since_first, count(DISTINCT customer_id) AS users
  FROM (SELECT customer_id, {gran('first_scan', 'week')} AS cohort_week,
               {gran('win_local', 'week')} AS week FROM firsts) GROUP BY 1, 2),
retention AS (SELECT c.*, s.users AS cohort_size, c.users / s.users AS retention
  FROM cohorts c JOIN cohorts s ON s.cohort_week = c.cohort_week AND s.weeks_since_first = 0)"""


def wide(source: str, value: str, max_weeks: int, week: str = "cohort_week") -> str:
    cells = ", ".join(
        f"{value.format(f'max(CASE WHEN weeks_since_first = {k} THEN v END)')} AS w{k}"
        for k in range(max_weeks + 1)
    )
    return f"SELECT {week} AS cohort_week, {cells} FROM {source} GROUP BY cohort_week"


def with_claims(adapter: Adapter) -> str:
    return f"""{with_norm(adapter)},
claims AS (SELECT *, (epoch_us(prize_receive_date) - epoch_us(win_date)) / 3600000000.0
    AS hours_to_claim FROM norm
  WHERE is_real_prize AND is_win_received AND prize_receive_date IS NOT NULL
    AND prize_receive_date >= win_date)"""


def with_gaps(adapter: Adapter) -> str:
    return f"""{with_work(adapter)},
gaps AS (SELECT *, lag(win_date) OVER (PARTITION BY customer_id ORDER BY win_date) AS prev_win_date
  FROM work WHERE customer_id IS NOT NULL),
deltas AS (SELECT *, (epoch_us(win_date) - epoch_us(prev_win_date)) / 3600000000.0 AS delta_hours
  FROM gaps)"""


def with_spans(adapter: Adapter, basis: str) -> str:
    """CTE ``spans``; full weeks are counted Monday by Monday."""
    last = {
        "own": "max(win_local)",
        "global": "(SELECT CAST(CAST(max(win_local) AS DATE) AS TIMESTAMP) FROM work)",
    }[basis]
    return f"""{with_work(adapter)},
ends AS (SELECT customer_id, min(win_local) AS first_win, {last} AS last_win,
       count(*) AS total_scans FROM work WHERE customer_id IS NOT NULL GROUP BY customer_id),
days AS (SELECT customer_id, first_win, CAST(first_win AS DATE) AS first_day,
       {gran('first_win', 'week')} AS first_week_start, last_win,
       CAST(last_win AS DATE) AS last_day, {gran('last_win', 'week')} AS last_week_start,
       total_scans FROM ends),
spans AS (SELECT *, greatest(1, date_diff('day', first_day, last_day) + 1) AS span_days,
       greatest(1, date_diff('day', first_week_start, last_week_start) // 7 + 1) AS span_weeks
  FROM days),
rates AS (SELECT *, total_scans / span_days AS daily_rate_span,
       total_scans / span_weeks AS weekly_rate_span FROM spans),
mondays AS (SELECT s.customer_id, count(*) AS full_weeks FROM spans s,
    (SELECT CAST(unnest(generate_series(
        (SELECT min(first_week_start) FROM spans)::TIMESTAMP,
        (SELECT max(last_day) FROM spans)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS monday) m
  WHERE m.monday >= s.first_day AND m.monday + 6 <= s.last_day GROUP BY 1),
weeks AS (SELECT s.*, coalesce(m.full_weeks, 0) AS full_weeks
  FROM spans s LEFT JOIN mondays m USING (customer_id))"""


def stats(col: str) -> str:
    return f"""coalesce(avg({col}), 0) AS mean, coalesce(quantile_cont({col}, 0.25), 0) AS q25,
  coalesce(quantile_cont({col}, 0.5), 0) AS median,
  coalesce(quantile_cont({col}, 0.75), 0) AS q75, count({col}) AS count"""


def rounded(sql: str, *cols: str) -> str:
    """Doubles to six places, as in the Spark query."""
    if not cols:
        return sql
    changes = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({changes}) FROM ({sql})"


LAPSED = """WITH s AS ({scans}), c AS ({customers}),
here AS (SELECT s.customer_id, c.phone_number AS phone, c.first_name, s.win_date,
         s.prize_id IS NOT NULL AS prize, s.is_win_received AS got
  FROM s LEFT JOIN c ON s.customer_id = c.id WHERE s.region_id = 2 AND s.win_date IS NOT NULL),
sums AS (SELECT customer_id, phone, max(first_name) AS first_name, count(*) AS scans,
         count(*) FILTER (WHERE prize AND NOT got) AS pending_cnt,
         count(*) FILTER (WHERE prize AND got) AS got_cnt,
         max(CASE WHEN prize THEN win_date END) AS last_prize_at FROM here GROUP BY 1, 2)
SELECT customer_id, phone, first_name, scans, pending_cnt,
       last_prize_at
FROM sums WHERE got_cnt = 0 AND last_prize_at < DATE '{day}' - 15"""


def lapsed(adapter: Adapter) -> str:
    return LAPSED.format(scans=adapter.sql, customers=CUSTOMERS_SQL, day=adapter.as_of[:10])
