"""Every operator as a query over whole test tables, with its check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import promoscan as ps

from . import oracle as o
from .adapters import EVENTS, ORDERS, ORDERS_LATE, RAW, TZ, Adapter, QueryFn, customers, table

U = "customer_id"
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
RATES = ("daily_rate_span", "weekly_rate_span")
SPAN_COLS = (
    "customer_id, first_win, first_day, first_week_start, last_win, last_day, last_week_start, "
    "total_scans, span_days, span_weeks"
)
MAX_WEEKS = 350
FLAGS = (
    "has_win, is_real_prize, is_point_win, win_type, is_win_received, is_real_prize_received, "
    "is_real_prize_pending, region_name"
)


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


def query(name: str, sql: str | None, *doubles: str):
    """Register a query; ``doubles`` are rounded to six places on both sides."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = o.rounded(sql, *doubles)
        return fn

    return add


def scoped(adapter: Adapter, fn, with_segments: bool = False, **params) -> QueryFn:
    """A query over the dashboard frames of one adapter."""
    return lambda spark, sf_dir: fn(adapter.frames(spark, sf_dir, with_segments, **params))


def cols(df: DataFrame, names: str) -> DataFrame:
    return df.select(*[n.strip() for n in names.split(",")])


# --- sources -----------------------------------------------------------------------------

query("read_scans_parquet", "SELECT * FROM events")(lambda spark, sf: table(spark, sf, "events"))

NULL_TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
query(
    "null_tokens",
    f"""WITH raw AS ({RAW.sql}) SELECT scan_id,
    CASE WHEN prize_id NOT IN {NULL_TOKENS} THEN prize_id END AS prize_id,
    CASE WHEN is_win_received NOT IN {NULL_TOKENS} THEN is_win_received END AS is_win_received
    FROM raw""",
)(lambda spark, sf: cols(ps.null_tokens(RAW.scans(spark, sf)), "scan_id, prize_id, is_win_received"))

# --- normalisation -----------------------------------------------------------------------

query(
    "parse_dates",
    f"WITH raw AS ({RAW.sql}) SELECT scan_id, {o.RAW_DATE.format('win_date')} AS win_date FROM raw",
)(lambda spark, sf: ps.parse_dates(RAW.scans(spark, sf)).select("scan_id", "win_date"))

DATE_FORMATS = ("dd.MM.yyyy HH:mm", "yyyy/MM/dd", "yyyyMMdd'T'HHmmss'Z'")


def _written_dates(spark, sf):
    """Event times in the forms of ``DATE_FORMATS``, in ISO form, and as an epoch number."""
    form = F.col("event_id") % 5
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    for i, pattern in enumerate(DATE_FORMATS):
        text = F.when(form == i, F.date_format("ts", pattern)).otherwise(text)
    text = F.when(form == 4, F.lit("31.31.2025")).otherwise(text)
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf, "events").select("event_id", text.alias("win_date"), nanos.alias("prize_receive_date"))


query(
    "parse_date_formats",
    """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('day', ts)
    WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS TIMESTAMP) AS win_date, ts AS prize_receive_date FROM events""",
)(lambda spark, sf: ps.parse_dates(_written_dates(spark, sf), formats=DATE_FORMATS))

query(
    "date_parse_report",
    """SELECT 'win_date' AS "column", count(ts) AS "values", CAST(count(ts) FILTER (event_id % 5 <> 3) AS BIGINT) AS unreadable
    FROM events UNION ALL SELECT 'prize_receive_date', count(ts), 0 FROM events""",
)(lambda spark, sf: ps.date_parse_report(_written_dates(spark, sf)))

query(
    "csv_round_trip",
    f"""WITH s AS ({EVENTS.sql}) SELECT CAST(scan_id AS VARCHAR) AS scan_id, CAST(customer_id AS VARCHAR) AS customer_id,
    win_date, CAST(prize_id AS VARCHAR) AS prize_id, CAST(is_win_received AS VARCHAR) AS is_win_received FROM s""",
)(lambda spark, sf: _csv_round_trip(cols(EVENTS.scans(spark, sf), "scan_id, customer_id, win_date, prize_id, is_win_received")))


def _csv_round_trip(df):
    return ps.parse_dates(ps.scans_from_csv_lines(ps.csv_lines(df), df.columns), ["win_date"])


query(
    "normalize_prize_id",
    f"WITH raw AS ({RAW.sql}) SELECT scan_id, {o.CLEAN_PRIZE} AS prize_id FROM raw",
)(lambda spark, sf: ps.normalize_prize_id(RAW.scans(spark, sf)).select("scan_id", "prize_id"))

query(
    "received_flag",
    f"""WITH raw AS ({RAW.sql}) SELECT scan_id,
    coalesce(lower(is_win_received) IN {o.RECEIVED}, false) AS is_win_received FROM raw""",
)(lambda spark, sf: ps.received(RAW.scans(spark, sf)).select("scan_id", "is_win_received"))

query("region_name", f"WITH raw AS ({RAW.sql}) SELECT scan_id, {o.REGION} AS region_name FROM raw")(
    lambda spark, sf: ps.region_name(RAW.scans(spark, sf)).select("scan_id", "region_name")
)


def _wins(spark, sf):
    return ps.win_flags(ORDERS.scans(spark, sf))


for _flag in ("has_win", "is_real_prize", "is_point_win"):
    query(_flag, f"{o.with_norm(ORDERS)} SELECT scan_id, {_flag} FROM norm")(
        lambda spark, sf, flag=_flag: _wins(spark, sf).select("scan_id", flag)
    )

query("win_type", f"{o.with_norm(ORDERS)} SELECT scan_id, win_type FROM norm")(
    lambda spark, sf: ps.win_type(_wins(spark, sf)).select("scan_id", "win_type")
)


def _received(spark, sf):
    return ps.points_received(ps.received(_wins(spark, sf)))


query("points_received", f"{o.with_norm(ORDERS)} SELECT scan_id, is_win_received FROM norm")(
    lambda spark, sf: _received(spark, sf).select("scan_id", "is_win_received")
)

for _flag in ("is_real_prize_received", "is_real_prize_pending"):
    query(_flag, f"{o.with_norm(ORDERS)} SELECT scan_id, {_flag} FROM norm")(
        lambda spark, sf, flag=_flag: ps.real_prize_flags(_received(spark, sf)).select("scan_id", flag)
    )

for _name, _adapter in (("normalize", RAW), ("normalize_orders", ORDERS), ("normalize_events", EVENTS)):
    _cols = f"scan_id, customer_id, win_date, prize_id, {FLAGS}"
    query(_name, f"{o.with_norm(_adapter, raw_text=_adapter is RAW)} SELECT {_cols} FROM norm")(
        lambda spark, sf, a=_adapter, c=_cols: cols(ps.normalize(a.scans(spark, sf)), c)
    )

query("to_local", f"WITH s AS ({EVENTS.sql}) SELECT scan_id, {o.LOCAL} AS win_local FROM s")(
    lambda spark, sf: ps.to_local(EVENTS.scans(spark, sf), tz=TZ).select("scan_id", "win_local")
)

query(
    "to_naive_utc",
    """SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') || '+04:00' AS TIMESTAMPTZ)
    AT TIME ZONE 'UTC' AS ts FROM events""",
)(
    lambda spark, sf: ps.to_naive_utc(
        table(spark, sf, "events").select(
            "event_id",
            F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+04:00"))
            .cast("timestamp")
            .alias("ts"),
        ),
        "ts",
    )
)

# --- text as it comes: forms of dates, ids, broken lines -----------------------------------

MIXED_DATES = {
    "spark": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_format(ts, 'dd.MM.yyyy HH:mm') WHEN 1 THEN date_format(ts, 'M/d/yyyy')
    WHEN 2 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 3 THEN date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
    WHEN 4 THEN CAST(unix_seconds(CAST(ts AS timestamp)) AS string) WHEN 5 THEN '31.31.2025' END AS win_date,
    CAST(unix_micros(CAST(ts AS timestamp)) AS double) AS prize_receive_date FROM {rows}""",
    "read": """CAST(CASE event_id % 7 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('day', ts)
    WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE date_trunc('second', ts) END AS TIMESTAMP)""",
}


def _mixed_dates(spark, sf):
    return ps.use_utc(spark).sql(MIXED_DATES["spark"], rows=table(spark, sf, "events"))


query(
    "parse_dates_vote", f"SELECT event_id, {MIXED_DATES['read']} AS win_date, ts AS prize_receive_date FROM events"
)(lambda spark, sf: ps.parse_dates(_mixed_dates(spark, sf), formats="vote", epoch_unit="us"))

_TIME = "[ H:mm[:ss[.SSSSSS]]]"
query(
    "date_votes",
    f"""SELECT 'win_date' AS "column", format, count(*) AS readable, chosen FROM events, (VALUES
    (0, 31, 'd.M.yyyy{_TIME}', true), (0, 12, 'M.d.yyyy{_TIME}', false), (1, 31, 'M/d/yyyy{_TIME}', true), (1, 12, 'd/M/yyyy{_TIME}', false),
    (2, 31, 'ISO-8601', true), (3, 31, 'yyyyMMdd''T''HHmmss[''Z'']', true), (4, 31, 'epoch s', true)) AS f(form, most, format, chosen)
    WHERE event_id % 7 = form AND day(ts) <= most AND ts IS NOT NULL GROUP BY 2, 4""",
)(lambda spark, sf: ps.date_votes(_mixed_dates(spark, sf)))

query(
    "normalize_vote",
    f"""WITH r AS (SELECT event_id, {MIXED_DATES['read']} AS win_date FROM events) SELECT event_id, win_date, win_date IS NOT NULL AS has_win FROM r""",
)(
    lambda spark, sf: ps.dashboard_frames(
        _mixed_dates(spark, sf), ps.ScanParams(date_formats="vote", epoch_unit="us")
    ).scans.select("event_id", "win_date", "has_win")
)


def _text_ids(spark, sf):
    """Users as a CSV file may hold them: some with a point, one column with other text."""
    point = F.when(F.col("event_id") % 3 == 0, ".0").otherwise("")
    user = F.when(F.col("event_id") % 211 != 0, F.concat(F.col("user_id").cast("string"), point))
    return table(spark, sf, "events").select("event_id", user.alias("customer_id"), F.col("event_type").alias("prize_id"))


query("typed_ids", "SELECT event_id, CASE WHEN event_id % 211 <> 0 THEN user_id END AS customer_id FROM events")(
    lambda spark, sf: ps.typed_ids(_text_ids(spark, sf)).select("event_id", U)
)
query(
    "id_profile",
    """SELECT 'customer_id' AS "column", count(user_id) AS "values", count(user_id) AS whole,
    count(*) FILTER (event_id % 3 = 0) AS point_zero, true AS typed FROM events WHERE event_id % 211 <> 0
    UNION ALL SELECT 'prize_id', count(event_type), 0, 0, count(event_type) = 0 FROM events""",
)(lambda spark, sf: ps.id_profile(_text_ids(spark, sf), ["customer_id", "prize_id"]))
query(
    "typed_user_picklist", "SELECT DISTINCT user_id AS customer_id FROM events WHERE event_id % 211 <> 0"
)(lambda spark, sf: ps.user_picklist(ps.typed_ids(_text_ids(spark, sf)), U))

CSV_FIELDS = ("event_id", "customer_id", "note")
# The same text in Spark and DuckDB; three of fifty lines are broken.
CSV_LINES = """SELECT event_id, CAST(event_id AS VARCHAR(20)) || CASE event_id % 50 WHEN 1 THEN '' ELSE ',' || CAST(user_id AS VARCHAR(20)) END
    || CASE event_id % 50 WHEN 2 THEN ',"open' ELSE ',"' || event_type || ', \"\"x\"\"\"' END
    || CASE event_id % 50 WHEN 0 THEN ',more' ELSE '' END AS line FROM {source}"""


def _csv_lines(spark, sf):
    return spark.sql(CSV_LINES.format(source="{rows}"), rows=table(spark, sf, "events")).select("line")


query(
    "csv_checked_rows",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id, event_type || ', "x"' AS note
    FROM events WHERE event_id % 50 NOT IN (0, 1, 2)""",
)(lambda spark, sf: ps.checked_csv_lines(_csv_lines(spark, sf), CSV_FIELDS).rows)
query(
    "csv_broken_lines",
    f"""SELECT line, CASE event_id % 50 WHEN 0 THEN 'too many fields' WHEN 1 THEN 'too few fields' ELSE 'open quote' END AS reason
    FROM ({CSV_LINES.format(source='events')}) WHERE event_id % 50 IN (0, 1, 2)""",
)(lambda spark, sf: ps.checked_csv_lines(_csv_lines(spark, sf), CSV_FIELDS).broken)

# --- segment and filters -----------------------------------------------------------------

for _name, _adapter in (("with_user_segment", ORDERS), ("with_user_segment_events", EVENTS)):
    query(_name, f"{o.with_norm(_adapter)} SELECT scan_id, customer_id, user_segment FROM seg")(
        lambda spark, sf, a=_adapter: ps.with_user_segment(a.scans(spark, sf), U).select(
            "scan_id", U, "user_segment"
        )
    )

FILTER_COLS = "scan_id, customer_id, win_date, prize_id, win_type, is_win_received, region_name"


def filter_query(name: str, where: str, fn, segments: bool = False) -> None:
    source = "seg" if segments else "norm"
    query(name, f"{o.with_norm(ORDERS)} SELECT {FILTER_COLS} FROM {source} WHERE {where}")(
        scoped(ORDERS, lambda f: cols(fn(f.scans), FILTER_COLS), segments)
    )


filter_query("filter_region", "region_name IN ('Georgia', 'nan')", lambda d: ps.filter_region(d, ("Georgia", "nan")))
filter_query("filter_prize", "CAST(prize_id AS VARCHAR) IN ('2', '5')", lambda d: ps.filter_prize(d, ("2", "5")))
filter_query(
    "filter_segment",
    "user_segment = 'Active (2-5 scans)'",
    lambda d: ps.filter_segment(d, ("Active (2-5 scans)",)),
    segments=True,
)
filter_query("filter_win_type", "win_type IN ('points', 'no_win')", lambda d: ps.filter_win_type(d, ("points", "no_win")))
filter_query("filter_received", "is_win_received", lambda d: ps.filter_received(d, "received"))
filter_query("filter_not_received", "NOT is_win_received", lambda d: ps.filter_received(d, "not_received"))
filter_query("drop_unscanned", "win_date IS NOT NULL", ps.drop_unscanned)
filter_query("filter_start", f"win_date >= TIMESTAMP '{ORDERS_LATE.start}'", lambda d: ps.filter_start(d, ORDERS_LATE.start))
LO, HI = "1997-02-03 00:00:00", "1999-11-30 00:00:00"
RANGE = f"win_date BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'"
filter_query("filter_range", RANGE, lambda d: ps.filter_range(d, LO, HI))

query(
    "date_extent",
    f"""{o.with_work(ORDERS_LATE)} SELECT greatest(TIMESTAMP '{ORDERS_LATE.start}', min(win_date)) AS lo,
    max(win_date) AS hi FROM work""",
)(scoped(ORDERS_LATE, lambda f: ps.date_extent(f.filtered, ORDERS_LATE.start)))

ALL_FILTERS = {
    "regions": ("Georgia", "Armenia"),
    "prizes": ("1", "2", "3"),
    "segments": (ps.config.POWER,),
    "win_types": ("real_prize",),
    "received": "not_received",
}
ALL_WHERE = """region_name IN ('Georgia', 'Armenia') AND CAST(prize_id AS VARCHAR) IN ('1', '2', '3')
  AND user_segment = 'Power User (6+ scans)' AND win_type = 'real_prize' AND NOT is_win_received"""
query(
    "apply_filters", f"{o.with_norm(ORDERS)} SELECT {FILTER_COLS}, user_segment FROM seg WHERE {ALL_WHERE}"
)(scoped(ORDERS, lambda f: cols(f.filtered, f"{FILTER_COLS}, user_segment"), **ALL_FILTERS))

query(
    "work_slice",
    f"{o.with_work(ORDERS_LATE, f'{ALL_WHERE} AND {RANGE}', 'seg')} SELECT {FILTER_COLS}, win_local FROM work",
)(scoped(ORDERS_LATE, lambda f: cols(f.work, f"{FILTER_COLS}, win_local"), lo=LO, hi=HI, **ALL_FILTERS))

for _name, _scope, _where in (("metrics_scope_slice", "slice", RANGE), ("metrics_scope_all", "all", "true")):
    query(_name, f"{o.with_work(ORDERS_LATE, _where)} SELECT {FILTER_COLS}, win_local FROM work")(
        scoped(ORDERS_LATE, lambda f: cols(f.metrics, f"{FILTER_COLS}, win_local"), lo=LO, hi=HI, scope=_scope)
    )

for _col, _expr in (
    ("region_name", "region_name"),
    ("prize_id", "CAST(prize_id AS VARCHAR)"),
    ("user_segment", "user_segment"),
    (U, U),
):
    query(
        f"distinct_values_{_col}",
        f"{o.with_norm(ORDERS)} SELECT DISTINCT {_expr} AS {_col} FROM seg WHERE {_col} IS NOT NULL",
    )(scoped(ORDERS, lambda f, c=_col: ps.distinct_values(f.scans, c), with_segments=_col == "user_segment"))

query(
    "user_picklist",
    f"""{o.with_work(EVENTS)}, users AS (SELECT DISTINCT customer_id FROM work
    WHERE customer_id IS NOT NULL) SELECT * FROM users""",
)(scoped(EVENTS, lambda f: ps.user_picklist(f.work, U)))

# --- time series -------------------------------------------------------------------------

for _gran in ("Day", "Week", "Month"):
    _key = _gran.lower()
    query(
        f"time_bucket_{_key}",
        f"{o.with_work(EVENTS)} SELECT scan_id, {o.gran('win_local', _gran)} AS date FROM work",
    )(scoped(EVENTS, lambda f, g=_gran: ps.time_bucket(f.work, "win_local", g).select("scan_id", "date")))
    query(f"count_by_time_{_key}", f"{o.with_counts(EVENTS, _gran)} SELECT * FROM counts")(
        scoped(EVENTS, lambda f, g=_gran: ps.count_by_time(f.work, g, TZ))
    )
    query(
        f"users_by_time_{_key}",
        f"{o.with_counts(ORDERS, _gran, 'count(DISTINCT customer_id)')} SELECT * FROM counts",
    )(scoped(ORDERS, lambda f, g=_gran: ps.users_by_time(f.work, g, TZ, U)))
    query(f"aggregate_time_{_key}", f"{o.series(ORDERS, _gran)} SELECT * FROM series")(
        scoped(ORDERS, lambda f, g=_gran: ps.aggregate_time(f.work, g, False, TZ, U))
    )
    query(
        f"aggregate_time_users_{_key}",
        f"{o.series(ORDERS, _gran, 'count(DISTINCT customer_id)')} SELECT * FROM series",
    )(scoped(ORDERS, lambda f, g=_gran: ps.aggregate_time(f.work, g, True, TZ, U)))
    query(
        f"real_prize_series_{_key}",
        f"{o.series(ORDERS, _gran, where='is_real_prize')} SELECT * FROM series",
    )(
        scoped(ORDERS, lambda f, g=_gran: ps.real_prize_series(f.work, g, False, TZ, U))
    )

RARE_WHERE = "is_real_prize"
RARE_SQL = o.with_counts(ORDERS, "Day", where=RARE_WHERE)


def _rare(f: ps.Frames) -> DataFrame:
    rare = f.work.where("is_real_prize")
    return ps.count_by_time(rare, "Day", TZ)


query("fill_time_gaps", f"{RARE_SQL}, {o.with_filled('Day')} SELECT * FROM filled")(
    scoped(ORDERS, lambda f: ps.fill_time_gaps(_rare(f), "Day"))
)

# Daily counts of a rare kind of row, with the zero days at both ends still there.
ENDS_SQL = o.with_counts(
    ORDERS, "Day", "count(*) FILTER (WHERE prize_id = 3 AND region_id = 1 AND is_win_received)"
).replace("counts AS", "filled AS")


def _zero_ends(f: ps.Frames) -> DataFrame:
    rare = (F.col("prize_id") == 3) & (F.col("region_id") == 1) & F.col("is_win_received")
    days = ps.time_bucket(f.work, "win_local", "Day")
    return days.groupBy("date").agg(F.count_if(rare).alias("count"))


query("trim_leading_zeros", f"{ENDS_SQL} {o.LEADING}")(
    scoped(ORDERS, lambda f: ps.trim_leading_zeros(_zero_ends(f)))
)
query("trim_trailing_zero", f"{ENDS_SQL} {o.TRAILING.format('filled')}")(
    scoped(ORDERS, lambda f: ps.trim_trailing_zero(_zero_ends(f)))
)
query(
    "series_export",
    f"{o.series(ORDERS, 'Week')} SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS date, count FROM series",
)(scoped(ORDERS, lambda f: ps.series_export(ps.aggregate_time(f.work, "Week", False, TZ, U))))
query(
    "series_preview",
    f"""{o.series(ORDERS, 'Day')} (SELECT 'head' AS part, date, count FROM series ORDER BY date LIMIT 10)
    UNION ALL (SELECT 'tail', date, count FROM series ORDER BY date DESC LIMIT 5)""",
)(scoped(ORDERS, lambda f: ps.series_preview(ps.aggregate_time(f.work, "Day", False, TZ, U))))

# --- key figures -------------------------------------------------------------------------

KPI_SQL = """count(*) AS total_events, count(DISTINCT customer_id) AS unique_users,
  CAST(sum(has_win::INT) AS BIGINT) AS wins_total,
  CAST(sum(is_real_prize::INT) AS BIGINT) AS real_prizes_total,
  CAST(sum(is_real_prize_received::INT) AS BIGINT) AS real_prizes_received,
  CAST(sum(is_real_prize_pending::INT) AS BIGINT) AS real_prizes_pending"""
query("kpi_summary", f"{o.with_work(ORDERS)} SELECT {KPI_SQL} FROM work")(
    scoped(ORDERS, lambda f: ps.kpi_summary(f.metrics, U))
)
query(
    "kpi_rates",
    f"""{o.with_work(ORDERS)}, k AS (SELECT {KPI_SQL} FROM work)
    SELECT coalesce(wins_total / total_events, 0) AS win_rate,
      coalesce(real_prizes_total / wins_total, 0) AS real_share,
      coalesce(real_prizes_received / real_prizes_total, 0) AS received_rate,
      coalesce(real_prizes_pending / real_prizes_total, 0) AS pending_rate FROM k""",
    "win_rate",
    "real_share",
    "received_rate",
    "pending_rate",
)(scoped(ORDERS, lambda f: ps.kpi_rates(f.metrics)))
query(
    "user_kpis",
    f"""{o.with_work(ORDERS)} SELECT
    count(DISTINCT customer_id) FILTER (WHERE has_win) AS users_won_any,
    count(DISTINCT customer_id) FILTER (WHERE is_win_received) AS users_received_any,
    count(DISTINCT customer_id) FILTER (WHERE is_real_prize_pending) AS users_pending_real,
    count(DISTINCT customer_id) FILTER (WHERE is_real_prize_received)
      AS users_pending_but_ever_received_real,
    count(DISTINCT customer_id) FILTER (WHERE is_real_prize_pending AND customer_id IN
      (SELECT customer_id FROM work WHERE is_real_prize_received))
      AS users_pending_and_received_real FROM work""",
)(scoped(ORDERS, lambda f: ps.user_kpis(f.metrics, U)))
query(
    "pending_events",
    f"{o.with_work(ORDERS)} SELECT {FILTER_COLS} FROM work WHERE is_real_prize_pending",
)(scoped(ORDERS, lambda f: cols(ps.pending_events(f.metrics), FILTER_COLS)))
query(
    "pending_events_count",
    f"{o.with_work(ORDERS)} SELECT count(*) AS pending_events FROM work WHERE is_real_prize_pending",
)(scoped(ORDERS, lambda f: ps.pending_events_count(f.metrics)))

PENDING_SQL = f"""{o.with_work(ORDERS)},
p AS (SELECT customer_id, count(*) AS n FROM work
  WHERE is_real_prize_pending AND customer_id IS NOT NULL GROUP BY 1),
r AS (SELECT customer_id, count(*) AS n FROM work
  WHERE is_real_prize_received AND customer_id IS NOT NULL GROUP BY 1),
pending AS (SELECT customer_id, coalesce(p.n, 0) AS pending_real_prizes,
  coalesce(r.n, 0) AS received_real_before_count,
  coalesce(r.n, 0) > 0 AS has_received_real_before FROM p FULL JOIN r USING (customer_id))"""
query("pending_users", f"{PENDING_SQL} SELECT * FROM pending")(
    scoped(ORDERS, lambda f: ps.pending_users(f.metrics, U))
)
query(
    "top_pending_users",
    f"{PENDING_SQL} SELECT * FROM pending ORDER BY pending_real_prizes DESC, customer_id LIMIT 20",
)(scoped(ORDERS, lambda f: ps.top_pending_users(ps.pending_users(f.metrics, U), U)))
query(
    "consistency_check",
    f"""{o.with_work(ORDERS)}, c AS (SELECT count(*) AS pending_events,
      count(DISTINCT customer_id) AS pending_unique_users FROM work WHERE is_real_prize_pending)
    SELECT *, 'customer_id' AS user_field, 'slice' AS scope,
      pending_unique_users > pending_events AS anomaly FROM c""",
)(scoped(ORDERS, lambda f: ps.consistency_check(f.metrics, U, "slice")))

# --- time of day, prizes -----------------------------------------------------------------

HOUR = "CAST(extract(hour FROM win_local) AS INTEGER)"
DOW = "CAST(extract(isodow FROM win_local) - 1 AS INTEGER)"
query("hourly_counts", f"{o.with_work(EVENTS)} SELECT {HOUR} AS hour, count(*) AS count FROM work GROUP BY 1")(
    scoped(EVENTS, lambda f: ps.hourly_counts(f.work, TZ))
)
query(
    "dow_hour_counts",
    f"{o.with_work(EVENTS)} SELECT {DOW} AS dow, {HOUR} AS hour, count(*) AS count FROM work GROUP BY 1, 2",
)(scoped(EVENTS, lambda f: ps.dow_hour_counts(f.work, TZ)))

ODDS_SQL = f"""{o.with_work(ORDERS)},
odds AS (SELECT prize_id, count(*) AS real_prize_count,
  count(*) FILTER (WHERE is_real_prize_received) AS received_count,
  count(*) / greatest((SELECT count(*) FROM work), 1) AS p_per_scan,
  count(*) / greatest((SELECT count(*) FROM work WHERE is_real_prize), 1) AS share_among_real,
  count(*) FILTER (WHERE is_real_prize_received) / count(*) AS received_share_in_prize
  FROM work WHERE is_real_prize GROUP BY prize_id)"""
ODDS = ("p_per_scan", "share_among_real", "received_share_in_prize")
query("prize_probabilities", f"{ODDS_SQL} SELECT * FROM odds", *ODDS)(
    scoped(ORDERS, lambda f: ps.prize_probabilities(f.metrics))
)
_pct = ", ".join(f"round_even({c} * 100 * 1000, 0) / 1000 AS {c}" for c in ODDS)
query("prize_probabilities_pct", f"{ODDS_SQL} SELECT * REPLACE ({_pct}) FROM odds", *ODDS)(
    scoped(ORDERS, lambda f: ps.prize_probabilities_pct(ps.prize_probabilities(f.metrics)))
)
query(
    "prize_efficiency",
    f"""{o.with_norm(ORDERS)} SELECT prize_id, count(*) AS total_won,
    count(*) FILTER (WHERE is_win_received) AS total_received,
    1 - count(*) FILTER (WHERE is_win_received) / count(*) AS unclaimed_rate
    FROM norm WHERE is_real_prize GROUP BY prize_id""",
    "unclaimed_rate",
)(scoped(ORDERS, lambda f: ps.prize_efficiency(f.filtered)))

# --- users -------------------------------------------------------------------------------

ACTIVITY = """SELECT customer_id, count(*) AS scans, count(*) FILTER (WHERE has_win) AS wins_any,
  count(*) FILTER (WHERE is_real_prize) AS real_prizes,
  coalesce(round_even(avg(delta_hours) * 100, 0) / 100, 0) AS avg_hours_between_scans,
  coalesce(round_even(median(delta_hours) * 100, 0) / 100, 0) AS median_hours_between_scans,
  coalesce(round_even(avg(delta_hours) / 24 * 100, 0) / 100, 0) AS avg_days_between_scans
  FROM deltas GROUP BY customer_id"""
for _suffix, _adapter in (("", EVENTS), ("_orders", ORDERS)):
    query(
        f"scan_gaps{_suffix}",
        f"{o.with_gaps(_adapter)} SELECT customer_id, win_date, prev_win_date, delta_hours FROM deltas",
        "delta_hours",
    )(scoped(_adapter, lambda f: ps.scan_gaps(f.metrics, U)))
    query(
        f"user_activity{_suffix}",
        f"{o.with_gaps(_adapter)} {ACTIVITY}",
        "avg_hours_between_scans",
        "median_hours_between_scans",
        "avg_days_between_scans",
    )(scoped(_adapter, lambda f: ps.user_activity(f.metrics, U)))

query(
    "user_history",
    f"""{o.with_work(ORDERS)} SELECT customer_id, region_name, win_type, is_win_received,
    is_real_prize, is_point_win, win_date, prize_receive_date, prize_id
    FROM work WHERE customer_id = 7""",
)(scoped(ORDERS, lambda f: ps.user_history(f.work, U, ps.cast_user_id(f.work, U, "7"))))

# --- cohorts and claims ------------------------------------------------------------------

query(
    "first_scan", f"{o.with_cohorts(ORDERS)} SELECT scan_id, customer_id, win_local, first_scan FROM firsts"
)(scoped(ORDERS, lambda f: ps.first_scan(f.filtered, U, TZ).select("scan_id", U, "win_local", "first_scan")))
query("cohort_counts", f"{o.with_cohorts(ORDERS)} SELECT * FROM cohorts")(
    scoped(ORDERS, lambda f: ps.cohort_counts(f.filtered, U, TZ))
)
query("cohort_counts_events", f"{o.with_cohorts(EVENTS)} SELECT * FROM cohorts")(
    scoped(EVENTS, lambda f: ps.cohort_counts(f.filtered, U, TZ))
)
query(
    "cohort_matrix",
    f"""{o.with_cohorts(ORDERS)} {o.wide('(SELECT *, users AS v FROM cohorts)', '{}', MAX_WEEKS)}""",
)(scoped(ORDERS, lambda f: ps.cohort_matrix(ps.cohort_counts(f.filtered, U, TZ), MAX_WEEKS)))
query("cohort_retention", f"{o.with_cohorts(ORDERS)} SELECT * FROM retention", "retention")(
    scoped(ORDERS, lambda f: ps.cohort_retention(ps.cohort_counts(f.filtered, U, TZ)))
)
_source = "(SELECT *, retention AS v FROM retention)"
_week = "strftime(cohort_week, '%Y-%m-%d')"
query(
    "cohort_retention_matrix",
    f"{o.with_cohorts(ORDERS)} {o.wide(_source, 'round({}, 6)', MAX_WEEKS, _week)}",
)(scoped(ORDERS, lambda f: ps.cohort_retention_matrix(ps.cohort_counts(f.filtered, U, TZ), MAX_WEEKS)))

query(
    "time_to_claim",
    f"{o.with_claims(ORDERS)} SELECT scan_id, win_date, prize_receive_date, hours_to_claim FROM claims",
    "hours_to_claim",
)(
    scoped(
        ORDERS,
        lambda f: ps.time_to_claim(f.filtered).select(
            "scan_id", "win_date", "prize_receive_date", "hours_to_claim"
        ),
    )
)
for _suffix, _adapter in (("", ORDERS), ("_events", EVENTS)):
    query(
        f"claim_stats{_suffix}",
        f"""{o.with_claims(_adapter)} SELECT count(*) AS claims, avg(hours_to_claim) AS mean_hours,
        median(hours_to_claim) AS median_hours FROM claims""",
        "mean_hours",
        "median_hours",
    )(scoped(_adapter, lambda f: ps.claim_stats(ps.time_to_claim(f.filtered))))

BINS_SQL = """, grid AS (SELECT {step} AS step, min(hours_to_claim) AS lo, max(hours_to_claim) AS hi
  FROM claims), bins AS (SELECT floor(lo / step) * step AS start, step,
  ceil((hi - floor(lo / step) * step) / step) - 1 AS last FROM grid)
SELECT start + greatest(0, least(last, floor((hours_to_claim - start) / step))) * step AS bin_start,
  start + greatest(0, least(last, floor((hours_to_claim - start) / step))) * step + step AS bin_end,
  count(*) AS count FROM claims, bins GROUP BY 1, 2"""
query(
    "claim_histogram",
    o.with_claims(ORDERS) + BINS_SQL.format(step="CAST(24 AS DOUBLE)"),
    "bin_start",
    "bin_end",
)(scoped(ORDERS, lambda f: ps.claim_histogram(ps.time_to_claim(f.filtered), step=24)))
# The widest candidate of 1, 2 and 5 times powers of ten that still fits is the smallest step
# with at most 30 bins.
AUTO_STEP = """(SELECT min(s) FROM (SELECT m * pow(10.0, e) AS s FROM (SELECT unnest([1, 2, 5]) AS m),
  (SELECT unnest(generate_series(-6, 9)) AS e)) WHERE
  (SELECT max(hours_to_claim) - min(hours_to_claim) FROM claims) / s <= 30)"""
query(
    "claim_histogram_auto",
    o.with_claims(ORDERS) + BINS_SQL.format(step=AUTO_STEP),
    "bin_start",
    "bin_end",
)(scoped(ORDERS, lambda f: ps.claim_histogram(ps.time_to_claim(f.filtered))))

FORGOTTEN = f"is_real_prize_pending AND win_date < TIMESTAMP '{ORDERS.as_of}' - INTERVAL 7 DAY"
query("forgotten_prizes", f"{o.with_norm(ORDERS)} SELECT {FILTER_COLS} FROM norm WHERE {FORGOTTEN}")(
    scoped(ORDERS, lambda f: cols(ps.forgotten_prizes(f.filtered, ORDERS.as_of), FILTER_COLS))
)
query(
    "forgotten_prizes_count",
    f"{o.with_norm(ORDERS)} SELECT count(*) AS forgotten_prizes FROM norm WHERE {FORGOTTEN}",
)(scoped(ORDERS, lambda f: ps.forgotten_prizes_count(f.filtered, ORDERS.as_of)))

# --- RFM and rates -----------------------------------------------------------------------


def rfm_sql(adapter: Adapter) -> str:
    return f"""{o.with_norm(adapter)},
g AS (SELECT customer_id, max(win_date) AS last_scan, count(*) AS frequency,
  count(*) FILTER (WHERE is_real_prize) AS real_prizes FROM norm
  WHERE win_date IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1),
rfm AS (SELECT *, CAST(floor((epoch_us((SELECT max(win_date) FROM norm)) - epoch_us(last_scan))
  / 86400000000) AS BIGINT) AS recency_days, {o.SEGMENT.format(n="frequency")} AS segment FROM g)"""


for _suffix, _adapter in (("", ORDERS), ("_events", EVENTS)):
    query(f"rfm{_suffix}", f"{rfm_sql(_adapter)} SELECT * FROM rfm")(
        scoped(_adapter, lambda f: ps.rfm(f.filtered, U))
    )
query("rfm_segment_counts", f"{rfm_sql(ORDERS)} SELECT segment, count(*) AS count FROM rfm GROUP BY 1")(
    scoped(ORDERS, lambda f: ps.rfm_segment_counts(ps.rfm(f.filtered, U)))
)

TOTALS = f"""{o.with_work(ORDERS)}, totals AS (SELECT customer_id, count(*) AS total_scans
  FROM work WHERE customer_id IS NOT NULL GROUP BY 1)"""
query("scans_per_user", f"{TOTALS} SELECT * FROM totals")(
    scoped(ORDERS, lambda f: ps.scans_per_user(f.metrics, U))
)
query("span_stats", f"{TOTALS} SELECT {o.stats('total_scans')} FROM totals", "mean", "q25", "median", "q75")(
    scoped(ORDERS, lambda f: ps.span_stats(ps.scans_per_user(f.metrics, U), "total_scans"))
)
query(
    "span_stats_price",
    f"SELECT {o.stats('o_totalprice')} FROM orders",
    "mean",
    "q25",
    "median",
    "q75",
)(lambda spark, sf: ps.span_stats(table(spark, sf, "orders"), "o_totalprice"))
query(
    "describe_scans",
    f"""{TOTALS} SELECT count(*) AS count, avg(total_scans) AS mean, stddev_samp(total_scans) AS std,
    min(total_scans) AS min, quantile_cont(total_scans, 0.25) AS q25,
    quantile_cont(total_scans, 0.5) AS median, quantile_cont(total_scans, 0.75) AS q75,
    max(total_scans) AS max FROM totals""",
    "mean",
    "std",
    "q25",
    "median",
    "q75",
)(scoped(ORDERS, lambda f: ps.describe_scans(ps.scans_per_user(f.metrics, U))))

for _basis in ("global", "own"):
    for _suffix, _adapter in (("", ORDERS), ("_events", EVENTS)):
        query(
            f"user_spans_{_basis}{_suffix}", f"{o.with_spans(_adapter, _basis)} SELECT {SPAN_COLS} FROM spans"
        )(scoped(_adapter, lambda f, b=_basis: ps.user_spans(f.metrics, U, b, TZ)))
    query(f"scan_rates_{_basis}", f"{o.with_spans(ORDERS, _basis)} SELECT * FROM rates", *RATES)(
        scoped(ORDERS, lambda f, b=_basis: ps.scan_rates(ps.user_spans(f.metrics, U, b, TZ)))
    )
    query(f"full_weeks_{_basis}", f"{o.with_spans(ORDERS, _basis)} SELECT * FROM weeks")(
        scoped(ORDERS, lambda f, b=_basis: ps.full_weeks(ps.user_spans(f.metrics, U, b, TZ)))
    )
    query(
        f"full_week_rate_{_basis}",
        f"""{o.with_spans(ORDERS, _basis)} SELECT *, CASE WHEN full_weeks > 0
        THEN total_scans / full_weeks END AS weekly_rate_full_weeks FROM weeks""",
        "weekly_rate_full_weeks",
    )(scoped(ORDERS, lambda f, b=_basis: ps.full_week_rate(ps.full_weeks(ps.user_spans(f.metrics, U, b, TZ)))))
    query(
        f"rate_stats_{_basis}",
        f"""{o.with_spans(ORDERS, _basis)}
        SELECT 'daily' AS rate, {o.stats('daily_rate_span')} FROM rates
        UNION ALL SELECT 'weekly', {o.stats('weekly_rate_span')} FROM rates""",
        "mean",
        "q25",
        "median",
        "q75",
    )(scoped(ORDERS, lambda f, b=_basis: ps.rate_stats(ps.scan_rates(ps.user_spans(f.metrics, U, b, TZ)))))

# --- lapsed customers --------------------------------------------------------------------

query("lapsed_prize_customers", o.lapsed(ORDERS))(
    lambda spark, sf: ps.lapsed_prize_customers(
        ORDERS.scans(spark, sf), customers(spark, sf), ORDERS.as_of
    )
)

RAW_AS_OF = "2025-10-15 00:00:00"
RAW_SCANS = f"""SELECT CASE WHEN customer_id IS NOT NULL THEN scan_id // 3 END AS customer_id,
    CASE WHEN win_date = '16.09.2025' THEN TIMESTAMP '2025-09-16' ELSE {o.RAW_DATE.format('win_date')} END AS win_date,
    {o.CLEAN_PRIZE} AS prize_id, TRY_CAST(region_id AS BIGINT) AS region_id,
    CASE WHEN lower(trim(is_win_received)) IN ('1', 'true', 'yes', 'y', 't') THEN true
         WHEN is_win_received IN ('0', 'false') THEN false END AS is_win_received FROM ({RAW.sql})"""


def _raw_text(spark, sf):
    """Raw scans with every column text; some customers written with a point."""
    point = F.when(F.col("scan_id") % 2 == 0, ".0").otherwise("")
    customer = F.concat(F.expr("scan_id div 3").cast("string"), point)
    return RAW.scans(spark, sf).withColumn(U, F.when(F.col(U).isNotNull(), customer))


query("lapsed_from_text", o.LAPSED.format(scans=RAW_SCANS, customers=o.CUSTOMERS_SQL, day=RAW_AS_OF[:10]))(
    lambda spark, sf: ps.lapsed_prize_customers(_raw_text(spark, sf), customers(spark, sf), RAW_AS_OF)
)

# --- scans laid out by day, sketches, loads of new files -------------------------------------


def _by_day(spark, sf):
    """Scans written by day: all first, then the days of one year once more, which replace themselves."""
    scans = ORDERS.scans(spark, sf)
    path = ps.shared_dir(ps.use_utc(spark), "by-day")
    ps.write_scans_by_day(scans, path)
    ps.write_scans_by_day(scans.where("year(win_date) = 1997"), path)
    return ps.read_scans_by_day(spark, path, scans.schema)


query("scans_by_day", f"SELECT *, CAST(win_date AS DATE) AS win_day FROM ({ORDERS.sql})")(_by_day)
query("filter_range_by_day", f"SELECT *, CAST(win_date AS DATE) AS win_day FROM ({ORDERS.sql}) WHERE {RANGE}")(
    lambda spark, sf: ps.filter_range(_by_day(spark, sf), LO, HI)
)
query(
    "users_from_sketches",
    f"""{o.with_work(ORDERS)} SELECT granularity, CAST(date_trunc(granularity, win_local) AS DATE) AS date, count(DISTINCT customer_id) AS count
    FROM work, (SELECT unnest(['Day', 'Week', 'Month']) AS granularity) GROUP BY 1, 2""",
)(scoped(ORDERS, lambda f: ps.users_from_sketches(ps.user_sketches(f.work, TZ, U))))


def _loaded(spark, sf):
    """Counts of orders in three files, loaded one after the other and each twice."""
    scans = ORDERS.scans(spark, sf)
    store = ps.shared_dir(ps.use_utc(spark), "counts")
    paths = []
    for i in range(3):
        paths.append(ps.shared_dir(spark, f"load{i}"))
        scans.where(F.col("scan_id") % 3 == i).write.parquet(paths[-1])
        files = spark.read.parquet(*paths).inputFiles()
        ps.load_new_files(spark, files, store, tz=TZ)
        ps.load_new_files(spark, files, store, tz=TZ)
    return ps.stored_counts(spark, store)


query("loaded_counts_by_day", f"{o.with_counts(ORDERS, 'Day')} SELECT * FROM counts")(
    lambda spark, sf: ps.counts_by_day(_loaded(spark, sf))
)
query(
    "loaded_kpi_counts",
    f"{o.with_work(ORDERS)}, k AS (SELECT {KPI_SQL} FROM work) SELECT total_events, coalesce(real_prizes_total, 0) AS real_prizes_total,"
    " coalesce(real_prizes_received, 0) AS real_prizes_received, coalesce(real_prizes_pending, 0) AS real_prizes_pending FROM k",
)(lambda spark, sf: ps.kpi_counts(_loaded(spark, sf)))
query("loaded_prize_counts", f"{ODDS_SQL} SELECT CAST(prize_id AS VARCHAR) AS prize_id, real_prize_count, received_count FROM odds")(
    lambda spark, sf: ps.prize_counts(_loaded(spark, sf))
)


def _by_user(spark, sf):
    """Orders by user in eight buckets; users with over twelve orders and orders without a user lie apart."""
    scans = ps.normalize(ORDERS.scans(spark, sf))
    path = ps.shared_dir(spark, "by-user")
    return ps.write_scans_by_user(scans, path.rsplit("/", 1)[-1].replace("-", "_"), U, 8, path, hot_rows=12)


def by_user(name: str, sql: str, fn, *doubles: str) -> None:
    query(name, sql, *doubles)(lambda spark, sf: fn(_by_user(spark, sf)))


by_user(
    "with_user_segment_by_user",
    f"{o.with_norm(ORDERS)} SELECT scan_id, customer_id, user_segment FROM seg",
    lambda s: s.each(lambda part: ps.with_user_segment(part, U)).select("scan_id", U, "user_segment"),
)
by_user(
    "cohort_counts_by_user",
    f"{o.with_cohorts(ORDERS)} SELECT * FROM cohorts",
    lambda s: s.each(lambda part: ps.cohort_counts(part, U, TZ)).groupBy("cohort_week", "weeks_since_first").agg(F.sum("users").alias("users")),
)
by_user(
    "user_activity_by_user",
    f"{o.with_gaps(ORDERS)} {ACTIVITY}",
    lambda s: s.each(lambda part: ps.user_activity(part, U)),
    "avg_hours_between_scans",
    "median_hours_between_scans",
    "avg_days_between_scans",
)
by_user("rfm_by_user", f"{rfm_sql(ORDERS)} SELECT * FROM rfm", lambda s: s.each(lambda part: ps.rfm(part, U, s.last_scan())))
by_user(
    "user_history_by_user",
    """SELECT scan_id, customer_id, win_date FROM ({sql}) WHERE customer_id = 7""".format(sql=ORDERS.sql),
    lambda s: s.of_user(U, 7).select("scan_id", U, "win_date"),
)

# The median of hours to claim, from sketches per weekday and prize: its rank is that of the middle, but for the stated error.


def _claim_sketches(f: ps.Frames) -> DataFrame:
    claims = ps.time_to_claim(f.filtered).withColumn("weekday", F.weekday("win_date"))
    parts = ps.quantile_sketches(claims, F.col("hours_to_claim"), ("weekday", "prize_id"))
    median = ps.sketch_quantiles(ps.merged_sketches(parts, ("weekday",)), (0.5,)).select(F.col("weekday").alias("d"), "n", F.col("q")[0].alias("median"))
    met = claims.join(F.broadcast(median), F.col("weekday") == F.col("d"))
    rank = F.count_if(F.col("hours_to_claim") <= F.col("median")) / F.max("n")
    below = F.count_if(F.col("hours_to_claim") < F.col("median")) / F.max("n")
    close = (rank >= 0.5 - 0.03) & (below <= 0.5 + 0.03)
    return met.groupBy("weekday").agg(F.max("n").alias("claims"), close.alias("median_is_close"))


query(
    "claim_median_from_sketches",
    f"""{o.with_claims(ORDERS)} SELECT CAST(isodow(win_date) - 1 AS INTEGER) AS weekday, count(*) AS claims, true AS median_is_close
    FROM claims GROUP BY 1""",
)(scoped(ORDERS, _claim_sketches))
