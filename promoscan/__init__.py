"""Promotion scan analytics as DataFrame operators for Spark."""

from .config import ScanParams
from .functions.sketches import merged_sketches, quantile_sketches, sketch_quantiles
from .operators.claims import (
    claim_histogram,
    claim_stats,
    forgotten_prizes,
    forgotten_prizes_count,
    time_to_claim,
)
from .operators.cohorts import (
    cohort_counts,
    cohort_matrix,
    cohort_retention,
    cohort_retention_matrix,
    first_scan,
)
from .operators.filters import (
    apply_filters,
    date_extent,
    distinct_values,
    drop_unscanned,
    filter_prize,
    filter_range,
    filter_received,
    filter_region,
    filter_segment,
    filter_start,
    filter_win_type,
    metrics_scope,
    user_picklist,
    with_user_segment,
    work_slice,
)
from .operators.kpis import (
    consistency_check,
    kpi_rates,
    kpi_summary,
    pending_events,
    pending_events_count,
    pending_users,
    top_pending_users,
    user_kpis,
)
from .operators.lapsed import lapsed_prize_customers
from .operators.normalize import (
    candidate_user_columns,
    normalize,
    normalize_prize_id,
    date_parse_report,
    parse_dates,
    points_received,
    raw_typed,
    real_prize_flags,
    received,
    region_name,
    to_local,
    to_naive_utc,
    user_column,
    win_flags,
    win_type,
)
from .operators.prizes import prize_efficiency, prize_probabilities, prize_probabilities_pct
from .operators.rates import (
    describe_scans,
    full_week_rate,
    full_weeks,
    rate_stats,
    scan_rates,
    scans_per_user,
    span_stats,
    user_spans,
)
from .operators.rfm import rfm, rfm_segment_counts
from .operators.timeofday import dow_hour_counts, hourly_counts
from .operators.timeseries import (
    aggregate_time,
    count_by_time,
    fill_time_gaps,
    real_prize_series,
    series_export,
    series_preview,
    time_bucket,
    trim_leading_zeros,
    trim_trailing_zero,
    user_sketches,
    users_by_time,
    users_from_sketches,
)
from .operators.users import cast_user_id, scan_gaps, user_activity, user_history
from .plans.dashboard import Frames, dashboard_frames
from .session import build_session, shared_dir, use_utc
from .sources.increments import counts_by_day, file_counts, kpi_counts, load_new_files, prize_counts, stored_counts
from .sources.layout import UserScans, read_scans_by_day, read_scans_by_user, with_day, write_scans_by_day, write_scans_by_user
from .sources.profile import TextProfile, date_votes, day_first, id_profile, text_profile, typed_ids
from .sources.readers import (
    CheckedRows,
    MissingColumnError,
    cache_scans,
    checked_csv_lines,
    csv_lines,
    jdbc_options,
    null_tokens,
    optional_columns,
    read_scans_csv,
    read_scans_csv_checked,
    read_scans_jdbc,
    read_scans_parquet,
    refresh,
    require_columns,
    scans_from_csv_lines,
)
from .sources.writers import write_csv

