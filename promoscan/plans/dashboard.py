"""The frames a dashboard works on, from raw rows to metrics scope.

Everything is lazy: each operator on top becomes one Spark plan that reads only the columns
and rows it needs. The user segment costs a shuffle of the whole table, so it is added only
when it is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..config import ScanParams
from ..operators.filters import apply_filters, metrics_scope, with_user_segment, work_slice
from ..operators.normalize import normalize, user_column
from ..sources.readers import require_columns


@dataclass(frozen=True)
class Frames:
    """``scans``: normalised; ``filtered``: after the filters; ``work``: the date slice on top;
    ``metrics``: the slice, or the filtered rows from the start date on."""

    user_col: str | None
    scans: DataFrame
    filtered: DataFrame
    work: DataFrame
    metrics: DataFrame


def dashboard_frames(raw: DataFrame, params: ScanParams, with_segments: bool = False) -> Frames:
    """Build all four frames; without a user column there are no segments.

    ``with_segments`` adds the user segment even if it filters nothing. Columns that the scans lack
    are not added; an operator that needs one adds it for itself.
    """
    scans = normalize(require_columns(raw), formats=params.date_formats, epoch_unit=params.epoch_unit)
    u = params.user_col or user_column(scans)
    if u is None:
        params = replace(params, segments=())
    elif with_segments or params.segments:
        scans = with_user_segment(scans, u)
    filtered = apply_filters(scans, params)
    return Frames(
        user_col=u,
        scans=scans,
        filtered=filtered,
        work=work_slice(filtered, params),
        metrics=metrics_scope(filtered, params),
    )
