"""What text columns hold: whole numbers as ids, and the form of dates. One aggregate tells both."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DATE_COLS, DATE_FORMATS, EPOCH_DIGITS
from ..functions.columns import format_shape, is_iso, read_format, strip, whole_number

CANDIDATES = (*DATE_FORMATS, *EPOCH_DIGITS)
ISO = "ISO-8601"
_VOTES = "array<struct<column: string, format: string, readable: bigint, chosen: boolean>>"
_IDS = "array<struct<column: string, values: bigint, whole: bigint, point_zero: bigint, typed: boolean>>"


def _text_columns(df: DataFrame, cols: Iterable[str]) -> list[str]:
    return [c for c in cols if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]


def id_columns(df: DataFrame) -> list[str]:
    """Text columns that are named like ids."""
    return _text_columns(df, [c for c in df.columns if c.lower().endswith("_id")])


def day_first(formats: Sequence[str] = CANDIDATES) -> tuple[str, ...]:
    """The same forms, of rivals the ones with the day first in front."""
    return tuple(sorted(formats, key=lambda f: f.startswith("M")))


def _filled(c: str) -> Column:
    return F.coalesce(strip(F.col(c)) != "", F.lit(False))


def _votes(cols: list[str], formats: Sequence[str]) -> Column:
    """An aggregate: per column and form how many values it reads, and whether it is chosen.

    The parser runs on values of the right shape alone. ISO text is no candidate's.
    """
    shapes = {f: format_shape(f) for f in formats}
    rows = []
    for c in cols:
        text = strip(F.col(c))
        other = ~is_iso(text)
        reads = {f: F.count_if(other & text.rlike(shapes[f]) & read_format(F.when(text.rlike(shapes[f]), text), f).isNotNull()) for f in formats}
        rows.append((c, ISO, F.count_if(is_iso(text)), F.lit(True)))
        for i, f in enumerate(formats):
            best = reads[f] > 0
            for j, rival in enumerate(formats):
                if j != i and shapes[rival] == shapes[f]:
                    best &= (reads[f] > reads[rival]) if j < i else (reads[f] >= reads[rival])
            rows.append((c, f, reads[f], best))
    structs = [F.struct(F.lit(c).alias("column"), F.lit(f).alias("format"), n.alias("readable"), best.alias("chosen")) for c, f, n, best in rows]
    return (F.array(*structs) if structs else F.array()).cast(_VOTES)


def _ids(cols: list[str]) -> Column:
    rows = []
    for c in cols:
        given = _filled(c)
        values, whole = F.count_if(given), F.count(whole_number(F.col(c)))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                values.alias("values"),
                whole.alias("whole"),
                F.count_if(whole_number(F.col(c)).isNotNull() & F.col(c).contains(".")).alias("point_zero"),
                (values == whole).alias("typed"),
            )
        )
    return (F.array(*rows) if rows else F.array()).cast(_IDS)


def date_votes(df: DataFrame, cols: Iterable[str] = DATE_COLS, formats: Sequence[str] = CANDIDATES) -> DataFrame:
    """(column, format, readable, chosen): which forms the text of date columns has.

    A row per column and form that reads a value, ISO-8601 always being read. Of rival forms, those that read the same
    texts, the one that reads most values is chosen (values over 12 tell day and month apart), the earlier
    in ``formats`` if they read equally many.
    """
    found = df.agg(_votes(_text_columns(df, cols), formats).alias("_v"))
    return found.select(F.inline("_v")).where("readable > 0")


def id_profile(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """(column, values, whole, point_zero, typed) per text column of ids.

    ``values`` aren't blank, ``whole`` of them are whole numbers of 64 bits, ``point_zero`` of these
    written with a point; ``typed`` if that is all of them.
    """
    return df.agg(_ids(id_columns(df) if cols is None else _text_columns(df, cols)).alias("_i")).select(F.inline("_i"))


@dataclass(frozen=True)
class TextProfile:
    """Id columns that hold whole numbers only, and the chosen date forms per column."""

    ids: tuple[str, ...]
    formats: dict[str, tuple[str, ...]]


def text_profile(df: DataFrame, id_cols: Iterable[str] | None = None, date_cols: Iterable[str] = DATE_COLS, formats: Sequence[str] = CANDIDATES) -> TextProfile:
    """Read the table once, one row comes back."""
    ids = id_columns(df) if id_cols is None else _text_columns(df, id_cols)
    dates = _text_columns(df, date_cols)
    if not ids and not dates:
        return TextProfile((), {})
    row = df.agg(_ids(ids).alias("ids"), _votes(dates, formats).alias("votes")).first()
    chosen = {c: tuple(v["format"] for v in row["votes"] if v["column"] == c and v["chosen"] and v["format"] != ISO) for c in dates}
    return TextProfile(tuple(i["column"] for i in row["ids"] if i["typed"]), chosen)


def typed_ids(df: DataFrame, cols: Iterable[str] | None = None, profile: TextProfile | None = None) -> DataFrame:
    """Id columns of whole numbers only as bigint, so that ``2`` and ``2.0`` are one id and sort as numbers.

    Others stay text. Without a ``profile`` the table is read once to see which they are.
    """
    known = text_profile(df, cols, ()) if profile is None else profile
    return df.withColumns({c: whole_number(F.col(c)) for c in known.ids}) if known.ids else df
