"""Remove long byte strings that occurred earlier, by bucket-pointer refinement of suffixes.

Candidates come from :mod:`repeats`; contexts that share an anchor are compared by a suffix
array of their concatenation: suffixes start in exact 8-byte buckets, and a bucket is refined by
sorting on the bucket pointers at a later offset. Pointers are updated in place, so each pass reuses
the refinement of the last one and the sorted depth doubles: 8, 16, 32, 64, width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscan.llm.common import lean, row_keys
from promoscan.llm.repeats import Windows, union_of, with_repeats

WIDTH, GRAM, START_DEPTH = 100, 24, 8


def refine_pointers(pointer: np.ndarray, active: np.ndarray, offset: int) -> np.ndarray:
    """Sort the suffixes ``active`` (all in buckets of two or more) by the pointers ``offset`` later.

    Updates ``pointer`` and returns the suffixes that still share a bucket.
    """
    later = np.minimum(active + offset, len(pointer) - 1)
    # pointers are places in one bounded batch, so that both fit one sort key
    order = np.argsort((pointer[active] << 32) + pointer[later] + 1)
    suffix = active[order]
    old, key = pointer[suffix], pointer[later[order]]
    at = np.arange(len(suffix))
    new_old = np.concatenate(([True], old[1:] != old[:-1]))
    new = new_old | np.concatenate(([True], key[1:] != key[:-1]))
    bucket = np.maximum.accumulate(np.where(new_old, at, 0))
    place = np.maximum.accumulate(np.where(new, at, 0))
    pointer[suffix] = old + (place - bucket)
    alone = new & np.concatenate((new[1:], [True]))
    return suffix[~alone]


def bucket_pointers(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every suffix by its first ``depth`` bytes, and the suffixes that share one."""
    padded = np.concatenate((data, np.zeros(START_DEPTH, np.uint8))).astype(np.uint64)
    gram = padded
    for step in (1, 2, 4):
        gram = gram[:-step] | (gram[step:] << np.uint64(8 * step))
    gram = gram[: len(data)]
    order = np.argsort(gram)
    sorted_gram = gram[order]
    new = np.concatenate(([True], sorted_gram[1:] != sorted_gram[:-1]))
    pointer = np.empty(len(data) + 1, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    pointer[-1] = -1
    active = order[~(new & np.concatenate((new[1:], [True])))]
    sorted_to = START_DEPTH
    while sorted_to < depth and len(active):
        offset = min(sorted_to, depth - sorted_to)
        active = refine_pointers(pointer, active, offset)
        sorted_to += offset
    return pointer, active


def equal_windows(data: np.ndarray, start: np.ndarray, width: int, count: np.ndarray) -> np.ndarray:
    """Bucket of the window at each start, -1 if no other suffix shares its first ``width`` bytes.

    Each suffix stands for ``count`` equal ones, so that one alone with two or more has a bucket.
    """
    pointer, active = bucket_pointers(data, width)
    shared = np.zeros(len(pointer), bool)
    shared[active] = True
    return np.where(shared[start] | (count > 1), pointer[start], -1)


def _cut(as_text: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for raw, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                text, runs = raw or b"", union_of(spans)
                n_bytes.append(len(text))
                n_removed.append(sum(b - a for a, b in runs))
                n_spans.append(len(runs))
                ends = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            last = pa.array([None if t is None else x.decode("utf-8", "ignore") for t, x in zip(texts, kept, strict=True)], pa.string()) if as_text else pa.array(kept, pa.binary())
            counts = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *counts, last], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return lean(run)


def suffix_array_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, as_text: bool = False
) -> DataFrame:
    """Drop each byte covered by a ``width``-byte string that also starts earlier.

    Earlier means in a row of smaller id, or further left in the same row. Strings are judged on
    the input, texts are UTF-8 bytes, a null text is empty. Returns one row per input row: ``row``
    (struct of all input columns but the text), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept`` (binary, as a cut can leave part of a character; with ``as_text`` a
    string without such parts, null for a null text). Rows of equal or null id count as
    separate documents, in the order of :func:`common.row_keys`. An empty table gives an empty one.
    ``width`` is at least 32.
    """
    keyed = row_keys(docs, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    frame = keyed.select(F.col("_row_key").alias("k"), F.col(text_col).alias("text"), row.alias("row"))
    windows = Windows(width, GRAM, words=False, same_doc=True)
    fields = T.StructType(
        [frame.schema["row"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    )
    return with_repeats(frame, windows, equal_windows).select("row", "text", "spans").mapInArrow(_cut(as_text), fields)
