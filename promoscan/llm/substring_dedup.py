"""Remove word windows that start in an earlier document, by prefix-partitioned suffix trees.

Suffixes (of words) are dealt out by a prefix whose length varies: the anchor gram of four words, or
all thirteen where the gram is too frequent for one group (:mod:`repeats`). For each group of bounded
size a subtree is grown from the top: a node splits by the next word of its suffixes, and only nodes
with two or more leaves grow on. The internal nodes left at the window's depth are the repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscan.llm.common import row_keys, split_words
from promoscan.llm.repeats import Windows, union_of, with_repeats

WIDTH, GRAM = 13, 4


def deep_nodes(words: np.ndarray, start: np.ndarray, depth: int, count: np.ndarray) -> np.ndarray:
    """Grow the suffix tree of the suffixes at ``start``: their internal node at ``depth``, else -1.

    Each suffix stands for ``count`` equal ones, so that one alone with two or more is internal.
    """
    node = np.zeros(len(start), np.int64)
    if not len(start):
        return node
    _, symbol = np.unique(words, return_inverse=True)
    n_symbols = int(symbol.max()) + 1
    leaves = np.arange(len(start))
    for level in range(depth):
        edge = node[leaves] * n_symbols + symbol[start[leaves] + level]
        _, child = np.unique(edge, return_inverse=True)
        inner = np.bincount(child, weights=count[leaves])[child] > 1
        node[leaves[~inner]] = -1
        leaves = leaves[inner]
        node[leaves] = child[inner]
    return node


def _cut(batches):
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, runs = split_words(text), union_of(spans)
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in runs))
            ends = [0, *(x for r in runs for x in r), len(words)]
            kept.append(b" ".join(w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]).decode())
        counts = [pa.array(x, pa.int64()) for x in (n_words, n_removed)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *counts, pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Drop each word covered by a ``width``-word window that also starts in a row of smaller id.

    Words are runs of anything but ASCII white space, unchanged; windows are judged on the input; a
    repeat inside one document alone counts for nothing. Returns one row per input row: ``row``
    (struct of all input columns but the text), ``n_words``, ``n_removed``, ``kept`` (kept words joined by single
    spaces). A null text has no words. Rows of equal or null id count as separate documents, in the
    order of :func:`common.row_keys`. An empty table gives an empty one. ``width`` is at least 5.
    """
    keyed = row_keys(docs, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    frame = keyed.select(F.col("_row_key").alias("k"), F.col(text_col).alias("text"), row.alias("row"))
    windows = Windows(width, GRAM, words=True, same_doc=False, whole_copies=False)
    fields = T.StructType(
        [frame.schema["row"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")), T.StructField("kept", T.StringType())]
    )
    return with_repeats(frame, windows, deep_nodes).select("row", "text", "spans").mapInArrow(_cut, fields)
