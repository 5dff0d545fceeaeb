"""Quality by co-training: one classifier reads the text, one the page metadata.

Both are fitted to the labelled rows; in each round each gives the rows it is sure of to the other as
pseudo-labels, and both are fitted again. Each view is calibrated on labelled rows that no fit
sees, and the calibrated log-odds are added, the prior counted once, to score every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscan.llm.common import discard, field, packed, row_keys, slices, stored

#: Most labelled ids that fits use (a hash sample beyond that); all others take part in the exchange.
FIT_ROWS = 200_000
#: With fewer labelled ids of either label there is no model.
LEAST_IDS = 10
ROUNDS, SURE, HASHED, META = 2, 0.97, 48, 48
KEEP = 0.5
N_SHAPE = 16


def text_view(text: str | None) -> np.ndarray:
    """Shape of a text and the frequencies of its hashed words."""
    from promoscan.llm.repeats import word_hashes

    out = np.zeros(N_SHAPE + HASHED)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    n, counts = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    hashes = word_hashes(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    shown = counts[33:127].sum() - upper - lower - counts[48:58].sum()
    pairs = hashes[:-1] * np.uint64(31) + hashes[1:]
    distinct = len(np.unique(hashes))
    out[:N_SHAPE] = (
        math.log1p(n), math.log1p(size / n), distinct / n, len(np.unique(pairs)) / max(len(pairs), 1),
        upper / size, lower / size, counts[48:58].sum() / size, shown / size,
        counts[[33, 63]].sum() / n, counts[[35, 36, 37, 38, 42]].sum() / n, counts[[60, 62, 124]].sum() / n,
        counts[46] / n, counts[44] / n, counts[128:].sum() / size, len(lines) / n, len(set(lines)) / max(len(lines), 1),
    )
    out[N_SHAPE:] = np.sqrt(np.bincount((hashes % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / n)
    return out


def _views(batches):
    kind = pa.list_(pa.float32())
    for batch in batches:
        for part in slices(batch, "text"):
            views = [text_view(t).astype(np.float32) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(views, kind)], names=[*part.schema.names[:-1], "text_view"])


def _meta_view(docs: DataFrame, columns: list[str]) -> Column:
    """Categories hashed to ``META`` places, numbers as logarithms, and what is missing."""
    hot, parts = [], []
    for c in columns:
        value = F.col(f"`{c}`")
        if isinstance(docs.schema[c].dataType, T.NumericType):
            parts += [F.log1p(F.greatest(F.coalesce(value, F.lit(0)).cast("double"), F.lit(0.0))), value.isNull().cast("double")]
        else:
            hot.append(F.pmod(F.xxhash64(F.lit(c), value.cast("string")), F.lit(META)))
    places = F.array(*hot) if hot else F.array().cast("array<long>")
    one_hot = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(META - 1).cast("long")), lambda i: F.array_contains(places, i).cast("double"))
    return F.concat(one_hot, F.array(*parts)) if parts else one_hot


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


@dataclass
class View:
    """A fitted classifier and its calibration, log-odds = slope * margin + offset."""

    name: str
    model: object
    slope: float = 1.0
    offset: float = 0.0

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p_<name>``, the calibrated probability of good quality."""
        out = self.model.transform(df.withColumn("features", array_to_vector(F.col(f"{self.name}_view").cast("array<double>"))))
        margin = vector_to_array("rawPrediction")[1]
        p = 1 / (1 + F.exp(-F.greatest(F.least(margin * self.slope + self.offset, F.lit(30.0)), F.lit(-30.0))))
        return out.withColumn(f"p_{self.name}", p).drop("features", "rawPrediction", "probability", "prediction")


def _fit(name: str, rows: DataFrame, target: str) -> View:
    data = rows.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("label"), array_to_vector(F.col(f"{name}_view").cast("array<double>")).alias("features"))
    return View(name, LogisticRegression(maxIter=40, regParam=1e-3, aggregationDepth=2).fit(data))


def _calibrate(view: View, held: DataFrame) -> View:
    out = view.model.transform(held.withColumn("features", array_to_vector(F.col(f"{view.name}_view").cast("array<double>"))))
    data = out.select(F.col("label").cast("double"), vector_to_array("rawPrediction")[1].alias("m"))
    lr = LogisticRegression(maxIter=40, regParam=1e-3).fit(data.select("label", array_to_vector(F.array("m")).alias("features")))
    return View(view.name, view.model, float(lr.coefficients[0]), float(lr.intercept))


@dataclass
class QualityModel:
    """Both views; without usable labels none, and every document is kept with the score 1."""

    text: View | None
    meta: View | None
    prior: float
    meta_columns: list[str]

    def score(self, views: DataFrame) -> DataFrame:
        """Add ``text_score``, ``meta_score``, ``score`` and ``kept`` to (..., text_view, meta_view)."""
        if self.text is None:
            one = F.lit(1.0)
            return views.select("*", one.alias("text_score"), one.alias("meta_score"), one.alias("score"), F.lit(True).alias("kept"))
        out = self.meta.score(self.text.score(views))
        odds = _log_odds(F.col("p_text")) + _log_odds(F.col("p_meta")) - math.log(self.prior / (1 - self.prior))
        score = 1 / (1 + F.exp(-odds))
        return out.select(*views.columns, F.col("p_text").alias("text_score"), F.col("p_meta").alias("meta_score"), score.alias("score"), (score >= KEEP).alias("kept"))


def with_views(docs: DataFrame, text_col: str, meta_columns: list[str]) -> DataFrame:
    """(row, meta_view, text_view): ``row`` is a struct of all columns; no shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    frame = docs.select(row.alias("row"), _meta_view(docs, meta_columns).cast("array<float>").alias("meta_view"), F.col(f"`{text_col}`").alias("text"))
    fields = [frame.schema["row"], frame.schema["meta_view"], T.StructField("text_view", T.ArrayType(T.FloatType()))]
    return frame.mapInArrow(_views, T.StructType(fields))


def cotrain(views: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", meta_columns: list[str] | None = None) -> QualityModel:
    """Fit both views to (id, meta_view, text_view) and the labels (0 or 1; several are averaged)."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    joined = views.join(marks, "id", "left")
    spread = F.xxhash64("id")
    known = {r["label"]: r for r in joined.filter("label is not null").groupBy("label").agg(F.count_distinct("id").alias("ids"), F.min(spread).alias("lo"), F.max(spread).alias("hi")).collect()}
    if len(known) < 2 or min(r["ids"] for r in known.values()) < LEAST_IDS:
        return QualityModel(None, None, 0.5, meta_columns or [])
    labelled = sum(r["ids"] for r in known.values())
    # of each label the lowest hash is always held and the highest always fitted, so that neither part lacks one
    lowest, highest = (spread.isin(*[r[x] for r in known.values()]) for x in ("lo", "hi"))
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    taken = F.col("label").isNull() | (share < FIT_ROWS / labelled) | lowest | highest
    held = F.col("label").isNotNull() & (lowest | ((F.pmod(spread, F.lit(4)) == 0) & ~highest))
    pool = joined.filter(taken).withColumn("held", held)
    seen = F.when(~F.col("held"), F.col("label"))
    pool = stored(pool.withColumn("for_text", seen).withColumn("for_meta", seen), "pool")
    held = pool.filter("held")

    def fitted() -> tuple[View, View]:
        return tuple(_calibrate(_fit(n, pool, f"for_{n}"), held) for n in ("text", "meta"))

    text, meta = fitted()
    for _ in range(ROUNDS):
        scored = meta.score(text.score(pool))

        def sure(p: str) -> Column:
            return F.when(F.col(p) >= SURE, 1).when(F.col(p) <= 1 - SURE, 0)

        free = F.col("label").isNull()
        scored = scored.withColumn("for_meta", F.when(free, F.coalesce("for_meta", sure("p_text"))).otherwise(F.col("for_meta")))
        scored = scored.withColumn("for_text", F.when(free, F.coalesce("for_text", sure("p_meta"))).otherwise(F.col("for_text")))
        # not stored again: the models are fixed, so that every pass over the views gives the same
        pool = scored.select(*pool.columns)
        text, meta = fitted()
    return QualityModel(text, meta, known[1]["ids"] / labelled, meta_columns or [])


def _model_and_views(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_columns: list[str], label_col: str, key: list[str]):
    """The model, and the stored views (id, *key, meta_view, text_view) of all rows; texts are read once."""
    narrow = docs.select(id_col, text_col, *meta_columns, *key)
    ids = [F.col(f"row.`{c}`") for c in key]
    views = with_views(narrow, text_col, meta_columns).select(F.col(f"row.`{id_col}`").cast("long").alias("id"), *ids, "meta_view", "text_view")
    views = stored(views, "views")
    return cotrain(views, labels, id_col, label_col, meta_columns), views


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_columns: list[str] | None = None, label_col: str = "quality"
) -> DataFrame:
    """(id, ``text_score``, ``meta_score``, ``score``, ``kept``) of every row of ``docs``.

    Scores are probabilities of good quality; ``kept`` is a score of ``KEEP`` or more. ``meta_columns`` are
    all other columns by default. Missing metadata is a value of its own, a null text is an empty
    one. Rows keep null and repeated ids. With fewer than ten labelled ids of either label, however often they are
    repeated, all rows score 1 and are kept. An empty table gives an empty one.
    """
    meta_columns = [c for c in docs.columns if c not in (id_col, text_col)] if meta_columns is None else meta_columns
    model, views = _model_and_views(docs, labels, id_col, text_col, meta_columns, label_col, [])
    return model.score(views).select(F.col("id").alias(id_col), "text_score", "meta_score", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_columns: list[str] | None = None, label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps.

    The stored views are scored and the rows taken by :func:`common.row_keys`, so that each text goes
    through Python once.
    """
    meta_columns = [c for c in docs.columns if c not in (id_col, text_col)] if meta_columns is None else meta_columns
    keyed = row_keys(packed(docs), field(id_col), field(text_col))
    key = "_" * max(map(len, docs.columns)) + "key"  # longer than any name, so a free one
    frame = keyed.select("row.*", F.col("_row_key").alias(key))
    model, views = _model_and_views(frame, labels, id_col, text_col, meta_columns, label_col, [key])
    kept = stored(model.score(views).filter("kept").select(F.col(key).alias("_row_key")), "kept")
    discard(views)
    return keyed.join(kept, "_row_key", "left_semi").select("row.*")
