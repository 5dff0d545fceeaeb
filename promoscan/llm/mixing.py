"""Mix sources to target weights by cube-method balanced sampling.

A source's rate (target / size, at most 3) gives each of its documents a whole number of copies and
one more with the fractional probability. The flight phase moves these probabilities along
directions that change neither the number of documents nor the number of words, until each is 0 or
1 but for two per block. Blocks are flown apart in parallel; what they leave is dealt into blocks
again, so that at last one block per source remains, whose two undecided documents are landed by
the choice that misses the word total least.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promoscan.llm.common import field, packed, row_keys, stored, words_of

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK = 4096
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes;
    no target exceeds ``cap`` times its source's size, and the excess goes to the others by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    limit = F.col("source_size") * float(cap)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", weight).withColumn("limit", limit)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the share of a unit of weight if all sources that reach their limit sooner are held to it
    shared = ranked.withColumn("share", left / heavy).withColumn("place", F.row_number().over(by_limit))
    fits = F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.col("place"))
    final = F.min_by("share", fits).over(everything)
    return shared.select("source", "n", "source_size", F.least("limit", F.coalesce(final, F.lit(0.0)) * F.col("weight")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move ``p`` until two at most are neither 0 nor 1, keeping sum(p) and sum(p * size)."""
    out, random = p.astype(float).tolist(), np.random.default_rng(seed & (1 << 63) - 1).random(len(p)).tolist()
    sizes = size.astype(float).tolist()
    open_units: list[int] = []
    for unit in range(len(out)):
        if EPS < out[unit] < 1 - EPS:
            open_units.append(unit)
        while len(open_units) == 3:
            i, j, k = open_units
            u = (sizes[k] - sizes[j], sizes[i] - sizes[k], sizes[j] - sizes[i])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for x, step in zip(open_units, u, strict=True):
                if step > 0:
                    up, down = min(up, (1 - out[x]) / step), min(down, out[x] / step)
                elif step < 0:
                    up, down = min(up, out[x] / -step), min(down, (1 - out[x]) / -step)
            move = up if random[unit] * (up + down) < down else -down
            random[unit] = random[unit] * 997.13 % 1.0
            for x, step in zip(open_units, u, strict=True):
                value = out[x] + move * step
                out[x] = 0.0 if value <= EPS else 1.0 if value >= 1 - EPS else value
            open_units = [x for x in open_units if 0 < out[x] < 1]
    return np.array(out)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide what :func:`flight` left: the choice nearest to the word total, then to the count."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    best = min(
        itertools.product((0, 1), repeat=len(rest)),
        key=lambda x: (abs(float(((x - p[rest]) * size[rest]).sum())), abs(float((x - p[rest]).sum())), x),
    )
    out = p.copy()
    out[rest] = best
    return out


def _fly(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["spread", "k"])
        size = block["size"].to_numpy()
        p = flight(block["p"].to_numpy(), size, int(block["spread"].iloc[0]))
        block["p"] = land(p, size) if last else p
        return block

    return run


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP
) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Returns (k, id, source, size, source_size, target, copies, taken) per row: size is the number of
    words (null text: 0), taken is size * copies. A source's taken words differ from its target by
    less than one document's size or so; copies never exceed ``cap``. Sources of null are a
    source like any other. Seeds are hashes of row keys, so that reruns agree; rows of equal or null id are
    ordered by :func:`common.row_keys`, whose number is ``k``. An empty table gives an empty one.
    """
    keyed = row_keys(docs, id_col, text_col)
    rows = keyed.select(
        F.col("_row_key").alias("k"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size")
    )
    rows = stored(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, cap), "targets").withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + EPS)
    dealt = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("base", base).withColumn("p", F.greatest(rate - base, F.lit(0.0))).withColumn("spread", F.xxhash64("k"))
    dealt = stored(dealt, "rates")

    open_rows = dealt.filter(F.col("p") > EPS).select("source", "k", "size", "p", "spread", (F.floor((F.col("n") - 1) / BLOCK) + 1).alias("blocks"))
    fields = "source string, k long, size long, p double, spread long, blocks long"
    decided: list[DataFrame] = []
    while True:
        most = open_rows.agg(F.max("blocks")).first()[0]
        last = most is None or most <= 1
        block = F.pmod(F.xxhash64("spread"), F.col("blocks"))
        flown = stored(open_rows.groupBy("source", block.alias("block")).applyInPandas(_fly(last), fields), "flight")
        decided.append(flown.filter("p <= 0 or p >= 1").select("k", F.col("p").cast("long").alias("extra")))
        if last:
            break
        rest = flown.filter("p > 0 and p < 1")
        counts = rest.groupBy("source").agg(F.count("*").alias("m")).withColumnRenamed("source", "s")
        open_rows = rest.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "k", "size", "p", "spread", (F.floor((F.col("m") - 1) / BLOCK) + 1).alias("blocks")
        )
    extra = decided[0]
    for part in decided[1:]:
        extra = extra.unionByName(part)
    copies = F.col("base") + F.coalesce("extra", F.lit(0).cast("long"))
    out = dealt.join(extra, "k", "left").withColumn("copies", copies)
    return out.select("k", "id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    keyed = row_keys(packed(docs), field(id_col), field(text_col))
    narrow = keyed.select(F.col("_row_key").alias("doc_id"), F.col(field(text_col)).alias("text"), F.col(field(source_col)).alias("source"))
    copies = mix_sources(narrow).filter("copies > 0").select(F.col("k").alias("_row_key"), "copies")
    taken = keyed.join(copies, "_row_key")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
