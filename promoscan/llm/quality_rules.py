"""A learned decision list over text statistics, in Spark expressions throughout.

Sequential covering: a rule is grown on two thirds of the labelled rows by adding the threshold
condition of the largest gain, pruned back on the last third, and what it covers is taken out before the
next rule. Labelled rows are binned and counted once; each step is one small aggregate over these
counts, of which the driver gets a row per statistic and bin. The list becomes one ordered CASE
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import stored, words_of

WINDOW, SYMBOLS, MIN_WORDS, MAX_REPEATED = 8, "[#*$%&|<>]", 20, 30
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 32, 12, 4, 0.8, 3


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks) per row.

    A null text has no words. Columns are named twice per level on purpose: an array that two
    expressions use is computed once, in a projection of its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_of(F.col(text_col)).alias("words"), lines.alias("lines"))
    rows = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(1), F.size("hashes") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    counted = [c for c in rows.columns if c != "hashes"]
    rows = rows.select(*counted, F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))).alias("windows"))
    in_order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.select(*counted, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), in_order).alias("ranked"))
    equal = F.zip_with(
        "ranked", F.slice("ranked", F.lit(2), F.size("ranked")), lambda a, b: F.when(a.h == b.h, F.array(a.p, b.p)).otherwise(F.array().cast("array<int>"))
    )
    rows = rows.select(*counted, F.when(F.col("ranked").isNotNull() & (F.size("ranked") > 1), F.array_sort(F.array_distinct(F.flatten(equal)))).alias("at"))
    covered = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.when(F.size("at") > 0, F.aggregate(covered, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return rows.select(*counted, F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_words": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / words,
        "capitals": F.col("n_capitals") / chars,
        "marks": F.col("n_marks") / words,
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` <= ``threshold``, or > with ``above``; ``bin`` is its place among the cuts."""

    feature: int
    name: str
    bin: int
    threshold: float
    above: bool

    def on_bins(self) -> Column:
        value = F.col("bins")[self.feature]
        return value > self.bin if self.above else value <= self.bin

    def on_rows(self) -> Column:
        value = _features()[self.name]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _covered(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _all([c.on_bins() for c in rule])
    return out


def _grow(stats: DataFrame, rules: list[Rule], cuts: list[list[float]]) -> Rule:
    names, rule, here = list(_features()), (), None
    while len(rule) < MAX_CONDITIONS:
        left = stats.filter(F.col("grow") & ~_covered(rules) & _all([c.on_bins() for c in rule]))
        binned = left.select(F.posexplode("bins").alias("feature", "bin"), "bad", "n")
        counts = binned.groupBy("feature", "bin").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n"))
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for f, b, p, n in counts.collect():
            table.setdefault(f, {})[b] = (p, n)
        if not table:
            break
        p0, n0 = (sum(x[i] for x in table[0].values()) for i in (0, 1))
        if p0 == 0 or p0 == n0:
            break
        here, best = p0 / n0, None
        for f, bins in sorted(table.items()):
            p = n = 0
            for b in range(len(cuts[f])):
                p, n = p + bins.get(b, (0, 0))[0], n + bins.get(b, (0, 0))[1]
                for above, (q, m) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if q >= MIN_COVER:
                        gain = q * (math.log2(q / m) - math.log2(here))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Condition(f, names[f], b, cuts[f][b], above))
        if best is None or best[0] <= 1e-9:
            break
        rule += (best[1],)
    return rule


def _prune(stats: DataFrame, rules: list[Rule], rule: Rule) -> tuple[Rule, float, int]:
    """The start of the rule that separates best on the pruning rows, its precision and cover."""
    left = stats.filter(~F.col("grow") & ~_covered(rules))
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all([c.on_bins() for c in rule[:k]])
        sums += [F.sum(F.when(hit & F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(hit, F.col("n")).otherwise(0))]
    row = [x or 0 for x in left.agg(*sums).first()]
    scored = [((2 * row[2 * k] - row[2 * k + 1]) / (row[2 * k + 1] + 1), k) for k in range(len(rule))]
    _, k = max(scored, key=lambda x: (x[0], -x[1]))
    return rule[: k + 1], (row[2 * k] + 1) / (row[2 * k + 1] + 2), row[2 * k]


def learn_rules(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Ordered rules for bad rows (label 0) from all labelled rows that pass the base rules."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) < 0.5).alias("bad"))
    rows = statistics.filter(~base_failed()).join(marks, "id").select("id", "bad", *[c.alias(f"f_{n}") for n, c in _features().items()])
    rows = stored(rows, "labelled")
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f"f_{n}", shares, 1000).alias(n) for n in _features()]).first()
    if found[0] is None:
        return []
    cuts = [sorted(set(x)) for x in found]
    bins = F.array(*[F.size(F.filter(F.lit(c), lambda x, v=F.col(f"f_{n}"): v > x)) for n, c in zip(_features(), cuts, strict=True)])
    grow = F.pmod(F.xxhash64("id"), F.lit(3)) != 0
    stats = stored(rows.groupBy(bins.alias("bins"), "bad", grow.alias("grow")).agg(F.count("*").alias("n")), "rule-counts")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(stats, rules, cuts)
        if not rule:
            break
        rule, precision, cover = _prune(stats, rules, rule)
        if precision < MIN_PRECISION or cover < MIN_COVER:
            break
        rules.append(rule)
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The first rule that covers a row, from 1 on; null if none does."""
    out = F.when(F.lit(False), 0)
    for i, rule in enumerate(rules, 1):
        out = out.when(_all([c.on_rows() for c in rule]), i)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics of every row of ``docs``, ``base_failed``, ``rule`` and ``kept``.

    ``kept`` is false if a base rule fails or a learned rule covers the row (``rule`` is its number).
    Rows with a null or repeated id keep their place; a null id has no label, several labels of an id
    are averaged. Without usable labels no rule is learned. An empty table gives an empty one; other
    columns are ignored.
    """
    statistics = stored(text_statistics(docs, id_col, text_col), "statistics")
    rule = rule_number(learn_rules(statistics, labels, id_col, label_col))
    out = statistics.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rule))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("id", id_col)
