"""Language identification by compression with per-language zstandard raw-content dictionaries.

Text that shares words with a dictionary compresses into fewer bytes. Only lower-cased words of
letters are compared, with matches from three bytes on. Each text is cut into parts of
``PART`` bytes, so that a long text can't learn from itself what the dictionary should tell, and
the sizes of all parts are added. The smallest sum wins; a narrow margin over the next is rejected.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promoscan.llm.common import slices

PART, LEVEL, MIN_MATCH, DICTIONARY = 1024, 5, 3, 110 << 10
#: Excerpts per language and their characters: the bounded sample that dictionaries are made of.
SAMPLE, EXCERPT = 96, 1200
#: A margin of less than this share of the second size, or no byte at all, is rejected.
NARROW = 0.01
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def language_dictionaries(rows: DataFrame, text_col: str, lang_col: str, key_col: str, sample: int = SAMPLE) -> dict[str, bytes]:
    """Raw content of each language: excerpts of the ``2 * sample`` texts with the lowest hashes of key and text.

    Only these, of ``EXCERPT`` characters each, come to the driver (a documented parameter), whatever keys are null or
    repeated. Each task passes on that many per language at most.
    """
    rows = rows.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    hit = F.xxhash64(key_col, text_col)
    # equal rows are one excerpt, not as many as there are
    hits = rows.groupBy(F.col(lang_col).alias("lang"), hit.alias("hit")).agg(F.count("*").alias("n"))
    lowest = hits.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hit"))).filter(F.col("place") <= 2 * sample)
    limits = {r[0]: r[1] for r in lowest.groupBy("lang").agg(F.max("hit")).collect()}
    if not limits:
        return {}
    counts = {r[0]: r[1] for r in hits.groupBy("lang").agg(F.sum("n")).collect()}
    spot = F.pmod(F.xxhash64(key_col, text_col, F.lit(7)), F.lit(1_000_000_007)) / 1_000_000_007.0
    length = F.length(text_col)
    start = F.floor(F.greatest(length - EXCERPT, F.lit(0)) * spot).cast("int") + 1
    highest = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    parts = rows.filter(hit <= highest[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.substr(text_col, start, F.lit(EXCERPT)).alias("part"), hit.alias("hit"))
    chosen = parts.groupBy("lang", "hit").agg(F.min("part").alias("part"))
    found: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    for lang, hit_value, part in chosen.collect():
        found[lang].append((hit_value, part))
    out = {}
    for lang, some in found.items():
        texts = dict.fromkeys(p for _, p in sorted(some))
        out[lang] = "\n".join(map(plain, texts)).encode()
    # frequent languages first, so that they win between equal sizes
    return {lang: out[lang][:DICTIONARY] for lang in sorted(out, key=lambda x: (-counts[x], x))}


class Recognizer:
    """Chooses the language whose dictionary compresses a text best."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.compress = []
        for lang, raw in dictionaries.items():
            raw = raw or lang.encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PART, dict_size=len(raw), min_match=MIN_MATCH, write_content_size=False, write_dict_id=False
            )
            d.precompute_compress(compression_params=how)
            self.compress.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether the margin is too narrow)."""
        if not text or not self.compress or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        raw = plain(text).encode()
        parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        ranked = sorted([(sum(len(compress(p)) for p in parts), lang) for lang, compress in self.compress], key=lambda x: x[0])
        best = ranked[0][0]
        second = ranked[1][0] if len(ranked) > 1 else best + len(raw)
        return ranked[0][1], 1 / (1 + math.exp(-min(second - best, 700) / 4)), second - best <= NARROW * second


def _identify(dictionaries: dict[str, bytes]):
    def run(batches):
        recognize = Recognizer(dictionaries)
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score, narrow = zip(*map(recognize, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())], names=["id", "lang", "score", "rejected"]
                )

    return run


def identify_language(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``rejected``) of every row of ``docs``, whole texts, no shuffle.

    Dictionaries come from the text and language of ``learn_from`` alone. ``lang_pred`` is always a
    learned language, or ``und`` for a null text, one without any letter, or if there is nothing to
    learn from; ``rejected`` marks these and narrow margins. ``score`` grows with the margin, from 0.5
    for none (0 for ``und``). Equal sizes go to the more frequent language. Rows keep
    their ids, repeated or null; other columns are ignored.
    """
    dictionaries = language_dictionaries(learn_from, text_col, lang_col, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_identify(dictionaries), f"id {kind}, lang string, score double, rejected boolean")
    return found.select(F.col("id").alias(id_col), F.col("lang").alias("lang_pred"), "score", "rejected")
