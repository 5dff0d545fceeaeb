"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscan.llm.collocations import collocations
from promoscan.llm.common import ship
from promoscan.llm.conversation_repair import repaired_after_damage
from promoscan.llm.embedding_dedup import embedding_dedup
from promoscan.llm.language_id import identify_language
from promoscan.llm.mixing import mix_sources
from promoscan.llm.quality_cotrain import score_quality
from promoscan.llm.quality_rules import quality_rules
from promoscan.llm.secret_links import listed, secret_spans
from promoscan.llm.sentencepiece_codec import sentencepiece_round_trip
from promoscan.llm.simhash_dedup import simhash_dedup
from promoscan.llm.substring_dedup import substring_dedup
from promoscan.llm.suffix_array_dedup import suffix_array_dedup
from promoscan.llm.token_frames import read_shards, write_shards

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality_rules(docs, labels).select(*columns)


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_shards(spark, write_shards(docs, vocabulary("word_bpe_49k.json")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = sentencepiece_round_trip(docs, vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_array_dedup(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = identify_language(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_after_damage(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_frames, op3_sentencepiece, op4_substring_dedup, op5_suffix_array_dedup,
        op6_quality_cotrain, op7_language_id, op8_embedding_dedup, op9_simhash_dedup, op10_mixing,
        op11_conversation_repair, op12_collocations, op13_secret_scan,
    )
}

_SUBSTRING_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM windows),
firsts AS (SELECT h, min(doc_id) AS first_id FROM hashed GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS places
    FROM hashed JOIN firsts USING (h) WHERE first_id < doc_id GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
           CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(places, k)) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

_COLLOCATION_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f AS (
    SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM starts, (SELECT unnest(range(1, 6)) AS k)
    WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
),
candidates AS (SELECT lang, p, f AS a, array_to_string(p, ' ') AS phrase FROM f WHERE len(p) > 1),
cuts AS (
    SELECT c.lang, c.p, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)]
    JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
kept AS (
    SELECT * FROM lowest x WHERE NOT EXISTS (
        SELECT 1 FROM candidates y WHERE y.lang = x.lang AND len(y.p) > len(x.p) AND 100 * y.a >= 100 * x.a
        AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op4_substring_dedup": _SUBSTRING_SQL, "op12_collocations": _COLLOCATION_SQL}
