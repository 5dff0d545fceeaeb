"""Documents to token ids: quality, near-duplicates, repeated strings, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; results are
written as Parquet and read again in between. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscan.llm.common import ship, stored
from promoscan.llm.mixing import mixed
from promoscan.llm.near_copies import drop_near_copies
from promoscan.llm.quality_cotrain import keep_good
from promoscan.llm.queries import table, vocabulary
from promoscan.llm.sentencepiece_codec import sentencepiece_round_trip
from promoscan.llm.suffix_array_dedup import suffix_array_dedup

#: The stages learn, choose and encode; no SQL gives the same rows.
ORACLE_SQL = None

#: Bytes of an Arrow batch. By default 10,000 rows go at once, some 35 MB of text, of which each task holds
#: several copies between JVM and Python.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> None:
    """What each stage needs of the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers keep."""
    prepared(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose five-word shingles link at a similarity of 0.8 or more."""
    prepared(spark)
    return drop_near_copies(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what occurred earlier; documents of which nothing is left go.

    A cut may leave part of a character, which goes too. ``n_chars`` is counted anew; a text that was
    null or empty before stays as it is.
    """
    prepared(spark)
    cut = suffix_array_dedup(docs, as_text=True)
    cut = cut.filter("n_removed = 0 or length(kept) > 0")
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("kept"), "n_chars": chars}
    return cut.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepared(spark)
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256) of each document of the mix."""
    prepared(spark)
    coded = sentencepiece_round_trip(docs, vocabulary("piece_bpe_32k.model"), carry=["doc_id", "source"], with_ids=True, with_text=False)
    return coded.select("row.doc_id", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
