"""The pipeline and the registered queries."""

import importlib

import corpus_pipeline
import pyarrow as pa
import pytest

from promoscan.llm import queries, sentencepiece_codec
from tests.check import connect, difference
from tests.llm.helpers import cut_bytes, documents

entry = importlib.import_module("__spark_entry__")


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len({q.split("_")[0] for q in queries.QUERIES}) == 13


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


def test_stages_in_turn(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert 0 < len(after)
        if name == "repeated_strings":
            before.sort()
            want = {i: x[3].decode("utf-8", "ignore") for (i, _), x in zip(before, cut_bytes([t for _, t in before]), strict=True)}
            assert dict(after) == {i: t for i, t in want.items() if t or not dict(before)[i]}
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != dict(before)[r.doc_id])
        elif name != "mix":
            assert set(after) <= set(before)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and all(len(r.ids) == r.n_tokens for r in out.collect())


def test_encode_sends_no_decoded_texts(spark, sf_dir, monkeypatch):
    seen = []
    coded = corpus_pipeline.sentencepiece_round_trip
    monkeypatch.setattr(corpus_pipeline, "sentencepiece_round_trip", lambda *a, **k: seen.append(coded(*a, **k)) or seen[-1])
    out = corpus_pipeline.encode(spark, documents(spark, sf_dir), sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert "decoded" not in seen[0].columns


def test_stages_send_small_batches(spark, sf_dir):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    corpus_pipeline.encode(spark, documents(spark, sf_dir), sf_dir)
    found = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) as text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 4000
    assert max(r.size for r in found) < 5_000_000


def test_workers_keep_no_units_after_a_partition():
    model = queries.vocabulary("piece_bpe_32k.model")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], names=["row", "text"])
    out = [b.num_rows for b in sentencepiece_codec._encode(model, True, False)(iter([batch, batch]))]
    assert sum(out) == 4
    assert not sentencepiece_codec.codec(model).units
