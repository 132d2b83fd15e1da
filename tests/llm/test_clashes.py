"""Columns that clash with an operator's own, empty tables and very long texts, operator by operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chargeloom.llm import bpe, simhash, tokenfile

OWN = "ids decoded fp component_id id node root n frame shard tie start crc32 text_hash coded _coded".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, None), (4, "")], "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in OWN})


def test_bpe(clashing):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = {r.doc_id: r for r in bpe.round_trip_documents(clashing, path, form="text").collect()}
    assert set(found[1].asDict()) == {"doc_id", "text", *OWN} and found[1].start == found[1]._coded == "x"
    assert found[1].ids == found[2].ids and len(found[1].ids) == 3 and found[1].decoded.strip() == "one two three"
    assert (found[3].ids, found[3].decoded, found[4].ids) == ([], "", [])
    assert bpe.round_trip_documents(clashing.limit(0), path).collect() == []


def test_simhash(spark, clashing):
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(clashing).collect()}
    assert found[1] == found[2] and found[1][1] == 1 and found[3] == found[4] == (0, 3)
    assert simhash.near_duplicates(clashing.limit(0)).collect() == []
    words = [f"w{i % 977}x{i % 31}" for i in range(300_000)]
    long = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words) + " end"), (3, " ".join(reversed(words)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(long).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3


def test_tokenfile(spark, clashing, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write_tokens(clashing, f"{tmp_path}/tokens", path)
    found = {r.doc_id: r for r in tokenfile.read_tokens(spark, f"{tmp_path}/tokens").collect()}
    assert list(found[1].ids) == list(found[2].ids) and (found[3].n_tokens, found[4].n_tokens) == (1, 1)
    assert [found[i].start for i in (1, 2, 3, 4)] == [0, found[1].n_tokens, 2 * found[1].n_tokens, 2 * found[1].n_tokens + 1]
