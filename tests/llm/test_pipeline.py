import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import decontamination, jaccard_join, language_id, pii


@pytest.fixture(scope="module")
def kept(spark, sf):
    """Each stage's rows, as lists."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs.collect()
    return out


def test_stages(spark, sf, kept):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name in list(kept)[:-1]:
        assert list(kept[name][0].asDict()) == columns
    assert {r.doc_id for r in kept["language_id"]} == {r.doc_id for r in language_id.op7_query(docs).collect() if r.lang_pred != "und"}
    before = spark.createDataFrame(kept["language_id"], docs.schema)
    joined = jaccard_join.op4_query(before).collect()
    assert sorted(r.doc_id for r in kept["jaccard_join"]) == sorted({r.component_id for r in joined})
    before = spark.createDataFrame(kept["jaccard_join"], docs.schema)
    judged = {r.doc_id: r for r in decontamination.op6_query(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept["decontamination"]} == {i for i, r in judged.items() if not r.contaminated}
    old = {r.doc_id: r.text for r in kept["jaccard_join"]}
    for r in kept["decontamination"]:
        assert r.n_chars == len(r.text) and (r.text == old[r.doc_id]) == (judged[r.doc_id].n_hit == 0)
    for r in kept["pii"]:
        assert not pii.base_spans(r.text)


def test_packed(kept):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in kept["pii"]}
    total = 0
    for r in kept["packing"]:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        total += r.length
    assert total == sum(map(len, ids.values()))


def test_run(spark, sf, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["packing"])


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, repeated rows and ids, empty and long texts, and an empty table."""
    columns = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = "The words of this text are plain and many of them stand here for a while so that it is long enough. "
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 5), (3, text, "en", "s", 5), (3, text.upper() + " and more of it follows", None, "s", 1),
        (None, text * 2, "en", None, None), (4, "!!! 123", "en", "s", 7), (5, text * 4000, "en", "s", 1), (6, "mail me at someone@host.example.org or token = \"9f86d081884c7d659a2feaa0c55ad015\" now", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, columns)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    assert sorted((r.doc_id or 0) for r in kept["language_id"]) == [0, 3, 3, 3, 5, 6]
    assert {r.doc_id for r in kept["pii"]} <= {None, 3, 5, 6} and any("[email]" in r.text for r in kept["pii"])
    assert sum(r.length for r in kept["packing"]) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in kept["packing"]}.values())
    docs = spark.createDataFrame([], columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
