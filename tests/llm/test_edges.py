"""Every operator and every pipeline stage on odd and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from idsignal.llm import language, licenses, mixing, packing, pii, quality, simhash, substrings, topk, toxicity
from idsignal.llm.common import fold
from idsignal.llm.queries import tokenizer_path

FILES = lambda docs: docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
RUN = {
    "language": lambda d, l: language.identify(d, fold() != 0, fold() == 1, d.columns),
    "toxicity": lambda d, l: toxicity.score(d, l, fold() != 0, d.columns),
    "substrings": lambda d, l: substrings.dedup(d, d.columns),
    "quality": lambda d, l: quality.judge(d, l, carry=d.columns),
    "simhash": lambda d, l: simhash.group(d, d.columns),
    "licenses": lambda d, l: licenses.scan(FILES(d), d.columns),
    "mixing": lambda d, l: mixing.mix(d, d.columns),
    "pii": lambda d, l: pii.find(d, d.columns),
}


@pytest.mark.parametrize("name", sorted(RUN))
def test_one_row_per_document(odd_docs, odd_labels, name):
    out = RUN[name](odd_docs, odd_labels)
    rows = out.select("doc.*").collect()
    assert sorted(map(str, rows)) == sorted(map(str, odd_docs.collect()))


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_table(no_docs, no_labels, name):
    assert RUN[name](no_docs, no_labels).count() == 0


def values(frame, *columns):
    return {r[0]: tuple(r[1:]) for r in frame.select("doc.doc_id", *columns).collect()}


def test_language_without_letters(odd_docs):
    got = values(language.identify(odd_docs, F.lit(True), F.lit(False), ["doc_id"]), "lang", "score")
    assert {got[i] for i in (4, 5, 6, 10)} == {("und", 0.0)}
    assert got[7][0] in ("en", "de")


def test_language_with_nothing_to_learn(odd_docs):
    got = values(language.identify(odd_docs, F.lit(False), F.lit(False), ["doc_id"]), "lang")
    assert set(got.values()) == {("und",)}


def test_quality_of_empty_and_unlabelled(odd_docs, no_labels):
    got = values(quality.judge(odd_docs, no_labels, carry=["doc_id"]), "n_words", "base_failed", "kept")
    assert got[4] == got[5] == got[6] == (0, True, False)
    assert got[1][1:] == (False, True)


def test_toxicity_without_labels(odd_docs, no_labels):
    assert {r["score"] < 1e-9 for r in toxicity.score(odd_docs, no_labels, F.lit(True), ["doc_id"]).collect()} == {True}


def test_substrings_order(odd_docs):
    rows = substrings.dedup(odd_docs, ["doc_id", "text"]).select("doc.doc_id", "n_words", "n_removed").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == [(27, 0)]
    assert got[2] == [(27, 27), (27, 27)]  # repeated rows are one document
    assert got[4] == got[5] == got[6] == [(0, 0)]
    assert got[8] == [(66_000, 66_000)]  # its text starts in document 1 and goes on repeating itself
    assert sorted(got[None]) == [(0, 0), (22, 22)]  # null ids come last


def test_simhash_links_empty_texts(odd_docs):
    got = values(simhash.group(odd_docs, ["doc_id"]), "fp", "component")
    assert {got[i] for i in (4, 5, 6)} == {(0, 4)}
    assert got[1] == got[2]


def test_keep_one_row_per_group(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(4) == 1 and 5 not in ids and 6 not in ids


def test_mixing_of_null_sources(odd_docs):
    rows = mixing.mix(odd_docs, ["doc_id", "source"]).select("doc.source", "size", "source_size", "target", "taken").collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1


def test_packing(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, ["doc_id"], tokenizer_path())
    rows = pieces.collect()
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    assert [r.doc_tokens for r in rows if r.doc.doc_id == 4] == [1]
    assert max(r.offset + r.length for r in rows) <= packing.CAPACITY
    assert packing.pack(no_docs, ["doc_id"], tokenizer_path()).count() == 0


def test_redaction(odd_docs):
    done = pii.redact(odd_docs)
    assert done.columns == odd_docs.columns and done.schema == odd_docs.schema
    text = {r.doc_id: r for r in done.where("doc_id in (4, 11)").collect()}
    assert text[4].text is None and text[4].n_chars is None
    assert text[11].text == "mail [EMAIL] or [IP] and [CARD] ok" and text[11].n_chars == len(text[11].text)


def test_licences(odd_docs):
    got = values(licenses.scan(FILES(odd_docs), ["doc_id"]), "own", "cosine")
    assert got[13] == ("Apache-2.0", 1.0) and got[4] == (None, None) and got[1] == (None, None)


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5, 0.5]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (7, [1.0]), (8, []), (200, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    out = {}
    for r in topk.top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.row_id, r.score))
    unit = 1024 * 1024
    assert out[0] == [(1, 1, 5 * unit), (2, 2, 5 * unit), (3, 100, 3 * unit // 2)]
    assert out[200] == [(1, 8, 0)]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("name,apply", corpus_pipeline.STAGES)
def test_pipeline_stage(spark, sf, odd_docs, no_docs, name, apply):
    out = apply(spark, odd_docs, sf)
    if name != "packing":
        assert out.columns == odd_docs.columns
    out.collect()
    assert apply(spark, no_docs, sf).count() == 0
