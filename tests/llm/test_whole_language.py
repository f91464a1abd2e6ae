"""Texts too short for a full run of characters."""

import math

import pytest
from pyspark.sql import functions as F

from idsignal.llm import language


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, "en", "a bee and a cow and a dog"), (2, "en", "a hen and a fox"), (3, "de", "der hund und die katze"), (4, "de", "ein huhn und ein fuchs"),
            (11, None, "A."), (12, None, "é"), (13, None, "E"), (14, None, " 7 a"), (15, None, "7 ."), (16, None, ""), (17, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    return {r.doc_id: r for r in language.identify(docs, F.lit(True), F.lit(False), ["doc_id"]).select("doc.doc_id", "lang", "score", "entropy").collect()}


def test_one_letter_texts_have_a_language(found):
    assert found[11].lang == found[14].lang == "en" and found[13].lang == "de" and found[12].lang in ("en", "de")
    assert all(found[i].score > 0 and found[i].entropy > 0 for i in (11, 12, 13, 14))


def test_only_letterless_texts_have_none(found):
    assert {(found[i].lang, found[i].score) for i in (15, 16, 17)} == {("und", 0.0)}


TEXTS = [("en", "a bee and a cow and a dog"), ("en", "A hen, and a fox."), ("de", "der hund und die katze"), ("de", "ein huhn und ein fuchs")]


def plain_bits(text, lang):
    """Interpolated Kneser-Ney from its definition: dictionaries of strings, no hashes, no arrays."""
    def runs(t, n=4):
        folded = " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split())
        full = f"\x01\x01 {folded} "
        return [full[i:i + n] for i in range(len(full) - n + 1)]

    def levels(of):
        counts = {4: {}}
        for t in of:
            for r in runs(t):
                counts[4][r] = counts[4].get(r, 0) + 1
        for n in (3, 2, 1):
            counts[n] = {}
            for r in counts[n + 1]:
                counts[n][r[1:]] = counts[n].get(r[1:], 0) + 1
        return counts

    alphabet = {r for name in ("en", "de") for r in levels([t for x, t in TEXTS if x == name])[1]}
    counts = levels([t for x, t in TEXTS if x == lang])

    def p(run):
        if not run:
            return 1 / (len(alphabet) + 1)
        same = [c for r, c in counts[len(run)].items() if r[:-1] == run[:-1]]
        if not same:
            return p(run[1:])
        direct = max(counts[len(run)].get(run, 0) - language.DISCOUNT, 0) / sum(same)
        return direct + language.DISCOUNT * len(same) / sum(same) * p(run[1:])

    scored = runs(text)
    return sum(-math.log2(p(r)) for r in scored) / len(scored)


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_entropies_equal_plain_kneser_ney(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "CELLS", cells)
    asked = ["the cat and the dog", "und der hund", "A.", "zzz 123 qqq", "ein bee", TEXTS[0][1]]
    rows = [(i, x, t, True) for i, (x, t) in enumerate(TEXTS)] + [(10 + i, None, t, False) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, learn boolean")
    got = language.identify(docs, F.col("learn"), F.lit(False), ["doc_id"]).select("doc.doc_id", "lang", "entropy").collect()
    for r in got:
        want = {x: plain_bits(next(t for i, _, t, _ in rows if i == r.doc_id), x) for x in ("en", "de")}
        assert r.entropy == pytest.approx(min(want.values()), abs=1e-9) and want[r.lang] == min(want.values())


def test_pieces_hold_every_run_once(spark):
    rows = spark.createDataFrame([(x, t.encode()) for x, t in TEXTS], "lang string, text binary")
    trained = language.train(language.count_grams(rows), cells=40)
    pieces = [trained.piece(i) for i in range(trained.pieces)]
    held = [set(p.hashes[4].tolist()) for p in pieces]
    assert trained.pieces > 3 and sum(map(len, held)) == len(set().union(*held)) == trained.tables[4].select("gram").distinct().count()


def test_a_language_of_the_calibration_part_alone_is_learned(spark):
    rows = [(i, x, t, i % 2 == 0) for i, (x, t) in enumerate(TEXTS)]
    rows += [(10 + i, "fr", "le chien et la vache sont dans le jardin", True) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, held boolean")
    got = language.identify(docs, F.lit(True), F.col("held"), ["doc_id"]).where("doc.doc_id >= 10").collect()
    assert {r.lang for r in got} == {"fr"}
