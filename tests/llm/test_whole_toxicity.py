"""The toxicity lexicon: no bar that rises with the table, a plain recount, long texts; selection of spans."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from idsignal.llm import pii, toxicity


def planted(spark, rows):
    """40 documents with a word no clean document has, among `rows`; a tenth of all rows is toxic by another word."""
    toxic = F.col("doc_id") % 10 == 0
    filler = F.concat_ws(" ", *[F.concat(F.lit("word"), F.translate((F.xxhash64("doc_id", F.lit(i)) % 500 + 500).cast("string"), "0123456789", "qwzxcvpmnh"))
                                for i in range(30)])
    slur = toxic & (F.col("doc_id") < 400)
    text = F.concat_ws(" ", filler, F.when(slur, "grobnak").when(toxic, "vilestench"))
    docs = spark.range(rows).withColumnRenamed("id", "doc_id").withColumn("text", text)
    return docs, docs.select("doc_id", toxic.cast("int").alias("toxic"))


@pytest.mark.parametrize("rows", [10_000, 100_000])
def test_rare_word_scores_alike_at_every_size(spark, rows):
    docs, labels = planted(spark, rows)
    probe = spark.createDataFrame([(-1, "some words and grobnak here"), (-2, "some words and nothing here")], "doc_id long, text string")
    found = toxicity.score(docs.unionByName(probe), labels, F.col("doc_id") >= 0, ["doc_id"])
    got = {r.doc_id: r.score for r in found.where("doc.doc_id < 0").select("doc.doc_id", "score").collect()}
    assert got[-1] > 0.95 and got[-2] < 0.05


def test_lexicon_equals_a_plain_recount(spark):
    dice = random.Random(3)
    common = ["alpha", "bravo", "charlie", "delta", "foxtrot", "golf", "hotel", "india"]
    texts = []
    for _ in range(400):
        bad = dice.random() < 0.3
        words = dice.choices(common, k=12) + (dice.choices(["scumbag", "scumbags", "nastyfolk", "golf"], k=2) if bad else [])
        dice.shuffle(words)
        texts.append((bad, " ".join(words)))
    totals = (sum(b for b, _ in texts), sum(not b for b, _ in texts))
    counts = {}
    for bad, text in texts:
        words = {w for w in toxicity.fold_text(text.encode()).split() if len(w) > 2}
        for token in {w[:n] for w in words for n in range(4, min(len(w), 10) + 1)} | {w + " " for w in words}:
            counts.setdefault(token, [0, 0])[not bad] += 1
    weight = {}
    for token, (t, c) in counts.items():
        odds = math.log((t + 0.5) / (totals[0] + 1)) - math.log((c + 0.5) / (totals[1] + 1))
        ratio = sum(2 * n * math.log(n * len(texts) / ((t + c) * total)) for n, total in ((t, totals[0]), (c, totals[1])) if n)
        if t >= toxicity.SUPPORT and odds >= toxicity.MIN_WEIGHT and math.sqrt(ratio) >= toxicity.MIN_Z:
            weight[token] = odds
    want = {}
    for token in sorted(weight, key=len):
        if weight[token] > 1.2 * max((want.get(token[:n], 0) for n in range(4, len(token))), default=0):
            want[token] = weight[token]
    rows = spark.createDataFrame([(b, t.encode()) for b, t in texts], "toxic boolean, text binary")
    got = toxicity.learn_lexicon(rows, totals)
    assert set(got) == set(want) and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_too_large_a_lexicon_is_an_error_not_a_cut(spark):
    with pytest.raises(ValueError):
        toxicity.gathered(spark.range(11), 10)
    assert len(toxicity.gathered(spark.range(10), 10)) == 10


def test_shields_against_every_pair():
    lexicon, phrases = {"grob": 2.0, "vile ": 3.0, "vilest": 4.0}, ["not grobnak ", "vile weed ", "grobnak weed "]
    matcher = toxicity.Matcher(lexicon, phrases)
    dice = random.Random(5)
    for _ in range(300):
        text = " ".join([*dice.choices(["grobnak", "vile", "vilestench", "weed", "not", "calm"], k=dice.randint(0, 12)), ""])
        starts = [i for i in range(len(text)) if i == 0 or text[i - 1] == " "]
        shields = [(i, i + len(p)) for i in starts for p in phrases if text.startswith(p, i)]
        want = [(i, max((w, i + len(k)) for k, w in lexicon.items() if text.startswith(k, i))) for i in starts
                if any(text.startswith(k, i) for k in lexicon) and not any(a <= i < b for a, b in shields)]
        assert sorted(matcher.hits(text)) == [(i, end, w) for i, (w, end) in want]


def test_long_text_in_linear_time():
    matcher = toxicity.Matcher({"grob": 2.0}, ["not grobnak "])
    start = time.perf_counter()
    assert toxicity.measure(matcher, b"not grobnak but grobnak is " * 200_000) == (1_000_000, 1, 2.0)
    assert time.perf_counter() - start < 20


def test_spans_chosen_as_by_every_pair():
    dice = random.Random(7)
    for _ in range(400):
        span = lambda: (lambda a: (a, dice.randrange(4), a + dice.randint(1, 9)))(dice.randrange(60))
        base = sorted({span() for _ in range(dice.randrange(4))})
        scored = [(*span(), dice.randrange(10) / 10) for _ in range(dice.randrange(25))]
        taken = list(base)
        for start, kind, end, score in sorted(scored, key=lambda c: (-c[3], c[0], c[1], c[2])):
            if score >= 0.3 and all(end <= a or b <= start for a, _, b in taken):
                taken.append((start, kind, end))
        assert pii.select(base, scored, [0.3] * 4) == sorted(taken)
    many = [(10 * i, 0, 10 * i + 8) for i in range(50_000)]
    start = time.perf_counter()
    assert len(pii.select(many, [(a + 8, 1, a + 10, 0.9) for a, _, _ in many], [0.5] * 4)) == 100_000
    assert time.perf_counter() - start < 10
