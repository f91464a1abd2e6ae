"""Filter audit, fingerprints and whitening against brute force, SQL elsewhere, and on odd tables."""

import base64
import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsignal.llm import audit, fingerprints, packing, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed_filters(text):
    words = WORD.findall(text)
    return {f for f, bad in zip("ABCD", [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        re.search("[#$%&*|]", text)]) if bad}


def audit_by_hand(docs, labels):
    """Every order and step counted document by document."""
    marks = {}
    for r in labels:
        good, toxic = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = (good or r.quality == 1, toxic or r.toxic == 1)
    first, cases = {}, []
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    for r in docs:
        failed = failed_filters(r.text or "")
        if r.doc_id is not None and r.doc_id > first[r.text or ""]:
            failed.add("E")
        cases.append((r.source or "", failed, *(marks.get(r.doc_id, (False, False)) if r.doc_id is not None else (False, False))))
    found, shapley = {}, Counter()
    for part in {c[0] for c in cases}:
        for order in permutations("ABCDE"):
            left = [c for c in cases if c[0] == part]
            for step, f in enumerate(order, 1):
                out = [c for c in left if f in c[1]]
                own = [c for c in cases if c[0] == part and f in c[1]]
                left = [c for c in left if f not in c[1]]
                shapley[part, f] += len(out)
                found[part, "".join(order), step] = (len(left), len(out), len(own) - len(out), sum(c[1] == {f} for c in own),
                                                     sum(c[2] for c in out), sum(c[3] for c in out))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def audited(docs, labels):
    rows = audit.interactions(audit.mask_counts(docs, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_of_odd_documents(odd_docs, odd_labels):
    assert audited(odd_docs, odd_labels) == audit_by_hand(odd_docs.collect(), odd_labels.collect())


def test_audit_without_labels_or_documents(odd_docs, no_docs, no_labels):
    got = audited(odd_docs, no_labels)
    assert {v[4:6] for v in got.values()} == {(0, 0)}
    assert audited(no_docs, no_labels) == {}


def test_audit_without_broadcast(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    whole = audited(docs, labels)
    monkeypatch.setattr(audit, "SKETCH_BYTES", 0)
    assert audited(docs, labels) == whole == audit_by_hand(docs.collect(), labels.collect())


def test_sketch_clears_unique_texts_and_no_others(spark):
    rows = spark.range(60_000).select(F.xxhash64(F.when(F.col("id") < 30_000, F.col("id")).otherwise(F.col("id") % 7)).alias("hash")).repartition(8)
    sketch = audit.merged_sketch(rows, 8)
    seen = rows.withColumn("block", audit.block_of(F.col("hash"), 8)).join(sketch, "block").withColumn("again", audit.possible())
    times = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.min("again").alias("always"))
    assert times.where("n > 1 and not always").count() == 0
    assert times.where("n = 1 and again").count() < 0.06 * 30_000


def test_pieces_join_up_to_the_text():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = bytes(rng.choice(list("ab \n.!?é".encode()), rng.integers(0, 700)).tolist())
        assert b"".join(fingerprints.PIECE.findall(text)) == text


def keys_by_hand(text):
    seen, keys = Counter(), set()
    for piece in fingerprints.PIECE.findall(text):
        keys.add((piece, seen[piece]))
        seen[piece] += 1
    return keys


@pytest.mark.parametrize("seed", range(4))
def test_peeling_finds_exactly_the_differences(seed):
    rng = np.random.default_rng(seed)
    lines = [f"line {i}.\n".encode() for i in range(3000)] + [b"again\n"] * 5
    old, new = [], []
    for size in (0, 1, 2, 30, 200, 2500, 2500):
        some = [lines[i] for i in rng.integers(0, len(lines), size)]
        old.append(b"".join(some))
        other = [lines[i] for i in rng.integers(0, len(lines), max(size // 2, 1))]
        new.append(b"".join(some[:size // 2] + other) if size != 1 else old[-1])
    a, b = fingerprints.Version(old), fingerprints.Version(new)
    gone, added, tries = fingerprints.differences(a, b)
    assert tries.max() > 1 and tries.min() == 1
    for i, (x, y) in enumerate(zip(old, new)):
        keys = [set(v.keys[v.ends[i]:v.ends[i + 1]].tolist()) for v in (a, b)]
        assert set(gone[i].tolist()) == keys[0] - keys[1] and set(added[i].tolist()) == keys[1] - keys[0]
        by_hand = keys_by_hand(x), keys_by_hand(y)
        assert (len(gone[i]), len(added[i])) == (len(by_hand[0] - by_hand[1]), len(by_hand[1] - by_hand[0]))


def test_differences_when_no_sketch_comes_out(monkeypatch):
    monkeypatch.setattr(fingerprints, "TRIES", 1)
    old, new = fingerprints.Version([b"a.b.c." * 40 + bytes(range(97, 120)).replace(b"", b".") * 3]), fingerprints.Version([b"x.\n"])
    gone, added, _ = fingerprints.differences(old, new)
    assert (len(gone[0]), len(added[0])) == (len(old.keys), 1)


def by_order(docs):
    key = lambda r: (r.doc_id is None, -(r.doc_id or 0))
    return sorted(docs, key=key)


def test_fingerprints_by_brute_force(spark, sf):
    docs = by_order(spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op12_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    prints = {}
    for here, there in zip(docs, docs[1:] + docs[:1]):
        text, after = here.text or "", there.text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[here.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = keys_by_hand(text.encode()), keys_by_hand(other.encode())
            assert near == (pytest.approx(2 * len(a & b) / (len(a) + len(b))) if a or b else 1.0)
        assert int.from_bytes(base64.b64decode(r.fingerprint)[:8], "little") == len(keys_by_hand(text.encode()))
    assert len(set(prints.values())) == len(prints)
    long = [r for r in got.values() if r.paragraphs >= 10]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_fingerprints_of_odd_documents(odd_docs, no_docs):
    pairs = fingerprints.followed(odd_docs, odd_docs.columns).collect()
    assert sorted(str(p["doc"]) for p in pairs) == sorted(str(r) for r in odd_docs.collect())
    texts = Counter(bytes(p["text"]) for p in pairs)
    assert texts == Counter(bytes(p["next"]) for p in pairs) == Counter((r.text or "").encode() for r in odd_docs.collect())
    ids = [p["doc"]["doc_id"] for p in pairs]
    assert {p["doc"]["doc_id"]: bytes(p["next"]) for p in pairs if ids.count(p["doc"]["doc_id"]) == 1}[5] == b""
    found = fingerprints.compare(fingerprints.followed(odd_docs, odd_docs.columns), "text", ("edited", "next")).collect()
    prints = {(r["doc"]["text"] or "").encode(): r["fingerprint"] for r in found}
    assert len(found) == odd_docs.count() and len(set(prints.values())) == len(prints)
    assert fingerprints.followed(no_docs, no_docs.columns).count() == 0


def test_one_document_follows_itself(odd_docs):
    row = fingerprints.followed(odd_docs.where("doc_id = 11"), ["doc_id"]).collect()
    text = "mail me@example.org or 10.0.0.1 and 4111 1111 1111 1111 ok"
    assert [bytes(r["edited"]).decode() for r in row] == [text[:len(text) - len(text) // 2] + text[:len(text) // 2]]


def whitened_by_hand(vectors, components=16):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    order = np.argsort(-values)[:components]
    return x, n, fit.sum(0), (x - mean) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(table)
    x, n, sums, want, explained = whitened_by_hand([table[i] for i in ids])
    rows = queries.op13_whitening(spark, sf).collect()
    assert len(rows) == 16 * len(ids) and {r.n for r in rows} == {n}
    got = np.zeros((len(ids), 16))
    for r in rows:
        got[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-8
    exact = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for i, row in zip(ids, x)}
    assert {r.vec_id: r.deviation for r in rows} == exact


@pytest.mark.parametrize("values", [
    [5.0, 3.0, 1.0, 0.5], [2.0, 2.0, 2.0, 1.0, 1.0], [1 + 1e-9, 1.0, 1 - 1e-9, 0.5, 1e-6], [1.0] * 6, [4.0, 0.0, 0.0, 1e-12], [7.0],
    list(1 + 1e-7 * np.arange(20)) + list(np.geomspace(1e-8, 1, 30))])
def test_refinement_reaches_double_precision(values):
    size = len(values)
    axes = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0].astype(np.longdouble)
    given = ((axes * np.array(values, np.longdouble)) @ axes.T).astype(float)
    given = (given + given.T) / 2
    for wide in (0, 256):
        found, vectors = whitening.eigen(given, wide)
        assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * max(values)
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-14 * size
        assert np.abs(given @ vectors - vectors * found).max() <= 1e-14 * size * max(values)


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (None, [5.0, 5.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0]), (10, [1e300, -1e300])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, doc string, n int")
    got = whitening.whiten(table, table.columns).collect()
    assert sorted(str(r["doc"]["vec_id"]) for r in got) == ["1", "1", "10", "2", "3", "None"]
    assert {len(r["whitened"]) for r in got} <= {1, 2} and {r["n"] for r in got} == {5} and all(r["identity_error"] < 1e-4 for r in got)
    assert {r["doc"]["vec_id"]: r["deviation"] for r in got}[10] is None
    small = whitening.whiten(table.where("vec_id < 4"), table.columns).collect()
    values = np.array([[64, 128], [192, 64], [0, 0]])
    deviation = {i: int(((3 * v - values.sum(0)) ** 2).sum()) for i, v in zip((1, 2, 3), values)}
    assert {r["doc"]["vec_id"]: r["deviation"] for r in small} == deviation
    assert whitening.whiten(table.where("vec_id = 1"), ["vec_id"]).select("n", F.size("whitened").alias("k")).distinct().collect() == [(1, 0)]
    assert whitening.whiten(table.where("vec_id = 99"), ["vec_id"]).count() == 0


def test_random_texts_equal_the_tokenizer():
    """Mixed scripts, marks, contractions, case changes that add marks, the tokenizer's own marks; the table emptied on the way."""
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(queries.tokenizer_path()), packing.Words(queries.tokenizer_path())
    parts = ["SEVDİ,", "ABİ.", "İ", "ı", "ß", "Straße!", "it's", "'S", "''ll", "5's", "a.b", "...", "!?", "3.14", "²", "½", "٣", "日本語", "हिन्दी", "é", "≠",
             "́", "😀", "😀!", " ", "x y", " ", "\x1c", "\x00", "<|endoftext|>", "a<|startoftext|>b", "<|", "|>", "<|ENDOFTEXT|>", "K", "ſ", "Ω", "the",
             "Quick", "BROWN", "me@example.org", "don't", "O'Reilly", "ΑΣ", "ﬁ", "ǅ", "a_b", "_", "-", "​", "'", "\"'s"]
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\v", "\f", "", ""]
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(20_000):
        pick = rng.integers(0, len(parts), rng.integers(0, 8))
        texts.append("".join(parts[i] + blanks[j] for i, j in zip(pick, rng.integers(0, len(blanks), len(pick)))))
    for at in range(0, len(texts), 500):
        if at % 5000 == 0:
            words.clear()
        some = texts[at:at + 500]
        want = [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        for text, got, ids in zip(some, words.encode([t.encode() for t in some]), want):
            assert got.tolist() == ids, text
