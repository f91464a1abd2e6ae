"""The registered queries on whole small tables against SQL, brute force, round trips or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from idsignal.llm import packing, pii, queries, simhash
from idsignal.llm.mixing import word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "keep_quality", "drop_near_copies", "redact_personal_data", "mix_sources", "pack_sequences"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def test_language_on_held_out_rows(spark, sf, docs):
    got = rows(spark, sf, "op1_language")
    assert len(got) == len(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in known]) >= 0.95


def test_toxicity_on_held_out_rows(spark, docs, labels):
    big = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in rows(spark, big, "op2_toxicity")}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 and r.held_out == held_out(i) for i, r in got.items())
    held = [(marks[i], r.score) for i, r in got.items() if r.held_out and marks.get(i) is not None]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) >= 0.9


def test_substrings_by_brute_force(spark, sf, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        words = WORD.findall(docs[i].text or "")
        gone = [False] * len(words)
        for a in range(len(words) - 19):
            gram = tuple(words[a:a + 20])
            if gram in seen:
                gone[a:a + 20] = [True] * 20
            seen.add(gram)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, sf, "op3_substring_dedup")} == want


def test_quality_by_brute_force(spark, sf, docs, labels):
    got = {r.doc_id: r for r in rows(spark, sf, "op4_quality_rules")}
    for i, doc in docs.items():
        text = doc.text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(words[a:a + 5]) for a in range(len(words) - 4)]
        count = Counter(grams)
        covered = {a + k for a, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    good = [i for i, x in labels.items() if x.quality == 1 and not got[i].base_failed]
    bad = [i for i, x in labels.items() if x.quality == 0]
    assert np.mean([got[i].kept for i in good]) >= 0.97
    assert np.mean([not got[i].kept for i in bad]) >= 0.7


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[a:a + 3]) for a in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_by_brute_force(spark, sf, docs):
    got = rows(spark, sf, "op6_simhash_groups")
    prints = {i: fingerprint(d.text) for i, d in docs.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == components(prints)


@pytest.mark.parametrize("blocks,cell", [(4, 50), (9, 10_000), (21, 16)])
def test_simhash_codes_and_cells_agree(spark, blocks, cell):
    """Chains and balls of fingerprints, under several codes and grids of tiny cells."""
    rng = np.random.default_rng(blocks)
    prints = set()
    for centre in rng.integers(-2 ** 62, 2 ** 62, 3).tolist():
        for _ in range(150):
            flips = rng.choice(64, int(rng.integers(0, 4)), replace=False)
            prints.add(int(np.int64(centre) ^ np.bitwise_xor.reduce([np.int64(np.uint64(1) << np.uint64(f)) for f in flips] or [np.int64(0)])))
    frame = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    found = simhash.roots(simhash.links(frame, 2, blocks, cell), "test").collect()
    index = {p: p & (2 ** 64 - 1) for p in prints}
    want = components(index)
    got = {r.node: r.root for r in found}
    parts = defaultdict(set)
    for p in prints:
        parts[got.get(p, p)].add(p)
    brute = defaultdict(set)
    for p, root in want.items():
        brute[root].add(p)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, brute.values()))


def test_licences_by_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in rows(spark, sf, "op7_license_scan")}
    stated = {"Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "MIT License": "MIT", "CC BY-NC": "CC-BY-NC-4.0"}
    own = {i: next((v for k, v in stated.items() if re.search(rf"^(Licensed|This work|Released)[^\n]*{k}", d.text or "", re.M)), None)
           for i, d in docs.items()}
    assert {i: r.own for i, r in got.items()} == own
    declared = {r.path.rpartition("/")[0]: r.own for r in got.values() if r.path.endswith("/LICENSE") and r.own}
    for r in got.values():
        folder, near = r.path.rpartition("/")[0], None
        while folder and not r.own:
            if folder in declared:
                near = folder
                break
            folder = folder.rpartition("/")[0]
        assert (r.licence, r.declared_in) == (r.own or declared.get(near), near)


def test_licences_inherit_from_nearest(spark):
    from idsignal.llm import licenses
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    files = [("r/LICENSE", mit), ("r/a/COPYING", gpl), ("r/a/x.py", "plain"), ("r/a/b/c/y.py", "plain"), ("r/z.py", "plain"),
             ("r/a/own.py", f"# code\n# {mit}\nmore"), ("q/z.py", "plain"), ("r/ab/w.py", "plain"), ("top.py", "plain")]
    frame = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.own, r.licence, r.declared_in) for r in licenses.scan(frame, ["path"]).drop("doc").collect()}
    assert got["r/a/b/c/y.py"] == got["r/a/x.py"] == (None, "GPL-3.0", "r/a")
    assert got["r/z.py"] == got["r/ab/w.py"] == (None, "MIT", "r")
    assert got["r/a/own.py"] == ("MIT", "MIT", None)
    assert got["q/z.py"] == got["top.py"] == (None, None, None)


def test_mixing_targets_and_quotas(spark, sf, docs):
    got = rows(spark, sf, "op8_mix_sources")
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    sources = sorted({d.source for d in docs.values()})
    total = {s: sum(size[i] for i, d in docs.items() if d.source == s) for s in sources}
    weight = {s: n % 3 + 1 for n, s in enumerate(sources)}
    capped, whole = set(), sum(total.values())
    while True:
        rest = whole - sum(3 * total[s] for s in capped)
        share = rest / sum(weight[s] for s in sources if s not in capped)
        over = {s for s in sources if s not in capped and share * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * total[s] if s in capped else share * weight[s] for s in sources}
    taken = Counter()
    for r in got:
        source = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], total[source]) and 0 <= r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(target[source])
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    assert sorted(got) == sorted(rows(spark, sf, "op8_mix_sources"))


def test_hypergeometric_draws(spark):
    """Draws stay inside their bounds and their mean and spread are those of the distribution."""
    from idsignal.llm.mixing import hypergeometric, uniform
    frame = spark.range(4000).select(hypergeometric(F.lit(60), F.lit(25), F.lit(18), uniform("id")).alias("k"),
                                     hypergeometric(F.lit(7), F.lit(7), F.lit(3), uniform("id")).alias("all"),
                                     hypergeometric(F.lit(9), F.lit(0), F.lit(4), uniform("id")).alias("none"))
    got = frame.toPandas()
    assert (got["all"] == 3).all() and (got["none"] == 0).all()
    assert abs(got.k.mean() - 7.5) < 0.12
    assert abs(got.k.var() - 18 * (25 / 60) * (35 / 60) * (42 / 59)) < 0.3


def test_split_keeps_quotas(spark):
    from idsignal.llm.mixing import split_quotas
    quota = [130, 0, 7, 1, 55]
    rows = split_quotas(spark.createDataFrame([(quota,)], "quota array<long>"), 3).collect()
    assert len(rows) == 8
    assert [sum(r.quota[j] for r in rows) for j in range(5)] == quota
    sums = [sum(r.quota) for r in rows]
    assert max(sums) - min(sums) <= 1


def test_mixed_rows_hold_the_words(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    from idsignal.llm import mixing
    taken = mixing.mix(frame, ["doc_id"]).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_rows(frame).agg(F.sum(word_count())).first()[0] == taken


def test_packing_round_trip(spark, sf, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], queries.tokenizer_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, doc in docs.items():
        want = np.array(tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == want
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        assert {r.doc_tokens for r in parts} == {len(want) // 4}
    held = padded = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        held += sum(r.length for r in parts)
        padded += parts[0].padded
    assert held <= padded <= 1.05 * held


@pytest.mark.parametrize("text", ["", "a.b", "foo,,, bar!? Baz... QUX", "naïve ﬁ ÄÖÜ ß é it's we'll 12a3", "x" * 300 + " y", "a b 日本 !?!"])
def test_words_equal_the_tokenizer(text):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = np.frombuffer(packing.Words(queries.tokenizer_path()).encode([text.encode()])[0], "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_patterns_place_every_piece():
    rng = np.random.default_rng(5)
    histogram = {int(b): int(n) for b, n in zip(rng.choice(np.arange(1, 257), 60, replace=False), rng.integers(1, 90, 60))}
    made = packing.patterns(histogram)
    placed = Counter()
    for times, pattern in made:
        assert sum(b * n for b, n in pattern.items()) <= 256
        for b, n in pattern.items():
            placed[b] += times * n
    assert placed == Counter(histogram)
    assert sum(t for t, _ in made) <= 1.1 * sum(b * n for b, n in histogram.items()) / 256 + 1


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def test_personal_data_by_brute_force(spark, sf, docs):
    for r in rows(spark, sf, "op10_personal_data"):
        spans = base_spans(docs[r.doc_id].text or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", [
    "a@b a@b.c @x.y a@@b.c x@y..z p@q.r.s@t.u", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111-1111 1111 1111 2 4111111111111111  4111111111111111",
    "+1 (555) 010-9999 +49.30.123456 ++1 234 567 8901 +1234 +1 555 0100 12 34 5678", "é@b.c ü1.2.3.4 日+1 555 010 9999",
])
def test_base_spans_by_plain_patterns(text):
    data = text.encode()
    found, _ = pii.scan(data)
    at = pii.points(data, [p for s in found for p in (s[0], s[2])])
    assert [(at[a], k, at[b]) for a, k, b in found] == base_spans(text)


def targets(total):
    """Words per source that the weights 1, 2, 3, ... ask for, at most three times what there is."""
    sources, capped, whole = sorted(total), set(), sum(total.values())
    weight = {s: n % 3 + 1 for n, s in enumerate(sources)}
    while True:
        share = (whole - sum(3 * total[s] for s in capped)) / max(1, sum(weight[s] for s in sources if s not in capped))
        over = {s for s in sources if s not in capped and share * weight[s] > 3 * total[s]}
        if not over:
            return {s: 3 * total[s] if s in capped else share * weight[s] for s in sources}
        capped |= over


def test_pipeline_by_its_stages(spark, sf, docs):
    """Every stage's output against its contract worked out by brute force from its input."""
    from tokenizers import Tokenizer
    frame, outputs = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, apply in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stage(apply(spark, frame, sf), "test-pipeline")
        outputs.append(frame.collect())
    kept, single, redacted, mixed, packed = outputs
    judged = {r.doc_id for r in rows(spark, sf, "op4_quality_rules") if r.kept}
    assert sorted(kept) == sorted(docs[i] for i in judged)
    groups = components({i: fingerprint(docs[i].text) for i in judged})
    assert sorted(single) == sorted(docs[i] for i in set(groups.values()))
    assert sorted(r.doc_id for r in redacted) == sorted(r.doc_id for r in single)
    for r in redacted:
        before = docs[r.doc_id]
        assert not base_spans(r.text) and r.n_chars == len(r.text) and (r.lang, r.source) == (before.lang, before.source)
        assert r.text == before.text or base_spans(before.text) or "[" in r.text
    total, size = Counter(), {}
    for r in redacted:
        size[r.doc_id] = len(WORD.findall(r.text))
        total[r.source] += size[r.doc_id]
    taken, whole = Counter(), {r.doc_id: r.text for r in redacted}
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
        assert whole[r.doc_id] == r.text or whole[r.doc_id].startswith(r.text)
    assert all(abs(taken[s] - t) <= 1 for s, t in targets(total).items())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert sum(whole[r.doc_id] != r.text for r in mixed) <= len(total)  # one cut a source at most
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        assert parts[-1].offset + parts[-1].length <= 2048


def test_run_applies_all_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == [
        "doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
