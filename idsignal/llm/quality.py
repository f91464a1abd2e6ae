"""Quality rules: an isolation forest on rule statistics, its threshold calibrated on labelled rows.

1. `rule_statistics`: one pass over whole texts gives counts and ratios per document.
2. `usual_levels`: per ratio a low and a high level, from a histogram of *all* rows of label 1; beyond
   all levels together lie at most `FALSE_REJECT` of them. The forest sees how far a ratio lies outside.
3. `grow_forest`: random splits on a bounded sample (`FOREST_ROWS` rows chosen by hash of the
   statistics) of the documents that pass the base rules; `TREES` trees of `TREE_ROWS` rows.
4. `anomaly`: 2 ** (-mean path length / expected length) for every document.
5. `calibrate`: a histogram of the scores of *all* labelled rows by label gives the threshold
   that rejects most rows of label 0 while at most `FALSE_REJECT` of the rows of label 1 go.

Defined cases: a null or empty text has no words and fails the base rules. Rows are judged one
by one, so repeated rows and ids get equal verdicts. Without labelled rows of label 0 nothing but
the base rules rejects; without those of label 1 the levels are those of all rows that pass the
base rules. Without rows that pass the base rules there is no forest and every score is 0.
Of several labels of one document the lowest counts; null labels are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from idsignal.llm.common import BLANKS, map_batches, packed, text_bytes
from idsignal.workspace import stage

TREES = 128
TREE_ROWS = 256
FOREST_ROWS = 8192
BINS = 2000
FALSE_REJECT = 0.002
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:'\"()[]{}/\\@=_~^`-+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_word_share", "log_word_chars", "distinct_word_share"]
LEVEL_BINS = 10_000
STATISTICS = ", ".join([f"{c} long" for c in COUNTS] + [f"{r} double" for r in RATIOS])


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of five words that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(grams)) == len(grams):
        return 0
    seen: dict = {}
    for gram in grams:
        seen[gram] = seen.get(gram, 0) + 1
    covered = end = 0
    for start, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += start + 5 - max(start, end)
            end = start + 5
    return covered


def document_statistics(text: bytes | None) -> tuple:
    """COUNTS and RATIOS of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    joined = b"".join(words)
    plain = joined.decode("utf-8", "replace")
    chars = len(plain)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    repeats = repeat_words(words)
    marks = len(joined) - len(joined.translate(None, MARKS))
    lowered = plain.lower()
    capitals = sum(map(str.__ne__, plain, lowered)) if len(lowered) == chars else sum(map(str.isupper, plain))
    twice = len(lines) - len(set(lines))
    return (n, chars, symbols, twice, repeats, symbols / chars, capitals / chars, marks / chars, twice / len(lines), repeats / n,
            math.log(chars / n), len(set(words)) / n)


def rule_statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` (default: all columns but the text) as struct `doc`, with the statistics of each row."""
    names = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in names])).alias("doc"), text_bytes(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*[document_statistics(t) for t in batch.column("text").to_pylist()]))
        arrays = [pa.array(c, pa.int64() if i < len(COUNTS) else pa.float64()) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], ["doc", *COUNTS, *RATIOS])

    return map_batches(rows, work, f"doc {kind}, {STATISTICS}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def expected_path(rows: float) -> float:
    """Mean path length of an unsuccessful search among `rows` rows."""
    if rows <= 1:
        return 0.0
    return 2 * (math.log(rows - 1) + 0.5772156649015329) - 2 * (rows - 1) / rows if rows > 2 else 1.0


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """(feature, cut, low child, high child) or (expected remaining path,)."""
    wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth else []
    if not len(wide):
        return (expected_path(len(rows)),)
    feature = int(rng.choice(wide))
    column = rows[:, feature]
    cut = rng.uniform(column.min(), column.max())
    low = column <= cut
    if low.all():
        return (expected_path(len(rows)),)
    return (feature, cut, grow_tree(rows[low], rng, depth - 1), grow_tree(rows[~low], rng, depth - 1))


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): the lowest label of each document."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("quality")))


def usual_levels(statistics: DataFrame, labels: DataFrame, outside: float = FALSE_REJECT) -> tuple[np.ndarray, np.ndarray]:
    """Per ratio a low and a high level, each with at most its part of `outside` of the rows of label 1 beyond it."""
    passing = statistics.where(~F.col("base_failed"))
    clean = passing.join(marked(labels).where("quality != 0").select(F.col("doc_id").alias("marked")), F.col("doc.doc_id") == F.col("marked"))
    placed = F.explode(F.array(*[F.struct(F.lit(i).alias("ratio"), F.floor(F.col(c) * LEVEL_BINS).alias("bin")) for i, c in enumerate(RATIOS)]))
    low, high = np.zeros(len(RATIOS)), np.zeros(len(RATIOS))
    for rows in (clean, passing):
        found = rows.select(placed.alias("at")).groupBy("at.ratio", "at.bin").count().orderBy("ratio", "bin").collect()
        if found:
            break
    for i in {r["ratio"] for r in found}:
        bins, counts = np.array([(r["bin"], r["count"]) for r in found if r["ratio"] == i]).T
        spare = outside / (2 * len(RATIOS)) * counts.sum()
        low[i] = bins[np.flatnonzero(counts.cumsum() > spare)[0]] / LEVEL_BINS
        high[i] = (bins[np.flatnonzero(counts[::-1].cumsum()[::-1] > spare)[-1]] + 1) / LEVEL_BINS
    return low, high


def outlying(rows: np.ndarray, levels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How far each ratio lies above its high level, or (negative) below its low one."""
    return np.maximum(rows - levels[1], 0) + np.minimum(rows - levels[0], 0)


def grow_forest(sample: np.ndarray, levels: tuple[np.ndarray, np.ndarray], trees: int = TREES, tree_rows: int = TREE_ROWS,
                seed: int = 7) -> dict | None:
    """Trees over random parts of `sample` (rows x RATIOS)."""
    if not len(sample):
        return None
    sample = outlying(sample, levels)
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(sample))
    depth = math.ceil(math.log2(max(size, 2)))
    grown = [grow_tree(sample[rng.choice(len(sample), size, replace=False)], rng, depth) for _ in range(trees)]
    return {"trees": grown, "expected": expected_path(size), "levels": levels}


def _paths(tree: tuple, rows: np.ndarray, index: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[index] += depth + tree[0]
        return
    low = rows[index, tree[0]] <= tree[1]
    _paths(tree[2], rows, index[low], depth + 1, out)
    _paths(tree[3], rows, index[~low], depth + 1, out)


def anomaly(forest: dict | None, rows: np.ndarray) -> np.ndarray:
    """Isolation score of each row, 0 to 1, higher: easier to isolate."""
    if forest is None or not len(rows) or not forest["expected"]:
        return np.zeros(len(rows))
    rows = outlying(rows, forest["levels"])
    total = np.zeros(len(rows))
    for tree in forest["trees"]:
        _paths(tree, rows, np.arange(len(rows)), 0, total)
    return 2.0 ** (-total / len(forest["trees"]) / forest["expected"])


def forest_sample(statistics: DataFrame, limit: int = FOREST_ROWS) -> np.ndarray:
    """At most `limit` rows that pass the base rules, chosen by hash."""
    passing = statistics.where(~F.col("base_failed"))
    keyed = passing.select(*RATIOS, F.xxhash64(F.lit(11), "doc", *RATIOS).alias("pick"))
    share = min(1.0, 3 * limit / max(passing.count(), 1))
    picked = keyed.where(F.pmod("pick", F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    found = picked.orderBy("pick").limit(limit).collect()
    return np.array([[r[c] for c in RATIOS] for r in found], float).reshape(len(found), len(RATIOS))


def scored(statistics: DataFrame, forest: dict | None) -> DataFrame:
    """`statistics` with the column `anomaly`."""
    shared = statistics.sparkSession.sparkContext.broadcast(forest)
    kind = statistics.schema.simpleString()[len("struct<"):-1]

    def run(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RATIOS])
            yield batch.append_column("anomaly", pa.array(anomaly(shared.value, rows)))

    return statistics.mapInArrow(run, f"{kind},anomaly:double")


def calibrate(scores: DataFrame, labels: DataFrame, false_reject: float = FALSE_REJECT) -> float:
    """The lowest score to reject, from all labelled rows; 2.0 (none) if nothing can be told.

    Among the cuts that reject at most `false_reject` of the rows of label 1 it takes the one that
    rejects most rows of label 0, the highest such cut on a tie.
    """
    bins = (scores.where(~F.col("base_failed"))
            .select(F.col("doc.doc_id").alias("doc_id"), F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
            .join(marked(labels), "doc_id").groupBy("bin", "quality").count().collect())
    bad, good = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for row in bins:
        (good if row["quality"] else bad)[row["bin"]] += row["count"]
    above_bad, above_good = bad[::-1].cumsum()[::-1], good[::-1].cumsum()[::-1]
    allowed = above_good <= false_reject * good.sum()
    if not bad.sum() or not (allowed & (above_bad > 0)).any():
        return 2.0
    best = above_bad[allowed].max()
    return float(np.flatnonzero(allowed & (above_bad == best)).max()) / BINS


def verdicts(docs: DataFrame, labels: DataFrame, text: str, carry: list[str] | None, name: str) -> tuple[DataFrame, dict | None, float]:
    """Scored statistics of every row, the forest, the threshold."""
    statistics = stage(rule_statistics(docs, text, carry).withColumn("base_failed", base_failed()), f"{name}-statistics")
    forest = grow_forest(forest_sample(statistics), usual_levels(statistics, labels))
    scores = scored(statistics, forest)
    return scores, forest, calibrate(scores, labels)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", carry: list[str] | None = None,
          name: str = "quality") -> DataFrame:
    """Rows (doc, statistics, base_failed, anomaly, kept); `doc` holds the carried columns."""
    scores, _, threshold = verdicts(docs, labels, text, carry, name)
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", name: str = "quality") -> DataFrame:
    """The rows of `docs` that `judge` keeps; texts are read again rather than shuffled to their verdicts."""
    _, forest, threshold = verdicts(docs, labels, text, [id_column], name)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select(packed(docs.drop(text)).alias("doc"), text_bytes(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [document_statistics(t) for t in batch.column("text").to_pylist()]
        ratios = np.array([m[len(COUNTS):] for m in made], float).reshape(len(made), len(RATIOS))
        sound = np.array([m[0] >= MIN_WORDS and 100 * m[4] <= MAX_REPEAT_PERCENT * m[0] for m in made], bool)
        return batch.filter(pa.array(sound & (anomaly(shared.value, ratios) < threshold)))

    kept = map_batches(rows, work, f"doc {rows.schema['doc'].dataType.simpleString()}, text binary")
    return kept.select(*[F.col("text").cast("string").alias(text) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
