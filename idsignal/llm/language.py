"""Language identification by interpolated Kneser-Ney character models.

* Texts are folded: lower case, letters kept, every other run of characters one space, a space at
  both ends, and `START` codes before the first, so that the first letters are scored too. A
  character is a 16-bit code (code points above that share one), so a run of up to `ORDER` = 4
  characters is one exact 64-bit key.
* Counts: all distinct `ORDER`-runs per language over all learning rows, summed by Spark. Lower
  orders count in how many different contexts a run occurs (Kneser-Ney), which follows from the
  distinct longer runs.
* Model: per order one array of hashes of runs, sorted, over all languages, with a row of
  probabilities per language. Every run counted is in it. It grows with the corpus, so it is cut by a
  hash of the two characters before the last one, which a run, its context and their shorter forms
  share: a piece answers for its runs alone, holds about `CELLS` keys times languages besides the runs
  of one and two characters, and is broadcast by itself. Texts pass through one piece after the
  other and carry their sums along; with one piece they are read once.
* A text's cross-entropy under each language is the mean over its characters of -log2 p, whatever
  its length; the lowest wins.
* Calibration: a first model of the learning rows outside the calibration part scores that part; the
  lead of the best language over the second becomes a score by the share of right predictions at
  such a lead; `rejected` marks texts whose cross-entropy lies above that of all but `REJECT` of the
  right ones. The model that scores the table then learns from both parts.

Defined cases: null text or text without letters: language `und`, score 0, not rejected. Null
languages are not learned from. Repeated rows count as often as they occur. With one language it is
always chosen; with none every row is `und` with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from idsignal.llm.common import map_batches, packed, slices, text_bytes
from idsignal.workspace import stage

ORDER = 4
DISCOUNT = 0.75
CELLS = 1 << 22
CALIBRATION = 1
REJECT = 0.001
BINS = 200
SPACE = 32
START = 1
HIGH = 0xFFFF
HASH = np.uint64(0x9E3779B97F4A7C15)
FLUSH = 2_000_000


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point to 16-bit code: lower-case letter, else space; beyond 16 bits all letters are one code."""
    table = np.full(0x10000, SPACE, np.uint16)
    for point in range(0x10000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def codes_of(points: np.ndarray) -> np.ndarray:
    codes = folding()[np.minimum(points, 0xFFFF)]
    for point in np.unique(points[points > 0xFFFF]).tolist():
        codes[points == point] = HIGH if chr(point).isalpha() else SPACE
    return codes


def folded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts after each other, and the index of the text of each code.

    Each text starts with a space; runs of spaces are one space; a text without letters gives nothing.
    """
    joined = " \x00".join([(t or b"").decode("utf-8", "replace").replace("\x00", " ") for t in texts])
    points = np.frombuffer((" " + joined + " ").encode("utf-32-le", "replace"), np.uint32)
    owner = np.cumsum(points == 0)
    codes = codes_of(points)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE) | (points[1:] == 0)
    codes, owner = codes[keep], owner[keep]
    letters = np.bincount(owner[codes != SPACE], minlength=len(texts))
    held = letters[owner] > 0
    return codes[held], owner[held]


def padded(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """`folded` with START codes before each text, so that its first letter ends a run of `order` codes."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    places = np.repeat(first, max(order - 2, 0))
    return np.insert(codes, places, START), np.insert(owner, places, owner[places])


def grams(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs of `order` codes inside one text, and the text of each."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed_run = np.zeros(n, np.uint64)
    for i in range(order):
        packed_run = (packed_run << np.uint64(16)) | codes[i:i + n].astype(np.uint64)
    same = owner[:n] == owner[order - 1:]
    return packed_run[same], owner[:n][same]


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): every run of `order` characters of every row (lang, text)."""

    def run(batches):
        langs: dict[str, int] = {}
        sums: dict[int, list[np.ndarray]] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        size = 0

        def merge(which: int) -> None:
            pending = np.unique(np.concatenate(waiting.pop(which)), return_counts=True)
            old = sums.get(which)
            if old is None:
                sums[which] = list(pending)
                return
            keys, place = np.unique(np.concatenate((old[0], pending[0])), return_inverse=True)
            sums[which] = [keys, np.bincount(place, np.concatenate((old[1], pending[1]))).astype(np.int64)]

        def flush():
            names = {v: k for k, v in langs.items()}
            for which in list(waiting):
                merge(which)
            for which, (keys, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([names[which]] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                                                  pa.array(counts, pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                which = np.array([langs.setdefault(x, len(langs)) for x in part.column("lang").to_pylist()], np.int64)
                runs, owner = grams(*padded(*folded(part.column("text").to_pylist()), order), order)
                kind = which[owner]
                for k in np.unique(kind).tolist():
                    waiting.setdefault(k, []).append(runs[kind == k])
                for k in [k for k, v in waiting.items() if sum(map(len, v)) > FLUSH]:
                    merge(k)
                size = sum(len(v[0]) for v in sums.values())
                if size > FLUSH:
                    yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shorter(counts: DataFrame, order: int) -> DataFrame:
    """Continuation counts of the suffixes: in how many contexts each run of order - 1 occurs."""
    suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1))
    return counts.groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n"))


def with_context(counts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n, total, kinds): with the sum and the number of the runs of the same context."""
    context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
    keyed = counts.withColumn("context", context)
    sums = keyed.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return keyed.join(sums, ["lang", "context"]).select("lang", "gram", "n", "total", "kinds")


def piece_of(grams, pieces: int):
    """The piece of the model that holds runs (numpy or a column of longs), by the two characters before the last."""
    if isinstance(grams, Column):
        last, earlier = (F.shiftrightunsigned(grams, bits).bitwiseAND(F.lit(HIGH)) for bits in (16, 32))
    else:
        last, earlier = ((grams >> np.uint64(bits)) & np.uint64(HIGH) for bits in (16, 32))
        last, earlier = last.astype(np.int64), earlier.astype(np.int64)
    return (earlier * 31 + last) * 40503 % 65537 % pieces


class Model:
    """Sorted hash arrays per order; row i of `direct` and `weight` belongs to hash i, a column per language.

    p(run) = direct[run] + weight[context] * p(run without its first character); the alphabet at the
    end is uniform over the codes seen.
    """

    def __init__(self, langs: list[str], tables: dict[int, dict], order: int = ORDER, discount: float = DISCOUNT):
        self.langs, self.order = langs, order
        self.hashes, self.direct, self.weights = {}, {}, {}
        column = {lang: i for i, lang in enumerate(langs)}
        alphabet = max(len({g for g in tables[1]["gram"]}) if len(tables[1]["gram"]) else 0, 1) + 1
        self.floor = 1.0 / alphabet
        for n in range(1, order + 1):
            table = tables[n]
            key = np.asarray(table["gram"], np.int64).view(np.uint64) * HASH
            keys, place = np.unique(key, return_inverse=True)
            which = np.array([column[x] for x in table["lang"]], np.int64)
            total = np.asarray(table["total"], float)
            direct = np.zeros((len(keys), len(langs)), np.float64)
            direct[place, which] = np.maximum(np.asarray(table["n"], float) - discount, 0) / total
            self.hashes[n], self.direct[n] = keys, direct
            # what discounting frees in a context goes to the shorter runs
            context = (np.asarray(table["gram"], np.int64).view(np.uint64) >> np.uint64(16)) if n > 1 else np.zeros(len(key), np.uint64)
            contexts, where = np.unique(context * HASH, return_inverse=True)
            weight = np.ones((len(contexts), len(langs)), np.float64)
            weight[where, which] = discount * np.asarray(table["kinds"], float) / total
            self.weights[n] = (contexts, weight)
        self._compile()

    @staticmethod
    def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted hash, the last row (for none) if it is absent."""
        at = np.searchsorted(sorted_hashes, wanted)
        at[at == len(sorted_hashes)] = 0
        return np.where(sorted_hashes[at] == wanted, at, len(sorted_hashes)) if len(sorted_hashes) else np.zeros(len(wanted), np.int64)

    def probability(self, runs: np.ndarray, order: int) -> np.ndarray:
        """p of the last character of each packed run given the ones before, a column per language."""
        if order == 0:
            return np.full((len(runs), len(self.langs)), self.floor)
        tail = runs & np.uint64((1 << (16 * (order - 1))) - 1) if order > 1 else np.zeros(len(runs), np.uint64)
        lower = self.probability(tail, order - 1)
        row = self._find(self.hashes[order], runs * HASH)
        direct = np.vstack((self.direct[order], np.zeros(len(self.langs))))[row]
        contexts, weight = self.weights[order]
        context = (runs >> np.uint64(16)) if order > 1 else np.zeros(len(runs), np.uint64)
        weight = np.vstack((weight, np.ones(len(self.langs))))[self._find(contexts, context * HASH)]
        return direct + weight * lower

    def _compile(self) -> None:
        """Bits of every known run of full order, so that most characters cost one search."""
        keys = self.hashes[self.order]
        inverse = np.uint64(pow(int(HASH), -1, 1 << 64))
        self.bits = -np.log2(self.probability(keys * inverse, self.order)) if len(keys) else np.zeros((0, len(self.langs)))

    def bits_of(self, texts: list[bytes | None], which: int = 0, pieces: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text (row) in each language and its number of characters, as far as this piece holds their runs."""
        runs, owner = grams(*padded(*folded(texts), self.order), self.order)
        if pieces > 1:
            mine = piece_of(runs, pieces) == which
            runs, owner = runs[mine], owner[mine]
        sums, counts = np.zeros((len(texts), len(self.langs))), np.bincount(owner, minlength=len(texts))
        keys, place = np.unique(runs, return_inverse=True)
        row = self._find(self.hashes[self.order], keys * HASH)
        known = row < len(self.bits)
        bits = np.empty((len(keys), len(self.langs)))
        bits[known] = self.bits[row[known]]
        bits[~known] = -np.log2(self.probability(keys[~known], self.order))
        for j in range(len(self.langs)):
            sums[:, j] = np.bincount(owner, bits[place, j], len(texts))
        return sums, counts


@dataclass(frozen=True)
class Trained:
    """The written tables of a model, one per order, and how many pieces they make."""

    langs: list[str]
    tables: dict[int, DataFrame]
    order: int
    pieces: int

    def piece(self, which: int) -> Model:
        tables = {}
        for n, table in self.tables.items():
            part = (table.where(piece_of(F.col("gram"), self.pieces) == which) if n > 2 and self.pieces > 1 else table).toArrow()
            tables[n] = {c: part.column(c).to_numpy() if c != "lang" else part.column(c).to_pylist() for c in part.column_names}
        return Model(self.langs, tables, self.order)


def train(counts: DataFrame, name: str = "language", order: int = ORDER, cells: int | None = None) -> Trained | None:
    """A model from the counts of runs per language (`count_grams`); None if there are none."""
    tables = {}
    for n in range(order, 0, -1):
        tables[n] = stage(with_context(counts, n), f"{name}-order")
        if n > 1:
            counts = stage(shorter(counts, n), f"{name}-grams")
    langs = sorted(r["lang"] for r in tables[1].select("lang").distinct().collect())
    held = sum(tables[n].count() for n in range(3, order + 1)) * len(langs)
    return Trained(langs, tables, order, min(-(-held // (cells or CELLS)) or 1, 65537)) if langs else None


def add_bits(rows: DataFrame, trained: Trained, which: int) -> DataFrame:
    """(doc, text, bits, n) with the bits and characters added that one piece of the model answers for; the last drops texts."""
    shared = rows.sparkSession.sparkContext.broadcast(trained.piece(which))
    pieces, width, last = trained.pieces, len(trained.langs), which == trained.pieces - 1
    names = [c for c in rows.columns if c != "text" or not last]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, n = shared.value.bits_of(batch.column("text").to_pylist(), which, pieces)
        bits += batch.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        sums = pa.ListArray.from_arrays(np.arange(0, bits.size + 1, width, dtype=np.int32), pa.array(bits.ravel()))
        made = {"doc": batch.column("doc"), "text": batch.column("text"), "bits": sums,
                "n": pa.array(n + batch.column("n").to_numpy(zero_copy_only=False))}
        return pa.RecordBatch.from_arrays([made[c] for c in names], names)

    return map_batches(rows, work, rows.select(*names).schema)


def score(docs: DataFrame, trained: Trained | None, carry: Column, text: str = "text", name: str = "language") -> DataFrame:
    """(doc, lang, entropy, lead) per row; lang is null without letters."""
    rows = docs.select(carry.alias("doc"), text_bytes(text).alias("text"))
    if trained is None:
        return rows.select("doc", *[F.lit(None).cast(kind).alias(c) for c, kind in (("lang", "string"), ("entropy", "double"), ("lead", "double"))])
    rows = rows.withColumns({"bits": F.array_repeat(F.lit(0.0), len(trained.langs)), "n": F.lit(0).cast("long")})
    for which in range(trained.pieces):
        rows = add_bits(rows if which == 0 else stage(rows, f"{name}-bits"), trained, which)
    each = F.when(F.col("n") > 0, F.transform("bits", lambda b: b / F.col("n")))
    ranked = F.sort_array("each")
    best = F.element_at(F.array(*[F.lit(x) for x in trained.langs]), F.array_position("each", F.array_min("each")).cast("int"))
    lang = F.when(F.col("n") > 0, best)  # element_at of a null place counts as never null
    lead = ranked[1] - ranked[0] if len(trained.langs) > 1 else F.when(F.col("n") > 0, 8.0)
    return rows.select("doc", "n", each.alias("each")).select("doc", lang.alias("lang"), F.array_min("each").alias("entropy"), lead.alias("lead"))


def calibrate(scored: DataFrame, truth: Column) -> tuple[np.ndarray, float]:
    """(score per bin of the lead, highest entropy not rejected), from all rows that have a language."""
    rows = scored.where(F.col("lang").isNotNull() & truth.isNotNull())
    lead_bin = F.least(F.floor(F.col("lead") * BINS / 4).cast("int"), F.lit(BINS - 1))
    entropy_bin = F.least(F.floor(F.col("entropy") * 100).cast("int"), F.lit(3999))
    table = rows.groupBy(lead_bin.alias("lead"), (F.col("lang") == truth).alias("right")).count().collect()
    right, total = np.zeros(BINS), np.zeros(BINS)
    for r in table:
        total[r["lead"]] += r["count"]
        right[r["lead"]] += r["count"] * r["right"]
    # a larger lead is never worth less: pool neighbours until the shares rise
    blocks: list[list[float]] = []
    for i in range(BINS):
        blocks.append([right[i], total[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-9) >= blocks[-1][0] * max(blocks[-2][1], 1e-9):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    shares = np.concatenate([np.full(int(n), (r + 1) / (t + 2)) for r, t, n in blocks])
    counts = rows.where(F.col("lang") == truth).groupBy(entropy_bin.alias("bin")).count().orderBy("bin").collect()
    seen, whole, limit = 0, sum(r["count"] for r in counts), float("inf")
    for r in counts:
        seen += r["count"]
        if seen >= (1 - REJECT) * whole:
            limit = (r["bin"] + 1) / 100
            break
    return shares, limit


def identify(docs: DataFrame, learn: Column, calibration: Column, carry: list[str], text: str = "text", lang: str = "lang",
             name: str = "language") -> DataFrame:
    """(doc, lang, score, entropy, rejected) per row: learned from all rows that `learn` names, the score calibrated on `calibration`'s."""
    held = F.coalesce(calibration, F.lit(False))
    known = docs.where(learn & F.col(f"`{lang}`").isNotNull())
    truth = F.col(f"`{lang}`").cast("string")
    labelled = truth.alias("lang"), text_bytes(text).alias("text")
    first = stage(count_grams(known.where(~held).select(*labelled)), f"{name}-grams")
    rest = stage(count_grams(known.where(held).select(*labelled)), f"{name}-grams")
    tried = score(known.where(held), train(first, name), F.struct(truth.alias("truth")), text, name)
    shares, limit = calibrate(stage(tried, f"{name}-calibration"), F.col("doc.truth"))
    both = stage(first.unionByName(rest).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"{name}-grams")
    scored = score(docs, train(both, name), F.struct(packed(docs.select(*[f"`{c}`" for c in carry])).alias("row")), text, name)
    place = F.least(F.floor(F.col("lead") * BINS / 4).cast("int"), F.lit(BINS - 1))
    sure = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), place + 1)
    return scored.select(F.col("doc.row").alias("doc"), F.coalesce("lang", F.lit("und")).alias("lang"),
                         F.when(F.col("lang").isNull(), 0.0).otherwise(sure).alias("score"), "entropy",
                         F.coalesce(F.col("entropy") > F.lit(limit), F.lit(False)).alias("rejected"))
