"""Packing token sequences by cutting-stock column generation.

1. Each text is tokenised once and ends with id `end`. It is cut into whole sequences of `capacity`
   ids and a remainder; the pieces with their ids are written to the shared folder.
2. The lengths of the remainders, in steps of `GRID` ids rounded up, give a histogram of at most
   capacity / GRID bins: all the driver ever sees, whatever the size of the corpus.
3. `patterns`: a linear program chooses how often each pattern (pieces per length that fit one
   sequence) is used. Columns are priced by knapsack dynamic programming until none could lower the
   number of sequences by more than `GAP`. Counts are rounded down; what is left fills greedily.
4. Pieces are ranked within their bin by hash, in `BUCKETS` parts per bin, so that a bin that holds
   a third of all pieces is not one task's work. A piece's rank tells pattern, sequence and place.

A sequence is padded to `capacity` unless its ids are a power of two. Defined cases: null text is
empty and gives the one id `end`; repeated rows are separate documents; an empty table gives no
pieces; texts of any length are cut into whole sequences first. A worker tokenises each piece of a
text once and starts its table anew when that holds more than `ROOM` bytes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from idsignal.llm.common import packed, slices, text_bytes
from idsignal.workspace import stage

CAPACITY = 2048
GRID = 8
GAP = 1e-3
ROUNDS = 3000
BUCKETS = 1024
ROOM = 96 << 20  # bytes of a worker's table, by estimate
KEY_BYTES = 150
END = 1
PIECE = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")

_WORDS: dict[str, "Words"] = {}


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = place = len(self)
        self.fresh.append(key)
        return place


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """`array` with room for `size` entries."""
    if len(array) >= size:
        return array
    wider = np.zeros(max(size, 2 * len(array)), array.dtype)
    wider[:len(array)] = array
    return wider


class Words:
    """Ids of texts by a tokenizer that lower-cases and never joins letters with marks, digits or white space.

    `PIECE` cuts as the tokenizer does as long as runs of bytes beyond ASCII are letters; each piece is
    tokenised once and its ids are kept in one array. Words with other characters (and those that
    may hold the tokenizer's own marks) are kept whole, under a key that starts with a blank.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.none = self.tokenizer.normalizer, normalizers.Sequence([])
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        self.held = self.used = 0
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def learn(self) -> None:
        """Tokenise the keys asked for since the last time; a piece that may not stand alone gets no ids."""
        fresh, self.places.fresh = self.places.fresh, []
        first = len(self.places) - len(fresh)
        self.starts, self.sizes = grown(self.starts, len(self.places)), grown(self.sizes, len(self.places))
        self.held += sum(map(len, fresh)) + KEY_BYTES * len(fresh)
        words = np.fromiter((key[:1] == b" " for key in fresh), bool, len(fresh))
        sound = np.fromiter(map(stands_alone, fresh), bool, len(fresh))
        for kind, own in ((sound & ~words, self.none), (words, self.normalizer)):
            chosen = np.flatnonzero(kind)
            for at in range(0, len(chosen), 20_000):
                some = chosen[at:at + 20_000]
                texts = [fresh[i].decode("utf-8", "replace").lstrip(" ") for i in some.tolist()]
                if own is self.none:  # normalised together: a call for each costs more than its ids
                    texts = self.normalizer.normalize_str(" ".join(texts)).split(" ")
                self.tokenizer.normalizer = own
                encoded = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
                sizes = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(texts))
                self.ids = grown(self.ids, self.used + len(encoded))
                self.ids[self.used:self.used + len(encoded)] = encoded.ids
                self.sizes[first + some] = sizes
                self.starts[first + some] = self.used + np.cumsum(sizes) - sizes
                self.used += len(encoded)

    def gather(self, keys: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids per list of keys, and which lists hold a key without ids."""
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(keys)), np.int64, int(counts.sum()))
        self.learn()
        sizes = self.sizes[places].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        spots = np.repeat(self.starts[places] - ends[:-1], sizes) + np.arange(ends[-1])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        empty = np.concatenate([[0], np.cumsum(sizes == 0)])[bounds]
        return np.split(self.ids[spots], ends[bounds[1:-1]]), np.diff(empty) > 0

    def by_word(self, text: bytes) -> list[bytes]:
        """Keys of a text in which some pieces may not stand alone."""
        keys = []
        for word in text.split():
            pieces = PIECE.findall(word.lower())
            keys += pieces if all(self.sizes[self.places[p]] for p in pieces) else [b" " + word]
        return keys

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if self.held > ROOM:
            self.clear()
        if not texts:
            return []
        found, odd = self.gather([PIECE.findall((t or b"").lower()) for t in texts])
        again = np.flatnonzero(odd).tolist()
        if again:
            for i, ids in zip(again, self.gather([self.by_word(texts[i]) for i in again])[0]):
                found[i] = ids
        return found


def stands_alone(key: bytes) -> bool:
    """Whether a key's ids do not depend on what its word holds besides it."""
    if key.isascii():
        return key[:1] == b" " or b"<|" not in key
    return key[:1] == b" " or unicodedata.normalize("NFC", key.decode("utf-8", "replace")).lower().isalpha()


def words_of(path: str) -> Words:
    """This worker's table for a tokenizer file."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def pieces(docs: DataFrame, carry: list[str], tokenizer: str, text: str = "text", capacity: int = CAPACITY,
           end: int = END) -> DataFrame:
    """(doc, start, length, doc_tokens, ids_crc32, ids): whole sequences, then the remainder, of every row."""
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"), text_bytes(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        words = words_of(tokenizer)
        for batch in batches:
            pa.default_memory_pool().release_unused()  # what earlier work of this Python process has left
            for part in slices(batch, "text", 1 << 20):
                owner, start, length, total, crc, data = [], [], [], [], [], []
                for i, ids in enumerate(words.encode(part.column("text").to_pylist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    n = len(ids)
                    for at in range(0, n, capacity):
                        some = ids[at:at + capacity].tobytes()
                        owner.append(i)
                        start.append(at)
                        length.append(len(some) // 4)
                        total.append(n)
                        crc.append(zlib.crc32(some))
                        data.append(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(crc, pa.int64()), pa.array(data, pa.binary())],
                    ["doc", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return rows.mapInArrow(run, f"doc {kind}, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def knapsack(worth: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits, items unlimited, by dynamic programming; and how many of each item."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(widths, c, "right"))
        best[c], pick[c] = best[c - 1], -1
        if fit:
            values = best[c - widths[:fit]] + worth[:fit]
            i = int(values.argmax())
            if values[i] > best[c] + 1e-12:
                best[c], pick[c] = values[i], i
    counts, c = np.zeros(len(widths)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= widths[pick[c]]
    return float(best[capacity]), counts


def solve(widths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their counts in the linear program that covers `demand` with fewest sequences."""
    columns = np.diag((capacity // widths).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    # a slight spread of the demands keeps ties, and with them idle pivots, away
    demand = demand * (1 + 1e-4 * np.random.default_rng(3).random(len(widths)))
    level = inverse @ demand
    full = widths / capacity  # the duals if every sequence could be filled: a bound, and near the end's duals
    bound = float(full @ demand)
    cost = np.ones(len(widths))
    pull = 0.9
    for _ in range(ROUNDS):
        if cost @ level <= (1 + GAP) * bound:
            break
        duals = cost @ inverse
        spare = int(duals.argmin())
        if duals[spare] < -1e-9:  # more pieces of one bin than asked for would help: let them be spare
            column, price = np.zeros(len(widths)), 0.0
            column[spare] = -1
        else:
            while True:  # price between the bound's duals and the program's, nearer to the program's if that finds nothing
                _, column = knapsack(pull * full + (1 - pull) * duals, widths, capacity)
                worth, price = float(duals @ column), 1.0
                if worth > 1 + 1e-6 or not pull:
                    break
                pull = pull - 0.3 if pull > 0.35 else 0.0
            if worth <= 1 + GAP / 10:
                break
            pull = 0.9
        step = inverse @ column
        rise = step > 1e-7
        if not rise.any():
            break
        ratio = np.where(rise, level / np.where(rise, step, 1), np.inf)
        out = int(np.where(ratio <= ratio.min() + 1e-9, step, 0).argmax())
        columns[:, out], cost[out] = column, price
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        level = np.maximum(inverse @ demand, 0)
    return columns * cost, level * cost


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {bin: pieces per sequence}) that place every piece; a bin is a length in steps of `grid`."""
    widths = np.array(sorted(histogram), np.int64)
    if not len(widths):
        return []
    left = np.array([histogram[w] for w in widths.tolist()], np.int64)
    room = capacity // grid
    columns, level = solve(widths, left.astype(float), room)
    made = []
    for j in np.argsort(-level, kind="stable"):
        column = columns[:, j].astype(np.int64)
        used = column > 0
        times = int(min(np.floor(level[j] + 1e-6), (left[used] // column[used]).min() if used.any() else 0))
        if times > 0:
            made.append((times, {int(w): int(n) for w, n in zip(widths[used], column[used])}))
            left -= times * column
    while left.any():
        column, free = np.zeros(len(widths), np.int64), room
        for i in range(len(widths) - 1, -1, -1):
            column[i] = min(left[i], free // widths[i])
            free -= column[i] * widths[i]
        used = column > 0
        times = int((left[used] // column[used]).min())
        made.append((times, {int(w): int(n) for w, n in zip(widths[used], column[used])}))
        left -= times * column
    return made


def seating(made: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end rank, per sequence, first sequence, first place): where ranked pieces go."""
    rows, sequence, used = [], 0, Counter()
    for times, pattern in made:
        place = 0
        for width in sorted(pattern, reverse=True):
            each = pattern[width]
            rows.append((width, used[width], used[width] + times * each, each, sequence, place))
            used[width] += times * each
            place += each
        sequence += times
    return rows


SEATS = StructType([StructField("bin", IntegerType()), *[StructField(n, LongType()) for n in
                    ("first", "until", "each", "first_sequence", "first_place")]])


def pack(docs: DataFrame, carry: list[str], tokenizer: str, text: str = "text", capacity: int = CAPACITY,
         end: int = END, name: str = "packing") -> DataFrame:
    """(doc, start, length, doc_tokens, ids_crc32, ids, sequence_id, offset, padded) per piece."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, carry, tokenizer, text, capacity, end), f"{name}-pieces")
    binned = cut.withColumn("bin", F.ceil(F.col("length") / GRID).cast("int"))
    histogram = {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}
    # at most 2 * (capacity / GRID) patterns of at most capacity / GRID bins each: a bounded table
    seats = spark.createDataFrame(seating(patterns(histogram, capacity)), SEATS)
    bucketed = binned.withColumn("spot", F.xxhash64("doc", "start", "ids_crc32")).withColumn("bucket", F.pmod("spot", F.lit(BUCKETS)))
    before = F.sum("count").over(Window.partitionBy("bin").orderBy("bucket")) - F.col("count")
    offsets = bucketed.groupBy("bin", "bucket").count().select("bin", "bucket", before.alias("ahead"))
    within = Window.partitionBy("bin", "bucket").orderBy("spot", "start", "ids_crc32")
    ranked = (bucketed.withColumn("place", F.row_number().over(within) - 1)
              .join(offsets, ["bin", "bucket"]).withColumn("rank", F.col("ahead") + F.col("place")))
    seat = F.col("rank") - F.col("first")
    seated = ranked.join(F.broadcast(seats), "bin").where("rank >= first and rank < until").select(
        "doc", "start", "length", "doc_tokens", "ids_crc32", "ids",
        (F.col("first_sequence") + F.floor(seat / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_place") + seat % F.col("each")).alias("place"))
    sequence = Window.partitionBy("sequence_id")
    total = F.sum("length").over(sequence)
    return seated.select(
        "doc", "start", "length", "doc_tokens", "ids_crc32", "ids", "sequence_id",
        (F.sum("length").over(sequence.orderBy("place")) - F.col("length")).alias("offset"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(capacity)).alias("padded"))
