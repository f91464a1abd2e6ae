"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut at line breaks and sentence ends into paragraphs (`PIECE` joins up to the text again;
what runs on for 255 bytes is cut there). Each paragraph's digest, mixed with how often it came
before, goes to one cell in each third of a sketch; a cell holds count, sum of digests and sum of
their checks. Subtracting the sketches of two versions leaves the paragraphs in which they differ:
a cell that holds a single one gives it up, which frees others (peeling). If cells are left over,
both versions are sketched again with four times the cells, until all differing digests are out.

The fingerprint of a text is its paragraph count and its sketch of `THIRD` * 3 cells, so equal texts
have equal fingerprints. Likeness is the share of paragraphs that two texts have in common, one less
the differing digests over all: 1 for equal texts (two empty ones too), 0 if none is shared.

Defined cases: a null text is empty and has no paragraphs. Repeated rows are separate documents.
Rows follow each other by falling id, rows of one id by a hash of their text, rows without an id come
last; the last is followed by the first, a single row by itself. Very long texts are read whole;
rows travel in slices of bounded size. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from idsignal.llm.common import packed, text_bytes
from idsignal.workspace import stage

PIECE = re.compile(rb"[^\n.!?]{0,255}[\n.!?]+|[^\n.!?]{1,255}")
THIRD = 8
GROWTH = 4
TRIES = 12  # after that many sizes the digests are compared as they are
SLICE_BYTES = 2 << 20
SEGMENT_BYTES = 128 << 20

CHECK = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of every paragraph; no digest occurs twice within a text."""
    owner, found = [], []
    for i, text in enumerate(texts):
        pieces = PIECE.findall(text)
        owner.append(len(pieces))
        found.extend(map(xxhash.xxh3_64_intdigest, pieces))
    owners, keys = np.repeat(np.arange(len(texts)), owner), np.array(found, np.uint64)
    order = np.lexsort((keys, owners))
    owners, keys = owners[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(fresh)
    before = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    return owners, np.where(before > 0, mixed(keys + before.astype(np.uint64)), keys)


class Sketches:
    """The sketches of a list of texts, one after the other; text i has three parts of `thirds[i]` cells."""

    def __init__(self, owners: np.ndarray, keys: np.ndarray, thirds: np.ndarray, turn: int = 0):
        self.thirds, self.turn = thirds, turn
        self.base = np.concatenate([[0], np.cumsum(3 * thirds)])
        self.count = np.zeros(self.base[-1], np.int32)
        self.keys = np.zeros(self.base[-1], np.uint64)
        self.checks = np.zeros(self.base[-1], np.uint64)
        self.put(owners, keys, np.ones(len(keys), np.int32))

    def put(self, owners: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        signed, checks = signs.astype(np.uint64), mixed(keys ^ CHECK)
        for j in range(3):
            at = self.base[owners] + j * self.thirds[owners]
            at = at + (mixed(keys + np.uint64(3 * self.turn + j + 1)) % self.thirds[owners].astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, signs)
            np.add.at(self.keys, at, keys * signed)
            np.add.at(self.checks, at, checks * signed)

    def minus(self, other: "Sketches") -> "Sketches":
        made = object.__new__(Sketches)
        made.thirds, made.turn, made.base = self.thirds, self.turn, self.base
        made.count, made.keys, made.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return made

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owners, keys, signs) taken out, sign 1 for the first version's; and which texts came out whole."""
        of_cell = np.repeat(np.arange(len(self.thirds)), 3 * self.thirds)
        owners, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        look = np.arange(len(self.count))
        while len(look):
            single = look[np.abs(self.count[look]) == 1]
            sign = self.count[single]
            key = self.keys[single] * sign.astype(np.uint64)
            sound = mixed(key ^ CHECK) == self.checks[single] * sign.astype(np.uint64)
            key, sign, owner = key[sound], sign[sound], of_cell[single[sound]]
            order = np.lexsort((key, owner))
            key, sign, owner = key[order], sign[order], owner[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, sign, owner = key[fresh], sign[fresh], owner[fresh]
            if not len(key):
                break
            self.put(owner, key, -sign)
            owners.append(owner)
            keys.append(key)
            signs.append(sign)
            look = look if len(self.thirds) < 2 else np.flatnonzero(np.isin(of_cell, owner))
        left = np.bincount(of_cell, (self.count != 0) | (self.keys != 0) | (self.checks != 0), len(self.thirds))
        return np.concatenate(owners), np.concatenate(keys), np.concatenate(signs), left == 0

    def text(self, i: int, paragraphs: int) -> str:
        part = slice(self.base[i], self.base[i + 1])
        cells = [self.count[part].astype("<i4"), self.keys[part].astype("<u8"), self.checks[part].astype("<u4")]
        return base64.b64encode(np.int64(paragraphs).astype("<i8").tobytes() + b"".join(c.tobytes() for c in cells)).decode()


class Version:
    """One version of each text of a batch: paragraph digests and, made once, their base sketches."""

    def __init__(self, texts: list[bytes]):
        self.owners, self.keys = digests(texts)
        self.sizes = np.bincount(self.owners, minlength=len(texts))
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.base = Sketches(self.owners, self.keys, np.full(len(texts), THIRD))

    def sketch(self, chosen: np.ndarray, thirds: np.ndarray, turn: int) -> Sketches:
        """Larger sketches of the chosen texts, numbered anew."""
        inside = np.isin(self.owners, chosen)
        return Sketches(np.searchsorted(chosen, self.owners[inside]), self.keys[inside], thirds, turn)

    def fingerprints(self) -> list[str]:
        return [self.base.text(i, int(n)) for i, n in enumerate(self.sizes)]


def differences(old: Version, new: Version) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per text the digests only `old` has, those only `new` has, and how many sketch sizes it took."""
    n = len(old.sizes)
    gone, added, tries = [np.zeros(0, np.uint64)] * n, [np.zeros(0, np.uint64)] * n, np.zeros(n, np.int32)
    todo, third = np.arange(n), THIRD
    for turn in range(TRIES):
        if not len(todo):
            break
        # no more cells than four for each paragraph there is: sizes follow the texts, not only the turns
        thirds = np.minimum(third, np.maximum(THIRD, 4 * (old.sizes + new.sizes)[todo])).astype(np.int64)
        left = old.base.minus(new.base) if not turn else old.sketch(todo, thirds, turn).minus(new.sketch(todo, thirds, turn))
        owners, keys, signs, whole = left.peel()
        order = np.argsort(owners, kind="stable")
        owners, keys, signs = owners[order], keys[order], signs[order]
        cuts = np.searchsorted(owners, np.arange(len(todo) + 1))
        tries[todo] += 1
        for place in np.flatnonzero(whole):
            part = slice(cuts[place], cuts[place + 1])
            gone[todo[place]], added[todo[place]] = keys[part][signs[part] > 0], keys[part][signs[part] < 0]
        todo, third = todo[~whole], third * GROWTH
    for i in todo:
        both = [v.keys[v.ends[i]:v.ends[i + 1]] for v in (old, new)]
        gone[i], added[i] = np.setdiff1d(*both), np.setdiff1d(*both[::-1])
    return gone, added, tries


COMPARED = "array<struct<fingerprint: string, likeness: double, gone: array<long>, added: array<long>, tries: int>>"


def compare(rows: DataFrame, base: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(doc, paragraphs, fingerprint, others) from rows (doc, `base`, `others`), texts as bytes.

    `others` holds, per further version, its fingerprint, its likeness to the base and the digests
    of the paragraphs in which they differ (as signed longs).
    """
    kind = rows.schema["doc"].dataType.simpleString()
    fields = pa.struct([("fingerprint", pa.string()), ("likeness", pa.float64()), ("gone", pa.list_(pa.int64())),
                        ("added", pa.list_(pa.int64())), ("tries", pa.int32())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        first = Version([t or b"" for t in part.column(base).to_pylist()])
        compared: list[list[dict]] = [[] for _ in range(part.num_rows)]
        for name in others:
            other = Version([t or b"" for t in part.column(name).to_pylist()])
            gone, added, tries = differences(first, other)
            for i, print_ in enumerate(other.fingerprints()):
                all_of = int(first.sizes[i] + other.sizes[i])
                like = 1 - (len(gone[i]) + len(added[i])) / all_of if all_of else 1.0
                compared[i].append({"fingerprint": print_, "likeness": like, "gone": gone[i].view(np.int64),
                                    "added": added[i].view(np.int64), "tries": int(tries[i])})
        return pa.RecordBatch.from_arrays([part.column("doc"), pa.array(first.sizes, pa.int64()), pa.array(first.fingerprints()),
                                           pa.array(compared, pa.list_(fields))], ["doc", "paragraphs", "fingerprint", "others"])

    def run(batches):
        for batch in batches:
            for part in bounded(batch, [base, *others]):
                yield work(part)

    return rows.select("doc", base, *others).mapInArrow(run, f"doc {kind}, paragraphs long, fingerprint string, others {COMPARED}")


def bounded(batch: pa.RecordBatch, columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in parts whose texts together hold about `limit` bytes, one row at least."""
    start = held = 0
    for i in range(batch.num_rows):
        held += sum(len(batch.column(c)[i].as_buffer() or b"") if batch.column(c)[i].is_valid else 0 for c in columns)
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


KEY = ["undated", "falling", "tie"]


def followed(docs: DataFrame, carry: list[str], text: str = "text", id_column: str = "doc_id", name: str = "fingerprints") -> DataFrame:
    """(doc, n_chars, text, next, edited): each text, the next row's, and the text with its last half replaced.

    Rows are dealt out by range of their order once, the only shuffle of texts. The first row of a
    range travels a second time, to the end of the range before it, so that each range pairs its
    rows by itself in one ordered pass. Ranges are balanced by Spark's own sampling of the keys; their
    heads, at most one per `SEGMENT_BYTES` of text or a few per core, are all the driver holds.
    """
    spark = docs.sparkSession
    number = F.col(f"`{id_column}`").cast("long")
    body = text_bytes(f"`{text}`")
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"), body.alias("text"), number.isNull().cast("int").alias("undated"),
                       F.coalesce(F.bitwise_not(number), F.lit(0)).alias("falling"), F.xxhash64(body).alias("tie"))
    kind = rows.schema["doc"].dataType.simpleString()
    made = f"doc {kind}, n_chars long, text binary, next binary, edited binary"
    keys = stage(rows.select(*KEY, F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), f"{name}-keys")
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    if not size["n"]:
        return spark.createDataFrame([], made)
    ranges = max(-(-size["bytes"] // SEGMENT_BYTES), min(size["n"], 6 * spark.sparkContext.defaultParallelism))
    found = keys.repartitionByRange(ranges, *KEY).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEY)).alias("head")).collect()
    heads = sorted(tuple(r["head"]) for r in found)
    shared = spark.sparkContext.broadcast(heads)

    def deal(batches):
        heads = shared.value
        first = {h: i for i, h in enumerate(heads)}
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
            segment = [bisect_right(heads, k) - 1 for k in key]
            dealt = batch.append_column("segment", pa.array(segment, pa.int32())).append_column("role", pa.array([0] * len(key), pa.int32()))
            yield dealt
            again = [i for i, k in enumerate(key) if k in first]
            if again:
                before = pa.array([(segment[i] - 1) % len(heads) for i in again], pa.int32())
                copies = batch.take(pa.array(again)).append_column("segment", before)
                yield copies.append_column("role", pa.array([1] * len(again), pa.int32()))

    dealt = rows.mapInArrow(deal, f"doc {kind}, text binary, undated int, falling long, tie long, segment int, role int")
    # a head's copy closes its range: of several equal rows at a head one copy is enough, the others pair with themselves
    ordered = dealt.repartition(len(heads), "segment").sortWithinPartitions("segment", "role", *KEY)

    def pair(batches):
        held = None
        made_rows: list[tuple] = []
        weight = 0
        for batch in batches:
            docs_here = batch.column("doc")
            for i, (body, segment, role) in enumerate(zip(batch.column("text").to_pylist(), batch.column("segment").to_pylist(), batch.column("role").to_pylist())):
                body = body or b""
                if held is not None and held[2] == segment:
                    here, there = held[1].decode("utf-8", "replace"), body.decode("utf-8", "replace")
                    half = len(here) // 2
                    edited = (here[:len(here) - half] + there[:half]).encode()
                    made_rows.append((held[0], len(here), held[1], body, edited))
                    weight += len(held[1]) + len(body) + len(edited)
                held = None if role else (docs_here.slice(i, 1), body, segment)
                if weight >= SLICE_BYTES:
                    yield joined(made_rows)
                    made_rows, weight = [], 0
        if made_rows:
            yield joined(made_rows)

    def joined(some: list[tuple]) -> pa.RecordBatch:
        owner, chars, here, there, edited = zip(*some)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(owner), pa.array(chars, pa.int64()), *[pa.array(c, pa.binary()) for c in (here, there, edited)]],
                                          ["doc", "n_chars", "text", "next", "edited"])

    return ordered.mapInArrow(pair, made)
