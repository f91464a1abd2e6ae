"""SimHash near-duplicates by anchor-point covering.

Fingerprint: lower-case A-Z, words, shingles of `shingle` words joined by a space (a shorter text:
all its words), XXH64 with seed 42 of each shingle, repeats included; a bit is set if it is set in
more than half of the hashes. No words: fingerprint 0, linked like any other.

Covering: the 64 bits are cut into `blocks` runs of n bits. The anchors are the words that are
constant on every run, a covering code of radius n // 2 per run. A fingerprint belongs to the
anchor nearest to it (ties to 0), and it is copied to every anchor that a fingerprint within
`distance` bits of it can belong to: those within covering radius plus `distance` that pass the
same test run by run. So of two fingerprints within `distance` bits, the one meets the other at its
own anchor, whatever the code; the code only sets how many copies there are and how many
fingerprints an anchor holds. `blocks` grows with the logarithm of the number of fingerprints.

Skew: equal fingerprints travel once. An anchor with more than `CELL` members or copies is cut into
a grid of cells (members by copies); each cell compares its share. A cell gives a spanning forest
of its links, never all pairs, and components are found by joins (`components.roots`).

Defined cases: null text counts as empty; a null id takes part but never names a component unless
all ids in it are null (then null); repeated rows and ids each get a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from idsignal.llm.common import map_batches, packed, text_bytes
from idsignal.llm.components import roots
from idsignal.workspace import stage

SHINGLE = 3
DISTANCE = 2
ANCHOR_ROWS = 64
CELL = 50_000
PAIRS = 1 << 22
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        grams = [joined[a:b] for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp) per row; `doc` is a struct of the carried columns."""
    rows = docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"), text_bytes(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(prints, pa.int64())], ["doc", "fp"])

    return map_batches(rows, work, f"doc {rows.schema['doc'].dataType.simpleString()}, fp long")


def cut_bits(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of `blocks` runs that cover 64 bits, as even as can be."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def anchors(prints: np.ndarray, blocks: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For signed prints: (index, anchor, own) of each copy; anchors are numbered by their runs' bits."""
    values = prints.view(np.uint64)
    home = np.zeros(len(values), np.int64)
    cost = np.empty((len(values), blocks), np.int8)
    for j, (first, bits) in enumerate(cut_bits(blocks)):
        weight = np.bitwise_count((values >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int8)
        high = weight > bits // 2
        home |= high.astype(np.int64) << j
        cost[:, j] = np.where(high, weight - bits // 2, bits // 2 + 1 - weight)
    index, anchor = [np.arange(len(values))], [home]
    held = [(np.arange(len(values)), home, np.zeros(len(values), np.int64), np.full(len(values), -1))]
    for _ in range(distance):  # flip one more run, later than the last one flipped
        grown = []
        for rows, at, spent, last in held:
            for j in range(blocks):
                ok = (last < j) & (spent + cost[rows, j] <= distance)
                if ok.any():
                    grown.append((rows[ok], at[ok] ^ (1 << j), spent[ok] + cost[rows[ok], j], np.full(ok.sum(), j)))
        held = grown
        index += [g[0] for g in grown]
        anchor += [g[1] for g in grown]
    index, anchor = np.concatenate(index), np.concatenate(anchor)
    own = np.zeros(len(index), bool)
    own[:len(values)] = True
    return index, anchor, own


def blocks_for(prints: int, anchor_rows: int = ANCHOR_ROWS) -> int:
    return min(40, max(4, math.ceil(math.log2(max(prints, 1) / anchor_rows + 1))))


def _copies(batch: pa.RecordBatch, blocks: int, distance: int):
    prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
    for part in range(0, len(prints), 4096):
        some = prints[part:part + 4096]
        index, anchor, own = anchors(some, blocks, distance)
        yield some[index], anchor, own


def copies(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(anchor, fp, own) of every copy of every fingerprint."""

    def run(batches):
        for batch in batches:
            for fp, anchor, own in _copies(batch, blocks, distance):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp), pa.array(own)], ["anchor", "fp", "own"])

    return prints.select("fp").mapInArrow(run, "anchor long, fp long, own boolean")


def crowded(prints: DataFrame, blocks: int, distance: int, cell: int = CELL) -> DataFrame:
    """(anchor, rows, cols): anchors whose members or copies fill more than one cell."""

    def run(batches):
        for batch in batches:
            for _, anchor, own in _copies(batch, blocks, distance):
                keys, place = np.unique(anchor, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.bincount(place, own).astype(np.int64)), pa.array(np.bincount(place))],
                    ["anchor", "members", "copies"])

    return (prints.select("fp").mapInArrow(run, "anchor long, members long, copies long")
            .groupBy("anchor").agg(F.sum("members").alias("members"), F.sum("copies").alias("copies"))
            .where((F.col("members") > cell) | (F.col("copies") > cell))
            .select("anchor", F.ceil(F.col("members") / cell).cast("int").alias("rows"),
                    F.ceil(F.col("copies") / cell).cast("int").alias("cols")))


class Forest:
    """Union-find over fingerprints that remembers the links that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(anchor: np.ndarray, cell: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int):
    """Links of rows sorted by (anchor, cell): each member against each copy of its cell."""
    edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1]))))
    sizes = np.diff(np.append(edge, len(anchor)))
    member = np.flatnonzero(own & np.repeat(sizes > 1, sizes))
    first, size = np.repeat(edge, sizes)[member], np.repeat(sizes, sizes)[member]
    done = 0
    while done < len(member):
        take = max(1, int(np.searchsorted(np.cumsum(size[done:]), PAIRS)))
        left = np.repeat(member[done:done + take], size[done:done + take])
        offsets = np.arange(len(left)) - np.repeat(np.cumsum(size[done:done + take]) - size[done:done + take], size[done:done + take])
        right = np.repeat(first[done:done + take], size[done:done + take]) + offsets
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= distance
        near &= fp[left] < fp[right]
        yield fp[left[near]], fp[right[near]]
        done += take


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """(u, v): links between different fingerprints that keep every component whole."""
    blocks = blocks or blocks_for(prints.count())
    hot = stage(crowded(prints, blocks, distance, cell), "simhash-crowded")
    spot = F.pmod(F.xxhash64("fp"), F.lit(1 << 40))
    rows, cols = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1))
    row, col = F.pmod(spot, rows), F.pmod(F.shiftright(spot, 20), cols)
    # a member goes to every column of its row, a copy to every row of its column; both say which they are
    as_member = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.struct((row * cols + c).cast("int").alias("cell"), F.lit(True).alias("own"))))
    as_copy = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.struct((r * cols + col).cast("int").alias("cell"), F.lit(False).alias("own")))
    spread = copies(prints, blocks, distance).join(hot, "anchor", "left")
    plain = spread.where("rows is null").select("anchor", F.lit(0).alias("cell"), "fp", "own")
    cut = (spread.where("rows is not null")
           .select("anchor", "fp", F.explode(F.concat(F.coalesce(as_member, F.array().cast("array<struct<cell:int,own:boolean>>")), as_copy)).alias("at"))
           .select("anchor", "at.cell", "fp", "at.own"))
    placed = plain.unionAll(cut).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")

    def run(batches):
        held: list[np.ndarray] = []
        rows_held = 0

        def flush(parts):
            anchor, at, fp, own = (np.concatenate(x) for x in zip(*parts))
            forest = Forest()
            for left, right in _compare(anchor, at, fp, own, distance):
                kept = [(a, b) for a, b in zip(left.tolist(), right.tolist()) if forest.link(a, b)]
                if kept:
                    yield pa.RecordBatch.from_pylist([{"u": a, "v": b} for a, b in kept])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "fp", "own")]
            if not len(columns[0]):
                continue
            held.append(columns)
            rows_held += len(columns[0])
            anchor, at = columns[0], columns[1]
            breaks = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1]))
            if rows_held >= 200_000 and len(breaks):
                cut_at = breaks[-1] + 1
                held[-1] = [c[:cut_at] for c in columns]
                yield from flush(held)
                held = [[c[cut_at:] for c in columns]]
                rows_held = len(held[0][0])
        if rows_held:
            yield from flush(held)

    return placed.mapInArrow(run, "u long, v long").distinct()


def group(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
          id_column: str = "doc_id", name: str = "simhash") -> DataFrame:
    """(doc, fp, component): every row with its fingerprint and the smallest id it reaches."""
    marked = stage(fingerprints(docs, carry, text, shingle), f"{name}-prints")
    distinct = stage(marked.groupBy("fp").agg(F.min(f"doc.{id_column}").alias("least")), f"{name}-distinct")
    root = stage(roots(links(distinct, distance), name), f"{name}-roots")
    rooted = stage(distinct.join(root, distinct["fp"] == root["node"], "left")
                   .select("fp", "least", F.coalesce("root", "fp").alias("root")), f"{name}-rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component")), f"{name}-least")
    named = stage(rooted.join(least, "root").select("fp", "component", "root"), f"{name}-named")
    return marked.join(named, "fp").select("doc", "fp", "root", "component")


def hex_digits(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
             id_column: str = "doc_id", name: str = "simhash") -> DataFrame:
    """`docs` with one row of each group: smallest id (nulls last), then an arbitrary one of equal ids."""
    numbered = stage(docs.select(packed(docs).alias("row")).withColumn("number", F.monotonically_increasing_id()), f"{name}-rows")
    plain = numbered.select("number", F.col(f"row.`{id_column}`").alias("id"), F.col(f"row.`{text}`").alias("words"))
    groups = stage(group(plain, ["id", "number"], "words", shingle, distance, "id", name)
                   .select("root", F.struct(F.col("doc.id").isNull().alias("unknown"), "doc.id", "doc.number").alias("rank")), f"{name}-groups")
    chosen = groups.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.number")
    return numbered.join(chosen, "number", "left_semi").select("row.*")
