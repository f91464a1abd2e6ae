"""How filters interact: counting-Bloom duplicate prepass, exact first ids, additive mask counts.

1. One pass over the texts gives a narrow row per document: its part, a mask of the text filters it
   fails (A to D), a digest and a 64-bit hash of the text.
2. `merged_sketch`: every task counts its hashes in blocks of counters that stop at two; the sketches
   of all tasks are added up per block. Blocks grow with the number of rows, `LOAD` counters a row.
3. A text one of whose counters stands at one occurs once: it is cleared. Only the others, possible
   repeats, are read again and shuffled, grouped by their full text for the smallest id of each.
4. Flags meet by digest and id. Rows are summed per (part, mask, labels) first, so a text that a third
   of all rows share is a few rows a task; every number of the report is a sum of mask counts.

Defined cases: a null text is empty, an empty text has no words (it fails A only); a null part is
the empty string. A null id is never smaller than another, and its row never fails E; rows of the
same id and text all count as first. A document is good or toxic if any of its label rows says so;
null labels and labels of unknown ids are left out. An empty table gives no rows. Further columns
are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from idsignal.workspace import stage

FILTERS = "ABCDE"
REPEATS = 1 << FILTERS.index("E")
CELLS = 1 << 16  # counters of a block, in four ranges of which a text takes one each
RANGE_BITS = 14
LOAD = 8
WORDS_64 = CELLS // 64
SKETCH_BYTES = 256 << 20
BLANK = "[\\x20\\x09-\\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(c: Column) -> Column:
        failed = [c["n"] < 50, 100 * c["distinct"] < 65 * c["n"], 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
        return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))

    return F.transform(F.array(counted), bits)[0]


def block_of(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), hashed), F.lit(blocks)).cast("int")


def merged_sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, crowded) from rows (hash): bit c of `crowded` is set if counter c of the block reached two."""

    def count(batches):
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            start = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64) * CELLS
            met = [start + (j << RANGE_BITS) + ((h >> np.uint64(RANGE_BITS * j)) & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64)
                   for j in range(4)]
            joined, place = np.unique(np.concatenate([cells, *met]), return_inverse=True)
            added = np.concatenate([counts, np.ones(4 * len(h), np.int64)])
            cells, counts = joined, np.minimum(np.bincount(place, added, len(joined)).astype(np.int64), 2)
        ends = np.flatnonzero(np.diff(cells // CELLS, append=-1)) + 1 if len(cells) else []
        at = 0
        made = []
        for end in ends:
            some, n = cells[at:end], counts[at:end]
            inside = (some % CELLS).astype("<u2")
            made.append((int(some[0] // CELLS), inside[n == 1].tobytes(), inside[n > 1].tobytes()))
            at = end
        for i in range(0, len(made), 1000):
            block, once, more = zip(*made[i:i + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                                             ["block", "once", "more"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist()):
            total[np.frombuffer(once, "<u2")] += 1
            total[np.frombuffer(more, "<u2")] += 2
        crowded = np.packbits(total > 1, bitorder="little").view("<i8")
        return pa.table({"block": table.column("block").slice(0, 1), "crowded": pa.array([crowded], pa.list_(pa.int64()))})

    sketched = hashes.select("hash", block_of(F.col("hash"), blocks).alias("block")).mapInArrow(count, "block int, once binary, more binary")
    return sketched.groupBy("block").applyInArrow(merge, "block int, crowded array<long>")


def possible() -> Column:
    """Whether all four counters of `hash` in `crowded` reached two."""
    seen = F.lit(True)
    for j in range(4):
        cell = F.shiftrightunsigned("hash", RANGE_BITS * j).bitwiseAND(F.lit((1 << RANGE_BITS) - 1)) + F.lit(j << RANGE_BITS)
        word = F.get("crowded", F.shiftright(cell, 6).cast("int"))
        seen = seen & (F.getbit(word, cell.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return seen


def labelled(labels: DataFrame) -> DataFrame:
    """(key, good, toxic) per labelled id."""
    flags = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg(*flags).withColumn("salt", F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", id_column: str = "doc_id",
                name: str = "audit") -> DataFrame:
    """(part, mask, good, toxic, n): documents per set of failed filters."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    read = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("text"))
    hashed = read.withColumn("hash", F.xxhash64("text"))
    narrow = stage(hashed.select("id", "part", "hash", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask")),
                   f"{name}-narrow")
    blocks = max(1, -(-narrow.count() * LOAD // CELLS))
    sketch = stage(merged_sketch(narrow.select("hash"), blocks), f"{name}-sketch")
    # a block is 8 KB and there is one per 8,192 rows: broadcast only while all of them are small
    sketch = F.broadcast(sketch) if blocks * CELLS // 8 <= SKETCH_BYTES else sketch

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", block_of(F.col("hash"), blocks)).join(sketch, "block")

    firsts = (marked(hashed).where(possible()).groupBy("text").agg(F.min("id").alias("id"))
              .select(F.unhex(F.sha2("text", 256)).alias("digest"), "id", F.lit(True).alias("first")))
    # null ids match no label: dealt out by their hash instead of meeting in one task
    salt = F.when(F.col("id").isNull(), F.pmod("hash", F.lit(256)) + 1).otherwise(F.lit(0)).cast("int")
    rows = marked(narrow).select("id", "part", "mask", "digest", salt.alias("salt"), possible().alias("again"))
    known = labelled(labels).hint("merge")
    rows = rows.join(known, (F.col("id") == F.col("key")) & (rows["salt"] == known["salt"]), "left")
    summed = rows.groupBy(
        F.when(F.col("again"), F.col("digest")).alias("digest"), F.when(F.col("again"), F.col("id")).alias("id"), "part", "mask",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    met = summed.join(firsts, ["digest", "id"], "left")
    repeat = F.col("digest").isNotNull() & F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(repeat, F.lit(REPEATS)).otherwise(F.lit(0))
    return met.groupBy("part", mask.alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of `filters` and step, what the step's filter does there; from `mask_counts`.

    The effect of a filter depends only on the set of filters before it, so sums are made once per
    (part, set before, filter) and then spread over the orders that share them.
    """
    n = len(filters)
    bits = {f: 1 << i for i, f in enumerate(filters)}
    orders: list[list[str]] = [[] for _ in range(n << n)]
    total = 0
    for order in permutations(filters):
        before = 0
        total += 1
        for f in order:
            orders[before * n + filters.index(f)].append("".join(order))
            before |= bits[f]
    places = [{"before": i // n, "filter": i % n} for i, some in enumerate(orders) if some]
    place = F.explode(F.from_json(F.lit(json.dumps(places)), "array<struct<before int, filter int>>"))
    at = counts.select("*", place.alias("at")).select("*", "at.before", "at.filter").withColumn("bit", F.expr("shiftleft(1, filter)"))
    fails, gone = (F.col("mask").bitwiseAND(F.col("bit"))) != 0, (F.col("mask").bitwiseAND(F.col("before"))) != 0
    size = F.bit_count("mask")
    share = F.when(fails, F.col("n") * F.element_at(F.array(*[F.lit(total // k) for k in range(1, n + 1)]), F.greatest(size, F.lit(1))))

    def amount(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    summed = at.groupBy("part", "before", "filter").agg(
        amount(~gone & ~fails).alias("kept"), amount(~gone & fails).alias("removed"), amount(gone & fails).alias("redundant"),
        amount(F.col("mask") == F.col("bit")).alias("unique_fails"), amount(~gone & fails & F.col("good")).alias("good_lost"),
        amount(~gone & fails & F.col("toxic")).alias("toxic_lost"), F.coalesce(F.sum(share), F.lit(0)).cast("long").alias("shapley"))
    spread = F.explode(F.get(F.from_json(F.lit(json.dumps(orders)), "array<array<string>>"), F.col("before") * n + F.col("filter")))
    return summed.select("part", spread.alias("filter_order"), (F.bit_count("before") + 1).cast("int").alias("step"),
                         "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
