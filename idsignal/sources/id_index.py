"""Which ids a store holds already, without scanning them all.

Stored ids lie in `BUCKETS` folders by hash. Beside them every block of about `BLOCK_IDS` ids has a
Bloom filter of 32,768 bits, so an id that was never stored is told from one that may have been by
one row of a small table. Only ids that may be stored are looked up, and only the buckets they fall
into are read. Blocks double (and filters are made again from the ids) when they are full, so the
share of false alarms stays below one in ten thousand however large the store becomes.

Both tables are lists of live parts: a load adds its ids and the filters it changed. A load whose
facts were written and whose ids were not leaves the index short; `rebuild` takes it from the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from idsignal.operators.lookup import fits_broadcast, lookup
from idsignal.streaming.tables import StreamTable
from idsignal.workspace import stage

BUCKETS = 64
BITS = 1 << 15
BLOCK_IDS = BITS // 24
PROBES = 8

IDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("bucket", T.IntegerType())])
FILTERS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("n", T.LongType()),
    T.StructField("blocks", T.LongType()), T.StructField("version", T.LongType())])


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BUCKETS)).cast("int")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks))


def probes(key: Column) -> list[Column]:
    """The bits of an id in its block."""
    hashes = [F.xxhash64(key, F.lit(seed)) for seed in (3, 4)]
    return [F.shiftrightunsigned(hashes[j // 4], 15 * (j % 4)).bitwiseAND(F.lit(BITS - 1)) for j in range(PROBES)]


def may_hold(bits: Column, key: Column) -> Column:
    """Whether all bits of an id are set."""
    seen = F.lit(True)
    for at in probes(key):
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        seen = seen & (F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return seen


def filters_of(ids: DataFrame, blocks: int) -> DataFrame:
    """(block, bits, n) of distinct ids."""
    at = F.explode(F.array(*probes(F.col("id")))).alias("at")
    return (ids.select(block_of(F.col("id"), blocks).alias("block"), at).groupBy("block")
            .agg(F.bitmap_construct_agg("at").alias("bits"), (F.count(F.lit(1)) / PROBES).cast("bigint").alias("n")))


class IdIndex:
    """The index below `path`; it has one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.ids = StreamTable(spark, f"{path}/ids", IDS, partition_by=["bucket"])
        self.filters = StreamTable(spark, f"{path}/filters", FILTERS, ["block"], newest_by="version")

    def size(self) -> tuple[int, int]:
        """Blocks and stored ids."""
        found = self.filters.read().agg(F.max("blocks").alias("blocks"), F.sum("n").alias("n")).first()
        return found["blocks"] or 0, found["n"] or 0

    def hits(self, wanted: DataFrame) -> DataFrame:
        """(id, bucket) of the distinct ids `wanted` that may be stored, as a written table."""
        blocks, _ = self.size()
        if not blocks:
            return wanted.where("false").select("id", bucket_of(F.col("id")).alias("bucket"))
        keyed = wanted.select("id", block_of(F.col("id"), blocks).alias("block"))
        met = lookup(keyed, self.filters.read().select("block", "bits"), "block", "id", "inner")
        return stage(met.where(may_hold(F.col("bits"), F.col("id"))).select("id", bucket_of(F.col("id")).alias("bucket")), "id_hits")

    def candidates(self, hits: DataFrame) -> DataFrame:
        """The stored ids of the buckets that were hit; there are at most `BUCKETS` of them."""
        hit = [r["bucket"] for r in hits.select("bucket").distinct().collect()]
        return self.ids.read().where(F.col("bucket").isin(hit))

    def known(self, wanted: DataFrame) -> DataFrame:
        """Those of the distinct ids `wanted` that are stored."""
        hits = self.hits(wanted)
        small = F.broadcast(hits) if fits_broadcast(hits) else hits
        return self.candidates(hits).join(small.select("id", "bucket"), ["id", "bucket"], "left_semi").select("id")

    def add(self, fresh: DataFrame) -> None:
        """Add ids that are distinct and not stored; `fresh` should be a written table."""
        count = fresh.count()
        if not count:
            return
        version = self.ids.next_batch()
        self.ids.append(fresh.select("id", bucket_of(F.col("id")).alias("bucket")), version)
        self.ids.compact()
        blocks, stored = self.size()
        if stored + count > blocks * BLOCK_IDS:
            self._filter_again(stored + count)
            return
        made = filters_of(fresh, blocks)
        touched = self.filters.read().select("block", "bits", "n").join(made.select("block"), "block", "left_semi")
        both = touched.unionByName(made).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))
        self._store(both, blocks, False)

    def rebuild(self, ids: DataFrame) -> None:
        """Make the index again from all stored ids."""
        listed = ids.select("id").where("id is not null").distinct().select("id", bucket_of(F.col("id")).alias("bucket"))
        self.ids.append(listed, self.ids.next_batch(), instead=True)
        self._filter_again(self.ids.read().count())

    def _filter_again(self, count: int) -> None:
        blocks = 1
        while blocks * BLOCK_IDS < 2 * count:
            blocks *= 2
        self._store(filters_of(self.ids.read().select("id"), blocks), blocks, True)

    def _store(self, rows: DataFrame, blocks: int, instead: bool) -> None:
        version = self.filters.next_batch()
        stamped = rows.withColumn("blocks", F.lit(blocks).cast("bigint")).withColumn("version", F.lit(version).cast("bigint"))
        self.filters.append(stamped, version, instead=instead)
        self.filters.compact()
