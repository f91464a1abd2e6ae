"""Mixing sources to target weights with DataFrame functions only.

1. Sizes per source; targets by filling up to `LIMIT` times a source's size (`source_targets`).
2. Each document hashes into one of its source's blocks (about `BLOCK_WORDS` words, at most
   `SOURCE_BLOCKS` blocks). A source is passed over whole as often as its target allows; of one more
   pass it gives blocks in permuted order until the target is met to the word, the last one in part.
   A taken (pass, block) is a unit; the units of a source are its exact quota.
3. A binary tree splits the quotas of all sources among the output shards. At each node the left
   half's share of every source is a multivariate hypergeometric draw, made source by source
   (`hypergeometric`), so every arrangement of units over shards is equally likely.
4. Each shard takes its quota of every source from that source's permuted units; no unit twice.
   `shuffle_key` orders the rows of a shard at random.

All draws come from hashes of the seed, so reruns agree. A hot source is split over its blocks; the
only lists gathered are a source's blocks (at most `SOURCE_BLOCKS` a pass) and one number per source
in each tree node.

Defined cases: null source is a source, last in order; null or empty text has size 0, takes part in
whole passes with 0 words and is never counted; a source of size 0 has target 0; repeated rows are
separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from idsignal.llm.common import WORD, packed
from idsignal.workspace import stage

LIMIT = 3
WEIGHTS = 3
BLOCK_WORDS = 1 << 16
SOURCE_BLOCKS = 1 << 16
SHARD_UNITS = 64
SHARDS = 4096
SEED = 20


def word_count(column: str = "text") -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(f"`{column}`"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, number, source_size, target, full, rest, blocks): what each source is to give."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("number", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.col("number") % WEIGHTS + 1).withColumn("room", limit * F.col("source_size") / F.col("weight"))
    by_room = Window.orderBy("room", "number")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(limit * F.col("source_size")).over(earlier), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    levels = weighed.withColumn("level", level)
    reached = F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything)
    target = F.least((limit * F.col("source_size")).cast("double"), F.coalesce(reached, F.lit(0.0)) * F.col("weight"))
    whole = F.least(F.round("target").cast("long"), limit * F.col("source_size"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    return (levels.withColumn("target", target).withColumn("words", whole)
            .select("source", "number", "source_size", "target", F.floor(F.col("words") / size).cast("int").alias("full"),
                    (F.col("words") % size).alias("rest"),
                    F.least(F.ceil(size / BLOCK_WORDS), F.lit(SOURCE_BLOCKS)).cast("long").alias("blocks")))


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 8, less the seven factors skipped."""
    z = x + 8.0
    factors = x + 1.0
    for i in range(2, 8):
        factors = factors * (x + float(i))
    return ((z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)) - F.log(factors)


def uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / float(1 << 53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` among `total` are in a draw of `drawn`, by inverting its distribution at u.

    Nine standard deviations around the mean are searched; what lies beyond has a chance below 1e-15.
    """
    size = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * marked / size
    spread = F.sqrt(mean * (1 - marked / size) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - 9 * spread - 1)).cast("long")
    high = F.greatest(low, F.least(drawn, marked, F.ceil(mean + 9 * spread + 1)).cast("long"))

    def weight(k: Column) -> Column:
        return -(log_factorial(k.cast("double")) + log_factorial((marked - k).cast("double"))
                 + log_factorial((drawn - k).cast("double")) + log_factorial((total - marked - drawn + k).cast("double")))

    logs = F.transform(F.sequence(low, high), weight)
    summed = F.aggregate(
        F.transform(F.array(logs), lambda one: F.transform(one, lambda x: F.exp(x - F.array_max(one))))[0],
        F.array().cast("array<double>"),
        lambda done, p: F.concat(done, F.array(F.coalesce(F.element_at(done, F.when(F.size(done) > 0, -1)), F.lit(0.0)) + p)))
    chosen = F.transform(F.array(summed), lambda s: F.size(F.filter(s, lambda c: c < u * F.element_at(s, -1))))[0]
    return F.least(high, low + chosen)


def split_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """(shard, quota): one row (quota: units per source) split into 2 ** levels shards."""
    nodes = quotas.select(F.lit(0).alias("shard"), "quota")
    for level in range(levels):
        sum_of = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
        drawn = nodes.withColumn("total", sum_of).withColumn("wanted", F.shiftright(F.col("total") + F.col("shard") % 2, 1))
        start = F.struct(F.col("total").alias("total"), F.col("wanted").cast("long").alias("wanted"), F.array().cast("array<long>").alias("left"))
        step = lambda a, k: F.struct(
            (a["total"] - k).alias("total"), a["wanted"].alias("wanted"), F.concat(a["left"], F.array(
                hypergeometric(a["total"], k, a["wanted"] - F.aggregate(a["left"], F.lit(0).cast("long"), lambda s, x: s + x),
                               uniform(F.lit(level), F.col("shard"), F.size(a["left"]))))).alias("left"))
        halves = drawn.select("shard", "quota", F.aggregate("quota", start, step)["left"].alias("left")).repartition("shard")
        right = F.zip_with("quota", "left", lambda q, x: q - x)
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quota")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quota")))).alias("half")).select("half.*")
    return nodes


def draw_units(sized: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """(number, block, picks): per block its taken units (pass, shard, words)."""
    blocks = sized.groupBy("number", "block").agg(F.sum("size").alias("words"))
    passes = blocks.join(sources.select("number", "full", "rest"), "number").select(
        "number", "block", "words", "full", "rest", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("pass"))
    order = F.xxhash64(F.lit(SEED), "number", "pass", "block")
    before = Window.partitionBy("number", "pass").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    taken = (passes.withColumn("before", F.when(F.col("pass") == F.col("full"), F.coalesce(F.sum("words").over(before), F.lit(0))))
             .withColumn("words", F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before"))))
             .where("pass < full or (words > 0 and before < rest)"))
    place = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(SEED + 1), "number", "pass", "block"), "pass", "block")
    units = stage(taken.select("number", "block", "pass", "words", (F.row_number().over(place) - 1).cast("long").alias("place")), f"{name}-units")
    counts = units.groupBy("number").agg(F.count("*").alias("units"))
    full = sources.select("number").join(counts, "number", "left").select("number", F.coalesce("units", F.lit(0)).alias("units"))
    quota = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "units"))), lambda s: s["units"]).alias("quota"))
    total = units.count()
    levels = max(0, min(SHARDS, -(-total // SHARD_UNITS)) - 1).bit_length()
    leaves = split_quotas(quota, levels).select("shard", F.posexplode("quota").alias("number", "units"))
    first = F.sum("units").over(Window.partitionBy("number").orderBy("shard")) - F.col("units")
    seats = (leaves.withColumn("first", first).where("units > 0")
             .select("shard", "number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("units") - 1)).alias("place")))
    return (units.join(stage(seats, f"{name}-seats"), ["number", "place"])
            .groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "words"))).alias("picks")))


def mix(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", id_column: str = "doc_id",
        name: str = "mixing") -> DataFrame:
    """(doc, size, source_size, target, taken, picks) per row; `picks` holds (pass, shard, taken)."""
    rows = stage(docs.select(packed(docs.select(*[f"`{c}`" for c in carry])).alias("doc"),
                             F.col(f"`{source}`").cast("string").alias("source"), word_count(text).alias("size"),
                             F.xxhash64(F.lit(SEED), F.col(f"`{id_column}`").cast("string"), F.col(f"`{text}`")).alias("spot")),
                 f"{name}-sized")
    sources = stage(source_targets(rows), f"{name}-sources")
    known = sources.select(F.col("source").alias("name"), "number", "source_size", "target", "blocks")
    sized = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.pmod("spot", "blocks"))
    picked = stage(draw_units(sized.select("number", "block", "size"), sources, name), f"{name}-picks")
    earlier = Window.partitionBy("number", "block").orderBy("spot", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    joined = placed.join(picked, ["number", "block"], "left")
    part = F.transform(F.coalesce("picks", F.array().cast(picked.schema["picks"].dataType)), lambda p: F.struct(
        p["pass"].alias("pass"), p["shard"].alias("shard"),
        F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), p["words"] - F.col("before"))).alias("taken")))
    return (joined.withColumn("picks", part)
            .withColumn("taken", F.aggregate("picks", F.lit(0).cast("long"), lambda a, p: a + p["taken"]))
            .select("doc", "size", "source_size", "target", "taken", "picks"))


def mixed_rows(docs: DataFrame, text: str = "text", length: str | None = "n_chars", source: str = "source",
               id_column: str = "doc_id", name: str = "mixing") -> DataFrame:
    """The mix itself: a row of `docs` per pass that takes it, shard by shard, shuffled within each.

    The document at which a source's target is met is cut after its last taken word.
    """
    chosen = mix(docs, docs.columns, text, source, id_column, name)
    rows = (chosen.select("doc", "size", F.explode("picks").alias("pick")).where("pick.taken > 0")
            .withColumn("shuffle_key", F.xxhash64(F.lit(SEED + 2), "pick.shard", "pick.pass", "doc"))
            .repartition("pick.shard").sortWithinPartitions("pick.shard", "shuffle_key"))
    words = F.regexp_extract_all(F.col(f"doc.`{text}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, 1, F.col("pick.taken").cast("int")), "")
    whole = F.col("pick.taken") >= F.col("size")
    columns = []
    for field in docs.schema:
        value = F.col(f"doc.`{field.name}`")
        if field.name == text:
            value = F.when(whole, value).otherwise(cut)
        elif field.name == length:
            value = F.when(whole, value).otherwise(F.char_length(cut)).cast(field.dataType)
        columns.append(value.alias(field.name))
    return rows.select(*columns)
