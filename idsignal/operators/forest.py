"""Random forest of a few 0-1 inputs, grown and applied by groupings and joins.

Inputs are cut into `BINS` equal bins, so rows fall into cells, one per combination of bins. A tree
sees only how often each class occurs in each cell; it grows level by level, all trees at once, from
histograms per (tree, node, input, bin). Each row is weighed per tree by a draw (a bootstrap), each
node tries `TRIED` inputs, and the split with the highest sum of squared class counts over their size,
which is the lowest Gini impurity, wins; ties go to the first input and the lowest bin. Draws are
pieces of an md5 and all counts are whole numbers, so the forest is the same on every cluster and SQL
can grow it again.

A node's children are 2n (bin at most the split's) and 2n + 1; the root is 1. Scoring walks each
distinct cell once, level by level, through the node table, and rows take their cell's result. The
node table holds at most trees x 2^(depth + 1) rows whatever the input, so it may be broadcast.

Defined cases: inputs outside 0-1 count as the nearest end, null ones as 0; rows without a label or id are not
learned from; with nothing to learn from all shares are 0 and the class is 0.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from idsignal.operators.lookup import lookup
from idsignal.workspace import load_or_write, stage

# -- fixed values: model settings -----------------------------------------------
BINS = 32
TREES = 100
DEPTH = 10
TRIED = 2  # inputs tried at a node
FIT_PARTS = 16  # tasks that draw weights, one per row and tree
SEED = 42
CLASSES = 4
LEAST_GAIN = 1e-6
SHARE_UNITS = 1_000_000_000  # class shares of leaves are whole numbers of this part
DRAW_DIGITS = 13
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]

COUNTS = [f"n{c}" for c in range(CLASSES)]
NODE_SCHEMA = "tree int, node int, input int, bin int, " + ", ".join(f"{n} long" for n in COUNTS)


def draw(*keys) -> Column:
    """A repeatable draw from [0, 1) per key."""
    digits = F.substring(F.md5(F.concat_ws("-", *[F.col(k) if isinstance(k, str) else F.lit(k) for k in keys]).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16 ** DRAW_DIGITS))


def binned(inputs: list[str]) -> Column:
    """The bin of each input, as one array."""
    return F.array(*[
        F.coalesce(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col(i) * BINS).cast("int"))), F.lit(0)) for i in inputs])


def squares(counts: list[Column]) -> Column:
    """Sum of squared counts over their sum."""
    total = sum(counts[1:], counts[0])
    return sum([c * c for c in counts[1:]], counts[0] * counts[0]).cast("double") / total.cast("double")


def bootstrap_cells(rows: DataFrame, row_id: str, inputs: list[str], label: str, trees: int, seed: int) -> DataFrame:
    """(tree, cell, n0..): how often each class occurs in each cell, by the rows' weights in the tree."""
    # an array of one, so that the draw is made once and not per edge
    weight = F.transform(F.array(draw(seed, row_id, "tree")), lambda drawn: sum(
        [(drawn >= edge).cast("long") for edge in POISSON[1:]], (drawn >= POISSON[0]).cast("long")))
    weighed = (
        rows.where(F.col(row_id).isNotNull() & F.col(label).isNotNull())
        .select(row_id, binned(inputs).alias("cell"), F.col(label).cast("int").alias("label"))
        .repartition(FIT_PARTS, row_id)
        .withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("weight", F.explode(weight)).where("weight > 0")
    )
    return weighed.groupBy("tree", "cell").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0)).alias(n) for c, n in enumerate(COUNTS)])


def walk(placed: DataFrame, splits: DataFrame) -> DataFrame:
    """One level down: rows (tree, node, cell, ...) whose node splits move to a child, others stay."""
    moved = F.col("node") * 2 + (F.get("cell", F.col("input")) > F.col("bin")).cast("int")
    found = splits.select("tree", "node", "input", "bin")
    return (
        placed.join(F.broadcast(found), ["tree", "node"], "left")
        .withColumn("node", F.when(F.col("input").isNull(), F.col("node")).otherwise(moved)).drop("input", "bin")
    )


def best_splits(placed: DataFrame, width: int, tried: int, seed: int) -> DataFrame:
    """(tree, node, input, bin): the best split of each node that gains by one."""
    order = F.array_sort(F.array(*[F.struct(draw(seed, "tree", "node", i).alias("at"), F.lit(i).alias("input")) for i in range(width)]))
    asked = placed.select("tree", "node").distinct().withColumn("input", F.explode(F.slice(order, 1, tried)["input"]))
    histogram = (
        placed.join(F.broadcast(asked), ["tree", "node"]).withColumn("bin", F.get("cell", F.col("input")))
        .groupBy("tree", "node", "input", "bin").agg(*[F.sum(n).alias(n) for n in COUNTS])
    )
    whole = Window.partitionBy("tree", "node", "input")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = histogram.select("tree", "node", "input", "bin", *[F.sum(n).over(below).alias(f"l{n}") for n in COUNTS],
                              *[F.sum(n).over(whole).alias(f"t{n}") for n in COUNTS])
    left, total = [F.col(f"l{n}") for n in COUNTS], [F.col(f"t{n}") for n in COUNTS]
    right = [t - part for t, part in zip(total, left)]
    scored = summed.where(sum(right[1:], right[0]) > 0).withColumn("score", squares(left) + squares(right))
    return (
        scored.where(F.col("score") > squares(total) + LEAST_GAIN)
        .groupBy("tree", "node").agg(F.max_by(F.struct("input", "bin"), F.struct("score", -F.col("input"), -F.col("bin"))).alias("best"))
        .select("tree", "node", "best.input", "best.bin")
    )


def grow(rows: DataFrame, row_id: str, inputs: list[str], label: str, trees: int = TREES, depth: int = DEPTH,
         tried: int = TRIED, seed: int = SEED, name: str = "forest") -> DataFrame:
    """The node table of a forest fitted on all `rows`; leaves have no input (runs two jobs per level)."""
    cells = stage(bootstrap_cells(rows, row_id, inputs, label, trees, seed), f"{name}-cells")
    placed, levels = cells.withColumn("node", F.lit(1)), []
    for level in range(depth):
        # nodes that did not split a level ago find no split now either: same cells, same draws
        levels.append(stage(best_splits(placed.where(F.col("node") >= 1 << level), len(inputs), tried, seed), f"{name}-splits"))
        placed = stage(walk(placed, levels[-1]), f"{name}-placed")
    splits = reduce(DataFrame.unionByName, levels)
    leaves = placed.groupBy("tree", "node").agg(*[F.sum(n).alias(n) for n in COUNTS])
    return leaves.select(
        "tree", "node", F.lit(None).cast("int").alias("input"), F.lit(None).cast("int").alias("bin"), *COUNTS,
    ).unionByName(splits, allowMissingColumns=True)


def load_or_grow(path: str, rows: DataFrame, row_id: str, inputs: list[str], label: str, **settings) -> DataFrame:
    """The node table saved at `path`, grown and saved first if there is none."""
    return load_or_write(rows.sparkSession, path, NODE_SCHEMA, lambda: grow(rows, row_id, inputs, label, **settings))


def cell_shares(cells: DataFrame, nodes: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(cell, shares): per class the sum over trees of its share in the leaf a cell falls into, in `SHARE_UNITS`."""
    splits = nodes.where("input is not null")
    placed = cells.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("node", F.lit(1))
    for _ in range(depth):
        placed = walk(placed, splits)
    total = sum([F.col(n) for n in COUNTS[1:]], F.col(COUNTS[0]))
    leaves = nodes.where("input is null").select(
        "tree", "node", *[F.expr(f"{n} * {SHARE_UNITS}L div ({' + '.join(COUNTS)})").alias(n) for n in COUNTS])
    return (
        placed.join(F.broadcast(leaves), ["tree", "node"], "left").groupBy("cell")
        .agg(F.array(*[F.coalesce(F.sum(n), F.lit(0)) for n in COUNTS]).alias("shares"))
    )


def class_shares(rows: DataFrame, nodes: DataFrame, row_id: str, inputs: list[str], trees: int = TREES, depth: int = DEPTH,
                 name: str = "forest") -> DataFrame:
    """`rows` with `shares`, the summed class shares of their cell; `rows` is read twice."""
    found = stage(cell_shares(rows.select(binned(inputs).alias("cell")).distinct(), nodes, trees, depth), f"{name}-shares")
    return lookup(rows.withColumn("cell", binned(inputs)), found, "cell", row_id).drop("cell")
