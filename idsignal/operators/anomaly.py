"""Isolation-forest anomaly score of event rows.

Spark samples the rows of every tree, grows the trees as grouped tasks and scores
all rows in Arrow batches. Every random draw is a piece of the md5 of its key (row and tree,
or tree and place in it), so that the whole forest can be grown again in SQL. The action is kept as one text column: splitting on
"action equals x" is the same as splitting on a one-hot flag, and needs no
vocabulary on the driver.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from idsignal.functions.numeric import number_or_zero
from idsignal.operators.lookup import lookup
from idsignal.operators.scaling import normalize
from idsignal.workspace import load_or_write, spread, stage

# -- fixed values: model defaults -----------------------------------------------
TREES = 100
SAMPLE = 256
SEED = 42
FLAG_ABOVE = 0.7
SCORE_WEIGHT = 5.0
OTHER_ACTION = "OTHER"

NUMERIC = ["final_risk_score", "ti_score", "hour", "weekday", "is_console"]
ACTION_SPLIT = len(NUMERIC)
LEAF = -1
NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, category string, "
    "left_id int, right_id int, path_length double, sample_size int"
)


def features(rows: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Add cleaned scores, hour, weekday (Monday 0), is_console and action_top."""
    return (
        rows
        .withColumn("final_risk_score", number_or_zero(F.col("final_risk_score")))
        .withColumn("ti_score", number_or_zero(F.col("ti_score")) if "ti_score" in rows.columns else F.lit(0.0))
        .withColumn("hour", F.coalesce(F.hour(ts), F.lit(0)))
        .withColumn("weekday", F.coalesce(F.weekday(ts), F.lit(0)))
        .withColumn("is_console", F.coalesce(F.col("action").ilike("%consolelogin%"), F.lit(False)).cast("int"))
        .withColumn("action_top", F.coalesce("action", F.lit(OTHER_ACTION)))
    )


def action_vocabulary(featured: DataFrame) -> DataFrame:
    """One row per action seen in training."""
    return featured.select("action_top").distinct()


def load_or_fit_vocabulary(path: str, featured: DataFrame) -> DataFrame:
    """The vocabulary saved at `path`, collected and saved first if there is none."""
    return load_or_write(featured.sparkSession, path, "action_top string", lambda: action_vocabulary(featured))


def one_hot(featured: DataFrame, vocabulary: DataFrame, row_id: str) -> DataFrame:
    """Sparse one-hot: `hot_feature` names the single flag that is 1, null for an unseen action."""
    flags = vocabulary.select("action_top", F.concat(F.lit("action_"), "action_top").alias("hot_feature"))
    return lookup(featured, flags, "action_top", row_id)


# -- training -------------------------------------------------------------------


DRAW_DIGITS = 13  # hexadecimal: 52 bits, which a double holds


def _unit(*keys) -> Column:
    """A repeatable draw from [0, 1) per key."""
    digits = F.substring(F.md5(F.concat_ws("-", *[F.col(k) if isinstance(k, str) else k for k in keys]).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16 ** DRAW_DIGITS))


def draw(*keys: int) -> float:
    """`_unit` of numbers."""
    return int(hashlib.md5("-".join(map(str, keys)).encode()).hexdigest()[:DRAW_DIGITS], 16) / 16 ** DRAW_DIGITS


def tree_samples(featured: DataFrame, row_id: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """`sample` rows per tree without replacement, chosen by hash.

    One draw per row cuts the table to a pool of about twice what all trees need;
    each tree then takes the rows of the pool with its smallest draws. Every group
    that reaches one task holds about 2 x `sample` rows whatever the table size.
    """
    wanted = 2 * trees * sample
    total = featured.agg(F.count(F.lit(1))).scalar()
    columns = [row_id, *NUMERIC, "action_top"]
    pool = featured.select(*columns).where(_unit(row_id, F.lit(seed)) * total < wanted)
    draws = (
        pool.withColumn("tree_id", F.explode(F.sequence(F.lit(1), F.lit(trees))))
        .withColumn("_draw", _unit(row_id, F.lit(seed), "tree_id"))
        .where(F.col("_draw") * F.least(total, F.lit(wanted)) < 2 * sample)
    )
    nearest = F.row_number().over(Window.partitionBy("tree_id").orderBy("_draw", row_id))
    return draws.withColumn("_place", nearest).where(F.col("_place") <= sample)


def mean_path(size) -> np.ndarray:
    """Expected path length of an unsuccessful search among `size` rows."""
    size = np.asarray(size, dtype=float)
    many = np.maximum(size, 2.0)
    length = 2.0 * (np.log(many - 1.0) + np.euler_gamma) - 2.0 * (many - 1.0) / many
    return np.where(size <= 1, 0.0, np.where(size == 2, 1.0, length))


def _split(values: np.ndarray, actions: np.ndarray, *place: int):
    """A random split among the features that vary here, or None; drawn by its place."""
    low, high = values.min(axis=0), values.max(axis=0)
    varying = np.flatnonzero(high - low > 1e-7)
    names = np.unique(actions)
    flags = len(names) if len(names) > 1 else 0
    if len(varying) + flags == 0:
        return None
    pick = int(draw(*place, 0) * (len(varying) + flags))
    if pick < len(varying):
        feature = int(varying[pick])
        threshold = float(low[feature] + draw(*place, 1) * (high[feature] - low[feature]))
        return feature, threshold, None, values[:, feature] > threshold
    name = names[pick - len(varying)]
    return ACTION_SPLIT, 0.5, str(name), actions == name


def grow_tree(rows: pd.DataFrame, row_id: str, seed: int) -> pd.DataFrame:
    """Nodes of one isolation tree over one sample."""
    rows = rows.sort_values(row_id)
    tree_id = int(rows["tree_id"].iloc[0])
    values = rows[NUMERIC].to_numpy(dtype=float)
    actions = rows["action_top"].to_numpy(dtype=object).astype(str)
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    # a place counts the root as 1 and the children of place p as 2p and 2p + 1
    nodes, waiting = [], [(0, 1, 0, np.arange(len(rows)))]
    issued = 1
    while waiting:
        node, place, depth, members = waiting.pop()
        split = _split(values[members], actions[members], seed, tree_id, place) if depth < limit and len(members) > 1 else None
        if split is None:
            nodes.append((tree_id, node, LEAF, 0.0, None, node, node, depth + float(mean_path(len(members))), len(rows)))
            continue
        feature, threshold, name, right = split
        nodes.append((tree_id, node, feature, threshold, name, issued, issued + 1, 0.0, len(rows)))
        waiting.append((issued, 2 * place, depth + 1, members[~right]))
        waiting.append((issued + 1, 2 * place + 1, depth + 1, members[right]))
        issued += 2
    return pd.DataFrame(nodes, columns=[part.split()[0] for part in NODE_SCHEMA.split(", ")])


def train_forest(featured: DataFrame, row_id: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Node table of all trees: at most trees x 2 x sample rows."""
    samples = tree_samples(featured, row_id, trees, sample, seed)
    return samples.groupBy("tree_id").applyInPandas(lambda rows: grow_tree(rows, row_id, seed), NODE_SCHEMA)


def load_or_train(path: str, featured: DataFrame, row_id: str, **settings) -> DataFrame:
    """The forest saved at `path`, trained and saved first if there is none."""
    return load_or_write(featured.sparkSession, path, NODE_SCHEMA, lambda: train_forest(featured, row_id, **settings))


# -- scoring --------------------------------------------------------------------


def _pack(nodes: pd.DataFrame) -> dict:
    """All trees in flat arrays; child links become positions in them.

    A row goes right where low < x <= high. For an action split x is the action's
    code and the bounds enclose one code; a leaf encloses nothing and links to itself.
    """
    nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    first = nodes.groupby("tree_id")["node_id"].transform(lambda ids: ids.index[0]).to_numpy()
    names = sorted(nodes["category"].dropna().unique())
    codes = {name: float(code) for code, name in enumerate(names)}
    feature = nodes["feature"].to_numpy()
    code = nodes["category"].map(codes).to_numpy(dtype=float)
    by_action = feature == ACTION_SPLIT
    low = np.where(by_action, code - 0.5, nodes["threshold"].to_numpy())
    return {
        "roots": np.unique(first),
        "depth": int(np.ceil(np.log2(max(nodes["sample_size"].max(), 2)))),
        "feature": np.maximum(feature, 0),
        "low": np.where(feature == LEAF, np.inf, low),
        "high": np.where(by_action, code + 0.5, np.inf),
        "child": np.stack([first + nodes["left_id"].to_numpy(), first + nodes["right_id"].to_numpy()], axis=1).ravel(),
        "length": nodes["path_length"].to_numpy(),
        "codes": codes,
        "unit": float(mean_path(nodes["sample_size"].max())),
    }


def _isolation(forest: dict, values: np.ndarray) -> np.ndarray:
    """2^(-mean path / expected path) for each row of (numeric columns, action code)."""
    width, flat = values.shape[1], np.ascontiguousarray(values).ravel()
    start = np.arange(len(values)) * width
    total = np.zeros(len(values))
    for root in forest["roots"]:
        at = np.full(len(values), root)
        for _ in range(forest["depth"]):
            x = flat[start + forest["feature"][at]]
            right = (x > forest["low"][at]) & (x <= forest["high"][at])
            at = forest["child"][2 * at + right]
        total += forest["length"][at]
    return np.power(2.0, -total / len(forest["roots"]) / max(forest["unit"], 1e-12))


def raw_scores(featured: DataFrame, forest: DataFrame, name: str = "raw_score") -> DataFrame:
    """Add the isolation score; only the bounded node table passes through the driver."""
    packed = featured.sparkSession.sparkContext.broadcast(_pack(forest.toPandas()))

    @F.pandas_udf("double")
    def isolation(numbers: pd.DataFrame, action: pd.Series) -> pd.Series:
        trees = packed.value
        codes = action.map(trees["codes"]).fillna(-1.0)
        return pd.Series(_isolation(trees, numbers[NUMERIC].astype(float).assign(action=codes).to_numpy()))

    return featured.withColumn(name, isolation(F.struct(*NUMERIC), F.col("action_top")))


def anomaly_scores(featured: DataFrame, forest: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns with ml_score (0-1), ml_flag and adjusted_risk_score.

    Raw scores are staged so that the Python scoring runs once although the
    normalisation reads the result twice.
    """
    columns = dict.fromkeys([*keep, "final_risk_score", "raw_score"])
    scored = stage(raw_scores(spread(featured), forest).select(*columns), "raw_scores")
    return (
        normalize(scored, "raw_score", "ml_score")
        .withColumn("ml_flag", (F.col("ml_score") > FLAG_ABOVE).cast("int"))
        .withColumn("adjusted_risk_score", F.col("final_risk_score") + F.col("ml_score") * SCORE_WEIGHT)
        .drop("raw_score")
    )
