"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; per segment its mean m and deviation s are kept. Of two
vectors the inner product is at most the sum over segments of n * (m m' + s s'), by Cauchy and
Schwarz on the centred parts: minus that is a lower bound of the distance -<q, x>, and it
tightens from level to level. A query first scores a few rows with the best coarse bounds exactly;
their k-th score is the mark that the other rows must reach, level by level; survivors are scored
exactly in integers.

Queries and rows meet in a grid: rows in groups of about `GROUP_ROWS` by hash of their id, queries
in blocks of about `QUERY_ROWS`; each cell gives k rows a query at most, merged per query. A cell's
size does not depend on the size of the table, and no key holds more than a cell.

Defined cases: vectors null or holding null or non-finite components, and rows without an id, take
no part; only vectors of one length meet; equal rows (id and vector) count once; rows with the
query's id are never its results; ties go to the smaller id. Scores must fit 64 bits, else the job
fails rather than give a wrong rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from idsignal.workspace import stage

K = 10
GROUP_ROWS = 8192
QUERY_ROWS = 8192
SEEDS = 4


def quantised(column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, null if the vector takes no part."""
    values = F.transform(F.col(f"`{column}`"), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(f"`{column}`").isNotNull() & ~bad, F.transform(values, lambda x: F.floor(x * scale)))


def levels(dims: int) -> list[int]:
    """Segments per level, coarse to fine, each half a segment's length down to four components."""
    out = [1]
    while dims // (2 * out[-1]) >= 4:
        out.append(2 * out[-1])
    return out


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(n) * mean and sqrt(n) * deviation, so that a bound is an inner product."""
    edges = [vectors.shape[1] * i // segments for i in range(segments + 1)]
    parts = []
    for a, b in zip(edges, edges[1:]):
        some = vectors[:, a:b].astype(float)
        mean = some.mean(1)
        parts += [mean * np.sqrt(b - a), np.sqrt(((some - mean[:, None]) ** 2).sum(1))]
    return np.column_stack(parts)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K):
    """(query index, row index, score) of each query's k best rows of other ids."""
    dims = rows.shape[1]
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dims, 1)
    if reach >= 2.0 ** 62:
        raise OverflowError("inner products of these vectors need more than 64 bits")
    if not dims:
        steps = []
    else:
        steps = [(statistics(queries, n), statistics(rows, n)) for n in levels(dims)]
    slack = 1e-9 * reach + 1e-6
    for i in range(len(queries)):
        alive = np.flatnonzero(row_ids != query_ids[i])
        if steps and len(alive) > SEEDS * k:
            bound = np.einsum("ij,j->i", steps[0][1], steps[0][0][i])[alive]
            seeds = alive[np.argpartition(-bound, SEEDS * k)[:SEEDS * k]]
            mark = np.sort(np.einsum("ij,j->i", rows[seeds], queries[i]))[-k] - slack
            alive = alive[bound >= mark]
            for query_side, row_side in steps[1:]:
                alive = alive[np.einsum("ij,j->i", row_side[alive], query_side[i]) >= mark]
        scores = np.einsum("ij,j->i", rows[alive], queries[i]) if dims else np.zeros(len(alive), np.int64)
        best = np.lexsort((row_ids[alive], -scores))[:k]
        yield i, alive[best], scores[best]


def top_k(table: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K,
          scale: int = 1024, name: str = "topk") -> DataFrame:
    """(query_id, rank, row_id, score): the k best rows of every query row, among rows of other ids."""
    base = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), quantised(vector, scale).alias("vector"),
                        F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = stage(base.where("id is not null and vector is not null").distinct(), f"{name}-rows")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries")).first()
    groups, blocks = max(1, -(-counts["rows"] // GROUP_ROWS)), max(1, -(-counts["queries"] // QUERY_ROWS))
    spot = F.xxhash64("id", "vector")
    sent_rows = rows.select("id", "vector", F.lit(False).alias("asks"), F.pmod(spot, F.lit(groups)).cast("int").alias("group"),
                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent_queries = rows.where("is_query").select("id", "vector", F.lit(True).alias("asks"),
                                                 F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
                                                 F.pmod(spot, F.lit(blocks)).cast("int").alias("block"))
    dealt = sent_rows.unionAll(sent_queries).repartition(groups * blocks, "group", "block").sortWithinPartitions("group", "block")

    def settle(parts: list[pa.RecordBatch]):
        cell = pa.Table.from_batches(parts)
        ids, asks = cell.column("id").to_numpy(), cell.column("asks").to_numpy()
        column = cell.column("vector").combine_chunks()
        sizes = np.array([len(v) for v in column], np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for dims in np.unique(sizes[asks]).tolist():
            who = np.flatnonzero(sizes == dims)
            matrix = flat[start[who][:, None] + np.arange(dims)].astype(np.int64).reshape(len(who), dims)
            q, d = asks[who], ~asks[who]
            out = []
            for i, found, scores in search(matrix[q], ids[who][q], matrix[d], ids[who][d], k):
                number = zlib.crc32(matrix[q][i].tobytes())
                out += [(int(ids[who][q][i]), number, int(r), int(s)) for r, s in zip(ids[who][d][found], scores)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "number", "row_id", "score"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            group, block = batch.column("group").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if key != (group[a], block[a]) and held:
                    yield from settle(held)
                    held = []
                key = (group[a], block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(held)

    found = dealt.mapInArrow(run, "query_id long, number long, row_id long, score long")
    best = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")
