"""Exact top-k inner products by a Voronoi partition: cells around pivots, bounds from cell summaries, local solutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch, shuffle_partitions


def integers(vector: Column, scale: int) -> Column:
    """Each component as floor(scale * x); null for a vector that is null or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where every partial sum is an exact integer there."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1] < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k best rows of each query, its own id left out, ties to the smaller id; a block of queries at a time."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    for at in range(0, len(queries), 256):
        scores, own = _scores(queries[at : at + 256], rows), query_ids[at : at + 256]
        for q, line in zip(own, scores, strict=True):
            where = np.flatnonzero(ids != q)
            if len(where) > k:
                least = np.partition(line[where], len(where) - k)[len(where) - k]
                where = where[line[where] >= least]
            best = where[np.argsort(-line[where], kind="stable")[:k]]
            out["query_id"].append(np.full(len(best), q))
            out["vec_id"].append(ids[best])
            out["score"].append(line[best])
    return {name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in out.items()}


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    pivots: int | None = None,
    most: int = 32_768,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of is_query the k rows of the highest integer inner product, its own id left out.

    Ties go to the smaller vec_id; a query with fewer candidates gets all. Vectors that are null, or hold a null or
    non-finite component, take no part. Vectors of one length are searched among themselves. Repeated rows of a vec_id count
    once; where they differ, the shortest and then least vector stands for it, a query if any of its rows is. Scaled components and scores must fit 64-bit integers. There are `pivots` cells, by default half the square root of the
    count of vectors, between 16 and 2048. A cell of more than twice the mean size (or `most` rows) is cut into blocks of
    that size, which are the tasks; only pivots and a summary a cell come to the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "voronoi")
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector), scale).alias("x"), is_query.alias("is_query"))
    x = x.filter("vec_id is not null and x is not null and size(x) > 0")
    x = x.groupBy("vec_id").agg(F.min(F.struct(F.size("x").alias("n"), "x"))["x"].alias("x"), F.max("is_query").alias("is_query"))
    x = scratch.save(x, "integers")
    widths = sorted((r["n"], r["count"]) for r in x.groupBy(F.size("x").alias("n")).count().collect())
    found = [_of_width(x.filter(F.size("x") == n), Scratch(spark, f"voronoi-{n}"), n, total, k, pivots, most) for n, total in widths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _of_width(x: DataFrame, scratch: Scratch, width: int, total: int, k: int, pivots: int | None, most: int, per: int = 4096) -> DataFrame:
    """top_k of `total` integer vectors x of one length."""
    spark = x.sparkSession
    pivots = pivots or min(2048, max(16, int(total**0.5) // 2))
    block = min(most, max(256, 2 * total // pivots))
    chosen = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("x").collect()
    centres = np.unique(np.array([r["x"] for r in chosen], np.int64).reshape(-1, width), axis=0)
    shared = spark.sparkContext.broadcast(centres)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest pivot, and its distance from it."""
        p = shared.value.astype(np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("x")).astype(np.float64)
            near = np.argmax(2 * rows @ p.T - (p**2).sum(axis=1), axis=1)
            far = np.sqrt(((rows - p[near]) ** 2).sum(axis=1))
            columns = [batch.column("vec_id"), batch.column("x"), batch.column("is_query"), pa.array(near.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "is_query", "cell", "far"])

    kinds = "vec_id long, x array<long>, is_query boolean, cell int, far double"
    settled = scratch.save(x.mapInArrow(settle, kinds), "settled")
    # A summary row a cell: its size, its radius, and the distances of the k + 1 rows next to the pivot.
    slots = shuffle_partitions(spark)
    nearest = settled.select("cell", "far", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).alias("slot"))
    parts = nearest.groupBy("cell", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("near"))
    summary = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    cells = {r["cell"]: r for r in summary.collect()}
    present = np.array(sorted(cells))
    radius = np.array([cells[c]["radius"] for c in present])
    blocks = np.array([-(-cells[c]["n"] // block) for c in present])
    near_cell = np.concatenate([np.full(len(cells[c]["near"]), i) for i, c in enumerate(present)])
    near_far = np.concatenate([cells[c]["near"] for c in present])
    bounds = spark.sparkContext.broadcast((centres[present].astype(np.float64), present, radius, blocks, near_cell, near_far))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query goes to the blocks of the cells that can hold one of its k best.

        With p a cell's pivot, q.x lies within |q| times x's distance from p around q.p. The distances in the summaries
        promise k scores, the query's own row allowed for; a cell whose upper bound is below the least of these is out.
        """
        p, own, r, parts, cell_of, far = bounds.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("x")).astype(np.float64)
            size = np.sqrt((q**2).sum(axis=1))[:, None]
            middle = q @ p.T
            promised = np.sort(middle[:, cell_of] - size * far, axis=1)
            least = promised[:, -(k + 1)] if promised.shape[1] > k else np.full(len(q), -np.inf)
            slack = 1e-9 * (np.abs(middle) + size * (r + 1))
            at, cell = np.nonzero(middle + size * r + slack >= least[:, None] - 1e-6 * np.abs(least[:, None]))
            at, cell, part = np.repeat(at, parts[cell]), np.repeat(cell, parts[cell]), np.concatenate([np.arange(n) for n in parts[cell]])
            columns = [batch.column("vec_id").take(pa.array(at)), batch.column("x").take(pa.array(at)), pa.array(own[cell].astype(np.int32)), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "cell", "part"])

    n_parts = F.element_at(F.create_map(*[F.lit(int(v)) for c, b in zip(present, blocks, strict=True) for v in (c, b)]), F.col("cell"))
    queries = settled.filter("is_query").select("vec_id", "x").mapInArrow(route, "vec_id long, x array<long>, cell int, part int")
    queries = scratch.save(queries, "routed")
    # The queries of a block come in chunks of about `per`; a row is sent once for each chunk of its own block, and only there.
    chunks = scratch.save(queries.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(per)).cast("int").alias("chunks")), "chunks")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).cast("int")
    queries = queries.join(chunks, ["cell", "part"]).withColumn("chunk", chunk).drop("chunks")
    data = settled.select("vec_id", "x", "cell", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int").alias("part")).join(chunks, ["cell", "part"])
    data = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    keys = ["cell", "part", "chunk"]

    def solve(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in ("query_id", "vec_id", "score")})
        found = _best(q["vec_id"].to_numpy(), np.stack(q["x"].to_numpy()), rows["vec_id"].to_numpy(), np.stack(rows["x"].to_numpy()), k)
        return pd.DataFrame(found)

    local = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
