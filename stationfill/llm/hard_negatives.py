"""Hard negatives by a pivot table: inner products as distances of augmented vectors, bracketed by stored distances from pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch
from stationfill.llm.voronoi import integers

_FOUND = "query_id long, slot long, vec_id long, score long"


class PivotTable:
    """Rows x of one length become (x, sqrt(M - |x|^2)) with M the largest |x|^2, queries q become (q, 0).

    Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so bounds of the distance from the triangle inequality over pivots are bounds of
    the score. The first `references` pivots, chosen far apart, have stored distances for each row; each row belongs to the
    cell of the nearest of all pivots.
    """

    def __init__(self, sample: np.ndarray, largest: int, references: int):
        self.largest = float(largest)
        points = self.rows_of(np.unique(sample, axis=0))
        chosen, gap = [0], np.full(len(points), np.inf)
        while len(chosen) < min(references, len(points)):
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(gap.argmax()))
        rest = np.setdiff1d(np.arange(len(points)), chosen)
        self.points, self.references = points[np.concatenate([chosen, rest]).astype(int)], len(set(chosen))
        self.norms = (self.points**2).sum(axis=1)

    def rows_of(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.largest - (x**2).sum(axis=1, keepdims=True)))])

    @staticmethod
    def queries_of(q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.hstack([q, np.zeros((len(q), 1))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        own = (points**2).sum(axis=1, keepdims=True)
        return np.sqrt(np.maximum(0.0, own + self.norms - 2 * points @ self.points.T))

    def slack(self, q: np.ndarray) -> np.ndarray:
        """Room for rounding in a query's bounds of scores: a distance near 0 is right to the square root of its rounding."""
        return 1e-6 * ((q.astype(np.float64) ** 2).sum(axis=1) + self.largest) + 1e-6

    def scores(self, q: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """Scores of distances: rows of `squared` belong to the queries."""
        own = (q.astype(np.float64) ** 2).sum(axis=1)
        return (own[:, None] + self.largest - squared) / 2


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where every partial sum is an exact integer there."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _local(table: PivotTable, queries: pd.DataFrame, rows: pd.DataFrame, k: int, same_label: bool) -> pd.DataFrame:
    """The k best rows of each query in one block: pivot distances bracket the scores, survivors are checked exactly."""
    out: dict[str, list] = {n: [] for n in ("query_id", "slot", "vec_id", "score")}
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, labels, x = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order], np.stack(rows["x"].to_numpy())[order]
    stored = np.stack(rows["far"].to_numpy())[order]
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        q, own, slots = np.stack(part["x"].to_numpy()), part["query_id"].to_numpy(), part["slot"].to_numpy()
        low, high = part["low"].to_numpy()[:, None], part["high"].to_numpy()[:, None]
        alive = (part["label"].to_numpy()[:, None] == labels) == same_label
        alive &= own[:, None] != ids
        far, room = table.distances(table.queries_of(q))[:, : table.references], table.slack(q)[:, None]
        # A distance in [sqrt(reach of high), sqrt(reach of low)] is wanted; every pivot gives |a - b| <= d <= a + b.
        reach = 2 * table.scores(q, np.zeros((len(q), 1)))
        most = np.sqrt(np.maximum(0.0, reach - 2 * low.astype(np.float64) + 2 * room))
        least = np.sqrt(np.maximum(0.0, reach - 2 * high.astype(np.float64) - 2 * room))
        for p in range(table.references):
            a, b = far[:, p : p + 1], stored[:, p]
            alive &= (np.abs(a - b) <= most) & (a + b >= least)
        some = np.flatnonzero(alive.any(axis=0))
        if not len(some):
            continue
        scores, alive = _inner(q, x[some]), alive[:, some]
        alive &= (scores >= low) & (scores <= high)
        for i in np.flatnonzero(alive.any(axis=1)):
            where = np.flatnonzero(alive[i])
            line = scores[i][where]
            if len(where) > k:
                cut = np.partition(line, len(line) - k)[len(line) - k]
                where, line = where[line >= cut], line[line >= cut]
            best = np.argsort(-line, kind="stable")[:k]
            out["query_id"].append(np.full(len(best), own[i]))
            out["slot"].append(np.full(len(best), slots[i]))
            out["vec_id"].append(ids[some[where[best]]])
            out["score"].append(line[best])
    return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()})


class Search:
    """Rows of one length, in cells with a pivot table, to search for the best scores in a range among rows of the same or of another label."""

    def __init__(self, x: DataFrame, scratch: Scratch, total: int, references: int = 16, most: int = 32_768, per: int = 4096):
        self.spark, self.scratch, self.per, self.runs = x.sparkSession, scratch, per, 0
        pivots = min(2048, max(16, int(total**0.5) // 2))
        sample = np.array([r["x"] for r in x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("x").collect()], np.int64)
        norm = F.aggregate("x", F.lit(0).cast("long"), lambda acc, v: acc + v * v)
        table = PivotTable(sample, x.agg(F.max(norm)).first()[0], references)
        self.table = self.spark.sparkContext.broadcast(table)
        shared = self.table

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each row's cell, and its distances from the reference pivots and from its own."""
            t = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = t.distances(t.rows_of(_matrix(batch.column("x"))))
                cell = d.argmin(axis=1)
                stored = np.hstack([d[:, : t.references], d[np.arange(len(d)), cell][:, None]])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "x")], pa.array(cell.astype(np.int32)), pa.array(list(stored), pa.list_(pa.float64()))], names=["vec_id", "label", "x", "cell", "far"])

        self.rows = scratch.save(x.select("vec_id", "label", "x").mapInArrow(settle, "vec_id long, label int, x array<long>, cell int, far array<double>"), "rows")
        # A summary row a cell, at most 2048 of them: its size, and the range of each stored distance.
        width = table.references + 1
        ranges = [f(F.col("far")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("a", F.min), ("b", F.max))]
        cells = sorted(self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ranges).collect(), key=lambda r: r["cell"])
        self.present = np.array([r["cell"] for r in cells])
        lows, highs = (np.array([[r[f"{n}{i}"] for i in range(width)] for r in cells]) for n in "ab")
        size = min(most, max(256, 2 * total // pivots))
        self.blocks = np.array([-(-r["n"] // size) for r in cells])
        self.summary = self.spark.sparkContext.broadcast((self.present, lows, highs, self.blocks))

    def _routed(self, queries: DataFrame, home: bool) -> DataFrame:
        """Queries (query_id, slot, label, x, low, high) with the blocks that they go to: those of the nearest cell, or those of all others that can hold a score in the range."""
        table, summary = self.table, self.summary

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = table.value
            cells, lows, highs, blocks = summary.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("x"))
                d = t.distances(t.queries_of(q))
                nearest = d[:, cells].argmin(axis=1)
                if home:
                    hit = np.zeros((len(q), len(cells)), bool)
                else:
                    hit = np.ones((len(q), len(cells)), bool)
                    low, high = (batch.column(c).to_numpy()[:, None].astype(np.float64) for c in ("low", "high"))
                    least, most = np.zeros(hit.shape), np.full(hit.shape, np.inf)
                    for i in range(lows.shape[1]):
                        own = d[:, i][:, None] if i < t.references else d[:, cells]
                        least = np.maximum(least, np.maximum(lows[:, i] - own, own - highs[:, i]))
                        most = np.minimum(most, own + highs[:, i])
                    room = t.slack(q)[:, None]
                    hit &= (t.scores(q, least**2) + room >= low) & (t.scores(q, most**2) - room <= high)
                hit[np.arange(len(q)), nearest] = home
                at, cell = np.nonzero(hit)
                at, cell, part = np.repeat(at, blocks[cell]), np.repeat(cell, blocks[cell]), np.concatenate([np.zeros(0, int), *[np.arange(n) for n in blocks[cell]]])
                taken = [batch.column(c).take(pa.array(at)) for c in names]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(cells[cell].astype(np.int32)), pa.array(part.astype(np.int32))], names=[*names, "cell", "part"])

        names = ["query_id", "slot", "label", "x", "low", "high"]
        return queries.select(*names).mapInArrow(route, "query_id long, slot long, label int, x array<long>, low long, high long, cell int, part int")

    def _solved(self, queries: DataFrame, k: int, same_label: bool, home: bool) -> DataFrame:
        """(query_id, slot, vec_id, score): the k best of each block that a query went to."""
        self.runs += 1
        n_parts = F.element_at(F.create_map(*[F.lit(int(v)) for c, b in zip(self.present, self.blocks, strict=True) for v in (c, b)]), F.col("cell"))
        routed = self.scratch.save(self._routed(queries, home), f"routed{self.runs}")
        # The queries of a block come in chunks of about `per`; a row is sent once for each chunk of its own block.
        chunks = self.scratch.save(routed.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.per)).cast("int").alias("chunks")), f"chunks{self.runs}")
        keys = ["cell", "part", "chunk"]
        asked = routed.join(chunks, ["cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("query_id", "slot"), F.col("chunks")).cast("int")).drop("chunks")
        rows = self.rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")).join(chunks, ["cell", "part"])
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        table = self.table

        def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({n: np.zeros(0, np.int64) for n in ("query_id", "slot", "vec_id", "score")})
            return _local(table.value, q, x, k, same_label)

        found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(solve, _FOUND)
        return self.scratch.save(found, f"found{self.runs}")

    def best(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(query_id, slot, rank, vec_id, score) of the k best rows with low <= score <= high; ties to the smaller vec_id.

        The cell nearest to a query is searched first; the k-th best score found there bounds what other cells must offer.
        """
        by = ["query_id", "slot"]
        order = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        first = self._solved(queries, k, same_label, True)
        kth = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(*by, F.col("score").alias("kth"))
        left = self.scratch.save(queries.join(kth, by, "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).drop("kth"), f"left{self.runs}")
        found = first.unionByName(self._solved(left, k, same_label, False))
        best = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
        return self.scratch.save(best.select(*by, "rank", "vec_id", "score"), f"best{self.runs}")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row of is_anchor.

    A row's score is the inner product with the anchor of their vectors in integers, floor(scale * x). Positives are the
    anchor's best `positives` other rows of its label; negatives are, for each of them, the best `negatives` rows of other
    labels that score at most what the positive does and at least low[0] / low[1] of it. Ties go to the smaller vec_id.
    Rows with a null vec_id or label, a vector that is null, empty or holds a null or non-finite component take no part.
    Repeated rows of a vec_id count once; where they differ, the least label and then shortest and least vector stands for it, an
    anchor if any of its rows is. Vectors of one length are compared among themselves. An anchor without positives, or a
    positive without such rows (always, if it scores below 0), gives no row; so does an empty table. Extra columns are not read.
    Scaled components and 100 times a score must fit 64-bit integers.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("int").alias("label"), integers(F.col(vector), scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    x = x.filter("vec_id is not null and label is not null and x is not null and size(x) > 0")
    x = x.groupBy("vec_id").agg(F.min(F.struct("label", F.size("x").alias("n"), "x")).alias("s"), F.max("anchor").alias("anchor"))
    x = scratch.save(x.select("vec_id", "s.label", "s.x", "anchor"), "integers")
    parts = []
    for width, total in sorted((r["n"], r["count"]) for r in x.groupBy(F.size("x").alias("n")).count().collect()):
        own = Scratch(spark, f"negatives-{width}")
        search = Search(x.filter(F.size("x") == width), own, total)
        anchors = x.filter("anchor").filter(F.size("x") == width).select(F.col("vec_id").alias("query_id"), "label", "x")
        wide = anchors.withColumns({"slot": F.lit(0).cast("long"), "low": F.lit(-(1 << 62)), "high": F.lit(1 << 62)})
        best = search.best(wide, positives, True).select("query_id", F.col("vec_id").alias("slot"), F.col("score").alias("high"))
        least = F.expr(f"(high * {low[0]} + {low[1] - 1}) div {low[1]}")
        asked = own.save(best.filter("high >= 0").withColumn("low", least).join(anchors, "query_id"), "asked")
        found = search.best(asked, negatives, False).join(best, ["query_id", "slot"])
        parts.append(found.select(F.col("query_id").alias("anchor_id"), F.col("slot").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score")))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole
