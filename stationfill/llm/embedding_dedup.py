"""Near-duplicate embeddings: tiles of int8 codes, products with proven error bounds, full precision for what stays open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationfill.llm.common import Scratch
from stationfill.llm.components import components

#: Room for rounding in bounds of values up to 1, far above what double precision needs.
SLACK = 1e-9
_FOUND = "t1 long, t2 long, kind string, a long, b long, at binary"


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, without a null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision; scaled first, so that no square leaves its range."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and residual norms: |x - scale * codes| <= residual for each row."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    residual = np.sqrt(((x - scale[:, None] * codes) ** 2).sum(axis=1)) + 1e-12
    return codes, scale, residual


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; in single precision where every partial sum is exact there."""
    kind = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def bracketed(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows surely similar, and pairs that may be, by codes alone.

    x.y differs from the product of the coded vectors by (x - x').y + x'.(y - y'), at most r + s + r s for unit vectors with residuals r and s.
    """
    (qa, sa, ra), (qb, sb, rb) = a, b
    about = products(qa, qb).astype(np.float64) * sa[:, None] * sb
    error = ra[:, None] + rb + ra[:, None] * rb + SLACK
    sure = about - error >= least
    return sure, (about + error >= least) & ~sure


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n vertices the smallest that links (i, j) reach."""
    up = np.arange(n)
    while True:
        least = up.copy()
        np.minimum.at(least, i, up[j])
        np.minimum.at(least, j, up[i])
        np.minimum.at(least, up, least)  # a root that hears of a smaller vertex follows it
        least = least[least]
        if (least == up).all():
            return up
        up = least


def _tile_rows(blob: dict, same: bool, other: dict, i: np.ndarray, j: np.ndarray) -> list[tuple[str, int, int]]:
    """Rows ('links', id, number) and ('edge', id, id) of linked rows i of one tile and j of another, or of the same."""
    ids, more = blob["ids"], other["ids"]
    n = np.bincount(i, weights=other["weights"][j], minlength=len(ids)).astype(np.int64)
    out = [("links", int(ids[k]), int(n[k])) for k in np.flatnonzero(n)]
    n = np.bincount(j, weights=blob["weights"][i], minlength=len(more)).astype(np.int64)
    out += [("links", int(more[k]), int(n[k])) for k in np.flatnonzero(n)]
    all_ids, j = (ids, j) if same else (np.concatenate([ids, more]), j + len(ids))
    up = forest(i, j, len(all_ids))
    return out + [("edge", int(all_ids[k]), int(all_ids[up[k]])) for k in np.flatnonzero(up != np.arange(len(up)))]


def _blob(row: dict) -> dict:
    take = lambda name, kind: np.frombuffer(row[name], kind)
    out = {"ids": take("ids", np.int64), "weights": take("weights", np.int64)}
    if "codes" in row:
        out["coded"] = (take("codes", np.int8).reshape(len(out["ids"]), -1), take("scales", np.float64), take("residuals", np.float64))
    else:
        out["unit"] = take("unit", np.float64).reshape(len(out["ids"]), -1)
    return out


def _table(rows: list[tuple]) -> pa.Table:
    names, kinds = ("t1", "t2", "kind", "a", "b", "at"), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _tiles(rows: DataFrame, scratch: Scratch, pivots: int, most: int) -> DataFrame:
    """Tiles: runs of at most `most` rows of one label and length, near vectors together, with codes and vectors as bytes.

    Rows are ordered by label, nearest pivot and distance from it, over as many tasks as there are partitions; so a label or
    a cell with a third of all rows is many tiles in many tasks.
    """
    spark = rows.sparkSession
    chosen: dict[int, np.ndarray] = {}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").toArrow()["vector"].combine_chunks()
    for n in {len(x) for x in sample}:
        chosen[n] = units(sample.filter(pa.array([len(x) == n for x in sample])))
    shared = spark.sparkContext.broadcast(chosen)
    kept = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("cell", pa.int32()), ("near", pa.float64()), ("unit", pa.binary())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for n in np.unique(widths):
                part = batch.filter(pa.array(widths == n))
                x = units(part.column("vector"))
                with_pivots = x @ shared.value.get(n, np.zeros((1, n))).T
                cell = with_pivots.argmax(axis=1)
                near = with_pivots[np.arange(len(x)), cell]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), part.column("label"), part.column("width"), pa.array(cell.astype(np.int32)), pa.array(-near), pa.array([r.tobytes() for r in x], pa.binary())], schema=kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to tiles; what is held is one tile and one batch."""
        from pyspark import TaskContext

        task, made, held, last = TaskContext.get().partitionId(), 0, [], None

        def tile() -> pa.RecordBatch:
            nonlocal made
            x = np.frombuffer(b"".join(r[2] for r in held)).reshape(len(held), -1)
            codes, scale, residual = quantised(x)
            centre = x.mean(axis=0)
            centre = centre / max(np.sqrt((centre**2).sum()), 1e-300)
            least = float((x @ centre).min())
            made += 1
            fields = [(task << 33) + made, *last, len(held), sum(r[1] for r in held), min(r[0] for r in held), centre.tolist(), least]
            fields += [np.array([r[k] for r in held], np.int64).tobytes() for k in (0, 1)] + [x_.tobytes() for x_ in (codes, scale, residual, x)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(fields, out_kinds, strict=True)], names=out_names)

        for batch in batches:
            ids, weights, labels, widths, vectors = (batch.column(c).to_pylist() for c in ("id", "weight", "label", "width", "unit"))
            for k in range(len(ids)):
                key = (labels[k], widths[k])
                if held and (key != last or len(held) == most):
                    yield tile()
                    held = []
                last = key
                held.append((ids[k], weights[k], vectors[k]))
        if held:
            yield tile()

    out_names = ["tile", "label", "width", "n", "weight", "first_id", "centre", "least", "ids", "weights", "codes", "scales", "residuals", "unit"]
    out_kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * 6]
    kinds = "tile long, label string, width int, n long, weight long, first_id long, centre array<double>, least double, ids binary, weights binary, codes binary, scales binary, residuals binary, unit binary"
    settled = scratch.save(rows.mapInArrow(settle, "id long, weight long, label string, width int, cell int, near double, unit binary"), "settled")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = settled.repartitionByRange(parts, "label", "width", "cell", "near", "id").sortWithinPartitions("label", "width", "cell", "near", "id")
    return scratch.save(ordered.mapInArrow(cut, kinds), "tiles")


def _tile_pairs(tiles: DataFrame, least: float, parts: int = 16) -> DataFrame:
    """(t1, t2, sure) of the tiles of a label that can hold a similar pair; sure where all their pairs are similar.

    Angles obey the triangle inequality: two vectors are as far apart as their tiles' centres, give or take both radii.
    Summaries are tiles, not rows; those of a label meet in `parts` tasks.
    """
    side = lambda k: tiles.select("label", "width", *[F.col(c).alias(f"{c}{k}") for c in ("tile", "centre", "least")])
    one = side(1).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    two = side(2).withColumn("part", F.pmod(F.xxhash64("tile2"), F.lit(parts)).cast("int"))
    both = one.join(two.hint("merge"), ["label", "width", "part"]).filter("tile1 <= tile2")
    dot = F.aggregate(F.zip_with("centre1", "centre2", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    reach, between = angle(F.col("least1")) + angle(F.col("least2")), F.when(F.col("tile1") == F.col("tile2"), 0.0).otherwise(angle(dot))
    limit, room = float(np.arccos(least)), 1e-6
    found = both.select(F.col("tile1").alias("t1"), F.col("tile2").alias("t2"), (between + reach + room <= limit).alias("sure"), (between - reach - room <= limit).alias("may"))
    return found.filter("may").drop("may")


def _meet(pairs: DataFrame, tiles: DataFrame, columns: list[str], solve) -> DataFrame:
    """solve(t1, t2, row of t1, row of t2) for each pair of tiles; a group is two tiles, however large the label."""
    blobs = tiles.select("tile", *columns)
    one = pairs.join(blobs.withColumnRenamed("tile", "t1"), "t1")
    two = pairs.select("t1", "t2").join(blobs.withColumnRenamed("tile", "t2"), "t2")
    two = two.select(*[F.col(c).alias(c) for c in two.columns])  # columns of its own: both sides come from one table

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.to_pylist()[0], b.to_pylist()[0]
        return _table([(a["t1"], a["t2"], *r) for r in solve(a, b)])

    return one.groupBy("t1", "t2").cogroup(two.groupBy("t1", "t2")).applyInArrow(run, _FOUND)


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", pivots: int = 256, most: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label link where their cosine is `least` (above 0) at least.

    A row a vec_id; n_links counts the other vectors linked directly, component_id is the smallest vec_id that links reach,
    kept tells whether that is the vector itself. A null label, or a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing; nor do vectors of different lengths. Repeated rows of a vec_id are one vector;
    where they differ, the least of them (label, vector) stands for it. A row without vec_id takes no part: all such rows
    are one row with null ids. Extra columns are not read.

    Equal vectors of a label are one row with a weight from the start, so a group of copies costs one row. Products of
    int8 codes settle most pairs of tiles; what they leave open is computed from the vectors, tile by tile. Tiles so close that
    all their pairs are similar are counted whole.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    x = x.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.*")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    rows = scratch.save(x.withColumn("digest", F.when(fit, F.sha2(F.concat(F.col("label"), F.lit("\n"), F.to_json("vector")), 256))), "rows")
    alike = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    alike = scratch.save(alike.withColumn("width", F.size("vector")), "alike")
    tiles = _tiles(alike.select("id", "weight", "label", "width", "vector"), scratch, pivots, most)
    pairs = scratch.save(_tile_pairs(tiles, least), "pairs")

    def by_codes(a: dict, b: dict) -> list[tuple]:
        same, one, two = a["t1"] == a["t2"], _blob(a), _blob(b)
        sure, may = bracketed(one["coded"], two["coded"], least)
        if same:
            sure, may = np.triu(sure, 1), np.triu(may, 1)
        out = [(*r, None) for r in _tile_rows(one, same, two, *np.nonzero(sure))]
        open_ = np.flatnonzero(may)
        return out + ([("open", None, None, open_.astype(np.uint32).tobytes())] if len(open_) else [])

    def by_vectors(a: dict, b: dict) -> list[tuple]:
        same, one, two = a["t1"] == a["t2"], _blob(a), _blob(b)
        i, j = np.divmod(np.frombuffer(a["at"], np.uint32).astype(np.int64), len(two["ids"]))
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 15):
            k = slice(at, at + (1 << 15))
            good[k] = np.einsum("ij,ij->i", one["unit"][i[k]], two["unit"][j[k]]) >= least
        return [(*r, None) for r in _tile_rows(one, same, two, i[good], j[good])]

    first = scratch.save(_meet(pairs.filter("NOT sure").select("t1", "t2"), tiles, ["ids", "weights", "codes", "scales", "residuals"], by_codes), "first")
    left = first.filter("kind = 'open'").select("t1", "t2", "at")
    second = scratch.save(_meet(left, tiles, ["ids", "weights", "unit"], by_vectors), "second")
    found = first.unionByName(second)
    # Tiles that are similar as a whole: sums of their partners' weights, and stars.
    sure, heads = pairs.filter("sure"), tiles.select("tile", "weight", "first_id")
    named = sure.join(heads.toDF("t1", "w1", "f1"), "t1").join(heads.toDF("t2", "w2", "f2"), "t2")
    sides = F.array(F.struct(F.col("t1").alias("tile"), F.col("w2").alias("more")), F.struct(F.when(F.col("t1") != F.col("t2"), F.col("t2")).alias("tile"), F.col("w1").alias("more")))
    whole = named.select(F.inline(sides), (F.col("t1") == F.col("t2")).cast("int").alias("own")).filter("tile is not null").groupBy("tile").agg(F.sum("more").alias("more"), F.max("own").alias("own"))
    member_kind = T.StructType.fromDDL("tile long, id long, weight long")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, weights = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weights"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["tile"])), pa.array(ids), pa.array(weights)], names=["tile", "id", "weight"])

    of_whole = tiles.select("tile", "first_id", "ids", "weights").join(whole, "tile")
    inside = scratch.save(of_whole.select("tile", "ids", "weights").mapInArrow(members, member_kind).join(of_whole.select("tile", "first_id", "more", "own"), "tile"), "inside")
    edges = found.filter("kind = 'edge'").select("a", "b").unionByName(named.select(F.col("f1").alias("a"), F.col("f2").alias("b"))).unionByName(inside.select(F.col("id").alias("a"), F.col("first_id").alias("b")))
    counts = found.filter("kind = 'links'").select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(inside.select("id", (F.col("more") - F.col("own") * F.col("weight")).alias("n")))
    counts = scratch.save(counts.groupBy("id").agg(F.sum("n").alias("n")), "counts")
    classes = components(edges, scratch)
    answer = alike.select("digest", "id", "weight").join(counts, "id", "left").join(classes, "id", "left")
    answer = scratch.save(answer.select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "answer")
    scratch.drop("settled", "tiles", "pairs", "first", "second", "inside", "counts", "alike")
    out = rows.select("vec_id", "digest").join(answer, "digest", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id").eqNullSafe(own)).alias("kept"))
