"""Gaps: maximal runs of missing eligible hours, their anchors and classes.

Series are dense, so a gap begins one hour after the last hour before it that is none, and the values there are its
anchors: two prefix scans find all of that. A gap of eligible hours always lies between two hours that are none, the ends
of the observed span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["station", "variable"]


def hour_number(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def piece_of(piece_hours: int) -> Column:
    """The number of the piece of a series that an hour lies in."""
    return F.floor(hour_number() / piece_hours).cast("long")


def with_runs(cells: DataFrame, gap: Column | None = None, columns: tuple[str, ...] = ("value",), piece_hours: int | None = None) -> DataFrame:
    """Cells with is_gap, and for gap hours gap_start, gap_end, n_steps and, for each column, its values next to the gap on both sides (left_, right_).

    Strictly the next hours: a value further away is no anchor. With `piece_hours` a series is scanned in pieces of so many
    hours, as tasks of their own; what a piece needs of others, the last hour before it that is no gap and the first after it,
    comes from a scan over one row a piece. The rows are the same.
    """
    gap = gap if gap is not None else F.col("value").isNull() & F.col("eligible")
    own = cells.withColumn("is_gap", gap)
    by = SERIES
    if piece_hours:
        own, by = own.withColumn("_piece", piece_of(piece_hours)), [*SERIES, "_piece"]
    anchor = F.when(~F.col("is_gap"), F.struct("ts", *columns))
    scan = lambda order: F.last(anchor, True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    found = own.withColumn("_left", scan(F.asc("ts"))).withColumn("_right", scan(F.desc("ts")))
    if piece_hours:
        ends = own.groupBy(*by).agg(F.min(anchor).alias("first"), F.max(anchor).alias("last"))
        carry = lambda f, order: f.over(W.partitionBy(*SERIES).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
        ends = ends.select(*by, carry(F.max("last"), F.asc("_piece")).alias("_before"), carry(F.min("first"), F.desc("_piece")).alias("_after"))
        found = found.join(ends, by).withColumns({"_left": F.coalesce("_left", "_before"), "_right": F.coalesce("_right", "_after")}).drop("_before", "_after", "_piece")
    when = lambda c: F.when(F.col("is_gap"), c)
    hour = F.expr("INTERVAL 1 HOUR")
    found = found.withColumns({"gap_start": when(F.col("_left.ts") + hour), "gap_end": when(F.col("_right.ts") - hour)})
    found = found.withColumn("n_steps", F.expr("timestampdiff(HOUR, gap_start, gap_end) + 1"))
    sides = {f"{side}_{c}": when(F.col(f"_{side}.{c}")) for c in columns for side in ("left", "right")}
    return found.withColumns(sides).drop("_left", "_right")


def find_gaps(cells: DataFrame, piece_hours: int | None = None) -> DataFrame:
    """(station, variable, gap_id, gap_start, gap_end, n_steps, duration_h); gap_id counts the gaps of a series from 1."""
    gaps = with_runs(cells, piece_hours=piece_hours).filter("is_gap AND ts = gap_start")
    number = F.row_number().over(W.partitionBy(*SERIES).orderBy("gap_start"))
    return gaps.select(*SERIES, number.alias("gap_id"), "gap_start", "gap_end", "n_steps", F.col("n_steps").alias("duration_h"))


def classify_gaps(gaps: DataFrame, short_gap_hours: int = 4) -> DataFrame:
    return gaps.withColumn("gap_class", F.when(F.col("duration_h") <= short_gap_hours, "short").otherwise("long"))


def gap_anchors(cells: DataFrame, piece_hours: int | None = None) -> DataFrame:
    """One row a gap: its anchors and whether both are there."""
    hours = with_runs(cells, piece_hours=piece_hours).filter("is_gap AND ts = gap_start")
    both = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    return hours.select(*SERIES, "gap_start", "gap_end", "n_steps", "left_value", "right_value", both.alias("anchored"))


def beside(df: DataFrame, columns: tuple[str, ...], steps: list[int], piece_hours: int | None = None) -> DataFrame:
    """For each column c, donors_<c>: the values that are there so many rows earlier (negative) or later in a dense series, in the order of `steps`.

    With `piece_hours` the series comes in pieces; each hour also goes to the neighbouring pieces that need it.
    """
    reach, by, own = max(map(abs, steps)), SERIES, None
    if piece_hours:
        whole = lambda hours: F.floor((hour_number() + hours) / piece_hours).cast("long")
        df = df.withColumn("_piece", F.explode(F.sequence(whole(-reach), whole(reach))))
        by, own = [*SERIES, "_piece"], F.col("_piece") == piece_of(piece_hours)
    w = W.partitionBy(*by).orderBy("ts")
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    df = df.withColumns({f"donors_{c}": F.array(*[at(c, k) for k in steps]) for c in columns})
    return df if own is None else df.filter(own).drop("_piece")
