"""Blocks of documents that share a key: what candidate search hands to local solvers.

Every key's leader is the smallest member that holds it. Members that share a key share that key's leader, so a
pair with a common key meets in the leader's block. Near copies share most of their keys, hence few leaders: a document
goes to few blocks, where keys as blocks would ship it once for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch


def leaders(postings: DataFrame, scratch: Scratch, repeats: bool = False) -> DataFrame:
    """(token, lead) of the tokens with two members at least; with `repeats`, also of those repeated in one member (column `again`)."""
    aggregates = [F.min("member").alias("lead"), F.max("member").alias("last")]
    wanted = F.col("lead") < F.col("last")
    if repeats:
        aggregates.append(F.max("again").alias("twice"))
        wanted = wanted | F.col("twice")
    return scratch.save(postings.groupBy("token").agg(*aggregates).filter(wanted).select("token", "lead"), "leaders")


def asked_for(rows: DataFrame, keys: list[str], by: DataFrame, n_rows: int, most_bits: int = 1 << 27) -> DataFrame:
    """The rows whose `keys` occur in `by`, and few others: a filter ahead of a join, so that rows nobody asks for aren't shuffled.

    A bit stands for a hash of the keys, 16 bits or more for each of n_rows rows, but `most_bits` (16 MB) at most, which go to every
    task. Where that makes them dense the filter lets more pass, and no row that `by` holds is ever lost.
    """
    page = 1 << 15  # bits of one bitmap of Spark's
    pages = min(most_bits, max(page, 1 << (16 * n_rows).bit_length())) // page
    place = F.pmod(F.xxhash64(*keys), F.lit(pages * page))
    # dealt by page first: maps of single tasks would be as many as tasks
    at = by.select(place.alias("at")).select(F.floor(F.col("at") / page).alias("page"), (F.col("at") % page).alias("bit"))
    maps = at.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = rows.withColumn("_at", place)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_at % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    there = placed.join(F.broadcast(maps), F.floor(F.col("_at") / page) == F.col("page"))
    return there.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).select(*rows.columns)


def sub_blocks(pairs: DataFrame, scratch: Scratch, most: int, weight: str, most_weight: int) -> DataFrame:
    """pairs with columns sub and n_sub: a block of more than `most` members, or `most_weight` of `weight`, is dealt into n_sub parts by a hash of the member."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most)), F.ceil(F.sum(weight) / F.lit(most_weight)))
    sizes = scratch.save(pairs.groupBy("lead").agg(need.cast("int").alias("n_sub")).filter("n_sub > 1"), "splits")
    joined = pairs.join(sizes, "lead", "left").withColumn("n_sub", F.coalesce("n_sub", F.lit(1)))
    return joined.withColumn("sub", F.pmod(F.xxhash64("member"), F.col("n_sub")).cast("int"))
