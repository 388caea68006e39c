"""Token counts of documents in flat token files, found by their separators.

A token file is ids of one width with a separator after each document, and no index. Blocks of the files are scanned
apart; a prefix scan over the blocks' summaries (separators so far, place of the last one) stitches what crosses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.llm.common import Scratch
from stationfill.llm.textbytes import slices

_loaded: dict[tuple, object] = {}


def _encoding(ranks: str, pattern: str):
    import base64

    import tiktoken

    if (ranks, pattern) not in _loaded:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        _loaded[ranks, pattern] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _loaded[ranks, pattern]


def write_token_files(docs: DataFrame, root: str, ranks: str, pattern: str, separator: int, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a flat file a task into the shared folder `root`; (file, ordinal, doc_id) says which document is where.

    A null text has no tokens before its separator. A task writes under its attempt's name and renames at its end, so a
    task that runs again replaces its file. The rows must be written before the files are read.
    """
    kinds = "file string, ordinal long, doc_id long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, context = _encoding(ranks, pattern), TaskContext.get()
        system, path = fs.FileSystem.from_uri(root)
        system.create_dir(path)
        name, end = f"shard-{context.partitionId():06d}.bin", np.array([separator], dtype).tobytes()
        draft, n = f"{path}/.{name}.{context.taskAttemptId()}", 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                for a, b, data, offsets in slices(batch.column("text"), 1 << 22):
                    raw = data.tobytes()
                    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        out.write(np.array(encoding.encode_ordinary(raw[i:j].decode()), dtype).tobytes() + end)
                    ids = batch.column("doc_id").slice(a, b - a)
                    columns = [pa.array([name] * (b - a), pa.string()), pa.array(np.arange(n, n + b - a)), ids]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "ordinal", "doc_id"])
                    n += b - a
        system.move(draft, f"{path}/{name}")

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, kinds)


def scan_token_files(spark: SparkSession, root: str, separator: int, dtype: str = "<u2", block: int = 1 << 20) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the *.bin files of `root`, the separator not counted.

    Tokens after a file's last separator are a document too. Files of no bytes have none. `block` ids are read at a time.
    """
    width = np.dtype(dtype).itemsize
    # only names and lengths are read here
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(root).select("path", (F.col("length") / width).cast("long").alias("ids"))
    blocks = files.filter("ids > 0").select("path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block).cast("long"))).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            for path, ids, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    system, local = fs.FileSystem.from_uri(path)
                    file, opened = system.open_input_file(local), path
                found = np.frombuffer(file.read_at(min(block, ids - start) * width, start * width), dtype)
                places = np.flatnonzero(found == separator) + start
                row = {"path": [path], "ids": [ids], "start": [start], "places": pa.array([places], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(row)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    scanned = blocks.repartition(n, "path", "start").mapInArrow(scan, "path string, ids long, start long, places array<long>")
    scanned = scanned.withColumn("last", F.array_max("places")).withColumn("n", F.size("places"))
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    stitched = scanned.withColumn("ordinals", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("carried", F.coalesce(F.max("last").over(before), F.lit(-1)))
    tail = (F.col("start") + block >= F.col("ids")) & (F.coalesce("last", "carried") < F.col("ids") - 1)
    ends = F.when(tail, F.concat("places", F.array("ids"))).otherwise(F.col("places"))
    begins = F.concat(F.array("carried"), F.col("places"))
    lengths = F.zip_with(ends, F.slice(begins, 1, F.size(ends)), lambda end, begin: end - begin - 1)
    rows = stitched.filter((F.col("n") > 0) | tail).select("path", "ordinals", F.posexplode(lengths).alias("k", "n_tokens"))
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), (F.col("ordinals") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, ranks: str, pattern: str, separator: int, doc_id: str = "doc_id", text: str = "text", block: int = 1 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, by writing flat token files and scanning them for separators."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    placed = scratch.save(write_token_files(docs, f"{scratch.root}/flat", ranks, pattern, separator, doc_id=doc_id, text=text), "placed")
    if placed.isEmpty():
        return placed.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    return scan_token_files(spark, f"{scratch.root}/flat", separator, block=block).hint("merge").join(placed, ["file", "ordinal"]).select("doc_id", "n_tokens")
