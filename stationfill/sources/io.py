"""Reading observations, forecasts and files; writing products and report tables."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationfill.functions.rules import KEYS
from stationfill.operators.contract import ContractError, number

PAYLOAD = "station string, latitude double, longitude double, timezone string, hourly_units struct<precipitation:string>, hourly struct<time:array<string>,precipitation:array<double>>"


def read_observations(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Raw rows of CSV files with a header. Text first, so that garbage is told from empty; a ragged row or a repeated header is an error."""
    header = spark.read.text(path).limit(1).collect()
    names = [c.strip() for c in header[0][0].split(",")] if header else []
    if not names or len(set(names)) != len(names):
        raise ContractError("the file is empty or repeats a column")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    text = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", nullValue="")
    numeric = {"FECHA", "HORA", "LONGITUD", "LATITUD", "ALTITUD", *variables}
    typed = text.select(*[number(c).alias(c) if c in numeric else F.col(c) for c in names])
    return typed.withColumns({c: F.col(c).cast("int") for c in KEYS[1:] if c in names})


def read_forecast_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


MANIFEST = "current.json"


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str | None:
    at, system = _files(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if system.exists(at) else None


def write_curated(product: DataFrame, log: DataFrame, summary: DataFrame, path: str, keep: int = 2) -> str:
    """A new version under path: data (Parquet by station), log and summary (CSV). Returns its name.

    The version is a folder of its own. A manifest that names it is written beside it and takes the old one's place last, in
    one rename: before that, readers see the old product, data, log and summary of one run; after it, the new one. What a
    failed run leaves is a folder that no manifest names. The `keep` newest versions stay for readers that have begun.
    """
    spark, version = product.sparkSession, f"v-{uuid.uuid4().hex}"
    product.write.partitionBy("ESTACION").parquet(f"{path}/{version}/data")
    log.write.csv(f"{path}/{version}/log", header=True)
    summary.coalesce(1).write.csv(f"{path}/{version}/summary", header=True)
    kept = ([version, *current_versions(spark, path)])[:keep]
    staged, manifest = f"{path}/_{version}.json", f"{path}/{MANIFEST}"
    at, system = _files(spark, staged)
    out = system.create(at, True)
    out.write(bytearray(json.dumps({"version": version, "versions": kept}).encode()))
    out.close()
    _replace(spark, staged, manifest)
    for status in system.listStatus(_files(spark, path)[0]):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept:
            system.delete(status.getPath(), True)
    return version


def _replace(spark: SparkSession, staged: str, target: str) -> None:
    """Rename over a file that may exist, in one step."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_files(spark, target)[0].toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = [context.makeQualified(_files(spark, p)[0]) for p in (staged, target)]
    context.rename(*qualified, options)


def current_versions(spark: SparkSession, path: str) -> list[str]:
    """The versions that the manifest keeps, the published one first; none before the first publication."""
    text = _read_text(spark, f"{path}/{MANIFEST}")
    return json.loads(text)["versions"] if text else []


def read_curated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data, log and summary of the published version, all of one run."""
    versions = current_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"nothing is published under {path}")
    at = f"{path}/{versions[0]}"
    data = spark.read.parquet(f"{at}/data").withColumn("ESTACION", F.col("ESTACION").cast("string"))
    return data, spark.read.csv(f"{at}/log", header=True), spark.read.csv(f"{at}/summary", header=True, inferSchema=True)


#: Suffixes by which the line reader would decompress a file.
_CODECS = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")
_MARK = b"\xef\xbb\xbf"


def artifact_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of each file, of any size: no file is held whole.

    A file comes as its pieces between line feeds, as raw bytes, from the splits of Spark's reader, and is hashed in their
    order by one task, which holds a batch of pieces. Its size tells whether it ended with a line feed and whether the reader left out
    a byte order mark. A file with a compression suffix, which the reader would unpack, is read as one value (up to 2 GB).
    """
    meta = "_metadata.file_path"
    files = spark.read.format("binaryFile").load(paths)
    packed = F.lower("path").rlike("(" + "|".join(c.replace(".", r"\.") for c in _CODECS) + ")$")
    sizes = files.select("path", F.col("length").alias("bytes"), F.col(meta).alias("file"))
    plain = [r["path"] for r in sizes.filter(~packed & (F.col("bytes") > 0)).select("path").collect()]  # names only, which the reader's index holds as well
    pieces = spark.read.option("lineSep", "\n").schema("value string").text(plain)
    pieces = pieces.select(F.col(meta).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("piece"))
    ordered = pieces.repartition("file").sortWithinPartitions("file", "start", "k")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, length, plain, marked = None, 0, 0, None, None

        def end() -> pa.RecordBatch:
            left = size - length
            whole = marked if left >= 3 else plain
            if left in (1, 4):
                whole.update(b"\n")
            return pa.RecordBatch.from_pydict({"file": [now], "sha256": [whole.hexdigest()]})

        for batch in batches:
            for file, total, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "size")), batch.column("piece"), strict=True):
                raw = piece.as_buffer()
                if file != now:
                    if now is not None:
                        yield end()
                    now, size, length, plain, marked = file, total, 0, hashlib.sha256(), hashlib.sha256(_MARK)
                else:
                    for h in (plain, marked):
                        h.update(b"\n")
                    length += 1
                for h in (plain, marked):
                    h.update(raw)
                length += raw.size
        if now is not None:
            yield end()

    found = ordered.select("file", "size", "piece").mapInArrow(digest, "file string, sha256 string")
    alone = F.lit(hashlib.sha256(_MARK).hexdigest())  # a byte order mark and no more is no piece
    whole = sizes.filter(~packed).join(found, "file", "left").select("path", "bytes", F.coalesce("sha256", alone).alias("sha256"))
    plainly = lambda f: re.sub(r"^(\w+):/+", r"\1:/", f)
    listed = {plainly(r["path"]) for r in sizes.select("path").collect()}
    empty = [(f, 0, hashlib.sha256().hexdigest()) for f in map(plainly, map(unquote, files.inputFiles())) if f not in listed]  # the reader skips them
    whole = whole.unionByName(spark.createDataFrame(empty, "path string, bytes long, sha256 string"))
    return whole.unionByName(files.filter(packed).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def write_report_tables(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Small tables as one CSV file each, with their fields in the given order."""
    for name, (df, fields) in tables.items():
        df.select(*fields).coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True)
