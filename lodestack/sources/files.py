"""Reading JSON lines, documents and files."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class BadInput(ValueError):
    """A file that can't be read as asked."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, required: tuple[str, ...] = (), optional: bool = False, limit: int | None = None, file_column: str | None = None, order_column: str | None = None, checked: bool = False) -> DataFrame:
    """JSON lines of one or more files or patterns, blank lines skipped.

    Bad lines make the read fail when it runs; ``checked`` reads the lines once
    before and names the first bad one's file and line.  ``optional``: paths
    that don't exist count as empty.  ``order_column`` gets a value that orders
    rows by file and place in it, however the files are split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if exists(spark, p)] if optional else paths
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [c for c in required if c not in schema.fieldNames()]
    if missing:
        raise BadInput(f"columns missing: {', '.join(missing)}")
    if not there:
        df = spark.createDataFrame([], schema)
        at = T.StructType([T.StructField("f", T.StringType()), T.StructField("s", T.LongType()), T.StructField("i", T.LongType())])
        df = df.withColumn(file_column, F.lit(None).cast("string")) if file_column else df
        return df.withColumn(order_column, F.lit(None).cast(at)) if order_column else df
    for p in there if checked else ():
        if (bad := first_bad_line(spark, p)) is not None:
            raise BadInput(f"not a JSON object: {bad}")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(there)
    if file_column:
        df = df.withColumn(file_column, F.col("_metadata.file_path"))
    if order_column:
        df = df.withColumn(order_column, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i")))
    if required:
        df = df.where(" and ".join(f"`{c}` is not null" for c in required))
    return df.limit(limit) if limit is not None else df


def first_bad_line(spark: SparkSession, path: str) -> str | None:
    """``path:line`` of the first line that isn't a JSON object, or None.  Line numbers come from byte order within each file."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"))
    bad = lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    first = bad.orderBy("f", "s", "i").limit(1).collect()
    if not first:
        return None
    r = first[0]
    before = lines.where((F.col("f") == r["f"]) & ((F.col("s") < r["s"]) | ((F.col("s") == r["s"]) & (F.col("i") < r["i"])))).count()
    return f"{PurePosixPath(r['f']).name}:{before + 1}"


def document(spark: SparkSession, path: str) -> dict:
    """One JSON or YAML document, on the driver."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise BadInput("YAML can't be read here") from e
        return yaml.safe_load(text)
    return json.loads(text)


def digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def replay(spark: SparkSession, rows: DataFrame, path: str, schema: str, key: str) -> DataFrame:
    """``rows`` with the recorded output of each key, the last of repeated ones; raises if any is missing."""
    recorded = jsonl(spark, path, schema, order_column="_at").groupBy(key).agg(F.max_by("raw_output", "_at").alias("raw_output"))
    joined = rows.join(recorded, key, "left")
    gone = joined.where("raw_output is null").count()
    if gone:
        raise BadInput(f"{gone} rows without a recorded output")
    return joined


def annotations(spark: SparkSession, folder: str, items_schema: str, notes_schema: str, key: str = "item_id") -> DataFrame:
    """Review items of a folder with their annotations, the last of repeated ones; items without one stay, annotations without an item don't."""
    items = jsonl(spark, f"{folder}/review_items.jsonl", items_schema, optional=True)
    notes = jsonl(spark, f"{folder}/annotations.jsonl", notes_schema, optional=True, order_column="_at")
    rest = [c for c in notes.columns if c not in (key, "_at")]
    last = notes.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_n")).select(key, *(F.col(f"_n.{c}").alias(c) for c in rest))
    return items.join(last, key, "left")
