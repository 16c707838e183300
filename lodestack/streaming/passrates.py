"""Pass rates of responses as they arrive, by event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestack.durable import shared_dir


def windowed(stream: DataFrame, late: str = "21 days", width: str = "1 day") -> DataFrame:
    """Counts by window and model; each response counts once, rows later than ``late`` are dropped.

    Deduplication keeps its state only within the watermark.
    """
    once = stream.withWatermark("generated_at", late).dropDuplicatesWithinWatermark(["response_id"])
    ok = F.coalesce("passed", F.lit(False))
    return once.groupBy(F.window("generated_at", width).alias("w"), "model").agg(F.count("*").alias("responses"), F.count_if(ok).alias("passed"))


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The stream of a folder or file of responses up to now, run to its end; state and output in the shared folder."""
    schema = spark.read.parquet(path).schema
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    glob = path if path.endswith("/") else path
    parent, name = glob.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    files = spark.read.parquet(path).inputFiles()
    stream = source.parquet(path) if len(files) > 1 or files[0].rsplit("/", 1)[1] != name else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    out = windowed(stream).select(F.col("w.start").alias("start"), "model", "responses", "passed")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    query = out.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{at}/out/batch={last}")
