"""Cutting lineage so that a lost executor never costs more than one stage.

Intermediate tables go as Parquet into the folder that all executors share
(``spark.checkpoint.dir``).  Parquet rather than RDD checkpoints: it is
compact, columnar, and its size on disk lets the planner choose joins.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode with nothing configured."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestack-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``durable`` that no later plan reads."""
    files = df.inputFiles()
    for spark, path in list(_written):
        if files and path.rsplit("/", 1)[1] in files[0]:
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass
    _written.clear()
