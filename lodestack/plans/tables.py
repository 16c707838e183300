"""The tables of a data folder in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def once(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """The named columns, one row a key; repeated rows are equal in all but their arrival."""
    return table(spark, d, name).select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key])


def derived(spark: SparkSession, d: str, name: str, key: str, *columns: Column) -> DataFrame:
    """The key and values computed from its row, one row a key; texts stay where they are, only the values are shuffled."""
    return table(spark, d, name).where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])


def responses(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(spark, d, "responses", "response_id", *columns)


def problems(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(spark, d, "problems", "id", *columns)


def judgments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest judgment of each response, of equal times the one with the higher score."""
    rows = table(spark, d, "judgments").where("response_id is not null")
    last = F.max_by(F.struct(*dict.fromkeys(("overall_score", *columns))), F.struct("judged_at", "overall_score")).alias("j")
    return rows.groupBy("response_id").agg(last).select("response_id", *(f"j.{c}" for c in columns))


#: The same, in SQL.
RESPONSES = "(select distinct on (response_id) * from responses where response_id is not null)"
PROBLEMS = "(select distinct on (id) * from problems where id is not null)"
FAILURES = "(select distinct on (response_id) * from failures where response_id is not null)"
SFT = "(select distinct on (id) * from sft_records where id is not null)"
JUDGMENTS = "(select * from judgments where response_id is not null qualify row_number() over (partition by response_id order by judged_at desc, overall_score desc nulls last) = 1)"
