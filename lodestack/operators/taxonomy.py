"""Failure taxonomies: term features, clusters of failures, and category statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodestack.durable import durable

VOCABULARY, COMPONENTS = 5000, 64


def term_pipeline(text: str, vocabulary: int = VOCABULARY) -> Pipeline:
    """TF-IDF of words and word pairs seen twice at least, brought to unit length."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\w]+", minTokenLength=2),
        StopWordsRemover(inputCol="_w", outputCol="_s"),
        NGram(n=2, inputCol="_s", outputCol="_g"),
        SQLTransformer(statement="SELECT *, concat(_s, _g) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocabulary, minDF=2),
        IDF(inputCol="_tf", outputCol="_tfidf"),
    ]
    return Pipeline(stages=[*stages, Normalizer(inputCol="_tfidf", outputCol="features")])


def reduced(df: DataFrame, components: int) -> DataFrame:
    """``df`` with its features on their first singular directions, at unit length.

    The decomposition multiplies by the rows where they are: the driver holds a
    few vectors of the vocabulary's length, never a matrix of its square.
    """
    vectors = MLUtils.convertVectorColumnsFromML(df.select("features"), "features").cache()
    right = RowMatrix(vectors).computeSVD(components).V.toArray()
    vectors.unpersist()
    shared = df.sparkSession.sparkContext.broadcast(right)
    project = F.udf(lambda v: DenseVector(v.values @ shared.value[v.indices]), VectorUDT())
    return Normalizer(inputCol="_r", outputCol="features").transform(df.withColumn("_r", project("features")).drop("features")).drop("_r")


def failure_text(summary: Column, failure: Column, error: Column) -> Column:
    """What a failure is clustered by: its summary, its kind and the first 200 characters of its error."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(blank(summary), F.lit(" [failure_type: "), F.coalesce(failure, F.lit("unknown")), F.lit("] [error: "), F.substring(blank(error), 1, 200), F.lit("]"))


def cluster_count(n: int) -> int:
    return max(4, min(15, round(math.sqrt(n))))


def clustered(df: DataFrame, text: str, key: str, k: int | None = None, vocabulary: int = VOCABULARY, components: int = COMPONENTS, seed: int = 42) -> DataFrame:
    """(key, cluster): k-means over the term features; rows without text are left out."""
    rows = df.where(F.length(F.trim(text)) > 0).select(key, text)
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(0).alias("cluster"))
    terms = term_pipeline(text, vocabulary).fit(rows)
    size = len(terms.stages[4].vocabulary)
    featured = durable(terms.transform(rows).select(key, "features"), "features")
    if size > 2:
        featured = durable(reduced(featured, min(components, size - 1, max(2, n - 1))), "reduced")
    return KMeans(k=min(k or cluster_count(n), n), seed=seed, featuresCol="features", predictionCol="cluster").fit(featured).transform(featured).select(key, "cluster")


def subclustered(df: DataFrame, text: str, key: str, share: float = 0.25, depth: int = 3) -> DataFrame:
    """(key, cluster): clusters with more than ``share`` of all rows are split again, ``depth`` levels at most; names are paths like 2.0.1."""
    placed = clustered(df, text, key).select(key, F.col("cluster").cast("string").alias("cluster"))
    total = placed.count()
    for _ in range(depth - 1):
        large = [r[0] for r in placed.groupBy("cluster").count().where(F.col("count") > share * total).select("cluster").collect()]  # fewer than 1 / share
        if not large:
            break
        for name in large:
            part = placed.where(F.col("cluster") == name).select(key).join(df.select(key, text), key)
            finer = clustered(part, text, key).select(key, F.concat(F.lit(f"{name}."), F.col("cluster").cast("string")).alias("finer"))
            placed = placed.join(finer, key, "left").select(key, F.coalesce("finer", "cluster").alias("cluster"))
    return placed


def category_stats(df: DataFrame, category: str, task: str, pattern: str) -> DataFrame:
    """For each category: rows, tasks, share of all rows, and its patterns with their counts as a map."""
    per = df.groupBy(category, F.coalesce(pattern, F.lit("unknown")).alias("p")).agg(F.count("*").alias("n"))
    maps = per.groupBy(category).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("patterns"))  # patterns are a closed list
    rows = df.groupBy(category).agg(F.count("*").alias("rows"), F.count_distinct(task).alias("tasks"))
    total = df.agg(F.count("*").alias("all"))
    return rows.join(maps.withColumnRenamed(category, "_c"), F.col(category).eqNullSafe(F.col("_c"))).drop("_c").crossJoin(F.broadcast(total)).withColumn("share", F.bround(F.col("rows") / F.col("all"), 6)).drop("all")  # one row


def named_clusters(df: DataFrame, cluster: str, text: str, words: int = 3, prefix: str = "discovered") -> DataFrame:
    """(cluster, name): the words of a cluster's texts that are most frequent in it for their frequency in all; a word comes once in a name, ties go by the word."""
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z_]{3,}"), F.lit(0))), lambda w: ~w.isin(*StopWordsRemover.loadDefaultStopWords("english")))
    each = df.select(F.col(cluster).alias("cluster"), F.explode(tokens).alias("word"))
    inside = each.groupBy("cluster", "word").agg(F.count("*").alias("n"))
    overall = inside.groupBy("word").agg(F.sum("n").alias("all"))
    total = max(1, df.count())
    weight = F.bround(F.col("n") * (F.log((1.0 + total) / (1.0 + F.col("all"))) + 1.0), 6)
    ranked = inside.join(overall, "word").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(weight), "word"))).where(F.col("r") <= words)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), "_")  # ``words`` a cluster
    named = ranked.groupBy("cluster").agg(F.concat(F.lit(f"{prefix}_"), joined).alias("name"))
    return df.select(F.col(cluster).alias("cluster")).distinct().join(named, "cluster", "left").select("cluster", F.coalesce("name", F.lit("unlabeled")).alias("name"))


def resized_categories(rows: DataFrame, category: str, pattern: str, least: int, most: int, broad: float = 0.4, fallback: str = "other") -> DataFrame:
    """``rows`` with ``operational``: categories with more than ``broad`` of all rows are split by pattern, as are the largest ones until there are ``least``; all but the ``most`` - 1 largest become ``fallback``.

    Sizes are of closed lists of categories and patterns and are decided on the driver; ties go by name.
    """
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy(F.coalesce(category, F.lit(fallback)), F.coalesce(pattern, F.lit("unknown"))).count().collect()}
    total, groups = sum(sizes.values()), {}
    for (c, p), n in sizes.items():
        groups.setdefault(c, {})[p] = n
    order = sorted(groups, key=lambda c: (-sum(groups[c].values()), c))
    names, count = {}, len(groups)
    for c in order:
        split = len(groups[c]) > 1 and (sum(groups[c].values()) > broad * total or count < least)
        count += len(groups[c]) - 1 if split else 0
        names |= {(c, p): f"{c}__{p}" if split else c for p in groups[c]}
    merged: dict[str, int] = {}
    for key, name in names.items():
        merged[name] = merged.get(name, 0) + sizes[key]
    kept = set(sorted(merged, key=lambda x: (-merged[x], x))[: most if len(merged) <= most else most - 1])
    table = rows.sparkSession.createDataFrame([(c, p, n if n in kept else fallback) for (c, p), n in names.items()], "_c string, _p string, operational string")
    keyed = rows.withColumn("_c", F.coalesce(category, F.lit(fallback))).withColumn("_p", F.coalesce(pattern, F.lit("unknown")))
    return keyed.join(F.broadcast(table), ["_c", "_p"], "left").drop("_c", "_p")  # a row a category and pattern


#: Fields of a category's definition, their least number of words, and phrases that say nothing.
DEFINITION = {"definition": 8, "include": 4, "exclude": 4, "checks": 4}
GENERIC = ("various issues", "incorrect logic", "does not work", "general error", "other problems", "wrong output")
LEAKS = ("expected_output", "test_list", "canonical_solution", "hidden test", "assert ")


def definition_quality(fields: dict[str, Column]) -> Column:
    """(score, faults) of a category's definition: 100 less 20 for a missing field, 10 for a short one, 15 for a phrase that says nothing and 40 for one that leaks."""
    faults, costs = [], []
    for name, least in DEFINITION.items():
        value = F.trim(F.coalesce(fields.get(name, F.lit(None).cast("string")), F.lit("")))
        words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
        low = F.lower(value)
        hit = lambda phrases: F.greatest(*(F.contains(low, F.lit(x)).cast("int") for x in phrases)) > 0  # noqa: E731, B023
        for cost, kind, holds in ((20, "missing", value == ""), (10, "short", (value != "") & (words < least)), (15, "generic", hit(GENERIC)), (40, "leak", hit(LEAKS))):
            faults.append(F.when(holds, F.lit(f"{kind}:{name}")))
            costs.append(F.when(holds, cost).otherwise(0))
    return F.struct(F.greatest(F.lit(0), F.lit(100) - sum(costs[1:], costs[0])).alias("score"), F.array_compact(F.array(*faults)).alias("faults"))


def best_definitions(candidates: DataFrame, category: str, key: str, fields: dict[str, Column], least: int = 60) -> DataFrame:
    """Each category's candidate of the highest quality, ties by key, and whether it reaches ``least``."""
    scored = candidates.withColumn("quality", definition_quality(fields))
    best = F.min_by(F.struct(*scored.columns), F.struct((-F.col("quality.score")).alias("s"), F.col(key).alias("k"))).alias("b")
    return scored.groupBy(category).agg(best).select("b.*").withColumn("accepted", F.col("quality.score") >= least)


def training_rows(rows: DataFrame, split: Column, human: Column, deterministic: Column, private: tuple[str, ...]) -> DataFrame:
    """Rows for training an evaluator: the split of their task, the label of a person, else the deterministic one with its source, and no private columns."""
    labelled = rows.withColumn("train_split", split).withColumn("error_label", F.coalesce(human, deterministic["label"]))
    source = F.when(human.isNotNull(), "human").when(deterministic.isNotNull(), deterministic["source"])
    return labelled.withColumn("label_source", source).drop(*private)


@F.pandas_udf(ArrayType(IntegerType()))
def _char_grams(texts: pd.Series) -> pd.Series:
    """Hashes of all runs of three to five characters of a text's words, each word with a blank at both ends."""
    def one(text: str | None) -> np.ndarray:
        line = " ".join((text or "").lower().split())
        codes = np.frombuffer(f" {line} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        out = []
        for n in (3, 4, 5):
            if len(codes) < n:
                continue
            h, inside = np.zeros(len(codes) - n + 1, dtype=np.uint64), np.ones(len(codes) - n + 1, dtype=bool)
            for k in range(n):
                part = codes[k : len(codes) - n + 1 + k]
                h = h * np.uint64(0x9E3779B97F4A7C15) + part
                inside &= (part != 32) | (k in (0, n - 1))  # a blank only at the ends of a run
            out.append((h[inside] >> np.uint64(33)).astype(np.int32))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)

    return texts.map(one)


def with_critic_inputs(df: DataFrame, text: str, features: str | None = None) -> DataFrame:
    """``df`` with what ``critic`` reads: ``_chars``, runs of characters, and ``_static``, the features of a map as a vector in the order of their names; it is computed once."""
    out = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).withColumn("_chars", _char_grams(F.col(text)))  # each fit passes over them many times
    if features is None:
        return durable(out, "inputs")
    from lodestack.functions.pyast import COUNTED, TERMS

    names = ["chars", "lines", "blank_lines", "comment_lines", "depth", "functions", "demos", "parseable", *(f"term_{t.strip(' (:.[').lower()}" for t in TERMS), *(f"ast_{k}" for k in COUNTED)]
    values = F.array(*(F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) for n in names))
    return durable(out.withColumn("_static", array_to_vector(values)), "inputs")


def critic(train: DataFrame, text: str, label: str, dimensions: int = 1 << 14, max_iter: int = 20, static: bool = False) -> PipelineModel:
    """A fitted classifier of pass or fail from hashed words, word pairs and runs of three to five characters of the source and, with ``static``, its features; rows come from ``with_critic_inputs``."""
    parts = ["_words", "_grams", *(["_scaled"] if static else [])]
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\w+|[^\w\s]", gaps=False), NGram(n=2, inputCol="_w", outputCol="_g"), SQLTransformer(statement="SELECT *, concat(_w, _g) AS _terms FROM __THIS__"),
        HashingTF(numFeatures=dimensions, inputCol="_terms", outputCol="_tf"), IDF(inputCol="_tf", outputCol="_words"), HashingTF(numFeatures=dimensions, inputCol="_chars", outputCol="_cf"), IDF(inputCol="_cf", outputCol="_grams"),
        *([StandardScaler(inputCol="_static", outputCol="_scaled")] if static else []), VectorAssembler(inputCols=parts, outputCol="features"), LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train)
