"""Problem 7: grouping records into similarity clusters.

Texts are reduced to the set of words that carry content; equal sets form one
node, so repeated causes cost one node.  Which words carry none is counted over
all rows: words that stand in a fixed place of the texts, words of a great
share of all texts, and words that occur with many more different rare words
than their number lets expect.  Neighbour descent builds an approximate
nearest-neighbour graph: it starts from neighbours in a few sorted orders of
min-hashed words and lets neighbours of neighbours meet, as long as one of the
two is new to the list, until hardly any list changes.  Links of enough
agreement go into a modularity-based community detection (parallel local
moving, then moving of whole communities), and communities are described by the
members of highest internal weighted degree.

Defined results: null and empty texts, and texts without content words,
belong to no cluster; equal sets are always together; repeated keys count
once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.durable import discard, durable

#: Neighbours kept a node, sorted orders to start from, neighbours taken from each, rounds of descent, share of changed lists that ends it.
NEIGHBOURS, ORDERS, NEAR, ROUNDS, STILL = 12, 24, 4, 6, 0.001
#: Common words that a link needs, as a share of the larger set.
AGREE = 0.6
LEVELS, MOVES = 4, 10
#: A word without content is in LEAST of the texts at least, and in OFTEN of them, or FIXED of its places lie within three
#: successive ones, or it occurs with SPREAD of all signatures and with RATIO times as many as texts in proportion.
LEAST, OFTEN, FIXED, SPREAD, RATIO = 0.02, 0.25, 0.6, 0.1, 1.4
#: Rare words in a text's signature.
SIGNATURE = 2
_JSON = re.compile(r'"summary"\s*:\s*"((?:[^"\\]|\\.)*)')


def words(text: Column) -> Column:
    """The words of a text in order, in lower case; raw JSON around it is dropped."""
    inner = F.regexp_extract(text, _JSON.pattern, 1)
    return F.regexp_extract_all(F.lower(F.when(inner != "", inner).otherwise(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _lower_bound(k: Column, n: Column, z: float = 2.0) -> Column:
    """The lower end of the Wilson interval of a share."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def words_without_content(texts: DataFrame) -> DataFrame:
    """(word) of (key, words), a row a text: the words that say nothing about a single text.

    Only words of LEAST of the texts are looked at, of which there are at most
    the texts' mean length / LEAST, so all that follows the first count is small.
    """
    total = texts.count()
    each = texts.select("key", F.explode(F.array_distinct("words")).alias("word"))
    count = durable(each.groupBy("word").agg(F.count("*").alias("df")), "counts")
    often = count.where(F.col("df") >= LEAST * total)
    # of all places of a word, from the start and from the end, the most that lie within three successive ones
    size = F.size("words")
    place = texts.select(F.posexplode("words").alias("i", "word"), size.alias("size")).join(often, "word")
    ends = place.select("word", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("i").alias("at")), F.struct(F.lit(1).alias("end"), (F.col("size") - F.col("i")).alias("at")))).alias("p"))
    at = ends.groupBy("word", "p.end", "p.at").agg(F.count("*").alias("n"))
    near = at.select("word", "end", "n", F.explode(F.sequence(F.col("at") - 2, F.col("at"))).alias("start")).groupBy("word", "end", "start").agg(F.sum("n").alias("n"))
    places = at.where("end = 0").groupBy("word").agg(F.sum("n").alias("places"))
    fixed = near.groupBy("word").agg(F.max("n").alias("most")).join(places, "word").where(_lower_bound(F.col("most"), F.col("places")) >= FIXED).select("word")
    first = durable(fixed.unionAll(often.where(F.col("df") >= OFTEN * total).select("word")).distinct(), "fixed")

    rest = durable(each.join(count, "word").join(first, "word", "left_anti"), "rest")
    signed = rest.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "word"))), 1, SIGNATURE).alias("s")).select("key", F.xxhash64("s.word").alias("s"))  # one text's words
    kinds = max(1, signed.agg(F.count_distinct("s")).first()[0])
    spread = rest.where(F.col("df") >= LEAST * total).join(signed, "key").groupBy("word", "df").agg(F.count_distinct("s").alias("kinds"))
    share = F.col("kinds") / kinds
    wide = spread.where((share >= SPREAD) & (share >= RATIO * F.col("df") / total)).select("word")
    return durable(first.unionAll(wide).distinct(), "common")


def content(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, toks): the hashes of each text's content words, sorted; texts without any are left out."""
    rows = df.select(F.col(key).cast("string").alias("key"), words(F.col(text)).alias("words")).where("key is not null").where(F.size("words") > 0)
    rows = durable(rows.groupBy("key").agg(F.max("words").alias("words")), "words")
    common = words_without_content(rows)
    each = rows.select("key", F.explode(F.array_distinct("words")).alias("word")).join(common, "word", "left_anti")
    return each.groupBy("key").agg(F.array_sort(F.collect_list(F.xxhash64("word"))).alias("toks"))  # one text's words


def _sorted_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, u, s): every row, the rows up to NEAR before it in the same order, and how many words both have, if more than one."""
    last: list = []
    current = None
    for pdf in batches:
        a, b, s = [], [], []
        for k, node, toks in zip(pdf["k"], pdf["node"], pdf["toks"]):
            if k != current:
                current, last = k, []
            own = set(toks.tolist())
            for other, others in last:
                if other != node and (common := len(own & others)) > 1:
                    a.append(node), b.append(other), s.append(common)
            last = [*last[-(NEAR - 1) :], (node, own)]
        yield pd.DataFrame({"v": a, "u": b, "s": s})


def _lists(links: DataFrame) -> DataFrame:
    """The NEIGHBOURS best of each node's links (v, u, s, new), ties by the neighbour's number; a link that is there twice is new only if both are."""
    once = links.groupBy("v", "u").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    w = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= NEIGHBOURS).drop("r")


def _both(links: DataFrame) -> DataFrame:
    return links.select("v", "u", "s", "new").unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u"), "s", "new"))


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """(v, u, s): approximate nearest neighbours of (node, toks) by common words."""
    each = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    low = each.withColumn("o", F.slice(F.array_sort(F.transform("toks", lambda t: F.xxhash64(t, F.col("k")))), 1, 3))
    # places in all orders are sorted at once; only rows at the edges of partitions lose a neighbour
    start = low.repartitionByRange("k", "o", "node").sortWithinPartitions("k", "o", "node").select("k", "node", "toks").mapInPandas(_sorted_neighbours, "v long, u long, s int")
    graph = durable(_lists(_both(start.withColumn("new", F.lit(True)))), "neighbours")
    total = graph.count()
    for _ in range(ROUNDS):
        # a node's own neighbours, and the nearest of those that have it as theirs
        around = _lists(_both(graph)).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("u", "new"))).alias("ns"))  # at most NEIGHBOURS each
        a = around.select("ns", F.posexplode("ns").alias("i", "a"))
        pairs = a.select("a", F.explode(F.slice("ns", F.col("i") + 2, F.lit(NEIGHBOURS))).alias("b")).where("a.new or b.new")
        met = pairs.select(F.col("a.u").alias("v"), F.col("b.u").alias("u")).distinct().join(graph.select("v", "u"), ["v", "u"], "left_anti")
        sets = met.join(nodes.select(F.col("node").alias("v"), F.col("toks").alias("vt")), "v").join(nodes.select(F.col("node").alias("u"), F.col("toks").alias("ut")), "u")
        found = sets.select("v", "u", F.size(F.array_intersect("vt", "ut")).alias("s"), F.lit(True).alias("new")).where("s > 1")
        new = durable(_lists(_both(found).unionAll(graph.select("v", "u", "s", F.lit(False).alias("new")))), "neighbours")
        changed = new.where("new").count()
        discard(graph)
        graph = new
        if changed <= STILL * max(total, 1):
            break
    return graph.select("v", "u", "s")


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) from weighted links (v, u, w), each given once in both directions, by modularity; ``community`` is a node of it."""
    graph = edges.select("v", "u", F.col("w").cast("double"))
    place = durable(graph.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("community")), "communities")
    for _ in range(LEVELS):
        moved = _local_moving(graph)
        if moved is None:
            break
        to = moved.select(F.col("node").alias("community"), F.col("community").alias("next"))
        place = durable(place.join(to, "community").select("node", F.col("next").alias("community")), "communities")
        a, b = moved.select(F.col("node").alias("v"), F.col("community").alias("cv")), moved.select(F.col("node").alias("u"), F.col("community").alias("cu"))
        graph = durable(graph.join(a, "v").join(b, "u").groupBy(F.col("cv").alias("v"), F.col("cu").alias("u")).agg(F.sum("w").alias("w")), "level")
    return place


def _local_moving(graph: DataFrame) -> DataFrame | None:
    """(node, community) after moves that each raise modularity; None if no node moves."""
    degree = durable(graph.groupBy("v").agg(F.sum("w").alias("k")), "degrees")
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    links = graph.where("v <> u")
    at = degree.select(F.col("v").alias("node"), "k", F.col("v").alias("community"))
    any_moved = False
    for turn in range(MOVES):
        weight = at.groupBy("community").agg(F.sum("k").alias("tot"))
        into = links.join(at.select(F.col("node").alias("u"), "community"), "u").groupBy(F.col("v").alias("node"), F.col("community").alias("target")).agg(F.sum("w").alias("inside"))
        options = into.join(at, "node").join(weight.select(F.col("community").alias("target"), "tot"), "target")
        gain = F.col("inside") - F.col("k") * (F.col("tot") - F.when(F.col("target") == F.col("community"), F.col("k")).otherwise(0.0)) / total
        # of equal gains the smaller community; moves go to smaller numbers only, every second turn those of half the nodes to any
        best = options.withColumn("gain", gain).groupBy("node").agg(
            F.max(F.struct("gain", (-F.col("target")).alias("t"))).alias("best"),
            F.max(F.when(F.col("target") == F.col("community"), F.col("gain"))).alias("now"),
        )
        target = -F.col("best.t")
        free = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0) if turn % 2 else F.lit(False)
        better = (F.col("best.gain") > F.coalesce("now", F.lit(0.0)) + 1e-9) & ((target < F.col("community")) | free)
        new = at.join(best, "node", "left").withColumn("moves", F.coalesce(better, F.lit(False))).select("node", "k", F.when(F.col("moves"), target).otherwise(F.col("community")).alias("community"), "moves")
        at = durable(new, "moves")
        n = at.where("moves").count()
        at = at.drop("moves")
        any_moved |= n > 0
        if n == 0 and turn % 2 == 0:
            break
    return at.select("node", "community") if any_moved else None


def clusters(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): (key, node, cluster) of every row with content, and (node, cluster, degree), the internal weighted degree of each set of words."""
    rows = durable(content(df, key, text).withColumn("node", F.xxhash64("toks")), "content")
    nodes = durable(rows.groupBy("node").agg(F.first("toks").alias("toks"), F.count("*").alias("n")), "nodes")
    graph = neighbour_graph(nodes.select("node", "toks"))
    size = nodes.select("node", F.size("toks").alias("size"))
    sized = graph.join(size.select(F.col("node").alias("v"), F.col("size").alias("vn")), "v").join(size.select(F.col("node").alias("u"), F.col("size").alias("un")), "u")
    linked = sized.where(F.col("s") >= F.ceil(F.greatest("vn", "un") * AGREE - 1e-9)).select("v", "u", F.col("s").alias("w"))
    linked = durable(linked.unionAll(linked.select(F.col("u").alias("v"), F.col("v").alias("u"), "w")).groupBy("v", "u").agg(F.max("w").alias("w")), "links")
    place = communities(linked)
    placed = durable(nodes.join(place, "node", "left").select("node", "n", F.coalesce("community", "node").alias("cluster")), "placed")
    a, b = placed.select(F.col("node").alias("v"), F.col("cluster").alias("cv")), placed.select(F.col("node").alias("u"), F.col("cluster").alias("cu"), F.col("n").alias("un"))
    degree = linked.join(a, "v").join(b, "u").where("cv = cu").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("w") * F.col("un")).alias("degree"))
    described = placed.join(degree, "node", "left").select("node", "n", "cluster", F.coalesce("degree", F.lit(0)).alias("degree"))
    return rows.select("key", "node").join(placed.select("node", "cluster"), "node").select("key", "node", "cluster"), described


def shared_causes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cluster_id) of the rows whose cluster has two rows or more; ``cluster_id`` is its smallest key."""
    members, _ = clusters(df, key, text)
    members = durable(members, "members")
    named = members.groupBy("cluster").agg(F.min("key").alias("cluster_id"), F.count("*").alias("n")).where("n > 1").select("cluster", "cluster_id")
    return members.join(named, "cluster").select("key", "cluster_id")


def typical_members(df: DataFrame, key: str, text: str, top: int = 3) -> DataFrame:
    """(cluster_id, size, rank, key, degree): each cluster's size and its most typical members; ties by key."""
    members, nodes = clusters(df, key, text)
    members = durable(members, "members")
    named = members.groupBy("cluster").agg(F.min("key").alias("cluster_id"), F.count("*").alias("size")).where("size > 1")
    first = members.groupBy("cluster", "node").agg(F.min("key").alias("key"))  # equal sets are equally typical
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "key"))
    return first.join(nodes.select("node", "degree"), "node").withColumn("rank", rank).where(F.col("rank") <= top).join(named, "cluster").select("cluster_id", "size", "rank", "key", "degree")
