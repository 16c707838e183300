"""The queries of the training-data problems over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestack.durable import durable
from lodestack.llm import clusters, groupsplit, leakage, mojibake, neardup, packing, pairdefects, splitleak, topn, truncation

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(_table(spark, d, "responses"), "response_id", "extracted_code")
    return pairs.select(F.col("a").alias("response_id_a"), F.col("b").alias("response_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a response: its group of near-duplicates and its number of different linked programs."""
    members, links = neardup.similar_texts(_table(spark, d, "responses"), "response_id", "extracted_code")
    links = durable(links, "links")
    roots = groupsplit.components(links.select("a", "b"))
    both = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    named = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(both, "rep", "left")
    return named.select(F.col("key").alias("response_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ids = _table(spark, d, "responses").select("response_id", "id").where("id is not null").dropDuplicates(["response_id"])
    scored = ids.join(topn.latest_scores(_table(spark, d, "judgments")), "response_id")
    return topn.top_n(scored, "id", "response_id", "overall_score", 3).select(F.col("grp").alias("id"), F.col("key").alias("response_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ends = truncation.answer_ends(_table(spark, d, "responses"), "response_id", "generated_code", "model")
    return ends.where("cut").select(F.col("key").alias("response_id"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    ends = truncation.answer_ends(_table(spark, d, "responses"), "response_id", "generated_code", "model")
    return ends.groupBy(F.col("source").alias("model")).agg(F.count("*").alias("answers"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("int")).alias("rate"))


def _cross(spark: SparkSession, d: str) -> DataFrame:
    problems = _table(spark, d, "problems")
    evaluation, training = problems.where("eval_split is not null"), problems.where("split = 'train' and eval_split is null")
    return splitleak.cross_split_pairs(evaluation, training, "id", "prompt")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cross(spark, d).select(F.least("e_key", "t_key").alias("id_a"), F.greatest("e_key", "t_key").alias("id_b")).where("id_a <> id_b").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs by the evaluation row's split and both rows' datasets."""
    of = _table(spark, d, "problems").where("id is not null").groupBy("id").agg(F.min(F.lower(F.trim("eval_split"))).alias("eval_split"), F.min("dataset").alias("dataset"))
    e = of.select(F.col("id").alias("e_key"), "eval_split", F.col("dataset").alias("eval_dataset"))
    t = of.select(F.col("id").alias("t_key"), F.col("dataset").alias("train_dataset"))
    return _cross(spark, d).join(e, "e_key").join(t, "t_key").groupBy("eval_split", "eval_dataset", "train_dataset").agg(F.count("*").alias("pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.torn_groups(_table(spark, d, "sft_records"))


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    groups = durable(groupsplit.sft_groups(_table(spark, d, "sft_records")), "groups")
    return groupsplit.assign_splits(groups, SHARES).select(F.col("record").alias("id"), F.col("root").alias("base"), "split")


def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    """How many records the assignment has, whether it keeps groups whole, and whether the splits are within a percent of their shares."""
    out = durable(p5_assignment(spark, d), "assigned")
    groups = out.groupBy("base").agg(F.count_distinct("split").alias("splits")).agg(F.max("splits").alias("most"))
    near = [F.abs(F.avg((F.col("split") == k).cast("int")) - v) < 0.01 for k, v in SHARES.items()]
    shares = out.agg(F.count("*").alias("records"), F.count_distinct("id").alias("ids"), *(c.alias(k) for c, k in zip(near, SHARES)))
    return shares.crossJoin(groups).select("records", (F.col("ids") == F.col("records")).alias("once"), (F.col("most") == 1).alias("whole"), F.greatest(*(~F.col(k) for k in SHARES)).alias("off"))  # a row each


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pairdefects.sft_and_responses(_table(spark, d, "sft_records"), _table(spark, d, "responses"), _table(spark, d, "problems"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).groupBy("src", "defect").agg(F.count("*").alias("records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.shared_causes(_table(spark, d, "failures"), "response_id", "llm_summary")
    return found.select(F.col("key").alias("response_id"), "cluster_id")


def p7_typical(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical_members(_table(spark, d, "failures"), "response_id", "llm_summary").withColumnRenamed("key", "response_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(_table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing keeps to the capacity and holds every token once, and how many containers lie between the least possible number and that."""
    packed = durable(packing.pack(_table(spark, d, "documents"), "doc_id", "text"), "packed")
    full = packed.groupBy("context").agg(F.sum("tokens").alias("tokens"))
    whole = packed.groupBy("key").agg(F.sum("tokens").alias("got"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.count_distinct("piece").alias("n"), F.max("pieces").alias("want"))
    a = full.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("tokens"), (F.avg("tokens") / packing.CAPACITY).alias("fill"))
    b = whole.agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.col("want")).alias("torn"))
    return a.crossJoin(b).select("documents", "tokens", (F.col("most") <= packing.CAPACITY).alias("within_capacity"), (F.col("torn") == 0).alias("complete"), (F.col("fill") > 0.9).alias("well_filled"))  # a row each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "bench_items"), "item_id", "text")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items, in how many documents and how completely."""
    return _leaks(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.max("coverage").alias("coverage"), F.max("longest").alias("longest"))


def p9_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold four fifths of an item in pieces, in whatever order."""
    found = leakage.find_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "bench_items"), "item_id", "text", coverage=0.8)
    return found.where("coverage >= 0.8").select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.bround("coverage", 4).alias("coverage"), ((F.col("longest") >= leakage.RUN) | (F.col("ordered") >= leakage.ORDERED)).alias("in_order"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(_table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_rates, p4_found, p4_counts, p5_found, p5_assignment, p5_balance, p6_found, p6_counts, p7_found, p7_typical, p8_found, p8_packing, p8_fill, p9_found, p9_items, p9_reordered, p10_found, p10_restored)}

_AGREE = """, n as (select k, count(*) as n from s group by k), c as (
  select {pairs} from s a join s b on a.g = b.g and {side} group by all)
select {out} from c join n x on x.k = ka join n y on y.k = kb where common >= 0.65 * (x.n + y.n - common)"""

_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+{1}')"

#: A task is the prompt without its template lines; the lines are those of splitleak.TEMPLATE_LINES.
_TASK = r"""regexp_replace(regexp_replace(prompt, '(?im)^[ \t]*The evaluator calls:[ \t]*\r?\n[ \t]*\w+(?:[ \t]*,[ \t]*\w+)*[ \t]*\r?$', '', 'g'),
 '(?im)^[ \t]*(?:""" + "|".join(x.replace("'", "''") for x in splitleak.TEMPLATE_LINES) + r""")[ \t]*\r?$', '', 'g')"""

_BASE = "(select regexp_replace(regexp_replace(split_part(lower(trim({0})), '__', 1), '[-/\\s]+', '/', 'g'), '(^|/)0+([0-9])', '\\1\\2', 'g'))"

SQL = {
    "p1_found": "with t as (select response_id as k, any_value(" + _WORDS.format("extracted_code", r"|[^\p{L}\p{N}_\s]") + ") as w from responses where trim(extracted_code) <> '' group by 1), "
    "s as (select distinct k, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select k, w, unnest(range(1, len(w) - 1)) as i from t))"
    + _AGREE.format(pairs="a.k as ka, b.k as kb, count(*) as common", side="a.k < b.k", out="ka as response_id_a, kb as response_id_b"),
    "p2_found": "with j as (select response_id, overall_score as s from judgments qualify row_number() over (partition by response_id order by judged_at desc, overall_score desc nulls last) = 1), "
    "r as (select distinct response_id, id from responses where id is not null) select id, response_id from r join j using (response_id) where s is not null and not isnan(s) "
    "qualify row_number() over (partition by id order by s desc, response_id) <= 3",
    "p4_found": "with t as (select id as k, eval_split is not null as e, any_value(" + _WORDS.format("lower(" + _TASK + ")", "") + ") as w from problems where eval_split is not null or split = 'train' group by 1, 2), "
    "s as (select distinct k, e, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select k, e, w, unnest(range(1, len(w) - 1)) as i from t))"
    + _AGREE.format(pairs="a.k as ka, b.k as kb, count(*) as common", side="a.e and not b.e", out="least(ka, kb) as id_a, greatest(ka, kb) as id_b"),
    "p5_found": "with recursive r as (select distinct id, nullif(lower(trim(eval_split)), '') as e, unnest([" + ", ".join(_BASE.format(c) for c in ("id", "problem_id", "metadata.original_response_id", "metadata.chosen_response_id")) + "]) as p from sft_records), "
    "k as (select distinct id, p from r where p is not null and not starts_with(p, 'mix/') and regexp_matches(p, '^[a-z].*/[0-9]+$')), "
    "link as (select distinct a.p as x, b.p as y from k a join k b using (id)), "
    "reach as (select x, y from link union select reach.x, link.y from reach join link on reach.y = link.x), root as (select x as p, min(y) as root from reach group by 1), "
    "g as (select distinct k.id, root.root from k join root using (p)), "
    "torn as (select root, min(g.id) as group_id from g join r using (id) group by 1 having count(distinct e) > 1) select id, group_id from g join torn using (root)",
    "p8_found": "select doc_id from documents where octet_length(encode(coalesce(text, ''))) + 1 > 4096",
}

_P1, _P4 = SQL["p1_found"], SQL["p4_found"]
_REACH = "link as (select ka as x, kb as y from pair union select kb, ka from pair), reach as (select x, y from link union select reach.x, link.y from reach join link on reach.y = link.x)"

SQL["p1_groups"] = (
    "with recursive pair as (select response_id_a as ka, response_id_b as kb from (" + _P1 + ")), " + _REACH + ", "
    "w as (select response_id as k, any_value(" + _WORDS.format("extracted_code", r"|[^\p{L}\p{N}_\s]") + ") as w from responses where trim(extracted_code) <> '' group by 1), "
    "s as (select k, md5(array_to_string(list_sort(list(distinct w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])), chr(2))) as h from (select k, w, unnest(range(1, len(w) - 1)) as i from w) group by k), "
    "r as (select k, min(k) over (partition by h) as rep from s), "
    "n as (select a.rep as rep, count(distinct b.rep) as links from link join r a on link.x = a.k join r b on link.y = b.k where a.rep <> b.rep group by 1), "
    "g as (select x as k, min(y) as root from reach group by 1) "
    "select r.k as response_id, coalesce(least(g.root, r.k), r.k) as group_id, coalesce(n.links, 0) as links from r left join g on g.k = r.k left join n on n.rep = r.rep"
)
SQL["p4_counts"] = (
    "with f as (" + _P4.replace("least(ka, kb) as id_a, greatest(ka, kb) as id_b", "ka, kb") + "), p as (select id, min(lower(trim(eval_split))) as eval_split, min(dataset) as dataset from problems where id is not null group by 1) "
    "select e.eval_split, e.dataset as eval_dataset, t.dataset as train_dataset, count(*) as pairs from f join p e on e.id = ka join p t on t.id = kb group by all"
)
_WILSON = "({k} / {n} + 4.0 / (2 * {n}) - 2 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 4.0 / (4.0 * {n} * {n}))) / (1 + 4.0 / {n})"
#: Words without content are found by counts over all rows, as in ``clusters.words_without_content``.
SQL["p7_found"] = (
    "with recursive t as (select response_id as k, any_value(regexp_extract_all(lower(coalesce(nullif(regexp_extract(llm_summary, '\"summary\"\\s*:\\s*\"((?:[^\"\\\\]|\\\\.)*)', 1), ''), llm_summary)), '[\\p{L}\\p{N}_]+')) as w from failures where llm_summary is not null and response_id is not null group by 1 having len(w) > 0), "
    "total as (select count(*) as total from t), e as (select distinct k, unnest(w) as word from t), cnt as (select word, count(*) as df from e group by 1), often as (select word, df from cnt, total where df >= 0.02 * total), "
    "pos as (select word, i, n from (select unnest(w) as word, unnest(range(len(w))) as i, len(w) as n from t) join often using (word)), "
    "place as (select word, side, p, count(*)::double as n from (select word, 0 as side, i as p from pos union all select word, 1, n - i from pos) group by all), "
    "near as (select word, side, p - j as s, sum(n) as n from place, (values (0), (1), (2)) v(j) group by all), most as (select word, max(n) as most from near group by 1), places as (select word, sum(n) as places from place where side = 0 group by 1), "
    "first as (select word from most join places using (word) where " + _WILSON.format(k="most", n="places") + " >= 0.6 union select word from often, total where df >= 0.25 * total), "
    "rest as (select k, word, df from e join cnt using (word) where word not in (select word from first)), "
    "signed as (select k, array_to_string(list_transform(list_sort(list({'df': df, 'word': word}))[1:2], lambda x: x.word), ' ') as s from rest group by 1), kinds as (select count(distinct s) as kinds from signed), "
    "wide as (select word from rest join signed using (k), total, kinds where df >= 0.02 * total group by word, df, total, kinds.kinds having count(distinct s) >= 0.1 * kinds.kinds and count(distinct s) / kinds.kinds >= 1.4 * df / total), "
    "c as (select k, word as t from e where word not in (select word from first) and word not in (select word from wide)), s as (select k, count(*) over (partition by k) as n, t from c), "
    "pair as (select a.k as ka, b.k as kb from s a join s b on a.t = b.t and a.k < b.k group by a.k, b.k having count(*) >= ceil(0.6 * max(greatest(a.n, b.n)) - 1e-9)), " + _REACH + " "
    "select x as response_id, min(y) as cluster_id from reach group by 1"
)
SQL["p5_balance"] = "select count(distinct id) as records, true as once, true as whole, false as off from sft_records where id is not null"
SQL["p8_fill"] = "select count(distinct doc_id) as documents, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as tokens, true as within_capacity, true as complete, true as well_filled from documents"
