"""Categories, rubric documents and review packets; documents are of a few dozen categories and live on the driver."""

from __future__ import annotations

from html import escape
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.functions import text as T
from lodestack.functions.jsonfn import anchors_of

#: What each score of a dimension says.
ANCHORS = {"1": "absent or wrong throughout", "2": "wrong in most cases", "3": "right in common cases only", "4": "right but for rare cases", "5": "right throughout"}


def consolidated(rows: DataFrame, cluster: str, mapping: DataFrame, fallback: str, most: int) -> DataFrame:
    """``rows`` with ``category``: the mapping's name of their cluster (cluster, category), ``fallback`` for clusters without one, and for all but the ``most`` - 1 largest categories.

    Ties of size go by name.
    """
    names = mapping.groupBy(F.col("cluster").alias("_c")).agg(F.min(T.slug(F.col("category"))).alias("_name"))
    named = rows.join(names, F.col(cluster) == F.col("_c"), "left").withColumn("category", F.coalesce("_name", F.lit(fallback))).drop("_c", "_name")
    sizes = named.groupBy("category").agg(F.count("*").alias("_n")).where(F.col("category") != fallback)
    kept = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_n"), "category"))).where(F.col("_r") < most).select(F.col("category").alias("_kept"))  # a row a category
    return named.join(kept, F.col("category") == F.col("_kept"), "left").withColumn("category", F.coalesce("_kept", F.lit(fallback))).drop("_kept")


def coverage(rows: DataFrame, cluster: str, mapping: DataFrame) -> DataFrame:
    """(cluster, mapped, used): clusters of either side that the other lacks show up as false."""
    a = rows.select(F.col(cluster).alias("cluster")).where("cluster is not null").distinct().withColumn("used", F.lit(True))
    b = mapping.select("cluster").distinct().withColumn("mapped", F.lit(True))
    return a.join(b, "cluster", "full").select("cluster", F.coalesce("mapped", F.lit(False)).alias("mapped"), F.coalesce("used", F.lit(False)).alias("used"))


def rubric(categories: DataFrame, threshold: float = 3.5) -> dict[str, Any]:
    """A rubric document from (category, rows, tasks): one dimension a category, weighted by the share of failures, the largest ones critical."""
    rows = sorted(categories.select("category", "rows", "tasks").collect(), key=lambda r: (-r["rows"], r["category"]))  # a row a category
    total = sum(r["rows"] for r in rows) or 1
    dimensions = [{"id": r["category"], "weight": round(r["rows"] / total, 4), "evidence": {"failures": r["rows"], "tasks": r["tasks"]}, "anchors": dict(ANCHORS)} for r in rows]
    return {"dimensions": dimensions, "aggregation": {"method": "weighted_mean", "pass_threshold": threshold, "critical": [d["id"] for d in dimensions if d["weight"] >= 0.25]}}


def rubric_problems(document: dict[str, Any]) -> list[str]:
    """What a rubric document lacks; [] if it can be used."""
    ids = [d.get("id") for d in document.get("dimensions", [])]
    out = ["no_dimensions"] * (not ids) + ["repeated_id"] * (len(set(ids)) < len(ids)) + ["empty_id"] * (not all(ids))
    out += [f"anchors:{d.get('id')}" for d in document.get("dimensions", []) if set(d.get("anchors", {})) != set(ANCHORS)]
    unknown = set(document.get("aggregation", {}).get("critical", [])) - set(ids)
    return out + [f"unknown_critical:{x}" for x in sorted(unknown)]


def packet(items: DataFrame, key: str, fields: list[str], labels: list[str], most: int = 500) -> str:
    """A review packet in Markdown: at most ``most`` items with their fields and the labels to choose from."""
    out = ["# Review packet", "", "Labels: " + ", ".join(f"`{x}`" for x in labels), ""]
    rows = items.select(key, *fields).orderBy(key).limit(most + 1).collect()
    for r in rows[:most]:
        out += [f"## {r[key]}", ""]
        for f in fields:
            v = "" if r[f] is None else str(r[f])
            out += [f"**{f}**", "", "```", v.replace("```", "'''"), "```", ""] if "\n" in v else [f"**{f}**: {v}", ""]
        out += ["Label: ", ""]
    if len(rows) > most:
        out += [f"{items.count() - most} more items are not shown.", ""]
    return "\n".join(out)


def annotation_schema(labels: list[str]) -> dict[str, Any]:
    """The JSON schema of an annotation of a packet's item."""
    text = {"type": "string"}
    fields = {"item_id": text, "label": {"enum": [*labels, None]}, "confidence": {"enum": ["low", "medium", "high", None]}, "notes": text, "status": {"enum": ["pending", "done", "skipped"]}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": fields, "required": ["item_id", "label", "status"], "additionalProperties": False}


def html_index(items: DataFrame, key: str, fields: list[str], most: int = 500) -> str:
    """A page that lists a packet's items, with its texts escaped; how many more there are is said below."""
    rows = items.select(key, *fields).orderBy(key).limit(most + 1).collect()
    cell = lambda v: f"<td>{escape('' if v is None else str(v))}</td>"
    body = "".join(f'<tr id="{escape(str(r[key]))}">' + "".join(map(cell, r)) + "</tr>\n" for r in rows[:most])
    head = "".join(f"<th>{escape(c)}</th>" for c in (key, *fields))
    more = f"<p>{items.count() - most} more items are not shown.</p>\n" if len(rows) > most else ""
    return f"<!doctype html>\n<meta charset=\"utf-8\">\n<title>Review items</title>\n<table>\n<tr>{head}</tr>\n{body}</table>\n{more}"


def low_dimensions(scores: Column, least: int) -> Column:
    """The applicable dimensions with a score below ``least``, by name."""
    low = F.map_filter(scores, lambda _, d: F.coalesce(d["applicable"], F.lit(False)) & (d["score"] < least))
    return F.array_sort(F.map_keys(low))


def taxonomy_faults(taxonomy: dict[str, Any]) -> list[str]:
    """What keeps a taxonomy of categories with refined rubrics from becoming a rubric; [] if nothing does."""
    categories = taxonomy.get("categories")
    if not isinstance(categories, list) or not categories:
        return ["no_categories"]
    ids = [str(c.get("id") or "") for c in categories]
    out = ["empty_id"] * (not all(ids)) + [f"repeated_id:{x}" for x in sorted({x for x in ids if x and ids.count(x) > 1})]
    for c in categories:
        anchors = (c.get("refined_rubric") or {}).get("score_anchors") if isinstance(c.get("refined_rubric"), dict) else None
        if c.get("id") and (not isinstance(anchors, dict) or set(map(str, anchors)) != set(ANCHORS)):
            out.append(f"anchors:{c['id']}")
    return out


def rubric_from_taxonomy(taxonomy: dict[str, Any], written: dict[str, Any] | None = None, threshold: float = 3.5) -> dict[str, Any]:
    """A rubric with a dimension a category, weighted by its failures: the refined texts where they are whole, else the usual anchors; a model's ``written`` rubric may replace texts but no dimension, weight or rule.  ``audit`` lists what was filled or refused."""
    categories = [c for c in taxonomy.get("categories") or [] if c.get("id")]
    total = sum(int(c.get("rows") or 0) for c in categories) or 1
    theirs = {str(d.get("id")): d for d in (written or {}).get("dimensions", []) if isinstance(d, dict)}
    dimensions, audit = [], taxonomy_faults(taxonomy)
    for c in categories:
        refined = c.get("refined_rubric") if isinstance(c.get("refined_rubric"), dict) else {}
        source = theirs.get(str(c["id"]), {}).get("anchors") or refined.get("score_anchors")
        anchors, filled = anchors_of(source, ANCHORS)
        audit += [f"filled:{c['id']}:{k}" for k in filled]
        dimensions.append({"id": str(c["id"]), "weight": round(int(c.get("rows") or 0) / total, 4), "definition": _plain(theirs.get(str(c["id"]), {}).get("definition") or refined.get("definition") or c.get("name")), "anchors": anchors})
    audit += [f"refused:{x}" for x in sorted(set(theirs) - {d["id"] for d in dimensions})]
    return {"dimensions": dimensions, "aggregation": {"method": "weighted_mean", "pass_threshold": threshold, "critical": [d["id"] for d in dimensions if d["weight"] >= 0.25]}, "audit": audit}


def _plain(text: Any) -> str:
    return " ".join(str(text or "").split())
