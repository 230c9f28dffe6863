"""Sinks: pages, indexes, graph exports, and the merge-write that keeps reviewed bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T


def graph_nodes(concepts: DataFrame, maps: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes of the exported graph: id, kind, label. A concept's map is the last that has it."""
    return (
        concepts.select(F.col("slug").alias("id"), F.lit("concept").alias("kind"), F.coalesce("title", F.lit("")).alias("label"))
        .unionByName(maps.select(F.col("slug").alias("id"), F.lit("moc").alias("kind"), F.coalesce("title", F.lit("")).alias("label")))
        .unionByName(sources.select(F.col("source_file").alias("id"), F.lit("source").alias("kind"), F.coalesce("title", F.lit("")).alias("label")))
    )


def graph_edges(edges: DataFrame, maps: DataFrame) -> DataFrame:
    """Edges of the exported graph: src, dst, relation; a map contains its members, equal relations both ways are one edge."""
    key = F.array_sort(F.array("src", "dst"))
    once = edges.groupBy(key.alias("k"), "relation").agg(F.min_by(F.struct("src", "dst"), "src").alias("e")).select("e.*", "relation")
    return once.unionByName(maps.select(F.col("slug").alias("src"), F.explode("members").alias("dst"), F.lit("contains").alias("relation")))


def mermaid(edges: DataFrame) -> DataFrame:
    """One line of a Mermaid graph per edge: line. Lines are rows, so a graph of any size is never one string."""
    return edges.select(F.concat(F.lit("    "), T.mermaid_id(F.col("src")), F.lit(" -->|"), F.col("relation"), F.lit("| "), T.mermaid_id(F.col("dst"))).alias("line"))


def front_matter(fields: dict[str, Column]) -> Column:
    """A front-matter block of scalar fields; values are JSON-quoted, which YAML reads."""
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def concept_pages(concepts: DataFrame) -> DataFrame:
    """path, content of concept pages. concepts: slug, title, summary, tags, confidence."""
    head = front_matter({"title": F.coalesce("title", F.lit("")), "type": F.lit("concept"), "confidence": F.coalesce("confidence", F.lit(1.0)).cast("string")})
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), T.sanitize_tag(t))), " ")
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.nullif("summary", F.lit("")), F.nullif(tags, F.lit("")))
    return concepts.select(F.concat(F.lit("concepts/"), "slug", F.lit(".md")).alias("path"), F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("content"))


def merge_write(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages to write: path, content, action. Equal pages are left alone, a reviewed page keeps its old body under the new head.

    old: path, content, reviewed; new: path, content. Pages that are no longer
    made come out with action delete and null content.
    """
    from tesserine.sources.vault import split_front_matter

    both = new.withColumnRenamed("content", "now").join(old.withColumnRenamed("content", "was"), "path", "full_outer")
    n, w = split_front_matter(F.col("now")), split_front_matter(F.col("was"))
    kept = F.concat(F.lit("---\n"), n["head"], F.lit("\n---\n\n"), w["body"])
    content = F.when(F.col("now").isNotNull() & F.coalesce("reviewed", F.lit(False)) & n["head"].isNotNull(), kept).otherwise(F.col("now"))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "create").otherwise("update")
    return both.select("path", content.alias("content"), action.alias("action"), "was").filter(~F.col("content").eqNullSafe(F.col("was"))).drop("was")


def directory_index(pages: DataFrame) -> DataFrame:
    """Lines of the index of each directory: dir, name, line."""
    rows = pages.select(F.regexp_extract("path", r"^(.*?)/?[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1).alias("name"))
    return rows.withColumn("line", F.concat(F.lit("- [["), "name", F.lit("]]")))


def evidence_numbers(claims: DataFrame) -> DataFrame:
    """slug, ord, mark: running number of displayable quotes in a concept, with * if not verified. claims: slug, ord, quote, verification."""
    from pyspark.sql import Window

    shown = F.coalesce(F.col("quote"), F.lit("")) != ""
    k = F.sum(shown.cast("int")).over(Window.partitionBy("slug").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    mark = F.when(shown, F.concat(F.lit("["), k.cast("string"), F.when(F.col("verification") == "verified", "]").otherwise("*]")))
    return claims.select("slug", "ord", mark.alias("mark"))


def events(rows: DataFrame) -> DataFrame:
    """One JSON text per row, without null fields: line."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "true"}).alias("line"))
