"""Concept tables: explode, merge, bundle, claims, maps and their thin-concept filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per key; rows delivered again are dropped before anything is counted."""
    return df.dropDuplicates([key])


def occurrences(syntheses: DataFrame) -> DataFrame:
    """One row per concept occurrence: synthesis_id, source_file, pos, and the concept's fields.

    A missing slug is made from the title. `ord` is the order of arrival
    (synthesis, then place), on which first-wins rules depend.
    """
    rows = distinct_rows(syntheses, "synthesis_id").select("synthesis_id", "source_file", F.posexplode("concepts").alias("pos", "c"))
    slug = F.coalesce(F.nullif(F.col("c.slug"), F.lit("")), T.slugify(F.coalesce(F.col("c.title"), F.lit(""))))
    fields = [F.col(f"c.{f}").alias(f) for f in ("title", "summary", "tags", "aliases", "sections", "claims", "related", "confidence", "provenance", "is_new")]
    return rows.select("synthesis_id", "source_file", "pos", F.struct("synthesis_id", "pos").alias("ord"), slug.alias("slug"), *fields)


def _in_order(column: str) -> Column:
    """Arrays of all occurrences, concatenated in order of arrival."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.col(column), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))


def merge(found: DataFrame) -> DataFrame:
    """Concepts by slug: the first occurrence gives title and summary, tags and aliases are ordered unions,
    confidence is the largest, is_new holds only if it held everywhere."""
    tags = found.withColumn("tags", T.normalise_tags(F.col("tags")))
    first = F.min_by(F.struct("title", "summary", "provenance"), F.col("ord"))
    rows = tags.groupBy("slug").agg(
        first.alias("f"), F.array_distinct(_in_order("tags")).alias("tags"), F.array_distinct(_in_order("aliases")).alias("aliases"), F.max("confidence").alias("confidence"), F.bool_and("is_new").alias("is_new"),
        F.sum(F.coalesce(F.size("sections"), F.lit(0))).alias("n_sections"), F.sum(F.coalesce(F.size("claims"), F.lit(0))).alias("n_claims"), F.count(F.lit(1)).alias("n_occurrences"),
    )
    return rows.select("slug", "f.title", "f.summary", "f.provenance", "tags", "aliases", "confidence", "is_new", "n_sections", "n_claims", "n_occurrences")


def links(found: DataFrame) -> DataFrame:
    """Related links, first per (slug, target) by order of arrival: src, dst, relation, display, ord."""
    rows = found.select("slug", "ord", F.posexplode("related").alias("k", "r")).select(F.col("slug").alias("src"), F.col("r.slug").alias("dst"), T.normalise_relation(F.col("r.relation")).alias("relation"), F.col("r.display").alias("display"), F.struct("ord", "k").alias("ord"))
    best = rows.filter(F.col("dst").isNotNull()).groupBy("src", "dst").agg(F.min_by(F.struct("relation", "display", "ord"), F.col("ord")).alias("m"))
    return best.select("src", "dst", "m.relation", "m.display", "m.ord")


def backlinks(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Missing reverse edges inside the bundle, with the inverse relation and the title of the linking concept."""
    inside = edges.join(concepts.select(F.col("slug").alias("dst")), "dst", "left_semi")
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    lone = inside.filter(F.col("src") != F.col("dst")).join(back, ["src", "dst"], "left_anti")
    titled = lone.join(concepts.select(F.col("slug").alias("src"), "title"), "src")
    return titled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), T.inverse_relation(F.col("relation")).alias("relation"), F.col("title").alias("display"))


def maps(syntheses: DataFrame) -> DataFrame:
    """Topic maps by slug: title of the first, members as ordered union with their place."""
    rows = distinct_rows(syntheses, "synthesis_id").select("synthesis_id", F.posexplode("maps").alias("pos", "m"))
    rows = rows.select("synthesis_id", "pos", F.struct("synthesis_id", "pos").alias("ord"), F.coalesce(F.nullif(F.col("m.slug"), F.lit("")), T.slugify(F.coalesce(F.col("m.title"), F.lit("")))).alias("slug"), F.col("m.title").alias("title"), F.col("m.concept_slugs").alias("members"))
    out = rows.groupBy("slug").agg(F.min_by("title", "ord").alias("title"), F.array_distinct(_in_order("members")).alias("members"))
    return out


def keep_substantial(found: DataFrame, least: int) -> DataFrame:
    """Concept occurrences whose body has at least `least` characters."""
    return found.filter(T.body_chars(F.col("sections")) >= least)


def claims(found: DataFrame) -> DataFrame:
    """One row per claim: synthesis_id, source_file, slug, text, source_ref, ord."""
    rows = found.select("synthesis_id", "source_file", "slug", "ord", F.posexplode("claims").alias("k", "cl"))
    return rows.select("synthesis_id", "source_file", "slug", F.col("cl.text").alias("text"), F.col("cl.source_ref").alias("source_ref"), F.struct("ord", "k").alias("ord"))


def unique_claims(rows: DataFrame, by: str) -> DataFrame:
    """Claims whose (concept, reference) key occurs once per `by`: key columns and text."""
    ref = F.regexp_replace(F.trim(F.coalesce("source_ref", F.lit(""))), r"\s+", " ")
    ready = rows.select(by, T.casefold(F.trim("slug")).alias("concept"), T.casefold(ref).alias("ref"), F.trim(F.coalesce("text", F.lit(""))).alias("text")).filter((F.col("concept") != "") & (F.col("ref") != "") & (F.col("text") != ""))
    return ready.groupBy(by, "concept", "ref").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).filter("n = 1").drop("n")


def changed_claims(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Claims with one stable key in both revisions whose text differs apart from case and spacing."""
    plain = lambda c: F.regexp_replace(T.casefold(c), r"\s+", " ")
    both = old.withColumnRenamed("text", "old_text").join(new.withColumnRenamed("text", "new_text"), [by, "concept", "ref"])
    changed = both.filter(plain(F.col("old_text")) != plain(F.col("new_text")))
    key = F.substring(F.sha2(F.concat_ws("\x1f", F.col(by).cast("string"), "concept", "ref", "old_text", "new_text"), 256), 1, 20)
    return changed.withColumn("change_id", F.concat(F.lit("source-revision-"), key))


def prefer_evidence(rows: DataFrame, by: list[str]) -> DataFrame:
    """One claim per text: evidence before none, verified before not, later pass before earlier, then arrival."""
    key = F.lower(F.trim("text"))
    w = Window.partitionBy(*by, "_key").orderBy(F.desc("has_evidence"), F.desc("verified"), F.desc("pass"), "ord")
    return rows.withColumn("_key", key).filter("_key <> ''").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_key")
