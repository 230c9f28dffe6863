"""Maintenance rules over the merged graph, fix plans, views and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T

# The fix of each kind of finding, and whether a person must look first.
FIXES = {
    "broken_relation": ("remove_broken_relation", False),
    "orphan_concept": ("propose_moc_assignment", True),
    "moc_assignment_candidate": ("propose_moc_assignment", True),
    "tag_normalization": ("normalize_tag", False),
    "alias_candidate": ("propose_alias", True),
    "empty_generated_stub": ("remove_empty_generated_stub", False),
}


def broken_relations(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges whose target is no concept: src, dst."""
    return edges.join(concepts.select(F.col("slug").alias("dst")), "dst", "left_anti").select("src", "dst")


def orphans(concepts: DataFrame, maps: DataFrame) -> DataFrame:
    """Concepts in no topic map: slug."""
    return concepts.select("slug").join(maps.select(F.explode("members").alias("slug")), "slug", "left_anti").distinct()


def untidy_tags(found: DataFrame) -> DataFrame:
    """Tags that aren't in canonical form: slug, tag, canonical."""
    tags = found.select("slug", F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull()).distinct()
    return tags.withColumn("canonical", T.normalise_tag(F.col("tag"))).filter(F.col("canonical") != F.col("tag"))


def alias_candidates(concepts: DataFrame) -> DataFrame:
    """Parenthesised parts of a title that aren't an alias yet: slug, alias."""
    groups = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda x: F.trim(x)))
    known = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.casefold)
    rows = concepts.select("slug", "title", known.alias("known"), F.explode(groups).alias("alias"))
    wanted = (F.length("alias") <= 160) & F.col("alias").rlike(r"[\p{L}\p{N}]") & (T.casefold(F.col("alias")) != T.casefold(F.trim("title"))) & ~F.array_contains("known", T.casefold(F.col("alias")))
    return rows.filter(wanted).select("slug", "alias")


def findings(concepts: DataFrame, occurrences: DataFrame, edges: DataFrame, maps: DataFrame) -> DataFrame:
    """All findings: kind, path, message, details, severity."""

    def rule(rows: DataFrame, kind: str, path: Column, message: Column, details: Column, severity: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), path.alias("path"), message.alias("message"), details.alias("details"), F.lit(severity).alias("severity"))

    def page(column: str) -> Column:
        return F.concat(F.lit("concepts/"), F.col(column), F.lit(".md"))

    stub = occurrences.groupBy("slug").agg(F.max(T.body_chars(F.col("sections"))).alias("chars")).filter("chars = 0")
    parts = [
        rule(broken_relations(edges, concepts), "broken_relation", page("src"), F.concat(F.lit("no concept "), "dst"), F.create_map(F.lit("target"), F.col("dst")), "warning"),
        rule(orphans(concepts, maps), "orphan_concept", page("slug"), F.lit("in no map"), F.create_map(F.lit("concept"), F.col("slug")), "info"),
        rule(untidy_tags(occurrences), "tag_normalization", page("slug"), F.concat(F.lit("tag "), "tag"), F.create_map(F.lit("tag"), F.col("tag"), F.lit("canonical"), F.col("canonical")), "info"),
        rule(alias_candidates(concepts), "alias_candidate", page("slug"), F.concat(F.lit("alias "), "alias"), F.create_map(F.lit("alias"), F.col("alias")), "info"),
        rule(stub, "empty_generated_stub", page("slug"), F.lit("no body"), F.create_map(F.lit("concept"), F.col("slug")), "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


def plan_fixes(found: DataFrame) -> DataFrame:
    """Fix of each finding: kind, path, message, fix, requires_review."""
    fix = F.try_element_at(F.create_map(*[x for k, (name, _) in FIXES.items() for x in (F.lit(k), F.lit(name))]), F.col("kind"))
    review = F.try_element_at(F.create_map(*[x for k, (_, r) in FIXES.items() for x in (F.lit(k), F.lit(r))]), F.col("kind"))
    return found.select("kind", "path", "message", fix.alias("fix"), review.alias("requires_review")).filter("fix is not null")


def citations(answer: Column) -> Column:
    """Distinct link targets cited in an answer, anchors removed, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x)))


def validate_citations(answers: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """n_cited, n_invalid and valid of each answer: something is cited and nothing outside the allowed targets.

    answers: key, answer; allowed: target.
    """
    cited = answers.select(key, F.explode_outer(citations(F.coalesce("answer", F.lit("")))).alias("target"))
    known = allowed.select("target").distinct().withColumn("ok", F.lit(1))
    rows = cited.join(known, "target", "left").groupBy(key).agg(F.count("target").alias("n_cited"), F.count_if(F.col("target").isNotNull() & F.col("ok").isNull()).alias("n_invalid"))
    return rows.withColumn("valid", (F.col("n_cited") > 0) & (F.col("n_invalid") == 0))


def ground(answer: Column, valid: Column, paths: Column) -> Column:
    """The answer, or without its links and with all retrieved paths as references if a citation is invalid."""
    references = F.concat(F.lit("\n\n## References\n\n"), F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- [["), p, F.lit("]]"))), "\n"))
    return F.when(valid, answer).otherwise(F.concat(F.trim(F.regexp_replace(answer, r"\[\[[^\]]+\]\]", "")), references))
