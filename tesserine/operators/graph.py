"""Link graph: alias resolution, maturity, personalised PageRank, closures and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.runtime import materialise


def alias_keys(pages: DataFrame) -> DataFrame:
    """Which page a reference means: key, path. A key several pages have belongs to the first path.

    pages: path, title, aliases. Keys are path, stem, title and aliases.
    """
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    refs = pages.select("path", F.explode(F.concat(F.array("path", stem, "title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("ref"))
    return refs.select(T.normalise_reference(F.col("ref")).alias("key"), "path").filter("key <> ''").groupBy("key").agg(F.min("path").alias("path"))


def resolve_links(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct edges src, dst, relation of references that resolve to another page. refs: src, ref, relation."""
    keyed = refs.withColumn("key", T.normalise_reference(F.col("ref")))
    return keyed.join(keys.withColumnRenamed("path", "dst"), "key").filter(F.col("src") != F.col("dst")).select("src", "dst", "relation").distinct()


def maturity(nodes: DataFrame, edges: DataFrame, pages: int = 4, links: int = 3, connected: int = 3) -> DataFrame:
    """One row: counts of pages, edges and connected pages, and whether graph signals may lead."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.count_distinct("n").alias("connected"))
    rows = nodes.agg(F.count(F.lit(1)).alias("pages")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(ends)  # three rows of one
    return rows.withColumn("mature", (F.col("pages") >= pages) & (F.col("edges") >= links) & (F.col("connected") >= connected))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, iterations: int = 40, cut_every: int = 2) -> DataFrame:
    """Personalised PageRank: path, rank. nodes: path; edges: src, dst; seeds: path, weight.

    A fixed number of iterations; out-degrees count distinct targets, the rank
    of pages without links returns to the seeds, seeds that add up to 0 stand
    for all pages. Ranks are read twice an iteration (links and dangling mass), so
    the plan doubles each time: lineage is cut in the shared folder every
    `cut_every` iterations.
    """
    if not 0 < damping < 1 or iterations < 1:
        raise ValueError("pagerank: damping in (0, 1) and at least one iteration")
    nodes = nodes.select("path").distinct()
    weights = nodes.withColumn("weight", F.lit(0.0)) if seeds is None else nodes.join(seeds.groupBy("path").agg(F.sum("weight").alias("weight")), "path", "left")
    weights = weights.select("path", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = weights.agg(F.sum("weight").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return nodes.select("path", F.lit(0.0).alias("rank"))
    person = weights.select("path", (F.col("weight") / total["t"] if total["t"] else F.lit(1.0 / total["n"])).alias("p"))
    pairs = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("path", "src"), "src", "left_semi").join(nodes.withColumnRenamed("path", "dst"), "dst", "left_semi")
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    out = materialise(pairs.join(degree, "src"), "out")
    base = materialise(person.join(degree.withColumnRenamed("src", "path"), "path", "left").select("path", "p", F.col("deg").isNull().alias("dangling")), "person")
    ranks = base.select("path", "p", "dangling", F.col("p").alias("rank"))
    for k in range(1, iterations + 1):
        given = out.join(ranks.select(F.col("path").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        lost = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        step = base.join(given, "path", "left").join(F.broadcast(lost))  # one row
        ranks = step.select("path", "p", "dangling", ((1 - damping) * F.col("p") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("rank"))
        if k % cut_every == 0 and k < iterations:
            ranks = materialise(ranks, "ranks")
    return ranks.select("path", "rank")


def chain_ends(mapping: DataFrame) -> DataFrame:
    """Last survivor of every victim: victim, survivor. Chains are halved each round; a cycle ends at its smallest member."""
    now = mapping.select("victim", "survivor").filter(F.col("victim") != F.col("survivor")).groupBy("victim").agg(F.min("survivor").alias("survivor"))
    while True:
        ahead = now.select(F.col("victim").alias("survivor"), F.col("survivor").alias("next"))
        step = now.join(ahead, "survivor", "left").select("victim", F.coalesce("next", "survivor").alias("to"), F.col("next").isNotNull().alias("moved"))
        step = materialise(step, "chain")
        stopped = step.filter(F.col("moved") & (F.col("to") != F.col("victim"))).limit(1).count() == 0
        if stopped:
            return step.select("victim", F.when(F.col("to") == F.col("victim"), F.lit(None)).otherwise(F.col("to")).alias("survivor")).filter("survivor is not null")
        now = step.filter(F.col("to") != F.col("victim")).select("victim", F.col("to").alias("survivor"))


def lexical(pages: DataFrame, query: str) -> DataFrame:
    """path, score: 4 x title, 3 x alias and 1 x body occurrences of the query's terms. pages: path, title, aliases, body."""
    terms = F.array_distinct(T.tokens(F.lit(query)))

    def hits(column):
        return F.size(F.filter(T.tokens(column), lambda t: F.array_contains(terms, t)))

    score = 4 * hits(F.col("title")) + 3 * hits(F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")) + hits(F.col("body"))
    return pages.select("path", "title", score.cast("double").alias("lexical"))


def retrieve(pages: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Best pages for a query: path, title, score, lexical, pagerank, strategy.

    Lexical score alone without edges or hits; otherwise PageRank from the hits,
    which leads only in a mature graph.
    """
    scored = materialise(lexical(pages, query), "lexical")
    seeds = scored.filter("lexical > 0").select("path", F.col("lexical").alias("weight"))
    mature = maturity(scored, edges).first()
    if not mature["edges"] or not seeds.limit(1).count():
        ranked = scored.withColumn("pagerank", F.lit(0.0)).withColumn("score", F.col("lexical")).withColumn("strategy", F.lit("lexical"))
    else:
        ranks = pagerank(scored.select("path"), edges, seeds)
        ranked = scored.join(ranks.withColumnRenamed("rank", "pagerank"), "path")
        score = F.col("pagerank") + 0.01 * F.col("lexical") if mature["mature"] else F.col("lexical") + 0.25 * F.col("pagerank")
        ranked = ranked.withColumn("score", score).withColumn("strategy", F.lit("graph_first_ppr" if mature["mature"] else "seeded_ppr"))
    return ranked.filter("score > 0").orderBy(F.desc("score"), F.desc("lexical"), "path").limit(limit).select("path", "title", "score", "lexical", "pagerank", "strategy")
