"""Bundle operators: full merges, remapped slugs, overlaps, two-hop references, link checks and bounded reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes of binary documents.
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".epub", ".ppt", ".pptx", ".xls", ".xlsx")
# Arrows as models write them, in the order in which they are replaced.
ARROWS = (
    ("$ightarrow$", "→"), ("$eftarrow$", "←"), ("\\rightarrow", "→"), ("\\leftarrow", "←"), ("\\Rightarrow", "⇒"), ("\\Leftarrow", "⇐"), ("\\leftrightarrow", "↔"), ("\\Leftrightarrow", "⇔"),
    ("$\\rightarrow$", "→"), ("$\\leftarrow$", "←"),
)
# Words that stay small inside a title, and those written in capitals.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "vs", "via")
CAPITALS = ("usdt", "swift", "tbml", "llm", "ai")


def document_suffix(url: Column) -> Column:
    """Suffix of the document an address or path names, in lower case; null if it names none."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.when(suffix.isin(*DOCUMENT_SUFFIXES), suffix)


def same_site(a: Column, b: Column) -> Column:
    """Whether two hosts (lower case, null for none) are one publisher's: equal, or both below ssrn.com."""
    below = a.endswith(".ssrn.com") & b.endswith(".ssrn.com")
    return F.coalesce((a == b) | below, F.lit(False))


def straight_arrows(text: Column) -> Column:
    """Text with written-out arrows as signs."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ARROWS, text)


def title_of_slug(slug: Column) -> Column:
    """Readable title of a slug; "Untitled" for a blank or null one."""
    words = F.filter(F.split(F.coalesce(slug, F.lit("")), "[-_]+"), lambda w: w != "")

    def one(w: Column, k: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(*CAPITALS), F.upper(w)).when((k > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), low.substr(F.lit(2), F.length(low))))

    return F.when(F.size(words) == 0, "Untitled").otherwise(F.array_join(F.transform(words, one), " "))


def is_chinese(text: Column) -> Column:
    """Whether text has Chinese characters and no kana; false for null."""
    return F.coalesce(text.rlike("[一-鿿]") & ~text.rlike("[぀-ゟ゠-ヿ]"), F.lit(False))


def prune_sections(sections: Column) -> Column:
    """Sections that have points or prose; blank prose counts as none, null sections stay null."""
    return F.filter(sections, lambda s: (F.coalesce(F.size(s["points"]), F.lit(0)) > 0) | (F.trim(F.coalesce(s["prose"], F.lit(""))) != ""))


def snippet(body: Column, terms: list[str], chars: int = 800) -> Column:
    """Start of the first section that has one of the terms, else of the first section, with single blanks; null for null."""
    sections = F.filter(F.split(body, r"(?m)(?=^#{1,6}\s)"), lambda s: F.trim(s) != "")
    wanted = F.array(*(F.lit(t.lower()) for t in terms)) if terms else F.array().cast("array<string>")
    hit = F.get(F.filter(sections, lambda s: F.arrays_overlap(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), wanted)), F.lit(0))
    flat = F.trim(F.regexp_replace(F.coalesce(hit, F.get(sections, F.lit(0)), F.lit("")), r"\s+", " "))
    return F.when(body.isNotNull(), F.substring(flat, 1, chars))


def merge_bodies(found: DataFrame) -> DataFrame:
    """Sections and claims of a concept's occurrences, concatenated in order of arrival: slug, sections, claims.

    found: occurrences(). A concept is a small group: it has as many
    occurrences as sources name it; a hot one is merged by partial arrays only.
    """

    def joined(column: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("ord", F.col(column).alias("v")))), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
        return F.flatten(F.transform(parts, lambda x: x["v"]))

    return found.groupBy("slug").agg(joined("sections").alias("sections"), joined("claims").alias("claims"))


def remap_members(maps: DataFrame, merged: DataFrame) -> DataFrame:
    """Members of topic maps after merges: slug, members. merged: victim, survivor. Order is kept, doubles go."""
    rows = maps.select("slug", F.posexplode("members").alias("k", "member")).join(merged, F.col("member") == F.col("victim"), "left")
    named = rows.select("slug", "k", F.coalesce("survivor", "member").alias("member")).groupBy("slug", "member").agg(F.min("k").alias("k"))
    return named.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "member"))), lambda x: x["member"]).alias("members"))


def remap_links(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Links between surviving concepts: src, dst, without those that became loops or doubles."""
    ends = edges.join(merged.select(F.col("victim").alias("src"), F.col("survivor").alias("_s")), "src", "left").join(merged.select(F.col("victim").alias("dst"), F.col("survivor").alias("_d")), "dst", "left")
    return ends.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst")).filter("src <> dst").distinct()


def overlap(new: DataFrame, cached: DataFrame) -> DataFrame:
    """Slugs of new sources that cached ones have too, with how many sources name them: slug, n_new, n_cached.

    new, cached: slug, source_file.
    """
    counts = [df.filter("slug is not null").distinct().groupBy("slug").agg(F.count(F.lit(1)).alias(name)) for df, name in ((new, "n_new"), (cached, "n_cached"))]
    return counts[0].join(counts[1], "slug")


def cross_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each link its target and up to two further neighbours of that: src, dst, onward (titles), back (whether it links back).

    edges: src, dst, ord (order of the source's links); nodes: slug, title.
    """
    known = edges.join(nodes.select(F.col("slug").alias("dst")), "dst", "left_semi").select("src", "dst")
    # three links of a target are enough for the first two that don't lead back
    first = edges.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).filter("k <= 3").select(F.col("src").alias("dst"), F.col("dst").alias("far"), "k")
    titled = first.join(nodes.select(F.col("slug").alias("far"), "title"), "far", "left")
    near = titled.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("k", "far", "title"))).alias("steps"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
    steps = F.slice(F.filter(F.coalesce("steps", F.array().cast("array<struct<k:int,far:string,title:string>>")), lambda s: s["far"] != F.col("src")), 1, 2)
    onward = F.array_join(F.transform(F.filter(steps, lambda s: s["title"].isNotNull()), lambda s: s["title"]), " → ")
    return known.join(near, "dst", "left").join(back, ["src", "dst"], "left").select("src", "dst", onward.alias("onward"), F.coalesce("back", F.lit(False)).alias("back"))


def broken_wikilinks(links: DataFrame, stems: DataFrame) -> DataFrame:
    """Distinct links (rec_id, target) to no known stem; targets with a dot name files and don't count.

    stems: stem. Both sides are compared in lower case without blanks around.
    """
    clean = links.select("rec_id", F.lower(F.trim("target")).alias("stem")).filter("stem <> ''").filter(~F.col("stem").contains("."))
    return clean.distinct().join(stems.select(F.lower(F.trim("stem")).alias("stem")).distinct(), "stem", "left_anti").select("rec_id", F.col("stem").alias("target"))


def orphan_marks(owners: DataFrame, deleted: DataFrame) -> DataFrame:
    """Concepts that only deleted sources had: slug, reason. owners: slug, source_file (exclusive); deleted: source_file."""
    return owners.join(deleted.select("source_file").distinct(), "source_file", "left_semi").select("slug", F.concat(F.lit("Source deleted: "), "source_file").alias("reason"))


def bounded_report(items: DataFrame, most: int = 50) -> DataFrame:
    """First `most` items of each kind in order, then one line that counts the rest: kind, line_no, line.

    The rank is taken over (kind, leading character) first, so a kind with most of the rows isn't sorted in one task.
    """
    local = Window.partitionBy("kind", F.substring("item", 1, 2)).orderBy("item")
    few = items.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= most).drop("r")
    top = few.withColumn("line_no", F.row_number().over(Window.partitionBy("kind").orderBy("item"))).filter(F.col("line_no") <= most)
    rest = items.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return top.select("kind", F.col("line_no").cast("long").alias("line_no"), F.concat(F.lit("- "), "item").alias("line")).unionAll(
        rest.select("kind", F.lit(most + 1).cast("long"), F.concat(F.lit("- ... and "), (F.col("n") - most).cast("string"), F.lit(" more")))
    )
