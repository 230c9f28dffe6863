"""Further core queries: bundle merges, remaps, overlaps, link checks and reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import bundle as B
from tesserine.operators import concepts as C
from tesserine.plans.catalog import _BODY, _LINKS, _OCC, _OPS, _SYN, _occ, _slug_sql, _t, query

_MEMBERS = f", ms AS (SELECT synthesis_id, unnest(maps) AS m, generate_subscripts(maps, 1) AS pos FROM syn), mm AS (SELECT synthesis_id, pos, coalesce(nullif(m.slug, ''), {_slug_sql('coalesce(m.title, $$$$)')}) AS moc, unnest(m.concept_slugs) AS member, generate_subscripts(m.concept_slugs, 1) AS k FROM ms), firstm AS (SELECT moc, member, row_number() OVER (PARTITION BY moc ORDER BY synthesis_id, pos, k) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY moc, member ORDER BY synthesis_id, pos, k) AS rn FROM mm WHERE member IS NOT NULL) WHERE rn = 1)"
_MERGED = ", named AS (SELECT slug, lower(trim(title)) AS name FROM nodes WHERE title IS NOT NULL), surv AS (SELECT name, min(slug) AS survivor FROM named GROUP BY name), merged AS (SELECT n.slug AS victim, s.survivor FROM named n JOIN surv s USING (name) WHERE n.slug <> s.survivor)"
_HOST = "nullif(lower(regexp_extract(trim({x}), '(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"
_PATH = "regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"


def _merged(spark, sf):
    """Concepts of one title: the smallest slug survives."""
    named = C.merge(_occ(spark, sf)).filter("title is not null").select("slug", F.lower(F.trim("title")).alias("name"))
    best = named.groupBy("name").agg(F.min("slug").alias("survivor"))
    return named.join(best, "name").filter("slug <> survivor").select(F.col("slug").alias("victim"), "survivor")


@query("document_types", f"SELECT rec_id, lower(regexp_extract({_PATH}, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS suffix FROM sources WHERE lower(regexp_extract({_PATH}, '[^/.][^/]*?(\\.[^./]+)$', 1)) IN ('.pdf', '.doc', '.docx', '.epub', '.ppt', '.pptx', '.xls', '.xlsx')")
def document_types(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", B.document_suffix(F.col("url")).alias("suffix")).filter("suffix is not null")


@query("same_site", f"SELECT rec_id, coalesce({_HOST.format(x='url')} = {_HOST.format(x='provenance.resolved_url')} OR ({_HOST.format(x='url')} LIKE '%.ssrn.com' AND {_HOST.format(x='provenance.resolved_url')} LIKE '%.ssrn.com'), false) AS same FROM sources")
def same_site(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", B.same_site(T.host(F.col("url")), T.host(F.col("provenance.resolved_url"))).alias("same"))


@query("pruned_sections", _OCC + " SELECT synthesis_id, pos, slug, list_aggregate(list_transform(list_filter(c.sections, lambda s: coalesce(len(s.points), 0) > 0 OR trim(coalesce(s.prose, '')) <> ''), lambda s: coalesce(s.heading, '')), 'string_agg', '|') AS headings, len(list_filter(c.sections, lambda s: coalesce(len(s.points), 0) > 0 OR trim(coalesce(s.prose, '')) <> '')) AS n FROM occ WHERE len(list_filter(c.sections, lambda s: coalesce(len(s.points), 0) > 0 OR trim(coalesce(s.prose, '')) <> '')) > 0")
def pruned_sections(spark, sf):
    rows = _occ(spark, sf).select("synthesis_id", F.col("pos").cast("long").alias("pos"), "slug", B.prune_sections(F.col("sections")).alias("s")).filter(F.size("s") > 0)
    return rows.select("synthesis_id", "pos", "slug", F.array_join(F.transform("s", lambda s: F.coalesce(s["heading"], F.lit(""))), "|").alias("headings"), F.size("s").cast("long").alias("n"))


@query("titles_of_slugs")
def titles_of_slugs(spark, sf):
    return _occ(spark, sf).select("slug").distinct().select("slug", B.title_of_slug(F.col("slug")).alias("title"))


@query("chinese_titles", "SELECT doc_id, coalesce(regexp_matches(title, '[一-鿿]') AND NOT regexp_matches(title, '[぀-ゟ゠-ヿ]'), false) AS chinese FROM documents")
def chinese_titles(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", B.is_chinese(F.col("title")).alias("chinese"))


_ARROWS = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, '$ightarrow$', '→'), '$eftarrow$', '←'), '\\rightarrow', '→'), '\\leftarrow', '←'), '\\Rightarrow', '⇒'), '\\Leftarrow', '⇐'), '\\leftrightarrow', '↔'), '\\Leftrightarrow', '⇔'), '$\\rightarrow$', '→'), '$\\leftarrow$', '←')"


@query("straight_arrows", f"SELECT rec_id, md5({_ARROWS.format(x='content')}) AS digest FROM sources WHERE content IS NOT NULL")
def straight_arrows(spark, sf):
    return _t(spark, sf, "sources").filter("content is not null").select("rec_id", F.md5(B.straight_arrows(F.col("content"))).alias("digest"))


@query("merged_bodies", _OCC + ", sec AS (SELECT slug, string_agg(coalesce(s.heading, ''), '|' ORDER BY synthesis_id, pos, k) AS headings, count(*) AS n_sections FROM (SELECT slug, synthesis_id, pos, unnest(c.sections) AS s, generate_subscripts(c.sections, 1) AS k FROM occ) GROUP BY slug), cla AS (SELECT slug, string_agg(coalesce(s.text, ''), '|' ORDER BY synthesis_id, pos, k) AS claims, count(*) AS n_claims FROM (SELECT slug, synthesis_id, pos, unnest(c.claims) AS s, generate_subscripts(c.claims, 1) AS k FROM occ) GROUP BY slug), slugs AS (SELECT DISTINCT slug FROM occ) SELECT slug, coalesce(headings, '') AS headings, coalesce(n_sections, 0) AS n_sections, coalesce(claims, '') AS claims, coalesce(n_claims, 0) AS n_claims FROM slugs LEFT JOIN sec USING (slug) LEFT JOIN cla USING (slug)")
def merged_bodies(spark, sf):
    merged = B.merge_bodies(_occ(spark, sf))

    def text(column: str, field: str):
        return F.array_join(F.transform(column, lambda x: F.coalesce(x[field], F.lit(""))), "|")

    return merged.select("slug", text("sections", "heading").alias("headings"), F.size("sections").cast("long").alias("n_sections"), text("claims", "text").alias("claims"), F.size("claims").cast("long").alias("n_claims"))


@query("remapped_members", _LINKS + _MEMBERS + _MERGED + ", r AS (SELECT moc, coalesce(survivor, member) AS member, min(nth) AS nth FROM firstm LEFT JOIN merged ON victim = member GROUP BY 1, 2) SELECT moc AS slug, string_agg(member, '|' ORDER BY nth) AS members FROM r GROUP BY moc")
def remapped_members(spark, sf):
    return B.remap_members(C.maps(_t(spark, sf, "syntheses")), _merged(spark, sf)).select("slug", F.array_join("members", "|").alias("members"))


@query("remapped_links", _LINKS + _MERGED + " SELECT DISTINCT coalesce(a.survivor, src) AS src, coalesce(b.survivor, dst) AS dst FROM edges LEFT JOIN merged a ON a.victim = src LEFT JOIN merged b ON b.victim = dst WHERE coalesce(a.survivor, src) <> coalesce(b.survivor, dst)")
def remapped_links(spark, sf):
    return B.remap_links(C.links(_occ(spark, sf)).select("src", "dst"), _merged(spark, sf))


_BATCHED = ", owned AS (SELECT DISTINCT slug, o.source_file, s.batch_no FROM occ o JOIN sources s ON s.source_file = o.source_file)"


@query("synthesis_overlap", _OCC + _BATCHED + " SELECT slug, count(DISTINCT source_file) FILTER (WHERE batch_no > 0) AS n_new, count(DISTINCT source_file) FILTER (WHERE batch_no = 0) AS n_cached FROM owned GROUP BY slug HAVING n_new > 0 AND n_cached > 0")
def synthesis_overlap(spark, sf):
    owned = _occ(spark, sf).select("slug", "source_file").distinct().join(_t(spark, sf, "sources").select("source_file", "batch_no"), "source_file")
    return B.overlap(owned.filter("batch_no > 0").select("slug", "source_file"), owned.filter("batch_no = 0").select("slug", "source_file"))


@query("cross_references", _LINKS + ", ranked AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY synthesis_id, pos, k) AS at FROM (SELECT slug AS src, r.slug AS dst, synthesis_id, pos, k, row_number() OVER (PARTITION BY slug, r.slug ORDER BY synthesis_id, pos, k) AS one FROM rel WHERE r.slug IS NOT NULL) WHERE one = 1), onward AS (SELECT e.src, e.dst, far.dst AS far, row_number() OVER (PARTITION BY e.src, e.dst ORDER BY far.at) AS nth, far.at FROM edges e JOIN ranked far ON far.src = e.dst WHERE far.dst <> e.src), told AS (SELECT o.src, o.dst, string_agg(n.title, ' → ' ORDER BY o.at) AS onward FROM onward o JOIN nodes n ON n.slug = o.far WHERE o.nth <= 2 AND n.title IS NOT NULL GROUP BY 1, 2) SELECT e.src, e.dst, coalesce(t.onward, '') AS onward, EXISTS (SELECT 1 FROM edges b WHERE b.src = e.dst AND b.dst = e.src) AS back FROM edges e LEFT JOIN told t ON t.src = e.src AND t.dst = e.dst WHERE e.dst IN (SELECT slug FROM nodes)")
def cross_references(spark, sf):
    occ = _occ(spark, sf)
    return B.cross_references(C.links(occ).select("src", "dst", "ord"), C.merge(occ).select("slug", "title"))


@query("broken_wikilinks", _OCC + ", l AS (SELECT rec_id, lower(trim(unnest(regexp_extract_all(content, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1)))) AS target FROM sources), stems AS (SELECT lower(trim(slug)) AS stem FROM occ UNION SELECT lower(trim(regexp_replace(source_file, '\\.[^.]*$', ''))) FROM sources WHERE source_file IS NOT NULL) SELECT DISTINCT rec_id, target FROM l WHERE target <> '' AND NOT contains(target, '.') AND target NOT IN (SELECT stem FROM stems WHERE stem IS NOT NULL)")
def broken_wikilinks(spark, sf):
    sources = _t(spark, sf, "sources")
    stems = _occ(spark, sf).select(F.col("slug").alias("stem")).unionAll(sources.select(F.regexp_replace("source_file", r"\.[^.]*$", "").alias("stem")))
    return B.broken_wikilinks(sources.select("rec_id", F.explode(T.wikilinks(F.col("content"))).alias("target")), stems.filter("stem is not null"))


@query("known_concepts", _OCC + " SELECT DISTINCT slug FROM occ WHERE slug IS NOT NULL")
def known_concepts(spark, sf):
    return _occ(spark, sf).select("slug").filter("slug is not null").distinct()


@query("orphan_marks", _OCC + ", own AS (SELECT slug, min(source_file) AS source_file FROM occ GROUP BY slug HAVING count(DISTINCT source_file) = 1) SELECT slug, 'Source deleted: ' || source_file AS reason FROM own WHERE source_file IN (SELECT source_file FROM sources WHERE batch_no >= 5)")
def orphan_marks(spark, sf):
    from tesserine.operators import corpus as S

    gone = _t(spark, sf, "sources").filter("batch_no >= 5")  # what a deletion of the last batches would leave
    return B.orphan_marks(S.exclusive_owners(_occ(spark, sf).select("slug", "source_file")), gone)


@query("outcome_tallies", f"WITH {_OPS} SELECT run_id, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL AND trim(error) <> '') AS n_errors, count(*) FILTER (WHERE output_file IS NOT NULL) AS n_written, sum(coalesce(bytes_extracted, 0))::BIGINT AS n_bytes FROM ops GROUP BY run_id")
def outcome_tallies(spark, sf):
    ops = C.distinct_rows(_t(spark, sf, "operations"), "id")
    failed = F.col("error").isNotNull() & (F.trim("error") != "")
    return ops.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_errors"), F.count_if(F.col("output_file").isNotNull()).alias("n_written"), F.sum(F.coalesce("bytes_extracted", F.lit(0))).alias("n_bytes"))


@query("pair_count", _LINKS + " SELECT count(*) AS n_pairs FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM edges WHERE src <> dst)")
def pair_count(spark, sf):
    edges = C.links(_occ(spark, sf)).filter("src <> dst")
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count(F.lit(1)).alias("n_pairs"))


@query("small_maps", "WITH " + _SYN + _MEMBERS + ", all_maps AS (SELECT DISTINCT coalesce(nullif(m.slug, ''), " + _slug_sql("coalesce(m.title, $$$$)") + ") AS slug FROM ms) SELECT slug, count(member) AS n FROM all_maps LEFT JOIN firstm ON moc = slug GROUP BY slug HAVING count(member) < 2")
def small_maps(spark, sf):
    return C.maps(_t(spark, sf, "syntheses")).select("slug", F.size("members").cast("long").alias("n")).filter("n < 2")


@query("bounded_report", _OCC + f", it AS (SELECT DISTINCT 'low confidence' AS kind, slug AS item FROM occ WHERE c.confidence < 0.5 UNION ALL SELECT DISTINCT 'thin concept', slug FROM occ WHERE {_BODY} < 500), r AS (SELECT kind, item, row_number() OVER (PARTITION BY kind ORDER BY item) AS line_no, count(*) OVER (PARTITION BY kind) AS n FROM it) SELECT kind, line_no, '- ' || item AS line FROM r WHERE line_no <= 50 UNION ALL SELECT kind, 51, '- ... and ' || (max(n) - 50) || ' more' FROM r GROUP BY kind HAVING max(n) > 50")
def bounded_report(spark, sf):
    occ = _occ(spark, sf)
    low = occ.filter("confidence < 0.5").select(F.lit("low confidence").alias("kind"), F.col("slug").alias("item")).distinct()
    thin = occ.filter(T.body_chars(F.col("sections")) < 500).select(F.lit("thin concept").alias("kind"), F.col("slug").alias("item")).distinct()
    return B.bounded_report(low.unionAll(thin))


@query("section_snippets")
def section_snippets(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", B.snippet(F.col("text"), ["archive", "vault"]).alias("snippet"))
