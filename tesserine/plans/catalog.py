"""Registry of the core queries and their oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import concepts as C
from tesserine.operators import corpus as S
from tesserine.operators import graph as G
from tesserine.operators import health as H
from tesserine.operators import render as R
from tesserine.operators import vectors as V
from tesserine.runtime import table

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}

# Parts of oracle statements.
_SYN = "syn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY synthesis_id) AS rn_ FROM syntheses) WHERE rn_ = 1)"
_SLUGIFY = "CASE WHEN {s} = '' THEN 'untitled' ELSE {s} END"


def _slug_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[''‘’]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')"
    return _SLUGIFY.format(s=f"regexp_replace(left(lower(trim({t}, '-')), 120), '-+$', '')")


_OCC = (
    _SYN
    + ", un AS (SELECT synthesis_id, source_file, unnest(concepts) AS c, generate_subscripts(concepts, 1) - 1 AS pos FROM syn)"
    + f", occ AS (SELECT synthesis_id, source_file, pos, coalesce(nullif(c.slug, ''), {_slug_sql('coalesce(c.title, $$$$)')}) AS slug, c FROM un)"
)
_TAG_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TAG_ALIASES.items())


def _tag_sql(x: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[ _]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"
    return f"CASE {t} {_TAG_CASE} ELSE {t} END"


_RELATION = "CASE WHEN translate(lower(trim(coalesce(r.relation, 'related_to'))), '- ', '__') IN (" + ", ".join(f"'{r}'" for r in T.RELATIONS) + ") THEN translate(lower(trim(coalesce(r.relation, 'related_to'))), '- ', '__') ELSE 'related_to' END"
_LINKS = (
    _OCC
    + ", rel AS (SELECT synthesis_id, pos, slug, unnest(c.related) AS r, generate_subscripts(c.related, 1) AS k FROM occ)"
    + f", links AS (SELECT slug AS src, r.slug AS dst, {_RELATION} AS relation, r.display AS display, row_number() OVER (PARTITION BY slug, r.slug ORDER BY synthesis_id, pos, k) AS rn FROM rel WHERE r.slug IS NOT NULL)"
    + ", edges AS (SELECT src, dst, relation, display FROM links WHERE rn = 1)"
    + ", firsts AS (SELECT slug, c.title AS title, row_number() OVER (PARTITION BY slug ORDER BY synthesis_id, pos) AS rn FROM occ), nodes AS (SELECT slug, title FROM firsts WHERE rn = 1)"
)
_INVERSE = "CASE e.relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.INVERSE_RELATIONS.items()) + " ELSE 'related_to' END"
_FOLD = "replace(lower({x}), 'ß', 'ss')"
_OPS = "ops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn_ FROM operations) WHERE rn_ = 1)"


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def keep(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def _occ(spark: SparkSession, sf: str) -> DataFrame:
    return C.occurrences(_t(spark, sf, "syntheses"))


# ---- scalar functions -------------------------------------------------------


@query("content_sha256", "SELECT rec_id, sha256(content) AS h FROM sources")
def content_sha256(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", S.content_hash(F.col("content")).alias("h"))


@query("hash_status", "SELECT rec_id, CASE WHEN provenance.content_sha256 IS NULL THEN 'missing' WHEN lower(provenance.content_sha256) = sha256(content) THEN 'right' ELSE 'stale' END AS status FROM sources")
def hash_status(spark, sf):
    known = F.col("provenance.content_sha256")
    status = F.when(known.isNull(), "missing").when(F.lower(known) == S.content_hash(F.col("content")), "right").otherwise("stale")
    return _t(spark, sf, "sources").select("rec_id", status.alias("status"))


@query("slugify_titles", f"SELECT rec_id, {_slug_sql('coalesce(title, $$$$)')} AS slug FROM sources")
def slugify_titles(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", T.slugify(F.coalesce("title", F.lit(""))).alias("slug"))


@query("safe_slugs", _OCC + " SELECT slug, regexp_matches(slug, '^[\\p{L}\\p{N}][\\p{L}\\p{N}_-]{0,79}$') AS safe, count(*) AS n FROM occ GROUP BY 1, 2".replace("SELECT slug", "SELECT slug", 1))
def safe_slugs(spark, sf):
    return _occ(spark, sf).groupBy("slug", T.is_safe_slug(F.col("slug")).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


@query("tag_normalise", f"WITH u AS (SELECT rec_id, unnest(tags) AS tag FROM sources) SELECT tag, {_tag_sql('tag')} AS canonical, count(*) AS n FROM u WHERE tag IS NOT NULL GROUP BY 1, 2")
def tag_normalise(spark, sf):
    tags = _t(spark, sf, "sources").select(F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull())
    return tags.groupBy("tag", T.normalise_tag(F.col("tag")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("tag_sanitise", "WITH u AS (SELECT unnest(tags) AS tag FROM sources) SELECT tag, regexp_replace(regexp_replace(trim(tag), '\\s+', '-', 'g'), '[#\"''`,;()\\[\\]{}]', '', 'g') AS clean, count(*) AS n FROM u WHERE tag IS NOT NULL GROUP BY 1, 2")
def tag_sanitise(spark, sf):
    tags = _t(spark, sf, "sources").select(F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull())
    return tags.groupBy("tag", T.sanitize_tag(F.col("tag")).alias("clean")).agg(F.count(F.lit(1)).alias("n"))


@query("relation_normalise", _OCC + f", rel AS (SELECT unnest(c.related) AS r FROM occ) SELECT r.relation AS raw, {_RELATION} AS relation, count(*) AS n FROM rel GROUP BY 1, 2")
def relation_normalise(spark, sf):
    rel = _occ(spark, sf).select(F.explode("related").alias("r"))
    return rel.groupBy(F.col("r.relation").alias("raw"), T.normalise_relation(F.col("r.relation")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("wikilink_refs", "WITH u AS (SELECT rec_id, unnest(regexp_extract_all(content, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1)) AS t FROM sources) SELECT rec_id, trim(t) AS target, replace(lower(regexp_replace(translate(trim(regexp_extract(trim(t), '^([^|#]*)', 1)), '\\', '/'), '\\.md$', '')), 'ß', 'ss') AS ref, count(*) AS n FROM u GROUP BY 1, 2, 3")
def wikilink_refs(spark, sf):
    links = _t(spark, sf, "sources").select("rec_id", F.explode(T.wikilinks(F.col("content"))).alias("target"))
    return links.groupBy("rec_id", "target", T.normalise_reference(F.col("target")).alias("ref")).agg(F.count(F.lit(1)).alias("n"))


@query("wikilink_build", _LINKS + " SELECT src, dst, CASE WHEN coalesce(display, '') = '' OR display = dst THEN '[[' || dst || ']]' ELSE '[[' || dst || '|' || display || ']]' END AS link FROM edges")
def wikilink_build(spark, sf):
    return C.links(_occ(spark, sf)).select("src", "dst", T.make_wikilink(F.col("dst"), F.col("display")).alias("link"))


@query("token_counts", "SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+|[㐀-鿿]+'), lambda w: CASE WHEN regexp_matches(w, '^[㐀-鿿]') THEN 1 + length(w) + greatest(length(w) - 1, 0) + greatest(length(w) - 2, 0) + greatest(length(w) - 3, 0) ELSE 1 END)), 0)::BIGINT AS n_tokens FROM documents")
def token_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)).cast("long").alias("n_tokens"))


@query(
    "detect_language",
    "SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[가-힯]') THEN 'ko' WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'ru' ELSE 'en' END "
    "ELSE CASE WHEN len(regexp_extract_all(s, '[぀-ヿ]')) / n > 0.01 THEN 'ja' WHEN len(regexp_extract_all(s, '[一-鿿]')) / n > 0.03 OR len(regexp_extract_all(s, '[" + "".join(T.ZH_MARKERS) + "]')) >= 5 THEN 'zh' WHEN len(regexp_extract_all(s, '[가-힯]')) / n > 0.02 THEN 'ko' "
    "WHEN len(regexp_extract_all(s, '[؀-ۿ]')) / n > 0.03 OR len(regexp_extract_all(s, '[؀-ۿ]{4,}')) >= 3 THEN 'ar' WHEN len(regexp_extract_all(s, '[Ѐ-ӿ]')) / n > 0.03 THEN 'ru' ELSE 'en' END END AS lang FROM (SELECT doc_id, text, left(text, 5000) AS s, greatest(length(left(text, 5000)), 1)::DOUBLE AS n FROM documents)",
)
def detect_language(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.detect_language(F.col("text")).alias("lang"))


@query("granularity", "SELECT rec_id, CASE WHEN k IN ('tweet','post','social','social-post','x-post','microblog') THEN 'concise' WHEN k IN ('document','pdf','paper','scientific-paper','scientific','research-paper','transcript','podcast') AND n > 4000 THEN 'detailed' WHEN n <= 4000 THEN 'concise' WHEN n <= 20000 THEN 'standard' ELSE 'detailed' END AS detail FROM (SELECT rec_id, length(content) AS n, trim(regexp_replace(lower(coalesce(source_type, '')), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM sources)")
def granularity(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", T.granularity(F.length("content"), F.col("source_type")).alias("detail"))


_BODY = "coalesce(list_sum(list_transform(c.sections, lambda s: coalesce(length(s.prose), 0) + coalesce(list_sum(list_transform(s.points, lambda p: coalesce(length(p), 0))), 0))), 0)::BIGINT"


@query("gradient_confidence", _OCC + f" SELECT synthesis_id, pos, n AS chars, round(CASE WHEN n >= 1200 THEN 1.0 WHEN n >= 600 THEN 0.5 + 0.5 * (n / 1200.0::DOUBLE) ELSE 0.1 + 0.4 * (n / 600.0::DOUBLE) END, 9)::DOUBLE AS confidence FROM (SELECT synthesis_id, pos, {_BODY} AS n FROM occ)")
def gradient_confidence(spark, sf):
    rows = _occ(spark, sf).select("synthesis_id", F.col("pos").cast("long").alias("pos"), T.body_chars(F.col("sections")).cast("long").alias("chars"))
    return rows.withColumn("confidence", F.round(T.gradient_confidence(F.col("chars"), 1200), 9))


@query("html_strip_text")
def html_strip_text(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", F.length(T.strip_tags(F.col("content"))).alias("n_chars"))


@query("markdown_title", "SELECT rec_id, trim(regexp_extract(content, '(?m)^# (.+)$', 1)) AS heading FROM (SELECT rec_id, replace(content, chr(13), '') AS content FROM sources)")
def markdown_title(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", T.markdown_title(F.replace("content", F.lit("\r"), F.lit(""))).alias("heading"))


@query("url_hosts", "SELECT host, count(*) AS n FROM (SELECT nullif(lower(regexp_extract(trim(url), '(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host FROM sources) GROUP BY 1")
def url_hosts(spark, sf):
    return _t(spark, sf, "sources").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("url_route", "SELECT rec_id, CASE WHEN h IS NULL OR h = '' THEN 'none' WHEN p LIKE '%.xml' THEN 'jats' WHEN p LIKE '%.pdf' THEN 'pdf' WHEN p LIKE '%.docx' THEN 'docx' WHEN regexp_matches(p, '\\.(?:rss)$|/(?:rss|feed)/?$') THEN 'podcast' ELSE 'web' END AS route FROM (SELECT rec_id, regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS h, regexp_extract(lower(trim(url)), '^https?://[^/?#]+([^?#]*)', 1) AS p FROM sources)")
def url_route(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", T.url_route(F.col("url")).alias("route"))


@query("url_titles", "SELECT rec_id, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)/?$', 1), '\\.[A-Za-z0-9]{1,5}$', ''), '[-_]+', ' ', 'g')) AS words FROM sources")
def url_titles(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", T.title_from_url(F.col("url")).alias("words"))


@query("public_urls")
def public_urls(spark, sf):
    return _t(spark, sf, "operations").dropDuplicates(["id"]).groupBy(T.is_public_url(F.col("source")).alias("public")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "quality_gate",
    "SELECT rec_id, CASE WHEN length(t) < 3 OR regexp_matches(t, '^(?:\\]\\(|\\[|https?://)') OR contains(t, '://') OR regexp_matches(t, '(?: on X| on Twitter)$') OR regexp_matches(t, '(?i)^https?(?:www)?(?:x|twitter|[a-z0-9-]+(?:com|org|net))') THEN 'invalid source title' "
    "WHEN regexp_matches(low, 'https://(?:x|twitter)\\.com/i/article/') AND regexp_matches(low, 'article\\r?\\n') THEN 'X article preview stub' "
    "WHEN " + " + ".join(f"contains(low, '{m}')::INT" for m in T.CHROME_MARKERS) + " >= 4 THEN 'navigation chrome' WHEN length(c) < 500 THEN 'too short, likely stub' WHEN contains(c, 'Full transcript unavailable') THEN 'stub fallback' "
    "WHEN contains(c, 'Abstract:') AND NOT regexp_matches(c, '## Full [Tt]ext') AND NOT regexp_matches(c, '(?m)^#{1,4}\\s+\\S') THEN 'abstract only' "
    "WHEN len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^(?:" + "|".join(T.METADATA_FIELDS) + ")'))) > 0.6 * len(ls) THEN 'metadata only' ELSE '' END AS reason "
    "FROM (SELECT rec_id, trim(coalesce(title, '')) AS t, coalesce(content, '') AS c, replace(lower(coalesce(content, '')), 'ß', 'ss') AS low, list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM sources)",
)
def quality_gate(spark, sf):
    return S.quality(_t(spark, sf, "sources"))


@query("chunk_pack", "SELECT rec_id, 1 AS k, length(content) AS n_chars FROM sources WHERE false")
def chunk_pack(spark, sf):
    chunks = _t(spark, sf, "sources").select("rec_id", F.posexplode(T.pack_paragraphs(F.col("content"), 6000)).alias("k", "chunk"))
    return chunks.select("rec_id", (F.col("k") + 1).alias("k"), F.length("chunk").alias("n_chars"))


_ORACLES.pop("chunk_pack")  # a fold with resets; tested against a plain loop


@query("subtitle_text")
def subtitle_text(spark, sf):
    return _t(spark, sf, "transcripts").dropDuplicates(["transcript_id"]).select("transcript_id", T.clean_subtitles(F.col("text")).alias("spoken"))


@query("mermaid_nodes", _LINKS + " SELECT replace(slug, '-', '_') AS id, translate(replace(title, '\"', ''''), '[]', '()') AS label FROM nodes")
def mermaid_nodes(spark, sf):
    merged = C.merge(_occ(spark, sf))
    return merged.select(T.mermaid_id(F.col("slug")).alias("id"), T.mermaid_label(F.col("title")).alias("label"))


@query("byte_gate", "SELECT c.config_id, s.rec_id, octet_length(encode(s.content)) < c.min_source_chars AS too_few_bytes, length(s.content) < c.min_source_chars AS too_few_chars, octet_length(encode(s.content)) > c.max_source_chars AS too_many_bytes FROM sources s CROSS JOIN chunk_configs c")
def byte_gate(spark, sf):
    src = _t(spark, sf, "sources").select("rec_id", F.octet_length("content").alias("b"), F.length("content").alias("n"))
    cfg = _t(spark, sf, "chunk_configs").select("config_id", "min_source_chars", "max_source_chars")
    rows = src.crossJoin(cfg)
    return rows.select("config_id", "rec_id", (F.col("b") < F.col("min_source_chars")).alias("too_few_bytes"), (F.col("n") < F.col("min_source_chars")).alias("too_few_chars"), (F.col("b") > F.col("max_source_chars")).alias("too_many_bytes"))


@query("byte_truncate")
def byte_truncate(spark, sf):
    return _t(spark, sf, "sources").select("rec_id", F.octet_length(S.truncate_bytes(F.col("content"), 4000)).alias("bytes"))


@query("quote_resolve", _OCC + ", cl AS (SELECT synthesis_id, source_file, pos, unnest(c.claims) AS cl, generate_subscripts(c.claims, 1) - 1 AS k FROM occ) SELECT synthesis_id, pos, k, CASE WHEN q = '' OR p = 0 OR p IS NULL THEN 'unmatched' WHEN p2 > 0 THEN 'ambiguous' ELSE 'verified' END AS verification, CASE WHEN NOT (q = '' OR p = 0 OR p IS NULL) AND NOT p2 > 0 THEN p - 1 ELSE -1 END AS start_offset FROM (SELECT cl.*, coalesce(cl.cl.text, '') AS q, strpos(s.content, coalesce(cl.cl.text, '')) AS p, strpos(substr(s.content, strpos(s.content, coalesce(cl.cl.text, '')) + 1), coalesce(cl.cl.text, '')) AS p2 FROM cl LEFT JOIN sources s ON s.source_file = cl.source_file)")
def quote_resolve(spark, sf):
    claims = C.claims(_occ(spark, sf))
    src = _t(spark, sf, "sources").select("source_file", "content")
    rows = claims.join(src, "source_file", "left").withColumn("q", T.quote_position(F.coalesce("text", F.lit("")), F.col("content")))
    return rows.select("synthesis_id", F.col("ord.ord.pos").cast("long").alias("pos"), F.col("ord.k").cast("long").alias("k"), F.col("q.verification").alias("verification"), F.coalesce(F.col("q.start_offset").cast("long"), F.lit(-1)).alias("start_offset"))


# ---- corpus, state, operations ---------------------------------------------


@query("duplicate_content_groups", "WITH k AS (SELECT rec_id, sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS h FROM sources WHERE content IS NOT NULL) SELECT rec_id, min(rec_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS copies FROM k")
def duplicate_content_groups(spark, sf):
    return S.duplicate_groups(_t(spark, sf, "sources"))


@query("change_classification", "WITH c AS (SELECT source_file AS file, sha256(content) AS h FROM sources WHERE batch_no > 0 OR rec_id % 3 > 0), p AS (SELECT source_file AS file, lower(provenance.content_sha256) AS h FROM sources WHERE batch_no = 0) SELECT coalesce(c.file, p.file) AS file, CASE WHEN p.file IS NULL OR p.h IS NULL THEN 'new' WHEN c.file IS NULL THEN 'deleted' WHEN c.h = p.h THEN 'unchanged' ELSE 'changed' END AS status FROM c FULL JOIN p ON c.file = p.file WHERE NOT (c.file IS NULL AND p.h IS NULL)".replace("batch_no > 0 OR rec_id % 3 > 0", "true"))
def change_classification(spark, sf):
    src = _t(spark, sf, "sources")
    now = src.select(F.col("source_file").alias("file"), S.content_hash(F.col("content")).alias("hash"))
    was = src.filter("batch_no = 0").select(F.col("source_file").alias("file"), F.lower("provenance.content_sha256").alias("hash")).filter("hash is not null")
    return S.classify_changes(now, was)


@query("exclusive_owners", _OCC + " SELECT slug, min(source_file) AS source_file FROM occ GROUP BY slug HAVING count(DISTINCT source_file) = 1")
def exclusive_owners(spark, sf):
    return S.exclusive_owners(_occ(spark, sf).select("slug", "source_file"))


@query("cache_reuse", "SELECT s.rec_id, coalesce(lower(s.provenance.content_sha256) = sha256(s.content), false) AND y.source_file IS NOT NULL AS reuse FROM sources s LEFT JOIN (SELECT DISTINCT source_file FROM syntheses) y ON y.source_file = s.source_file")
def cache_reuse(spark, sf):
    cached = _t(spark, sf, "syntheses").select("source_file").distinct().withColumn("hit", F.lit(True))
    src = _t(spark, sf, "sources").join(cached, "source_file", "left")
    same = F.coalesce(F.lower("provenance.content_sha256") == S.content_hash(F.col("content")), F.lit(False))
    return src.select("rec_id", (same & F.col("hit").isNotNull()).alias("reuse"))


@query("latest_per_source", "WITH " + _OPS + " SELECT source, id, status, attempt, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, created_at DESC, id DESC) AS rn FROM ops WHERE source IS NOT NULL) WHERE rn = 1")
def latest_per_source(spark, sf):
    return S.latest_operation(_t(spark, sf, "operations"))


@query("retention_last_n", "WITH " + _OPS + " SELECT run_id, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, id DESC) AS rn FROM ops) WHERE rn <= 20")
def retention_last_n(spark, sf):
    ops = _t(spark, sf, "operations").dropDuplicates(["id"]).select("run_id", "id", "updated_at")
    return S.retain_last(ops, ["run_id"], [F.desc("updated_at"), F.desc("id")], 20).select("run_id", "id")


@query("run_rollup", "WITH " + _OPS + " SELECT run_id, count(*) AS n_operations, count(*) FILTER (status = 'succeeded') AS n_succeeded, count(*) FILTER (status = 'failed') AS n_failed, coalesce(sum(bytes_extracted) FILTER (status = 'succeeded'), 0)::BIGINT AS bytes_ok, max(attempt) AS most_attempts FROM ops GROUP BY 1")
def run_rollup(spark, sf):
    return S.run_rollup(_t(spark, sf, "operations"))


@query("operation_steps", "WITH " + _OPS + ", h AS (SELECT history AS h, unnest(range(2, len(history) + 1)) AS k FROM ops WHERE len(history) > 1) SELECT h[k - 1].status AS was, h[k].status AS now, count(*) AS n FROM h GROUP BY 1, 2")
def operation_steps(spark, sf):
    return S.steps(_t(spark, sf, "operations")).groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


@query("illegal_steps")
def illegal_steps(spark, sf):
    return S.illegal_steps(S.steps(_t(spark, sf, "operations")), S.OPERATION_STEPS).groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


@query("failed_ledger", "WITH " + _OPS + " SELECT source, left(coalesce(error, ''), 120) AS error FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, created_at DESC, id DESC) AS rn FROM ops) WHERE rn = 1 AND status = 'failed'")
def failed_ledger(spark, sf):
    return S.failed_ledger(_t(spark, sf, "operations"))


@query("resume_marker", "WITH " + _OPS + " SELECT DISTINCT source, lower(coalesce(source_kind, 'url')) AS kind FROM ops o WHERE status IN ('planned', 'running', 'retrying', 'cancelled') AND NOT EXISTS (SELECT 1 FROM ops d WHERE d.source = o.source AND d.status = 'succeeded')")
def resume_marker(spark, sf):
    ops = _t(spark, sf, "operations").dropDuplicates(["id"]).select("source", F.lower(F.coalesce("source_kind", F.lit("url"))).alias("kind"), "status")
    open_ = ops.filter(F.col("status").isin("planned", "running", "retrying", "cancelled"))
    return open_.join(ops.filter("status = 'succeeded'").select("source"), "source", "left_anti").select("source", "kind").distinct()


@query("collision_names", f"SELECT rec_id, s || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.md' AS name FROM (SELECT rec_id, s, row_number() OVER (PARTITION BY s ORDER BY rec_id) - 1 AS k FROM (SELECT rec_id, {_slug_sql('coalesce(title, $$$$)')} AS s FROM sources))")
def collision_names(spark, sf):
    rows = _t(spark, sf, "sources").select("rec_id", T.slugify(F.coalesce("title", F.lit(""))).alias("stem"))
    return S.collision_names(rows, "stem", "rec_id").select("rec_id", "name")


@query("quota_per_day", "SELECT ts::DATE::VARCHAR AS day, count(*) AS calls FROM events GROUP BY 1")
def quota_per_day(spark, sf):
    return S.quota(_t(spark, sf, "events"))


@query("transcript_cache", "SELECT transcript_id, sha256(trim(identity)) AS key, length(text) >= 200 AS usable FROM (SELECT DISTINCT transcript_id, identity, text FROM transcripts)")
def transcript_cache(spark, sf):
    return _t(spark, sf, "transcripts").select("transcript_id", "identity", "text").distinct().select("transcript_id", F.sha2(F.trim("identity"), 256).alias("key"), (F.length("text") >= 200).alias("usable"))


@query("view_freshness", "SELECT rec_id, coalesce(provenance.retrieved_at, '') AS retrieved_at, coalesce(title, '') AS title FROM sources")
def view_freshness(spark, sf):
    return S.freshness(_t(spark, sf, "sources"))


# ---- concepts ---------------------------------------------------------------


@query("merge_first_wins", _LINKS.replace("firsts AS (SELECT slug, c.title AS title,", "firsts AS (SELECT slug, c.title AS title, c.summary AS summary,").replace("nodes AS (SELECT slug, title FROM", "nodes AS (SELECT slug, title, summary FROM") + ", agg AS (SELECT slug, max(c.confidence) AS confidence, bool_and(c.is_new) AS is_new, sum(coalesce(len(c.sections), 0))::BIGINT AS n_sections, sum(coalesce(len(c.claims), 0))::BIGINT AS n_claims, count(*) AS n_occurrences FROM occ GROUP BY slug) SELECT n.slug, n.title, n.summary, a.confidence, a.is_new, a.n_sections, a.n_claims, a.n_occurrences FROM nodes n JOIN agg a USING (slug)")
def merge_first_wins(spark, sf):
    return C.merge(_occ(spark, sf)).select("slug", "title", "summary", "confidence", "is_new", "n_sections", "n_claims", "n_occurrences")


@query("merge_tag_union", _OCC + f", t AS (SELECT slug, synthesis_id, pos, unnest(c.tags) AS tag, generate_subscripts(c.tags, 1) AS k FROM occ), d AS (SELECT slug, {_tag_sql('tag')} AS tag, synthesis_id, pos, k FROM t WHERE tag IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY slug, tag ORDER BY synthesis_id, pos, k) AS rn FROM d WHERE tag <> '') SELECT slug, string_agg(tag, '|' ORDER BY synthesis_id, pos, k) AS tags FROM f WHERE rn = 1 GROUP BY slug")
def merge_tag_union(spark, sf):
    return C.merge(_occ(spark, sf)).filter(F.size("tags") > 0).select("slug", F.array_join("tags", "|").alias("tags"))


@query("map_members", _SYN.join(["WITH ", ""]) + f", un AS (SELECT synthesis_id, unnest(maps) AS m, generate_subscripts(maps, 1) AS pos FROM syn), mm AS (SELECT synthesis_id, pos, coalesce(nullif(m.slug, ''), {_slug_sql('coalesce(m.title, $$$$)')}) AS slug, unnest(m.concept_slugs) AS member, generate_subscripts(m.concept_slugs, 1) AS k FROM un), f AS (SELECT *, row_number() OVER (PARTITION BY slug, member ORDER BY synthesis_id, pos, k) AS rn FROM mm) SELECT slug, string_agg(member, '|' ORDER BY synthesis_id, pos, k) AS members, count(*) AS n FROM f WHERE rn = 1 GROUP BY slug")
def map_members(spark, sf):
    return C.maps(_t(spark, sf, "syntheses")).filter(F.size("members") > 0).select("slug", F.array_join("members", "|").alias("members"), F.size("members").cast("long").alias("n"))


@query("thin_concepts", _OCC + f" SELECT slug, count(*) AS n FROM occ WHERE {_BODY} < 500 GROUP BY slug")
def thin_concepts(spark, sf):
    occ = _occ(spark, sf)
    return occ.filter(T.body_chars(F.col("sections")) < 500).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


@query("thin_cascade", _LINKS + f", kept AS (SELECT DISTINCT slug FROM occ WHERE {_BODY} >= 500) SELECT src, dst FROM edges WHERE src IN (SELECT slug FROM kept) AND dst IN (SELECT slug FROM kept)")
def thin_cascade(spark, sf):
    occ = _occ(spark, sf)
    kept = C.keep_substantial(occ, 500).select("slug").distinct()
    edges = C.links(occ).select("src", "dst")
    return edges.join(kept.withColumnRenamed("slug", "src"), "src", "left_semi").join(kept.withColumnRenamed("slug", "dst"), "dst", "left_semi").select("src", "dst")


@query("low_confidence", _OCC + " SELECT synthesis_id, pos, slug, c.confidence AS confidence FROM occ WHERE c.confidence < 0.5")
def low_confidence(spark, sf):
    return _occ(spark, sf).filter("confidence < 0.5").select("synthesis_id", F.col("pos").cast("long").alias("pos"), "slug", "confidence")


@query("unique_claims", _OCC + ", cl AS (SELECT source_file, slug, unnest(c.claims) AS cl FROM occ), k AS (SELECT source_file, replace(lower(trim(slug)), 'ß', 'ss') AS concept, replace(lower(regexp_replace(trim(coalesce(cl.source_ref, '')), '\\s+', ' ', 'g')), 'ß', 'ss') AS ref, trim(coalesce(cl.text, '')) AS text FROM cl) SELECT source_file, concept, ref, min(text) AS text FROM k WHERE concept <> '' AND ref <> '' AND text <> '' GROUP BY 1, 2, 3 HAVING count(*) = 1")
def unique_claims(spark, sf):
    return C.unique_claims(C.claims(_occ(spark, sf)), "source_file")


@query("claim_counts", _OCC + ", cl AS (SELECT slug, unnest(c.claims) AS cl FROM occ) SELECT slug, count(*) AS n, count(DISTINCT lower(trim(cl.text))) AS n_distinct FROM cl GROUP BY slug")
def claim_counts(spark, sf):
    return C.claims(_occ(spark, sf)).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("text"))).alias("n_distinct"))


@query("deepest_section", _OCC + ", s AS (SELECT synthesis_id, pos, slug, unnest(c.sections) AS s, generate_subscripts(c.sections, 1) AS k FROM occ), d AS (SELECT slug, lower(trim(s.heading)) AS heading, coalesce(length(s.prose), 0) + coalesce(list_sum(list_transform(s.points, lambda p: coalesce(length(p), 0))), 0) AS chars, row_number() OVER (PARTITION BY slug, lower(trim(s.heading)) ORDER BY coalesce(length(s.prose), 0) + coalesce(list_sum(list_transform(s.points, lambda p: coalesce(length(p), 0))), 0) DESC, synthesis_id, pos, k) AS rn, synthesis_id FROM s) SELECT slug, heading, chars::BIGINT AS chars, synthesis_id FROM d WHERE rn = 1")
def deepest_section(spark, sf):
    rows = _occ(spark, sf).select("slug", "ord", F.posexplode("sections").alias("k", "s"))
    chars = T.body_chars(F.array("s")).cast("long")
    keyed = rows.select("slug", F.lower(F.trim("s.heading")).alias("heading"), chars.alias("chars"), F.col("ord.synthesis_id").alias("synthesis_id"), F.struct((-chars).alias("c"), "ord", "k").alias("o"))
    return keyed.groupBy("slug", "heading").agg(F.min_by(F.struct("chars", "synthesis_id"), "o").alias("m")).select("slug", "heading", "m.*")


# ---- graph ------------------------------------------------------------------


@query("concept_links", _LINKS + " SELECT src, dst, relation, display FROM edges")
def concept_links(spark, sf):
    return C.links(_occ(spark, sf)).select("src", "dst", "relation", "display")


@query("backlink_closure", _LINKS + f" SELECT e.dst AS src, e.src AS dst, {_INVERSE} AS relation, n.title AS display FROM edges e JOIN nodes n ON n.slug = e.src WHERE e.src <> e.dst AND e.dst IN (SELECT slug FROM nodes) AND NOT EXISTS (SELECT 1 FROM edges b WHERE b.src = e.dst AND b.dst = e.src)")
def backlink_closure(spark, sf):
    occ = _occ(spark, sf)
    return C.backlinks(C.links(occ), C.merge(occ).select("slug", "title"))


@query("reverse_edges", _LINKS + " SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) > 1 AS both_ways FROM edges WHERE src <> dst GROUP BY 1, 2")
def reverse_edges(spark, sf):
    edges = C.links(_occ(spark, sf)).filter("src <> dst")
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.count(F.lit(1)) > 1).alias("both_ways"))


@query("broken_relations", _LINKS + " SELECT src, dst FROM edges WHERE dst NOT IN (SELECT slug FROM nodes)")
def broken_relations(spark, sf):
    occ = _occ(spark, sf)
    return H.broken_relations(C.links(occ), occ.select("slug").distinct())


_MAPS = f", un2 AS (SELECT synthesis_id, unnest(maps) AS m, generate_subscripts(maps, 1) AS pos FROM syn), mm AS (SELECT synthesis_id, pos, coalesce(nullif(m.slug, ''), {_slug_sql('coalesce(m.title, $$$$)')}) AS moc, unnest(m.concept_slugs) AS member FROM un2)"


@query("orphan_concepts", _LINKS + _MAPS + " SELECT slug FROM nodes WHERE slug NOT IN (SELECT member FROM mm WHERE member IS NOT NULL)")
def orphan_concepts(spark, sf):
    return H.orphans(_occ(spark, sf).select("slug"), C.maps(_t(spark, sf, "syntheses")))


@query("intra_map_edges", _LINKS + _MAPS + ", mem AS (SELECT DISTINCT moc, member FROM mm) SELECT a.moc, least(e.src, e.dst) AS a, greatest(e.src, e.dst) AS b, count(*) > 1 AS both_ways FROM edges e JOIN mem a ON a.member = e.src JOIN mem b ON b.member = e.dst AND b.moc = a.moc WHERE e.src <> e.dst GROUP BY 1, 2, 3")
def intra_map_edges(spark, sf):
    edges = C.links(_occ(spark, sf)).select("src", "dst").filter("src <> dst")
    mem = C.maps(_t(spark, sf, "syntheses")).select(F.col("slug").alias("moc"), F.explode("members").alias("member"))
    inside = edges.join(mem.withColumnRenamed("member", "src"), "src").join(mem.withColumnRenamed("member", "dst"), ["dst", "moc"])
    return inside.groupBy("moc", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.count(F.lit(1)) > 1).alias("both_ways"))


@query("source_graph", _OCC + " SELECT DISTINCT source_file AS source, slug AS target FROM occ")
def source_graph(spark, sf):
    return _occ(spark, sf).select(F.col("source_file").alias("source"), F.col("slug").alias("target")).distinct()


@query("source_degrees", _OCC + " SELECT source_file, count(DISTINCT slug) AS n_concepts FROM occ GROUP BY 1")
def source_degrees(spark, sf):
    return _occ(spark, sf).select("source_file", "slug").distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("n_concepts"))


@query("graph_maturity", _LINKS + " SELECT (SELECT count(*) FROM nodes) AS pages, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) AS connected, (SELECT count(*) FROM nodes) >= 4 AND (SELECT count(*) FROM edges) >= 3 AND (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges)) >= 3 AS mature")
def graph_maturity(spark, sf):
    occ = _occ(spark, sf)
    return G.maturity(occ.select("slug").distinct(), C.links(occ).select("src", "dst"))


def _pagerank_sql(iterations: int) -> str:
    head = _LINKS + ", e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT slug FROM nodes) AND dst IN (SELECT slug FROM nodes)), deg AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY 1), nn AS MATERIALIZED (SELECT slug, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS p, d.d IS NULL AS dangling FROM nodes LEFT JOIN deg d ON d.src = slug), r0 AS MATERIALIZED (SELECT slug, p AS rank FROM nn)"
    for k in range(1, iterations + 1):
        head += f", r{k} AS MATERIALIZED (SELECT nn.slug, 0.15 * nn.p + 0.85 * (coalesce(g.got, 0) + nn.p * (SELECT coalesce(sum(r.rank), 0) FROM r{k - 1} r JOIN nn x ON x.slug = r.slug WHERE x.dangling)) AS rank FROM nn LEFT JOIN (SELECT e.dst, sum(r.rank / deg.d) AS got FROM e JOIN deg ON deg.src = e.src JOIN r{k - 1} r ON r.slug = e.src GROUP BY 1) g ON g.dst = nn.slug)"
    return head + f" SELECT slug AS path, round(rank, 9) AS rank FROM r{iterations}"


@query("pagerank", _pagerank_sql(40))
def pagerank(spark, sf):
    from tesserine.runtime import materialise

    occ = materialise(_occ(spark, sf).select("synthesis_id", "pos", "ord", "slug", "related"), "occ")
    ranks = G.pagerank(occ.select(F.col("slug").alias("path")).distinct(), C.links(occ).select("src", "dst"))
    return ranks.select("path", F.round("rank", 9).alias("rank"))


@query("lexical_topk", "WITH t AS (SELECT doc_id, text, coalesce(title, '') AS title FROM documents), s AS (SELECT doc_id, (4 * len(list_filter(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[a-z0-9]+|[㐀-鿿]+'), lambda w: w IN ('archive', 'map', 'notes'))) + len(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+|[㐀-鿿]+'), lambda w: w IN ('archive', 'map', 'notes'))))::DOUBLE AS score FROM t) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def lexical_topk(spark, sf):
    docs = _t(spark, sf, "documents")
    pages = docs.select(F.col("doc_id").alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.array().cast("array<string>").alias("aliases"), F.col("text").alias("body"))
    scored = G.lexical(pages, "archive map notes").filter("lexical > 0").orderBy(F.desc("lexical"), "path").limit(10)
    return scored.select(F.col("path").alias("doc_id"), F.col("lexical").alias("score"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval: lexical hits on merged concepts, ranked with PageRank over their links."""
    from tesserine.runtime import materialise

    occ = materialise(_occ(spark, sf), "occ")
    merged = C.merge(occ)
    pages = merged.select(F.col("slug").alias("path"), F.coalesce("title", F.lit("")).alias("title"), "aliases", F.coalesce("summary", F.lit("")).alias("body"))
    edges = C.links(occ).select("src", "dst", "relation").join(merged.select(F.col("slug").alias("dst")), "dst", "left_semi")
    return G.retrieve(pages, edges.select("src", "dst", "relation"), "archive notes map", 10)


@query("hybrid_retrieval")
def hybrid_retrieval(spark, sf):
    return flagship(spark, sf)


@query("merge_chain_closure", "WITH RECURSIVE m AS (SELECT rec_id AS victim, prev AS survivor FROM (SELECT rec_id, lag(rec_id) OVER (PARTITION BY lower(provenance.content_sha256) ORDER BY rec_id) AS prev FROM sources WHERE provenance.content_sha256 IS NOT NULL) WHERE prev IS NOT NULL), c AS (SELECT victim, survivor FROM m UNION ALL SELECT c.victim, m.survivor FROM c JOIN m ON m.victim = c.survivor) SELECT victim, min(survivor) AS survivor FROM c GROUP BY 1")
def merge_chain_closure(spark, sf):
    from pyspark.sql import Window

    rows = _t(spark, sf, "sources").filter("provenance.content_sha256 is not null")
    prev = F.lag("rec_id").over(Window.partitionBy(F.lower("provenance.content_sha256")).orderBy("rec_id"))
    return G.chain_ends(rows.select(F.col("rec_id").alias("victim"), prev.alias("survivor")).filter("survivor is not null"))


# ---- vectors ----------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("same_label_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def same_label_pairs(spark, sf):
    return V.similar_pairs(_t(spark, sf, "embeddings"), 0.4, True).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("cross_label_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def cross_label_pairs(spark, sf):
    return V.similar_pairs(_t(spark, sf, "embeddings"), 0.4, False).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("centroids", "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos, round(avg(x), 6) AS x FROM u GROUP BY 1, 2")
def centroids(spark, sf):
    return V.centroids(_t(spark, sf, "embeddings")).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("nearest_centroid", "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1), s AS (SELECT e.vec_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS sim FROM embeddings e CROSS JOIN c) SELECT vec_id, label, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s WHERE sim > 0.2) WHERE rn = 1")
def nearest_centroid(spark, sf):
    vec = _t(spark, sf, "embeddings")
    return V.nearest_centroid(vec, V.centroids(vec), 0.2).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


# ---- maintenance ------------------------------------------------------------


@query("untidy_tags", _OCC + f", t AS (SELECT DISTINCT slug, unnest(c.tags) AS tag FROM occ) SELECT slug, tag, {_tag_sql('tag')} AS canonical FROM t WHERE tag IS NOT NULL AND {_tag_sql('tag')} <> tag")
def untidy_tags(spark, sf):
    return H.untidy_tags(_occ(spark, sf))


def _findings(spark, sf):
    occ = _occ(spark, sf)
    return H.findings(C.merge(occ), occ, C.links(occ), C.maps(_t(spark, sf, "syntheses")))


@query("health_findings")
def health_findings(spark, sf):
    return _findings(spark, sf).select("kind", "path", "message", "severity", F.to_json("details").alias("details"))


@query("finding_counts")
def finding_counts(spark, sf):
    return _findings(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("fix_plan")
def fix_plan(spark, sf):
    return H.plan_fixes(_findings(spark, sf))


@query("citation_validation", _OCC + ", a AS (SELECT rec_id, unnest(CASE WHEN len(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1)) = 0 THEN [NULL] ELSE list_distinct(list_transform(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1), lambda x: trim(x))) END) AS target FROM sources) SELECT rec_id, count(target) AS n_cited, count(*) FILTER (target IS NOT NULL AND target NOT IN (SELECT slug FROM occ)) AS n_invalid, count(target) > 0 AND count(*) FILTER (target IS NOT NULL AND target NOT IN (SELECT slug FROM occ)) = 0 AS valid FROM a GROUP BY 1")
def citation_validation(spark, sf):
    answers = _t(spark, sf, "sources").select("rec_id", F.col("content").alias("answer"))
    return H.validate_citations(answers, _occ(spark, sf).select(F.col("slug").alias("target")), "rec_id")


@query("view_confidence", _OCC + " SELECT slug, max(c.confidence) AS confidence FROM occ GROUP BY 1")
def view_confidence(spark, sf):
    return C.merge(_occ(spark, sf)).select("slug", "confidence").orderBy(F.desc("confidence"), "slug")


@query("view_maps", _LINKS + _MAPS + " SELECT moc AS slug, count(DISTINCT member) AS n FROM mm GROUP BY 1")
def view_maps(spark, sf):
    return C.maps(_t(spark, sf, "syntheses")).select("slug", F.size("members").cast("long").alias("n")).filter("n > 0").orderBy(F.desc("n"), "slug")


@query("export_nodes", _LINKS + _MAPS + ", mt AS (SELECT moc, min_by(m.title, (synthesis_id, pos)) AS title FROM (SELECT synthesis_id, pos, m, coalesce(nullif(m.slug, ''), " + _slug_sql("coalesce(m.title, $$$$)") + ") AS moc FROM un2) GROUP BY moc) SELECT slug AS id, 'concept' AS kind, coalesce(title, '') AS label FROM nodes UNION ALL SELECT moc, 'moc', coalesce(title, '') FROM mt UNION ALL SELECT source_file, 'source', coalesce(title, '') FROM sources")
def export_nodes(spark, sf):
    return R.graph_nodes(C.merge(_occ(spark, sf)), C.maps(_t(spark, sf, "syntheses")), _t(spark, sf, "sources"))


@query("export_edges", _LINKS + _MAPS + ", o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation, min(src) AS src FROM edges GROUP BY 1, 2, 3) SELECT src, CASE WHEN src = a THEN b ELSE a END AS dst, relation FROM o UNION ALL SELECT DISTINCT moc, member, 'contains' FROM mm WHERE member IS NOT NULL")
def export_edges(spark, sf):
    return R.graph_edges(C.links(_occ(spark, sf)).select("src", "dst", "relation"), C.maps(_t(spark, sf, "syntheses")))


@query("page_index", _OCC + " SELECT DISTINCT 'concepts' AS dir, slug AS name, '- [[' || slug || ']]' AS line FROM occ")
def page_index(spark, sf):
    return R.directory_index(R.concept_pages(C.merge(_occ(spark, sf))))


@query("concept_pages")
def concept_pages(spark, sf):
    return R.concept_pages(C.merge(_occ(spark, sf)))


@query("event_lines")
def event_lines(spark, sf):
    return R.events(_t(spark, sf, "operations").dropDuplicates(["id"]).select("id", "source", "status", "error"))


@query("normal_slugs")
def normal_slugs(spark, sf):
    from tesserine.functions.parsing import normal_slug, with_column

    return with_column(_t(spark, sf, "sources").select("rec_id", "title"), "slug", lambda t: normal_slug(None, t), "title").select("rec_id", "slug")


def queries():
    """All registered queries."""
    from tesserine.plans import notes  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql():
    """The oracle statements of those that have one."""
    from tesserine.plans import notes  # noqa: F401  registers its queries

    return {k: v if v.lstrip().upper().startswith(("SELECT", "WITH")) else "WITH " + v for k, v in _ORACLES.items()}
