"""Scalar library: every function maps Columns to a Column and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short tags and what they stand for.
TAG_ALIASES = {
    "ml": "machine-learning",
    "ai": "artificial-intelligence",
    "nlp": "natural-language-processing",
    "llm": "large-language-model",
    "dl": "deep-learning",
    "rl": "reinforcement-learning",
    "nn": "neural-network",
    "cnn": "convolutional-neural-network",
    "rnn": "recurrent-neural-network",
    "gpu": "graphics-processing-unit",
    "api": "application-programming-interface",
}
# The relations a link may have.
RELATIONS = ("variant_of", "depends_on", "contrasts_with", "related_to", "prerequisite_of", "example_of", "component_of", "causes", "enables", "part_of", "explains")
# The relation of a link seen from its target; related_to for all others.
INVERSE_RELATIONS = {"depends_on": "prerequisite_of", "prerequisite_of": "depends_on", "component_of": "part_of", "part_of": "component_of", "variant_of": "variant_of", "contrasts_with": "contrasts_with", "related_to": "related_to"}
# Frequent Chinese words.
ZH_MARKERS = ("的", "是", "在", "不", "了", "和", "有", "我", "他", "这", "个", "为", "到", "说")
# Signs of a page that is all navigation; sentinels of a missing transcript; metadata fields.
CHROME_MARKERS = ("skip to main content", "navigation", "advanced searches", "back to top", "loading...")
STUB_MARKERS = ("Note: Full transcript unavailable", "Full transcript unavailable")
METADATA_FIELDS = ("Title:", "Channel:", "Published:", "URL:", "Duration:")
# Source kinds that are short by nature, and those that are dense.
SOCIAL_KINDS = ("tweet", "post", "social", "social-post", "x-post", "microblog")
DENSE_KINDS = ("document", "pdf", "paper", "scientific-paper", "scientific", "research-paper", "transcript", "podcast")
SHORT_SOURCE, LONG_SOURCE = 4_000, 20_000


def lookup(values: dict[str, str]) -> Column:
    """A literal map column."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def casefold(text: Column) -> Column:
    """Lower case with sharp s folded."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def slugify(text: Column) -> Column:
    """File-name-safe slug of at most 120 characters, `untitled` if nothing is left."""
    t = F.regexp_replace(text, "['‘’]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-")
    t = F.regexp_replace(F.substring(F.lower(F.trim(t, F.lit("-"))), 1, 120), "-+$", "")
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def is_safe_slug(text: Column) -> Column:
    """Whether text is a bounded identifier that can't be a path."""
    return F.coalesce(text.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}_-]{0,79}\z"), F.lit(False))


def normalise_tag(tag: Column) -> Column:
    """One canonical tag; empty if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(tag)), "[ _]", "-")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9-]", ""), "-+", "-"), F.lit("-"))
    return F.coalesce(F.try_element_at(lookup(TAG_ALIASES), t), t)


def normalise_tags(tags: Column) -> Column:
    """Canonical tags in first-seen order; null counts as none."""
    made = F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalise_tag)
    return F.array_distinct(F.filter(made, lambda t: t.isNotNull() & (t != "")))


def sanitize_tag(tag: Column) -> Column:
    """Tag without blanks and characters that break front matter; case is kept."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(tag, F.lit(""))), r"\s+", "-"), r"[#\"'`,;()\[\]{}]", "")


def normalise_relation(value: Column) -> Column:
    """A valid relation; related_to for anything else."""
    t = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("related_to")))), "- ", "__")
    return F.when(t.isin(*RELATIONS), t).otherwise(F.lit("related_to"))


def inverse_relation(value: Column) -> Column:
    """The relation seen from the other end."""
    return F.coalesce(F.try_element_at(lookup(INVERSE_RELATIONS), value), F.lit("related_to"))


def normalise_reference(value: Column) -> Column:
    """Lookup key of a wikilink, page path or alias."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^\[\[", ""), r"\]\]$", "")
    t = F.trim(F.regexp_extract(t, r"^([^|#]*)", 1))
    return casefold(F.regexp_replace(F.translate(t, "\\", "/"), r"\.md$", ""))


def wikilinks(body: Column) -> Column:
    """Targets of all [[target]] and [[target|alias]] links, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def make_wikilink(slug: Column, alias: Column) -> Column:
    """[[slug]], or [[slug|alias]] if the alias differs."""
    return F.when(F.coalesce(alias, F.lit("")).isin("") | (alias == slug), F.concat(F.lit("[["), slug, F.lit("]]"))).otherwise(F.concat(F.lit("[["), slug, F.lit("|"), alias, F.lit("]]")))


def tokens(text: Column) -> Column:
    """Latin words and runs of ideographs; a run also gives its 2- to 4-grams and characters."""
    words = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+|[㐀-鿿]+"), F.lit(0))

    def grams(word: Column) -> Column:
        n = F.length(word)

        def of(width: int) -> Column:
            return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(word, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))

        run = F.concat(F.array(word), of(2), of(3), of(4), of(1))
        return F.when(word.rlike(r"^[㐀-鿿]"), run).otherwise(F.array(word))

    return F.flatten(F.transform(words, grams))


def detect_language(text: Column) -> Column:
    """Script-ratio language guess: en, zh, ja, ko, ar or ru."""
    short = F.trim(F.coalesce(text, F.lit("")))
    by_script = (
        F.when(short.rlike(r"[぀-ヿ]"), "ja").when(short.rlike(r"[一-鿿]"), "zh").when(short.rlike(r"[가-힯]"), "ko").when(short.rlike(r"[؀-ۿ]"), "ar").when(short.rlike(r"[Ѐ-ӿ]"), "ru").otherwise("en")
    )
    sample = F.substring(text, 1, 5000)
    n = F.greatest(F.length(sample), F.lit(1)).cast("double")

    def ratio(chars: str) -> Column:
        return F.regexp_count(sample, F.lit(f"[{chars}]")) / n

    markers = F.regexp_count(sample, F.lit("[" + "".join(ZH_MARKERS) + "]"))
    long_ = (
        F.when(ratio(r"぀-ヿ") > 0.01, "ja").when((ratio(r"一-鿿") > 0.03) | (markers >= 5), "zh").when(ratio(r"가-힯") > 0.02, "ko")
        .when((ratio(r"؀-ۿ") > 0.03) | (F.regexp_count(sample, F.lit(r"[؀-ۿ]{4,}")) >= 3), "ar").when(ratio(r"Ѐ-ӿ") > 0.03, "ru").otherwise("en")
    )
    return F.when(F.length(short) < 20, by_script).otherwise(long_)


def quality_reason(title: Column, content: Column) -> Column:
    """First rule of the extraction gate a source breaks; "" if it passes all."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.coalesce(content, F.lit(""))
    low = casefold(c)
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    fields = F.size(F.filter(lines, lambda x: x.rlike("^(?:" + "|".join(METADATA_FIELDS) + ")")))
    chrome = sum((F.contains(low, F.lit(m)).cast("int") for m in CHROME_MARKERS[1:]), F.contains(low, F.lit(CHROME_MARKERS[0])).cast("int"))
    bad_title = (F.length(t) < 3) | t.rlike(r"^(?:\]\(|\[|https?://)") | F.contains(t, F.lit("://")) | t.rlike(r"(?: on X| on Twitter)$") | t.rlike(r"(?i)^https?(?:www)?(?:x|twitter|[a-z0-9-]+(?:com|org|net))")
    preview = low.rlike(r"https://(?:x|twitter)\.com/i/article/") & low.rlike(r"article\r?\n")
    abstract = F.contains(c, F.lit("Abstract:")) & ~c.rlike("## Full [Tt]ext") & ~c.rlike(r"(?m)^#{1,4}\s+\S")
    return (
        F.when(bad_title, "invalid source title").when(preview, "X article preview stub").when(chrome >= 4, "navigation chrome").when(F.length(c) < 500, "too short, likely stub")
        .when(F.contains(c, F.lit(STUB_MARKERS[1])), "stub fallback").when(abstract, "abstract only").when((F.size(lines) > 0) & (fields > 0.6 * F.size(lines)), "metadata only").otherwise("")
    )


def granularity(length: Column, kind: Column) -> Column:
    """concise, standard or detailed, from characters and kind of source."""
    k = F.trim(F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(k.isin(*SOCIAL_KINDS), "concise").when(k.isin(*DENSE_KINDS) & (length > SHORT_SOURCE), "detailed").when(length <= SHORT_SOURCE, "concise").when(length <= LONG_SOURCE, "standard").otherwise("detailed")


def gradient_confidence(chars: Column, least: int) -> Column:
    """Confidence from the length of a body; it jumps at half of `least`."""
    if least <= 0:
        return F.lit(1.0)
    half = least * 0.5
    return F.when(chars >= least, F.lit(1.0)).when(chars >= half, 0.5 + 0.5 * (chars / F.lit(float(least)))).otherwise(0.1 + 0.4 * (chars / F.lit(half)))


def quote_position(quote: Column, content: Column) -> Column:
    """struct(verification, start_offset, end_offset): verified iff the quote occurs once, overlaps counted."""
    first = F.position(quote, content)
    second = F.position(quote, content, first + 1)
    state = F.when(F.coalesce(quote, F.lit("")).isin("") | F.coalesce(first, F.lit(0)).isin(0), "unmatched").when(second > 0, "ambiguous").otherwise("verified")
    start = F.when(state == "verified", first - 1)
    return F.struct(state.alias("verification"), start.alias("start_offset"), (start + F.length(quote)).alias("end_offset"))


def strip_tags(html: Column) -> Column:
    """Text of an HTML page; block tags become line ends, frequent entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(?:div|p|h[1-6]|li|tr|br|hr|section|article|header|footer|nav|main|aside|blockquote|pre|table|ul|ol|dl|figure|figcaption)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    """<title>, else og:title, else the first <h1>; "" without any."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    meta = F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", 1)
    head = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.coalesce(*(F.nullif(strip_tags(x), F.lit("")) for x in (title, meta, head)), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) address; null otherwise."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def url_route(url: Column) -> Column:
    """Which reader takes an address: the first matching specialist, else web; none if it is no address."""
    h, u = host(url), F.lower(F.trim(url))
    path = F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1)
    return (
        F.when(h.isNull(), "none").when(h.isin("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"), "youtube").when(h.isin("x.com", "www.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com"), "twitter")
        .when(h.isin("open.spotify.com", "podcasts.apple.com"), "podcast").when(path.rlike(r"\.(?:rss)$|/(?:rss|feed)/?$"), "podcast").when(h.endswith("ssrn.com"), "ssrn").when(h.isin("arxiv.org", "www.arxiv.org"), "arxiv")
        .when(path.endswith(".xml"), "jats").when(path.endswith(".pdf"), "pdf").when(path.endswith(".docx"), "docx").otherwise("web")
    )


def youtube_id(url: Column) -> Column:
    """The 11-character video id of a YouTube address; null without one."""
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit(""))


def arxiv_id(url: Column) -> Column:
    """New or old style arXiv id; null without one."""
    return F.nullif(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf|html)/((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?)", 1), F.lit(""))


def title_from_url(url: Column) -> Column:
    """Words of the last path segment, without extension."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)/?$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""), r"[-_]+", " "))


def is_public_url(url: Column) -> Column:
    """Syntax half of the address check: http(s), no local name, no private or numeric host."""
    h = host(url)
    private = h.rlike(r"^(?:127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.|\[|\d+$|0x)")
    return F.coalesce(h.isNotNull() & ~h.rlike(r"(?:^|\.)localhost$|\.local$|\.internal$") & ~private, F.lit(False))


def clean_subtitles(text: Column) -> Column:
    """Spoken lines of a VTT or SRT text: no cues, numbers or tags, each line once."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^\d+$") & ~x.rlike("^(?:WEBVTT|Kind:|Language:|NOTE)"))
    return F.array_join(F.array_distinct(spoken), "\n")


def markdown_title(text: Column) -> Column:
    """Text of the first level-one heading; "" without one."""
    return F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1))


def mermaid_id(slug: Column) -> Column:
    """Slug as a node id."""
    return F.translate(slug, "-", "_")


def mermaid_label(text: Column) -> Column:
    """Text safe inside a node label."""
    return F.translate(F.replace(text, F.lit('"'), F.lit("'")), "[]", "()")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of arrays of numbers; 0 for different lengths, zero norms or values that aren't finite."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, e: s + e)

    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    value = F.when((F.size(x) == F.size(y)) & (norm > 0), dot / norm)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def body_chars(sections: Column) -> Column:
    """Characters of prose and points of a concept's sections; null counts as none."""
    def one(s: Column) -> Column:
        points = F.aggregate(F.coalesce(s["points"], F.array().cast("array<string>")), F.lit(0), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
        return F.coalesce(F.length(s["prose"]), F.lit(0)) + points

    return F.coalesce(F.aggregate(sections, F.lit(0), lambda n, s: n + one(s)), F.lit(0))


def pack_paragraphs(content: Column, size: int, separator: str = "\n\n") -> Column:
    """Chunks of whole paragraphs up to size characters; longer ones are cut hard."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"), F.lit(False).alias("some"))

    def step(acc: Column, para: Column) -> Column:
        full = acc["some"] & (acc["n"] + F.length(para) + 2 > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | ~acc["some"], para).otherwise(F.concat(acc["open"], F.lit(separator), para)).alias("open"),
            F.when(full, F.length(para)).otherwise(acc["n"] + F.length(para) + 2).alias("n"),
            F.lit(True).alias("some"),
        )

    packed = F.aggregate(F.split(content, separator), zero, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    cut = F.flatten(F.transform(F.filter(packed, lambda c: c != ""), lambda c: F.transform(F.sequence(F.lit(1), F.length(c), F.lit(size)), lambda i: F.substring(c, i, F.lit(size)))))
    return F.when(F.length(content) <= size, F.array(content)).otherwise(cut)
