"""Bundle operators on literal rows: nulls, blanks, ties and empty tables."""

from pyspark.sql import functions as F

from tesserine.functions.parsing import recover_json
from tesserine.operators import bundle as B


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    for url, suffix in (("https://a.b/x.PDF?y=1", ".pdf"), ("https://a.b/x.html", None), ("dir/y.docx", ".docx"), ("https://a.pdf", None), (None, None), ("https://a.b/.pdf", None)):
        assert one(spark, B.document_suffix(F.lit(url).cast("string"))) == suffix, url
    assert one(spark, B.same_site(F.lit("papers.ssrn.com"), F.lit("deliverypdf.ssrn.com"))) and not one(spark, B.same_site(F.lit("a.b"), F.lit(None).cast("string")))
    assert not one(spark, B.same_site(F.lit("ssrn.com"), F.lit("papers.ssrn.com")))
    for slug, title in (("the-art_of-llm", "The Art of LLM"), ("--", "Untitled"), (None, "Untitled"), ("of-mice", "Of Mice")):
        assert one(spark, B.title_of_slug(F.lit(slug).cast("string"))) == title
    assert one(spark, B.straight_arrows(F.lit("a $ightarrow$ b \\leftarrow c"))) == "a → b ← c"
    assert one(spark, B.is_chinese(F.lit("中文"))) and not one(spark, B.is_chinese(F.lit("日本の"))) and not one(spark, B.is_chinese(F.lit(None).cast("string")))


def test_snippets(spark):
    body = "intro words\n# One\nnothing\n\n# Two\nthe Vault  is here"
    assert one(spark, B.snippet(F.lit(body), ["vault"])) == "# Two the Vault is here" and one(spark, B.snippet(F.lit(body), ["absent"])) == "intro words"
    assert one(spark, B.snippet(F.lit(""), ["x"])) == "" and one(spark, B.snippet(F.lit(None).cast("string"), ["x"])) is None and one(spark, B.snippet(F.lit(body), [], 5)) == "intro"


def test_sections(spark):
    rows = spark.createDataFrame([(1, [("a", [], " "), ("b", ["p"], None), ("c", None, "x")]), (2, None), (3, [])], "k int, s array<struct<heading:string,points:array<string>,prose:string>>")
    got = {r[0]: r[1] for r in rows.select("k", F.transform(B.prune_sections(F.col("s")), lambda s: s["heading"])).collect()}
    assert got == {1: ["b", "c"], 2: None, 3: []}


def test_remaps(spark):
    merged = spark.createDataFrame([("x", "a"), ("y", "a")], "victim string, survivor string")
    maps = spark.createDataFrame([("m", ["x", "b", "y", "a"]), ("n", ["b"])], "slug string, members array<string>")
    assert {r[0]: r[1] for r in B.remap_members(maps, merged).collect()} == {"m": ["a", "b"], "n": ["b"]}
    edges = spark.createDataFrame([("x", "y"), ("x", "b"), ("a", "b"), ("b", "y")], "src string, dst string")
    assert {tuple(r) for r in B.remap_links(edges, merged).collect()} == {("a", "b"), ("b", "a")}
    assert B.remap_links(edges.limit(0), merged).count() == 0 and B.remap_members(maps, merged.limit(0)).count() == 2


def test_cross_references(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 2), ("b", "gone", 3), ("b", "d", 4), ("a", "gone", 2)], "src string, dst string, ord int")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", None)], "slug string, title string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in B.cross_references(edges, nodes).collect()}
    assert got == {("a", "b"): ("C", True), ("b", "a"): ("", True), ("b", "c"): ("", False), ("b", "d"): ("", False)}


def test_reports_and_links(spark):
    items = spark.createDataFrame([("k", f"i{n:03d}") for n in range(70)] + [("j", "only")], "kind string, item string")
    rows = B.bounded_report(items, 50).collect()
    lines = {(r["kind"], r["line_no"]): r["line"] for r in rows}
    assert len(rows) == 52 and lines["k", 51] == "- ... and 20 more" and lines["k", 50] == "- i049" and lines["j", 1] == "- only"
    links = spark.createDataFrame([(1, " Known "), (1, "lost"), (1, "lost"), (2, "a.png"), (2, None), (2, " ")], "rec_id int, target string")
    stems = spark.createDataFrame([("known",), (None,)], "stem string")
    assert [tuple(r) for r in B.broken_wikilinks(links, stems).collect()] == [(1, "lost")]


def test_recovered_json():
    assert recover_json('{"a": [1, {"b": "x]') == '{"a": [1, {"b": "x]"}]}' and recover_json('{"a": "\\d"}') == '{"a": "\\\\d"}'
    assert recover_json("no json") is None and recover_json('[[1], [2, "q\\"r') == '[[1], [2, "q\\"r"]]'
