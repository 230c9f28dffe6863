"""Readers of Markdown folders and their front matter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.runtime import ship

# Files of a source folder that are no sources.
NOT_SOURCES = ("failed_urls.md", "index.md")


def read_vault(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = "*.md") -> DataFrame:
    """path (relative), name, raw of all files that are valid UTF-8; a folder without files gives no rows."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    base = folder.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + base.replace("\\", "\\\\").replace(".", "\\.") + "/", "")
    return rows.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), text.alias("raw")).filter("raw is not null").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def split_front_matter(raw: Column) -> Column:
    """struct(head, body): the block between --- lines at the very start and the rest; head is null without one."""
    has = raw.rlike(r"(?s)^---\n.*?\n---(?:\n|$)")
    head = F.when(has, F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---\n?(.*)$", 1))
    body = F.when(has, F.regexp_replace(F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---\n?(.*)$", 2), r"^\n+", "")).otherwise(raw)
    return F.struct(head.alias("head"), body.alias("body"))


def parse_front_matter(rows: DataFrame, head: str = "head") -> DataFrame:
    """rows with `meta`, the front matter as JSON text; null where it is missing or no mapping.

    Needs the yaml package on the executors; without it only flat `key: value`
    lines and lists are read.
    """
    ship(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(head)).to_pylist()
            made = pa.array([load_mapping(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "meta"])

    return rows.mapInArrow(run, f"{fields}, meta string")


def load_mapping(text: str | None) -> str | None:
    """A YAML mapping as JSON text; null for anything else."""
    import json

    if text is None:
        return None
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:
        value = _flat(text)
    except Exception:
        return None
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, dict) else None


def _flat(text: str) -> dict:
    found: dict = {}
    last = None
    for line in text.split("\n"):
        item = line.strip()
        if item.startswith("- ") and last is not None:
            if not isinstance(found[last], list):
                found[last] = []
            found[last].append(item[2:].strip().strip("\"'"))
        elif ":" in item and not line.startswith((" ", "\t")):
            last, value = (x.strip() for x in item.split(":", 1))
            if value.startswith("[") and value.endswith("]"):
                found[last] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
            else:
                found[last] = value.strip("\"'")
    return found


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source documents of one folder: source_file, title, url, content. Blank files and indexes are left out; a missing title is the stem."""
    rows = read_vault(spark, folder, recursive=False).filter(~F.col("name").isin(*NOT_SOURCES)).withColumn("s", split_front_matter(F.col("raw")))
    rows = parse_front_matter(rows.select("name", F.col("s.head").alias("head"), F.col("s.body").alias("body"))).filter(F.trim("body") != "")
    field = lambda k: F.nullif(F.trim(F.get_json_object("meta", f"$.{k}")), F.lit(""))
    stem = F.regexp_replace("name", r"\.md$", "")
    return rows.select(F.col("name").alias("source_file"), F.coalesce(field("title"), stem).alias("title"), F.coalesce(field("url"), field("source_url")).alias("url"), F.col("body").alias("content"))


def read_clippings(spark: SparkSession, folder: str, least: int = 100) -> DataFrame:
    """Clippings with a body of at least `least` characters and a title: given, source, address, first heading, first line."""
    rows = read_vault(spark, folder, recursive=False).withColumn("s", split_front_matter(F.col("raw")))
    rows = parse_front_matter(rows.select("name", F.col("s.head").alias("head"), F.col("s.body").alias("body"))).filter(F.length(F.trim("body")) >= least)
    field = lambda k: F.nullif(F.trim(F.get_json_object("meta", f"$.{k}")), F.lit(""))
    line = F.substring(F.trim(F.element_at(F.filter(F.split("body", "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#")), 1)), 1, 80)
    title = F.coalesce(field("title"), field("source"), F.nullif(T.title_from_url(field("url")), F.lit("")), F.nullif(T.markdown_title(F.col("body")), F.lit("")), F.nullif(line, F.lit("")))
    return rows.select("name", title.alias("title"), field("url").alias("url"), F.col("body").alias("content")).filter("title is not null")


def read_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """First http(s) line of each *.url file, each address once: url."""
    rows = read_vault(spark, folder, recursive=False, pattern="*.url")
    first = F.element_at(F.filter(F.transform(F.split("raw", r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)^https?://")), 1)
    return rows.select("path", first.alias("url")).filter("url is not null").groupBy("url").agg(F.min("path").alias("path")).select("url")


def read_log(spark: SparkSession, path: str, action: str | None = None) -> DataFrame:
    """Headers of a log file: at, action, detail."""
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^## \[[^\]]+\] \w+"))
    parts = rows.select(*(F.regexp_extract("value", r"^## \[([^\]]+)\] (\w+):?\s*(.*)$", k).alias(n) for k, n in enumerate(("at", "action", "detail"), 1)))
    return parts.filter(F.col("action") == action) if action else parts
