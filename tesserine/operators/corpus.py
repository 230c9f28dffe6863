"""Source corpus, state snapshots, operation log and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T


def content_hash(content: Column) -> Column:
    """SHA-256 of the text in UTF-8."""
    return F.sha2(content, 256)


def duplicate_groups(sources: DataFrame) -> DataFrame:
    """Class of each source by the hash of its stripped content: rec_id, class_id (smallest rec_id), copies."""
    keyed = sources.filter(F.col("content").isNotNull()).select("rec_id", content_hash(F.regexp_replace("content", r"^\s+|\s+$", "")).alias("h"))
    groups = keyed.groupBy("h").agg(F.min("rec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(groups, "h").select("rec_id", "class_id", "copies")


def classify_changes(current: DataFrame, state: DataFrame) -> DataFrame:
    """new, changed, unchanged or deleted by file: file, status. Both sides: file, hash."""
    c, s = current.select("file", F.col("hash").alias("now")), state.select("file", F.col("hash").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return c.join(s, "file", "full_outer").select("file", status.alias("status"))


def exclusive_owners(owners: DataFrame) -> DataFrame:
    """Concepts that one source alone has: slug, source_file. owners: source_file, slug."""
    return owners.groupBy("slug").agg(F.min("source_file").alias("source_file"), F.max("source_file").alias("last")).filter(F.col("source_file") == F.col("last")).drop("last")


def latest_operation(operations: DataFrame) -> DataFrame:
    """Latest operation of each source by (updated_at, created_at, id)."""
    rows = operations.dropDuplicates(["id"]).filter(F.col("source").isNotNull())
    return rows.groupBy("source").agg(F.max_by(F.struct("id", "status", "attempt", "updated_at"), F.struct("updated_at", "created_at", "id")).alias("m")).select("source", "m.*")


def retain_last(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The last `keep` rows of each key in the given descending order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def run_rollup(operations: DataFrame) -> DataFrame:
    """Counts and bytes of each run."""
    ok = F.col("status") == "succeeded"
    return operations.dropDuplicates(["id"]).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_operations"), F.count_if(ok).alias("n_succeeded"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes_extracted"))), F.lit(0)).alias("bytes_ok"), F.max("attempt").alias("most_attempts"),
    )


# The states of an operation and where each may go.
OPERATION_STEPS = {"planned": ("running", "cancelled", "failed", "succeeded", "retrying"), "running": ("succeeded", "failed", "cancelled", "retrying"), "retrying": ("running", "succeeded", "failed", "cancelled"), "failed": ("retrying",), "succeeded": (), "cancelled": ()}
# The states of a contradiction and where each may go.
CONTRADICTION_STEPS = {"detected": ("review_ok", "pending_fix", "resolved", "suppressed"), "review_ok": ("pending_fix", "resolved", "suppressed"), "pending_fix": ("review_ok", "resolved", "suppressed"), "resolved": (), "suppressed": ()}


def steps(operations: DataFrame) -> DataFrame:
    """Transitions in the histories: id, k, was, now."""
    h = operations.dropDuplicates(["id"]).select("id", F.coalesce("history", F.array().cast(operations.schema["history"].dataType)).alias("h"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("h")), lambda i: F.struct(i.alias("k"), F.element_at("h", i - 1)["status"].alias("was"), F.element_at("h", i)["status"].alias("now")))
    return h.filter(F.size("h") > 1).select("id", F.explode(pairs).alias("p")).select("id", "p.*")


def illegal_steps(found: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Transitions the table of allowed steps doesn't have; staying in a state is always allowed."""
    legal = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), F.col("was")), F.col("now")), F.lit(False))
    return found.filter(~legal & (F.col("was") != F.col("now")))


def collision_names(rows: DataFrame, stem: str, order: str) -> DataFrame:
    """File names without collisions: stem, stem-1, ... by order of arrival."""
    k = F.row_number().over(Window.partitionBy(stem).orderBy(order)) - 1
    return rows.withColumn("name", F.concat(F.col(stem), F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.lit("")), F.lit(".md")))


def truncate_bytes(content: Column, most: int) -> Column:
    """Longest prefix of at most `most` UTF-8 bytes that ends at a character."""
    raw = F.encode(content, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(0, most - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(content) <= most, content).otherwise(F.coalesce(*cuts))


def quota(calls: DataFrame, at: str = "ts") -> DataFrame:
    """Calls of each day."""
    return calls.groupBy(F.to_date(at).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("calls"))


def failed_ledger(operations: DataFrame) -> DataFrame:
    """Last error of each source that failed last: source, error of at most 120 characters."""
    last = operations.dropDuplicates(["id"]).groupBy("source").agg(F.max_by(F.struct("status", "error"), F.struct("updated_at", "created_at", "id")).alias("m"))
    return last.filter("m.status = 'failed'").select("source", F.substring(F.coalesce("m.error", F.lit("")), 1, 120).alias("error"))


def freshness(sources: DataFrame) -> DataFrame:
    """Sources with their place by freshness: retrieved_at, then title, both descending; missing dates last.

    Places come from a global range sort with counts by partition, not from one task.
    """
    rows = sources.select("rec_id", F.coalesce("provenance.retrieved_at", F.lit("")).alias("retrieved_at"), F.coalesce("title", F.lit("")).alias("title"))
    return rows.orderBy(F.desc("retrieved_at"), F.desc("title"), "rec_id")


def quality(sources: DataFrame) -> DataFrame:
    """rec_id and the rule of the extraction gate it breaks ("" if none)."""
    return sources.select("rec_id", T.quality_reason(F.col("title"), F.col("content")).alias("reason"))
