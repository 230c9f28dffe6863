"""Problem 8: combine sources to target shares of tokens.

Each document gets the Efraimidis-Spirakis key -ln(u) / weight, u being a hash
of mix, source and id. A source's token budget is filled by complete epochs
first, then by its documents in order of key up to the rest of the budget.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.runtime import materialise, ship

#: Documents that one bucket of the prefix sum holds about.
BUCKET_ROWS = 50_000
#: Rows of targets that the driver may be asked to broadcast.
MAX_TARGETS = 100_000


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """df's columns `keep` and n_tokens, by the byte-pair vocabulary file at `vocabulary`.

    A null text has 0 tokens. The file is read by each executor; its path must
    be readable there.
    """
    ship(df.sparkSession)
    chosen = df.select(*keep, F.col(text_col).alias("_text"))
    fields = [(f.name, f.dataType.simpleString()) for f in chosen.schema.fields[:-1]]

    def run(batches):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return chosen.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields) + ", n_tokens long")


def default_weight(n_tokens: Column) -> Column:
    """Quality weight from 0.25 to 1: very short texts are drawn less often."""
    return F.lit(0.25) + F.lit(0.75) * F.least(F.lit(1.0), n_tokens / F.lit(200.0))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Budget of each (mix, source): epochs, rest and what is available.

    sized: source, n_tokens. targets: mix_name, source, target_share,
    max_repeats. The total of a mix is `total_tokens` or, by default, the
    largest one at which no source that has documents passes max_repeats. The
    shares of sources without tokens can't be reached and are spread over the
    others in proportion. Null or non-positive shares or repeats give budget 0.
    """
    have = sized.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
    share = F.when((F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(F.lit(0.0))
    rows = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(F.broadcast(have.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")), "source", "left").fillna(0, ["available", "n_docs"])
    mix = Window.partitionBy("mix_name")
    usable = F.when(F.col("available") > 0, share).otherwise(F.lit(0.0))
    rows = rows.withColumn("_share", usable).withColumn("_share", F.try_divide("_share", F.sum("_share").over(mix)))
    rows = rows.withColumn("_share", F.coalesce("_share", F.lit(0.0)))
    limit = F.try_divide(F.col("available") * F.col("max_repeats"), F.col("_share"))
    rows = rows.withColumn("total", F.lit(total_tokens).cast("double") if total_tokens else F.min(limit).over(mix))
    most = F.col("available") * F.coalesce("max_repeats", F.lit(0))
    rows = rows.withColumn("budget", F.coalesce(F.least(F.floor(F.col("total") * F.col("_share") + 1e-6), most), F.lit(0)).cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.try_divide("budget", "available"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    return rows.select("mix_name", "source", "target_share", "max_repeats", "available", "n_docs", "budget", "epochs", "rest")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None, weight: Column | None = None) -> DataFrame:
    """Documents of every mix with the number of copies taken.

    sized: doc_id, source, n_tokens (and what `weight` reads). Result:
    mix_name, source, doc_id, n_tokens, copies >= 1. The document at the edge of
    a budget is taken if at least half of it fits. Documents with null
    source or without tokens are in no mix; rows with the same id are drawn
    together or not, by the same key, in order of their token count.

    A source may hold any part of all rows: its prefix sum runs in buckets of
    about BUCKET_ROWS documents by key, offset by pre-aggregated bucket sums.
    """
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"mix: more than {MAX_TARGETS} targets")
    wanted = materialise(plan(sized, targets, total_tokens).filter(F.col("budget") > 0), "mixplan")
    unit = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source", F.col("doc_id").cast("string")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    w = F.greatest(F.coalesce(weight if weight is not None else default_weight(F.col("n_tokens")), F.lit(0.0)), F.lit(1e-9))
    drawn = sized.filter(F.col("n_tokens") > 0).withColumn("_w", w).join(F.broadcast(wanted), "source").withColumn("_key", -F.log(unit) / F.col("_w"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(BUCKET_ROWS)))
    drawn = drawn.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key") / 2)) * buckets), buckets - 1))
    sums = drawn.groupBy("mix_name", "source", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("mix_name", "source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("mix_name", "source", "_bucket").orderBy("_key", "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.join(offsets, ["mix_name", "source", "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    copies = (F.col("epochs") + (F.col("_upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("long")).cast("int")
    return placed.select("mix_name", "source", "doc_id", "n_tokens", copies.alias("copies")).filter(F.col("copies") > 0)


def shares(mixed: DataFrame, targets: DataFrame, sized: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Target and actual share of each (mix, source), with tokens, documents and repeats used."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"))
    rows = plan(sized, targets, total_tokens).join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "docs_used", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return rows.select(
        "mix_name", "source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("actual_share"), "tokens", "budget", "available", "docs_used", F.col("most_copies").cast("int").alias("most_copies"), "max_repeats"
    )
