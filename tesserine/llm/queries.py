"""Queries of the training-data operators and their oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.chunking import chunk
from tesserine.llm.history import append, fingerprint, repeats, stored
from tesserine.llm.languages import cached, languages, missing_labels, train
from tesserine.llm.leakage import leaks
from tesserine.llm.mixing import count_tokens, mix, shares
from tesserine.llm.residue import has_slot, residue
from tesserine.llm.sentences import sentences
from tesserine.llm.turns import speaker_turns
from tesserine.llm.wrappers import main_bodies
from tesserine.runtime import materialise, new_folder, table


def _bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Main bodies of all sources, and the residue among them."""
    bodies = materialise(main_bodies(table(spark, sf_dir, "sources"), mark=has_slot), "bodies")
    return bodies, materialise(residue(bodies).select("rec_id", "reason"), "excluded")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that belong to the page around the main body."""
    bodies, excluded = _bodies(spark, sf_dir)
    return bodies.join(excluded, "rec_id", "left_anti").select("rec_id", F.explode("chrome").alias("line_no"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, excluded = _bodies(spark, sf_dir)
    model = train(table(spark, sf_dir, "documents"))
    return cached(languages(bodies.join(excluded, "rec_id", "left_anti").select("rec_id", F.col("body").alias("text"), F.array().cast("array<int>").alias("chrome")), model))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose language label is missing or wrong, and lines in another language."""
    return missing_labels(_languages(spark, sf_dir), table(spark, sf_dir, "sources"), table(spark, sf_dir, "syntheses"))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every record and of each segment in another language."""
    return _languages(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of new batches that repeat an earlier record, with the first one."""
    bodies, excluded = _bodies(spark, sf_dir)
    texts = bodies.select("rec_id", "body")  # texts are read in place, only fingerprints move
    prints = fingerprint(texts.withColumn("batch_no", F.lit(0))).drop("batch_no")
    prints = prints.join(excluded, "rec_id", "left_anti").join(table(spark, sf_dir, "sources").select("rec_id", "batch_no"), "rec_id")
    folder = new_folder(spark, "prints")
    append(folder, prints)
    return repeats(stored(spark, folder, prints), texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to exclude: error pages, notices, filler and unfilled slots."""
    return _bodies(spark, sf_dir)[1].select("rec_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are cut under which config: those with more than one piece."""
    pieces = chunk(table(spark, sf_dir, "sources"), table(spark, sf_dir, "chunk_configs"), keep_text=False, oversized_only=True)
    return pieces.filter(F.col("piece_no") == 2).select("config_id", "rec_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized texts, with their text."""
    return chunk(table(spark, sf_dir, "sources"), table(spark, sf_dir, "chunk_configs"), oversized_only=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all transcripts with the number of their speaker."""
    return speaker_turns(table(spark, sf_dir, "transcripts"), table(spark, sf_dir, "episodes")).select("transcript_id", "turn_no", "speaker_no")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all transcripts with speaker, time and clean text."""
    return speaker_turns(table(spark, sf_dir, "transcripts"), table(spark, sf_dir, "episodes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat at least half of an evaluation item, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return materialise(count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN), "tokens")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their copies."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in each mix."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares(mix(sized, targets), targets, sized)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents with their places."""
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_pos", "end_pos")


def queries():
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_languages": p2_languages, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_turns": p6_turns, "p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}


def oracle_sql():
    return {
        "p5_found": "SELECT c.config_id, s.rec_id FROM sources s JOIN chunk_configs c ON length(s.content) > c.chunk_size",
    }
