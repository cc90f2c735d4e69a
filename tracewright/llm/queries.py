"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import components, names, packing, pages, spans, tokens, transcripts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_ref, group_ref of every record in a group of at least two."""
    return components.same_records(spark.read.parquet(f"{sf_dir}/semantic_assertion.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture, broken and misread words and continued paragraphs of all pages."""
    return pages.findings(spark.read.parquet(f"{sf_dir}/pdf_page_text.parquet"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_ref, mention_id of every mention that means a registered entity of its work."""
    state = spark.read.parquet(f"{sf_dir}/current_state.parquet").where("predicate = 'CANONICAL_IDENTITY'")
    registry = state.select("entity_ref", "work_id", "display_label", "aliases", (F.get_json_object("object_ref", "$.canonical_type") == "organisation").alias("organisation"))
    mentions = spark.read.parquet(f"{sf_dir}/source_mention.parquet")
    return names.link_mentions(mentions, registry, spark.read.parquet(f"{sf_dir}/name_short_form.parquet")).select("entity_ref", "mention_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, utterance_index, turn_first, word_count of every utterance with spoken words."""
    t = transcripts.speaker_turns(spark.read.parquet(f"{sf_dir}/audio_output.parquet"), texts=False)
    return t.select("media_id", "utterance_index", "turn_first", "word_count")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utterances with their texts and speakers, rolling captions cut down, turns split at pauses eight times as long as the recording's median."""
    return transcripts.speaker_turns(spark.read.parquet(f"{sf_dir}/audio_output.parquet"), rolling=3, pause=8.0)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    sized = tokens.encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", only_count=True)
    return packing.pack(sized, "doc_id", "n_tokens", limits=(2048, 2048, 2048))


def p8_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as instruction examples: what comes before the first blank line asks, the rest answers and bears the loss.

    Containers hold 2,048 tokens, 12 examples and 1,024 tokens that bear loss.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.contains("text", F.lit("\n\n")), F.substring_index("text", "\n\n", 1)).otherwise("").alias("asked"), "text")
    docs = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("asked").alias("text")), F.struct(F.lit(1).alias("side"), F.col("text").substr(F.length("asked") + 1, F.length("text")).alias("text")))).alias("x"))
    sized = tokens.encode_column(docs.select(F.struct("doc_id", "x.side").alias("at"), "x.text"), "at", "text", only_count=True)
    sized = sized.groupBy("at.doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(F.col("at.side") == 1, F.col("n_tokens"))).alias("loss"))
    return packing.pack(sized, "doc_id", "n_tokens", "loss", limits=(2048, 12, 1024))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shared_chars of every document with a stretch of 200 characters that another has too."""
    return spans.shared_chars(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 200)


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_turns": p6_turns, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_instructions": p8_instructions, "p9_found": p9_found}

SQL = {
    "p1_found": r"""
WITH RECURSIVE r AS (
  SELECT lower(regexp_replace(subject_ref, '^\s+|\s+$', '', 'g')) AS s, lower(regexp_replace(object_ref, '^\s+|\s+$', '', 'g')) AS o
  FROM semantic_assertion WHERE upper(regexp_replace(predicate_code, '^\s+|\s+$', '', 'g')) IN ('CORRESPONDS_TO', 'ALIAS_OF')
), e AS (
  SELECT s AS a, o AS b FROM r WHERE s <> '' AND o <> '' AND s <> o UNION SELECT o, s FROM r WHERE s <> '' AND o <> '' AND s <> o
), reach(a, m) AS (
  SELECT DISTINCT a, least(a, b) FROM e
  UNION
  SELECT e.b, reach.m FROM reach JOIN e ON e.a = reach.a
)
SELECT a AS record_ref, min(m) AS group_ref FROM reach GROUP BY a
""",
}
