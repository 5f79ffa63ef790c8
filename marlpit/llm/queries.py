"""The corpus queries of the driver contract and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import chat, decontam, line_dedup, minhash, mixing, pii, prefix_trie, quality, simhash, substring, token_counts, toxicity, whitening
from marlpit.llm.common import materialize, table

#: Tokenizer versions that are counted, with their files; None counts words.
TOKENIZERS: dict[str, str | None] = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "words_1": None}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pieces = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.mixed_documents(pieces).drop("row")


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds; clean documents have none."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizers: dict[str, str | None] = TOKENIZERS) -> DataFrame:
    """Totals after four batches: all documents go in, the first batch is replayed (and changes nothing), texts with numbers are revised, later copies of a text are taken out."""
    docs = table(spark, sf_dir, "documents")
    ledger = token_counts.new_ledger(spark)
    for _ in range(2):
        ledger.commit("load", upserts=token_counts.token_rows(docs, tokenizers))
    ledger.commit("masked", upserts=token_counts.token_rows(token_counts.masked(docs), tokenizers))
    ledger.commit("copies", deletes=token_counts.later_copies(docs))
    return ledger.totals()


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.toxicity_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str, key: bytes = b"rotate this key") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, key).withColumnRenamed("_n_replaced", "n_replaced")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept_text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), drop=("text",))
    base = [F.col(f"_{c}").alias(c) for c in quality.FEATURES]
    return found.select("doc_id", *base, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_bits").alias("bits_per_word"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written out as raw transcripts, of which a fifth of the turns has no marker; roles recovered and rendered, in parts of CHUNK_LINES lines."""
    lines = materialize(chat.numbered_lines(chat.raw_turns(chat.turn_rows(table(spark, sf_dir, "conversations")))), "transcript")
    return chat.canonical_turns(chat.parse_transcripts(lines, chat.fit_hmm(lines)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(whitening.whitened(table(spark, sf_dir, "embeddings")))


def op12_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_minhash_groups": op12_minhash_groups,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op7_line_dedup": line_dedup.LINE_SQL,
    "op13_prefix_trie": prefix_trie.TRIE_SQL,
}
