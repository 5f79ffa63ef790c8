"""A corpus from raw documents to a mix: quality rules, line dedup, near-dedup, decontamination, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last keep the columns of docs, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import decontam, line_dedup, mixing, quality, simhash
from marlpit.llm.common import free_prefix, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    prefix = free_prefix(docs)
    return quality.quality_verdicts(docs, prefix=prefix).filter(f"{prefix}kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id has; n_chars, where there is one, follows."""
    prefix = free_prefix(docs)
    out = line_dedup.line_dedup(docs, prefix=prefix).withColumn("text", F.col(f"{prefix}kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.first_of_groups(docs, simhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with size, source_size, target and taken: how many words of each row the mix takes, passes counted; 0 leaves it out of the mix. Rows that share an id, or have none,
    each get their own. Where docs has a column of such a name, the new one has an underscore in front."""
    return mixing.with_mix(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Hamming distances of fingerprints and a language model's perplexity have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
