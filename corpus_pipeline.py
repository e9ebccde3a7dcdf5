"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding.

Every stage takes all rows that its predecessor kept; between stages the rows are written as Parquet and read again.
All stages but the last return the columns of ``documents``; the last one returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowloom.llm.decontam import drop_contaminated_rows
from rowloom.llm.linededup import deduplicated
from rowloom.llm.pieces import encode_documents
from rowloom.llm.rules import keep_good
from rowloom.llm.simhash import one_row_of_each
from rowloom.scratch import materialise, only_kept, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them only; texts and n_chars change."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class stays."""
    return one_row_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go."""
    return drop_contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source with piece ids, the source bytes that each piece covers, and the decoded text."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Iterative classes and the tokenizer have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote on its way goes when its rows are written, and those go when the next stage's are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with only_kept(kept):
            kept.append(materialise(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
