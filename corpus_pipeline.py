"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Defined results of every stage but the last, which are those of its operator on whole rows: all columns
are kept as they are (``text`` and ``n_chars`` change where lines go), also such as clash with names
that an operator uses; a null doc_id is kept, and rows of equal ids or equal rows are rows of their own;
an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import decontaminate, line_dedup, near_dup, packing, quality_crf
from wakeline.llm.shared import staged, table

#: No stage but the first could be put in SQL: they sketch, align and tokenize.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects go. A null, empty or wordless text scores the labelled rows' share of good ones, as does every text without labels of both kinds; a score at the threshold stays."""
    return quality_crf.good_documents(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, or nearly so, go; so do documents left without any. Null and wordless texts have no such lines and stay; of equal rows the first keeps its lines."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the lowest doc_id (then the first row; null ids last). Wordless and null texts are copies of each other."""
    return near_dup.without_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and wordless texts hold none; without a benchmark all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 1024. A null or empty text is its end id alone; no documents give no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("near_dup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
