"""The corpus pipeline: language, near copies, benchmark passages, source weights, token files.

Every stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and reread as the next one's
``docs``.  Null texts, languages, sources and ids pass through or go by each stage's own rule (see its docstring).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language was found; null texts and texts without a letter go."""
    from quillstone.llm.language import accepted, fit_languages

    docs = docs.select(*COLUMNS)
    return accepted(docs, fit_languages(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of smallest id.

    SimHash with pivot tables links the nearest copies first, prefix filtering finds the rest; every link is checked on the shingle sets.
    """
    from quillstone.llm.simhash import near_copies, one_of_each

    return one_of_each(docs.select(*COLUMNS), near_copies)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from quillstone.llm.decontaminate import without_leaks

    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until every source has its target of words; a copy is a row of its own."""
    from quillstone.llm.mixing import mixed_documents

    mixed = mixed_documents(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"), with_source=True)
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return copies.select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as token files and read back."""
    from quillstone.llm.queries import vocabulary
    from quillstone.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(docs, vocabulary())).drop("file")


STAGES = [
    ("languages", identify_languages),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Hashing, learned models and token files cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
