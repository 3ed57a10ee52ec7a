"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; each result is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of
documents.  Texts change in line dedup and decontamination; n_chars follows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate as clean
from quillon.llm import jaccard, langid, line_dedup, packing
from quillon.llm.common import fold, free_names, materialize, named, small_side
from quillon.llm.queries import tokenizer_path


def _documents(like: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars, if there, counts the text's code points."""
    return rows.select(*(F.coalesce(F.length("text"), F.lit(0)).cast(dict(like.dtypes)[c]).alias(c) if c == "n_chars" else named(c) for c in like.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; where no language could be learned, the others stay."""
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    lang, score = free_names(docs, "lang", "score")
    found = langid.identify(docs, model, lang_out=lang, score_out=score)
    known = F.col(lang) != langid.UNDETERMINED if model.langs else F.col("text").rlike(r"\p{L}")
    return found.where(known).select(*map(named, docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more share stay in the last of them only."""
    return _documents(docs, line_dedup.dedup_lines(docs, min_chars=40, min_docs=5, counts=tuple(free_names(docs, "n_lines", "n_dropped"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 4-word shingles at 0.85 make, the smallest doc_id stays.

    Rows that repeat an id are one document; rows with a null id link with nothing and stay.
    """
    groups = jaccard.similarity_groups(docs, size=4, percent=85)
    gone = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*map(named, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document that is little else goes."""
    return _documents(docs, clean.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.8))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path=tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Packing counts tokens of a byte-level vocabulary, which SQL cannot; see the brute-force test.
ORACLE_SQL = None
