"""From raw documents to packed training sequences: five stages, each over all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabloom.llm.decontaminate import decontaminate
from vocabloom.llm.language import held_out, predict, train
from vocabloom.llm.lines import dedup_lines
from vocabloom.llm.neardup import one_of_each
from vocabloom.llm.packing import pack
from vocabloom.llm.shared import table, written

#: A document goes if its language is less likely than this; four languages share 1, so this rejects guesses only.
LEAST_SCORE = 0.3


def hidden(docs: DataFrame, *names: str) -> DataFrame:
    """Documents whose own columns of these names have other names, which `with_own` undoes."""
    return docs.withColumnsRenamed({n: f"_own_{n}" for n in names if n in docs.columns})


def with_own(docs: DataFrame, made: DataFrame) -> DataFrame:
    """The columns of `docs` from a result of `hidden` documents."""
    return made.select(*(F.col(f"_own_{n}" if f"_own_{n}" in made.columns and f"_own_{n}" not in docs.columns else n).alias(n) for n in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go, and those whose best language is hardly likelier than the others.

    Null texts have no letter and go; repeated rows are judged each; with no labelled document nothing is in a language.
    """
    model = train(docs.filter(~held_out("doc_id")))
    return with_own(docs, predict(hidden(docs, "lang_pred", "score"), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text.

    A document that loses all its lines stays, with an empty text; null texts stay null.
    """
    kept = dedup_lines(hidden(docs, "n_lines", "n_dropped", "kept_text"))
    changed = F.col("n_dropped") > 0
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return with_own(docs, kept.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id. Documents without words or without an id stay."""
    return one_of_each(docs).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate(hidden(docs, "n_words", "hit_spans", "item_ids", "contaminated"), table(spark, sf_dir, "benchmark"))
    return with_own(docs, found.filter("not contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
