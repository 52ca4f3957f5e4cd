"""The corpus pipeline: language, exact copies, near copies, mixture, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartergrid.llm.chosen_path import drop_near_copies
from quartergrid.llm.content_dedup import drop_copies
from quartergrid.llm.joins import free, keyed
from quartergrid.llm.language import keep_identified
from quartergrid.llm.mixing import mixed
from quartergrid.llm.packing import pack
from quartergrid.llm.queries import language_model
from quartergrid.llm.token_files import fresh_path

TOKENIZER = "word_bpe_49k.json"
# Tells rows apart from the first stage's output to the mixture; ids may repeat or be null.
ROW = "row_key"
# The language that the first stage identifies; the mixture weighs a source's languages apart.
LANGUAGE = "identified_lang"


def _row(docs: DataFrame) -> str | None:
    """The key of the first stage, which is the last column; None in a table without it."""
    return docs.columns[-1] if docs.columns[-1].startswith(ROW) else None


def _language(docs: DataFrame) -> str | None:
    """The identified language, which stands before the row key; None in a table without it."""
    names = docs.columns[-2:]
    return names[0] if _row(docs) and names[0].startswith(LANGUAGE) else None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Name each document's language for the mixture; drop texts that are null or have no letter (``und``).

    Without labelled documents the language of all others is ``und`` too, and they stay.
    Repeated rows, null ids and all columns stay; the language and the row key take names
    that no column has. An empty table stays empty.
    """
    named = keep_identified(docs, language_model(docs), into=free(LANGUAGE, docs))
    return keyed(named, free(ROW, docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts that are equal but for white space; null counts as empty."""
    return drop_copies(docs, row=_row(docs))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies; texts without words stay."""
    return drop_near_copies(docs, row=_row(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources, a null one included, meet their targets.

    The documents of a source in one identified language are a source of their own.
    """
    row, language = _row(docs), _language(docs)
    if language is None:
        return mixed(docs, row=row).drop(*[row] if row else [])
    part = free("_part", docs)
    # A null source comes last, as it does without languages.
    parts = docs.withColumn(part, F.struct(F.col("source").isNull().alias("none"), "source", language))
    return mixed(parts, source=part, row=row).drop(part, language, row)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixture into sequences; null and empty texts are an end id each."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language identification by a trained model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
