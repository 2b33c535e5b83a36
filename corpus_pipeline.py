"""The corpus pipeline: stages over documents, each written and read again.

All stages but the last return the columns of documents, other columns left out.
Nulls in any column, empty and very long texts, repeated rows and empty tables
pass through every stage, with the results its docstring states; an empty table
gives an empty table.  Each row is judged whole, however long its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgweave.llm.common import Scratch, table
from kgweave.llm.decontaminate import drop_contaminated
from kgweave.llm.jaccard_join import one_per_class
from kgweave.llm.quality_rules import quality_rules
from kgweave.llm.queries import token_file
from kgweave.llm.raking import mix_to_targets
from kgweave.llm.token_orc import read_tokens, with_crc32, write_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have fewer than 20 words, so they go.  Null languages and
    sources are groups of their own.  Repeated rows are judged alike and all stay.
    """
    return quality_rules(docs).filter("kept").select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest doc_id.

    Documents without words are no duplicates and all stay.  Of rows equal in doc_id and
    text one stays.  A null doc_id is kept only where all of its class are null.
    """
    return one_per_class(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and empty texts hold none.  Repeated rows go or stay together.
    """
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities raked to the target weights.

    The draw is a hash of doc_id (null: the empty text), so rows of one id share it.
    Null sources and languages are the group "".  Null texts are drawn with their cell.
    """
    return mix_to_targets(docs).filter("kept").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and per document what is read back from them.

    doc_id, start, n_tokens and ids_crc32.  Null and empty texts have the end id alone.
    Null doc_ids come first; repeated rows stay rows of their own.
    """
    path = Scratch(spark, "pipeline-tokens").path("orc")
    write_tokens(docs, path, token_file())
    return with_crc32(read_tokens(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontamination_stage),
    ("raking", mixing_stage),
    ("token_orc", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quantile sketches and the tokenizer cannot be said in SQL; tests/llm/test_pipeline.py holds
#: run() and every stage against a plain version.
ORACLE_SQL = None

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLE: dict[str, str] = {}
