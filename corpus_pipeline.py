"""A corpus pipeline: language, near copies, benchmark leaks, source mix, token codes.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.llm.common import table, written

#: SQL can't express the stages (a fitted model, similarity groups, BM25, rounding in sequence, a tokenizer).
ORACLE_SQL = None

#: A text whose most likely language has less than this posterior is rejected, as is one without a letter.
LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told."""
    from lineagelake.llm.language_id import fit, identify

    model = fit(docs, order=F.xxhash64("doc_id"))
    told = identify(docs, model)
    return told.filter(F.col("lang_pred") != "und").filter(F.col("score") >= LANGUAGE_SCORE).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    from lineagelake.llm.ngram_join import drop_near_copies

    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    from lineagelake.llm.decontaminate import drop_leaks

    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their share of the words."""
    from lineagelake.llm.mixing import take

    return take(docs)


def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all texts as token codes; a row for each document, read back from the files."""
    import public_tokenizers

    from lineagelake.llm.token_codes import read_index, write_codes

    return read_index(write_codes(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("source_mix", source_mix), ("token_codes", token_codes)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
