"""A training corpus from raw documents: five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's input. All but the last return
the columns of their input. The order is fixed: language, near duplicates,
benchmark leaks, mixing, token files.

Defined results: documents without text or letters have no language and go in
the first stage, whatever their other columns; with no labelled document at all
every document stays there. Null ids, sources and labels are kept: a document
without an id is linked with none and judged by its own text, a null source is
one of its own. Of documents that share an id each is judged by its own text, but
for near duplicates, where they are one document. Of linked documents the
smallest doc_id stays, all its rows if it is repeated. Texts of any length are
read whole. An empty table gives an empty corpus. Extra columns go through the
stages as they are, whatever their names. What the stages write lies under
``spark.checkpoint.dir`` until ``locusframe.llm._common.clean_scratch``, as results
are read from there. Executors live on from stage to stage, so each stage begins
by giving back what the one before has left in their heaps.

``ORACLE_SQL`` is None: the language model and the tokenizer cannot be
expressed in SQL; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontamination, jaccard_join, language_id, mixing, token_files
from locusframe.llm._common import give_back_heaps, read_table, work_dir, write_shared

#: Documents whose language is predicted with less are rejected, as are those without letters.
LEAST_SCORE = 0.3
#: Written at the end of every document.
END_ID = 1

ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; the others go."""
    give_back_heaps(spark)
    model = language_id.fit_unheld(docs)
    if model is None:
        return docs
    predicted = language_id.predict_rows(docs, model)
    return predicted.where((F.col("lang") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the smallest doc_id."""
    give_back_heaps(spark)
    return jaccard_join.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    give_back_heaps(spark)
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix gives it."""
    give_back_heaps(spark)
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    give_back_heaps(spark)
    uri = work_dir(spark, "corpus")
    token_files.write_tokens(docs, uri, token_files.default_tokenizer(), END_ID)
    return token_files.read_tokens(spark, uri)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_similar),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    path = work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
