"""Corpus preparation in five stages: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage works on all that its predecessor kept. The first drops documents predicted toxic, the second keeps one
document of each near-duplicate group, the third masks secrets in the text, the fourth samples documents by calibrated
weights, the last encodes whole texts. All but the last return the columns of documents, whatever other columns those
have, with the values they had (secrets changes text and n_chars).

Every stage: null and empty texts stay rows like any other, texts are worked on whole, repeated rows are treated alike
(but one of each near-duplicate group stays), an empty table stays empty, columns named like an operator's output pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, secrets, simhash, spm, toxicity
from loomgraph.llm.common import stored
from loomgraph.llm.queries import MIX_SEED, tokenizer_path

#: How far the mixing stage draws the sources', languages' and topics' shares towards each other (1: not at all).
TEMPER = 0.98
#: The columns that stages read; any others only pass through.
READ = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing(stage: Stage) -> Stage:
    """The stage with all other columns renamed while it runs, so that none meets a column of an operator's own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c.lower() if c.lower() in READ else f"passing_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@passing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Labels come from the table of labels; without any no document goes."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=docs.columns, keep_text=True).where(F.col("predicted") == 0).select(*docs.columns)


@passing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that with the smallest id, of equal ids one row; null ids come last."""
    return simhash.deduplicate(docs)


@passing
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the new text; null texts stay null."""
    return secrets.redact(docs)


@passing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares of sources, languages and topics meet their tempered targets; rows of an id go or stay together."""
    return mixing.mix(docs, seed=MIX_SEED, temper=TEMPER).where("kept").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the digests of the ids and of the text decoded from them; a row for each document."""
    return spm.round_trip(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("sentencepiece", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
