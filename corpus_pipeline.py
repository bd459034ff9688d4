"""From raw documents to token ids: five stages over the operators of heedstream.llm.

Each stage takes the documents that the stage before it kept, all of them
and whole, and returns the columns of ``documents``; the last one returns
token ids. Stages are written as Parquet and read again, so that a lost
executor never repeats more than its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedstream.llm import decontam, ngram_join, quality, sentencepiece_bpe, suffix_dedup
from heedstream.llm._common import stage_table
from heedstream.llm.queries import piece_model, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half."""
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).where("selected").select("carried.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similar shingle sets the document of smallest id."""
    return ngram_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start earlier; n_chars is counted anew."""
    out = suffix_dedup.remove_repeats(docs)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.coalesce(F.length("kept_text"), F.col("carried.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, even with edits."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to."""
    return sentencepiece_bpe.encode(docs, piece_model(), keep_ids=True, keep_text=False)


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", tokenize),
]

#: The classifier's fit and the tokenizer can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.split()[0], spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
