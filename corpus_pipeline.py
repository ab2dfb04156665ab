"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage is one operator of ``signals.llm`` applied to all that the stage before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signals.llm.bpe import encode_texts
from signals.llm.line_dedup import remove_spread_lines
from signals.llm.mixing import pareto_mix
from signals.llm.queries import MAX_BITS, SHINGLE_WORDS, TOKENIZER
from signals.llm.simhash import simhash_groups
from signals.llm.toxicity import fit_toxicity, held_out, score_toxicity
from signals.sources.scratch import write_once


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under a half; the model never saw the labels held out for measuring it.

    Null and empty texts get the score of the model's bias. Repeated rows are scored each; without labels every score is the
    same; an empty table gives no rows. All columns come back, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    score = _free("toxic", docs)
    return score_toxicity(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that different texts of many sources share; ``n_chars`` follows the text.

    Near copies count as one text here: their lines must last until the next stage has chosen one of them. Null texts
    stay null and keep their ``n_chars``; repeated rows keep a row each; an empty table gives no rows. All columns come
    back, but those named ``lines`` and ``lines_removed``, which the operator replaces, as they were given.
    """
    names = {c: _free(c, docs) for c in ("lines", "lines_removed") if c in docs.columns}
    clean = remove_spread_lines(docs.withColumnsRenamed(names), near_copies=True)
    length = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.select(*[length.alias(c) if c == "n_chars" else F.col(names.get(c, c)).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles that links of two bits reach.

    The row with the smallest id stays, null last, then by a hash of all its columns; equal rows are copies like any
    other. Null and empty texts are copies of each other. An empty table gives no rows. All columns come back,
    whatever their names.
    """
    groups = simhash_groups(docs, words=SHINGLE_WORDS, max_bits=MAX_BITS, carry=docs.columns)
    return groups.where("kept").select("carried.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies are rows of their own.

    Null and empty texts count no words, null sources are one source, repeated rows are drawn each; an empty table gives
    no rows. All columns come back, whatever their names.
    """
    mix = pareto_mix(docs, carry=docs.columns).where(F.col("copies") > 0)
    return mix.select("carried", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("carried.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the token ids of each document taken, and a digest of what they decode to.

    Null texts count as empty, which have no tokens; repeated rows keep a row each; texts of any length are encoded whole;
    an empty table gives no rows; further columns are ignored.
    """
    coded = encode_texts(docs, public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _free(name: str, docs: DataFrame) -> str:
    """A name that no column has."""
    while name in docs.columns:
        name += "_"
    return name


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("source mix", source_mix),
    ("bpe", bpe),
]

#: Fingerprints, learned scores and token ids cannot be stated in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
