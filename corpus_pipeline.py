"""A training corpus from documents: five stages, each a decision of one operator of llm.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents;
the last returns their tokens.  run() writes each stage to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import bpe_round_trip, id_digest
from llm.common import Stages, keyed, small_batches
from llm.mixing import mix
from llm.similar import similar_copies
from llm.substrings import cut_repeats
from llm.toxicity import THRESHOLD, fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    small_batches(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}  # none that score() adds
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return score(spark, rows, model, threshold=THRESHOLD).filter("predicted = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def _rows(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text and the whole row; a doc_id may be null or repeated, so stages pick and join on rid."""
    return keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "row")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id (null first), listed once.

    Near copies share four fifths of their five-word shingles or more; op10's fingerprints only find most of them.
    """
    rows = _rows(docs)
    kept = similar_copies(spark, rows).select(F.col("component").alias("rid")).distinct()
    return rows.select("rid", "row").join(kept, "rid", "left_semi").groupBy("rid").agg(F.min("row").alias("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; untouched texts keep their white space.

    A document goes only if nothing is left of it that had words before.
    """
    rows = _rows(docs)
    # Rows of one rid have one text, and so one remainder.
    cut = cut_repeats(spark, rows).filter("n_removed > 0").select("rid", "kept").dropDuplicates(["rid"])
    joined = rows.select("rid", "row").join(cut, "rid", "left").filter("kept is null or kept <> ''")
    old = lambda c: F.col("row").getField(c)
    text = F.coalesce("kept", old("text"))
    n_chars = F.when(F.col("kept").isNull(), old("n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[(text if c == "text" else n_chars if c == "n_chars" else old(c)).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture draws them."""
    return mix(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of its ids and of what they decode to."""
    out = bpe_round_trip(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("simhash near-dedup", simhash_dedup), ("substring dedup", substring_dedup), ("source mixing", mixing), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over documents."""
    st = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = st.put(f"stage-{i}", stage(spark, docs, sf_dir))
        if i:
            st.drop(f"stage-{i - 1}")
    return docs


#: Fingerprints, the classifier and the merges have no SQL; tests/llm holds every stage and run() against plain versions.
ORACLE_SQL = None
