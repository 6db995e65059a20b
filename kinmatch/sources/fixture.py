"""A linkage view over a table of documents: three sources, names, addresses, and a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import text as T


#: Words of other scripts and spellings that some names begin with.
FOREIGN = {5: "Łódź Škoda", 11: "Москва", 17: "दिल्ली"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, src, country, business_name, business_address: a name of the first five words of a text, an address of the next six.

    One address in seven has no number, and three names in 29 begin with words of other alphabets.
    """
    # only the words that the view takes are cut; the last of twelve is the rest
    w = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+", ""), r"\s+", 12)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", F.filter(F.slice(w, 1, 11), lambda x: x != "").alias("w"))
    src = (F.col("doc_id") % 3 + 1).cast("int")
    name, addr = F.array_join(F.slice("w", 1, 5), " "), F.array_join(F.slice("w", 6, 6), " ")
    first = F.lit(None).cast("string")
    for k, words in FOREIGN.items():
        first = F.when(F.col("doc_id") % 29 == k, words).otherwise(first)
    return d.select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        src.alias("src"),
        F.col("lang").alias("country"),
        F.concat_ws(" ", first, name).alias("business_name"),
        F.when(F.col("n_chars") % 7 == 3, addr).otherwise(F.concat((F.col("n_chars") % 1000).cast("string"), F.lit(" "), addr)).alias("business_address"),
    )


def normalised(records: DataFrame) -> DataFrame:
    """records plus nm and ad."""
    return records.withColumns({"nm": T.name_tokens(F.col("business_name")), "ad": T.addr_tokens(F.col("business_address"))})


def truth(norm: DataFrame) -> DataFrame:
    """(s1, q): an observation belongs to the least catalogue entry of its country and name."""
    first = norm.filter("src = 1 and nm <> ''").groupBy("country", "nm").agg(F.min("entity_id").alias("s1"))
    return norm.filter("src > 1").select("country", "nm", F.col("entity_id").alias("q")).join(first, ["country", "nm"]).select("s1", "q")
