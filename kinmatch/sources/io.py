"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
#: Drops the shuffle files of an action when it ends.
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Tab-separated, a header, no quoting; an empty field is null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """Records as TSV that keeps missing and empty texts apart: \\N is a missing one, and a text of backslashes and N gets one more."""
    marked = lambda c: F.coalesce(F.regexp_replace(c, r"^(\\+N)$", r"\\$1"), F.lit(r"\N")).alias(c)
    write_tsv(df.select(*[marked(c) for c in ("entity_id", "business_name", "business_address", "country")]), path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What write_records wrote."""
    text = lambda c: F.when(F.col(c) == r"\N", None).otherwise(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\\(\\+N)$", "$1")).alias(c)
    records = read_tsv(spark, path)
    return records.select(*[text(c) for c in records.columns])


def read_sources(spark: SparkSession, paths: dict[int, str], read=read_tsv) -> DataFrame:
    """All sources in one table with src."""
    out = None
    for src, path in paths.items():
        one = read(spark, path).withColumn("src", F.lit(src))
        out = one if out is None else out.unionByName(one)
    return out


def read_truth(wide: DataFrame) -> DataFrame:
    """(s1, q) from lists."""
    q = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return wide.select(F.col("source1_entity_id").alias("s1"), q.alias("q")).select("s1", F.trim("q").alias("q")).filter("q <> ''")


def lists(entries: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """A row for every entry: its observations in order, joined by commas; '' for none."""
    of = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("q")), ",").alias(column))
    return entries.select("s1").join(of, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_lists(entries: DataFrame, pairs: DataFrame, column: str, path: str) -> None:
    write_tsv(lists(entries, pairs, column).orderBy("source1_entity_id"), path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line of a text file, without byte-order mark and carriage return."""
    return spark.read.text(path).select(clean_line(F.col("value")).alias("line"))


def clean_line(c):
    return F.regexp_replace(c, r"^\x{FEFF}|\r$", "")


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write once: a directory that is complete is read, not made again.  The write's shuffle files go with it."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        before = spark.conf.get(CLEAN_CONF, None)
        spark.conf.set(CLEAN_CONF, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            spark.conf.unset(CLEAN_CONF) if before is None else spark.conf.set(CLEAN_CONF, before)
    return spark.read.parquet(path)


def read_countries(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """A table written by partition of country: only the named partitions are listed and read."""
    return spark.read.parquet(path).filter(F.col("country").isin(countries))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small artefact as one JSON line, on any file system that Spark knows."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_matrix(features: DataFrame, columns: list[str], path: str) -> None:
    """A matrix of features in single precision beside its keys."""
    features.select(*[F.col(c).cast("float").alias(c) if c in columns else F.col(c) for c in features.columns]).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns only; the others are not read."""
    return spark.read.parquet(path).select(*columns)


def append_log(spark: SparkSession, path: str, row: dict, keep: bool) -> None:
    """A row of an experiment log with its verdict."""
    spark.createDataFrame([(json.dumps(row, sort_keys=True), "KEEP" if keep else "REJECT")], "result string, verdict string").write.mode("append").json(path)
