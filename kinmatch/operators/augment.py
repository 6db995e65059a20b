"""Synthetic hard negatives: observations that look like an entry's but belong to its neighbour.

Chance is a hash of the record and a seed, so a run repeats itself whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNTHETIC = "-SYN"


def dice(seed: str, *parts: Column) -> Column:
    """0..999999, from the hash of the parts."""
    text = F.concat_ws("|", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("bigint") % 1_000_000


def shift_number(addr: Column, roll: Column) -> Column:
    """The first run of digits moved by 1 to 30 up or down, to 1 at least; texts without digits stay."""
    digits = F.regexp_extract(addr, "([0-9]+)", 1)
    by = roll % 30 + 1
    moved = digits.try_cast("bigint") + F.when(roll.bitwiseAND(32) > 0, by).otherwise(-by)
    return F.when(moved.isNull(), addr).otherwise(F.regexp_replace(addr, F.lit("^([^0-9]*)[0-9]+"), F.concat(F.lit("$1"), F.greatest(moved, F.lit(1)).cast("string"))))


def insert_marker(name: Column, marker: Column, roll: Column) -> Column:
    """The marker put behind some word but never before the first."""
    w = F.split(name, " ")
    at = (F.when(F.size(w) > 1, roll % (F.size(w) - 1)).otherwise(F.lit(0)) + 1).cast("int")
    return F.array_join(F.concat(F.slice(w, 1, at), F.array(marker), F.slice(w, at + 1, F.greatest(F.size(w), F.lit(1)))), " ")


#: Most copies that one row can be drawn as; at the rates in use here the chance of more is below the dice's step.
MOST_COPIES = 12


def resample(rows: DataFrame, rate: float, seed: str, *key: str) -> DataFrame:
    """rows drawn with replacement, `rate` times each on average: the copies of a row, numbered from 0 in `copy`.

    In a sample with replacement from many rows, the copies of each follow a Poisson law; here its quantile at the row's dice.
    Nothing is counted or sorted, so a draw needs no shuffle.
    """
    law = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(MOST_COPIES)]
    roll = dice(seed, *[F.col(k) for k in key])
    copies = sum((F.when(roll >= F.lit(sum(law[: k + 1]) * 1_000_000), 1).otherwise(0) for k in range(MOST_COPIES)), F.lit(0))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).filter(F.col("copy") < copies)


def sample_fraction(rows: DataFrame, fraction: float, seed: str, *key: str) -> DataFrame:
    """About the given share of the rows, the same ones in every run."""
    return rows.filter(dice(seed, *[F.col(k) for k in key]) < int(fraction * 1_000_000))


def make_decoys(linked: DataFrame, loose: DataFrame, markers: DataFrame, quota: int, seed: str = "decoy") -> DataFrame:
    """Synthetic records: src, country, business_name, business_address, entity_id, kind.

    linked and loose: q, src, country, business_name, business_address of the observations with and without an entry.  About half
    the quota is drawn from either, with replacement.  A loose one gets another house number and is dropped without one.  Of the linked ones four in
    five get another number; three in five, and all that kept theirs, a marker word of the country.  One that ends unchanged is dropped.
    """
    sizes = linked.select(F.lit(1).alias("linked")).unionByName(loose.select(F.lit(0).alias("linked"))).agg(F.count_if(F.expr("linked = 1")).alias("m"), F.count_if(F.expr("linked = 0")).alias("l")).first()
    half = quota // 2
    drawn = resample(loose, half / max(1, sizes["l"]), f"{seed}l", "q").withColumn("kind", F.lit("reshift"))
    drawn = drawn.unionByName(resample(linked, (quota - half) / max(1, sizes["m"]), f"{seed}m", "q").withColumn("kind", F.lit("mark")))
    roll = lambda tag: dice(seed + tag, F.col("q"), F.col("copy").cast("string"))
    words = markers.groupBy("country").agg(F.array_sort(F.collect_set("tok")).alias("words"))
    each = drawn.join(words, "country", "left").withColumn("again", F.col("kind") == "reshift")
    moved = F.col("again") | (roll("shift") < 800_000)
    each = each.withColumn("addr", F.when(moved, shift_number(F.col("business_address"), roll("by"))).otherwise(F.col("business_address")))
    word = F.initcap(F.get("words", (roll("word") % F.greatest(F.size("words"), F.lit(1))).cast("int")))
    marked = ~F.col("again") & (F.coalesce(F.size("words"), F.lit(0)) > 0) & ((roll("mark") < 600_000) | (F.col("addr") == F.col("business_address")))
    each = each.withColumn("name", F.when(marked, insert_marker(F.col("business_name"), word, roll("at"))).otherwise(F.col("business_name")))
    each = each.filter("name <> business_name or addr <> business_address")
    ident = F.concat(F.lit("S"), F.col("src").cast("string"), F.lit(SYNTHETIC), F.md5(F.concat_ws("|", "q", "copy")))
    return each.select("src", "country", F.col("name").alias("business_name"), F.col("addr").alias("business_address"), ident.alias("entity_id"), "kind")


def without_decoys(records: DataFrame) -> DataFrame:
    """Takes all synthetic records out again."""
    return records.filter(~F.col("entity_id").contains(SYNTHETIC))
