"""Context features for a second model over first-stage scores (q, s1, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.similarity import similarity


def query_context(pairs: DataFrame) -> DataFrame:
    """Best and second score, number and sure ones of the query; gap to the best and to the best other."""
    w = Window.partitionBy("q")
    p = pairs.withColumns({"r": F.row_number().over(w.orderBy(F.desc("p"), "s1")), "q_pmax": F.max("p").over(w), "q_n": F.count("*").over(w), "q_nhi": F.count_if(F.col("p") > 0.5).over(w)})
    p = p.withColumn("q_p2", F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))).over(w), F.col("q_pmax")))
    other = F.when(F.col("p") == F.col("q_pmax"), F.col("q_p2")).otherwise(F.col("q_pmax"))
    return p.withColumns({"q_gap": F.round(F.col("q_pmax") - F.col("p"), 9), "q_runner": F.round(F.col("p") - other, 9)}).drop("r")


def entry_context(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("s1")
    return pairs.withColumns({"s_sum": F.round(F.sum("p").over(w), 6), "s_nhi": F.count_if(F.col("p") > 0.5).over(w), "s_rank": F.row_number().over(w.orderBy(F.desc("p"), "q")), "s_n": F.count("*").over(w)})


def siblings(pairs: DataFrame) -> DataFrame:
    """The best other observation of the entry: the first, or for the first itself the second."""
    w = Window.partitionBy("s1")
    p = pairs.withColumn("r", F.row_number().over(w.orderBy(F.desc("p"), "q")))
    nth = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c))).over(w)
    p = p.withColumns({"q1": nth(1, "q"), "q2": nth(2, "q"), "p1": nth(1, "p"), "p2": nth(2, "p")})
    return p.withColumns({"sib": F.when(F.col("r") == 1, F.col("q2")).otherwise(F.col("q1")), "sib_p": F.when(F.col("r") == 1, F.col("p2")).otherwise(F.col("p1"))}).drop("q1", "q2", "p1", "p2", "r")


def sibling_likeness(pairs: DataFrame, meta: DataFrame, kernel: str = "ratio") -> DataFrame:
    """How like the sibling the observation is, in name, address and house number."""
    m = lambda q, end: meta.select(F.col("entity_id").alias(q), F.col("nm").alias(f"nm_{end}"), F.col("ad").alias(f"ad_{end}"), F.col("num1").alias(f"num_{end}"))
    p = siblings(pairs).join(m("q", "q"), "q").join(m("sib", "b"), "sib", "left")
    use = lambda a, b: similarity(kernel, a, b)
    sure = lambda c: F.when(F.col("sib").isNotNull(), F.round(c, 6))
    return p.select("q", "s1", "p", "sib", "sib_p", sure(use(F.col("nm_q"), F.col("nm_b"))).alias("sib_n_ratio"), sure(use(F.col("ad_q"), F.col("ad_b"))).alias("sib_a_ratio"), (F.col("num_q") == F.col("num_b")).cast("int").cast("double").alias("sib_num_eq"))


def contexts(pairs: DataFrame, meta: DataFrame, kernel: str = "ratio") -> DataFrame:
    return entry_context(query_context(pairs)).join(sibling_likeness(pairs, meta, kernel).drop("p"), ["q", "s1"])
