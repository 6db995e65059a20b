"""From scored pairs (q, s1, p) to decisions, and what they are worth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_entry(pairs: DataFrame) -> DataFrame:
    """Each observation with its best entry only."""
    w = Window.partitionBy("q").orderBy(F.desc("p"), "s1")
    return pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def assign(pairs: DataFrame, threshold: float) -> DataFrame:
    return best_entry(pairs).filter(F.col("p") >= threshold)


def expected_f(pairs: DataFrame) -> DataFrame:
    """Keep the first k observations of an entry that maximise the expected F0.5, unless none is better still.

    With probabilities in falling order the value of k is 1.25 * sum of the first k / (0.25 * sum of all + k); that of none
    is the product of 1 - p.
    """
    w = Window.partitionBy("s1")
    order = w.orderBy(F.desc("p"), "q")
    b = best_entry(pairs).withColumns({
        "k": F.row_number().over(order), "cum": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "tot": F.sum("p").over(w), "none": F.product(1 - F.col("p")).over(w),
    })
    b = b.withColumn("ef", F.round(1.25 * F.col("cum") / (0.25 * F.col("tot") + F.col("k")), 9))
    b = b.withColumn("best", F.max("ef").over(w))
    b = b.withColumn("best_k", F.min(F.when(F.col("ef") == F.col("best"), F.col("k"))).over(w))
    return b.filter("k <= best_k and best > none").select("q", "s1", "p")


def decide(pairs: DataFrame, rule: str, threshold: float) -> DataFrame:
    return expected_f(pairs) if rule == "expected_f" else assign(pairs, threshold)


def per_entry(pred: DataFrame, truth: DataFrame, entries: DataFrame) -> DataFrame:
    """s1, tp, n_pred, n_true, f of every entry."""
    hit = pred.select("s1", "q").withColumn("pred", F.lit(1)).join(truth.select("s1", "q").withColumn("true", F.lit(1)), ["s1", "q"], "full")
    n = hit.groupBy("s1").agg(F.count_if((F.col("pred") == 1) & (F.col("true") == 1)).alias("tp"), F.count("pred").alias("n_pred"), F.count("true").alias("n_true"))
    out = entries.select("s1").join(n, "s1", "left").fillna(0, ["tp", "n_pred", "n_true"])
    safe = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).when(F.col("tp") == 0, 0.0)
    p, r = F.col("tp") / safe("n_pred"), F.col("tp") / safe("n_true")
    return out.withColumn("f", f.otherwise(1.25 * p * r / (0.25 * p + r)))


def macro_f05(pred: DataFrame, truth: DataFrame, entries: DataFrame) -> DataFrame:
    return per_entry(pred, truth, entries).agg(F.round(F.avg("f"), 6).alias("f05"))


def breakdown(pred: DataFrame, truth: DataFrame, entries: DataFrame) -> DataFrame:
    """F0.5 with micro precision and recall, accuracy on entries without observations, F0.5 on the others."""
    e = per_entry(pred, truth, entries)
    return e.agg(
        F.round(F.avg("f"), 6).alias("f05"), F.round(F.try_divide(F.sum("tp"), F.sum("n_pred")), 6).alias("precision"), F.round(F.try_divide(F.sum("tp"), F.sum("n_true")), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("n_true") == 0, F.col("f"))), 6).alias("singleton_accuracy"), F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f"))), 6).alias("matched_f05"),
        F.count_if(F.expr("n_true = 0")).alias("singletons"), F.count("*").alias("entries"),
    )


def threshold_curve(pairs: DataFrame, truth: DataFrame, entries: DataFrame, grid: list[float]) -> DataFrame:
    """F0.5 at each threshold."""
    return per_threshold(pairs, truth, entries, grid).groupBy("t").agg(F.round(F.avg("f"), 6).alias("f05"))


def per_threshold(pairs: DataFrame, truth: DataFrame, entries: DataFrame, grid: list[float]) -> DataFrame:
    """s1, t, f in one pass: every best pair counts at all thresholds up to its p.

    An entry without any pair scores the same at all; it is added at the end.
    """
    best = best_entry(pairs).join(truth.withColumn("true", F.lit(1)), ["s1", "q"], "left")
    at = F.filter(F.array(*map(F.lit, grid)), lambda t: F.col("p") >= t)
    n = best.select("s1", "true", F.explode(at).alias("t")).groupBy("s1", "t").agg(F.count("*").alias("n_pred"), F.count("true").alias("tp"))
    links = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    all_ = entries.select("s1").join(links, "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.array(*map(F.lit, grid))).alias("t"))
    e = all_.join(n, ["s1", "t"], "left").fillna(0, ["n_pred", "tp"])
    p, r = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_true")
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).when(F.col("tp") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return e.select("s1", "t", f.alias("f"))


def best_threshold(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.desc("f05"), "t").limit(1)


def thin_out(pairs: DataFrame, truth: DataFrame, drop) -> tuple[DataFrame, DataFrame]:
    """Pairs and truth without the true observations that `drop` (a Column of q) picks: what a denser catalogue looks like."""
    gone = truth.filter(drop).select("q").distinct()
    return pairs.join(gone, "q", "left_anti"), truth.join(gone, "q", "left_anti")


def errors(pairs: DataFrame, chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, q, s1, p: false merges, and true links that were no candidate, went elsewhere or were not chosen."""
    false = chosen.select("q", "s1", "p").join(truth, ["q", "s1"], "left_anti").withColumn("kind", F.lit("false_merge"))
    missed = truth.select("q", "s1").join(chosen, ["q", "s1"], "left_anti").join(pairs.select("q", "s1", "p"), ["q", "s1"], "left")
    other = chosen.select("q", F.lit(1).alias("other")).distinct()
    kind = F.when(F.col("p").isNull(), "miss:not_in_candidates").when(F.col("other") == 1, "miss:assigned_elsewhere").otherwise("miss:not_selected")
    return false.unionByName(missed.join(other, "q", "left").withColumn("kind", kind).select("q", "s1", "p", "kind")).select("kind", "q", "s1", "p")


def override_unseen(chosen: DataFrame, pairs: DataFrame, unseen: DataFrame, threshold: float) -> DataFrame:
    """Decisions of entries of the given (s1) are made again at another threshold."""
    again = assign(pairs, threshold).join(unseen, "s1", "left_semi").select("q", "s1", "p")
    return chosen.join(unseen, "s1", "left_anti").select("q", "s1", "p").unionByName(again)


def pseudo_labels(pairs: DataFrame, unseen: DataFrame, high: float = 0.97, low: float = 0.03) -> DataFrame:
    """Sure pairs of the given entries as labels."""
    x = pairs.join(unseen, "s1", "left_semi")
    return x.filter((F.col("p") >= high) | (F.col("p") <= low)).select("q", "s1", (F.col("p") >= high).cast("int").alias("label"))


def country_report(entries: DataFrame, cands: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entries, mean candidates, mean matches and the share without any match, by country.  entries: s1, country."""
    n = lambda d, c: d.groupBy("s1").agg(F.count("*").alias(c))
    e = entries.join(n(cands, "c"), "s1", "left").join(n(chosen, "m"), "s1", "left").fillna(0, ["c", "m"])
    return e.groupBy("country").agg(F.count("*").alias("n_s1"), F.round(F.avg("c"), 6).alias("candidates"), F.round(F.avg("m"), 6).alias("matches"), F.round(100 * F.avg((F.col("m") == 0).cast("int")), 6).alias("pct_empty"))


def margin_assign(pairs: DataFrame, thresholds: dict[int, float], margin: float) -> DataFrame:
    """pairs with src: a threshold for each source, a lead below the entry's best of at least the margin (the best itself stays), one entry per observation."""
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    kept = pairs.filter(F.col("p") >= F.try_element_at(limit, F.col("src")))
    w = Window.partitionBy("s1").orderBy(F.desc("p"), "q")
    kept = kept.withColumns({"r": F.row_number().over(w), "top": F.max("p").over(Window.partitionBy("s1"))})
    kept = kept.filter((F.col("r") == 1) | (F.round(F.col("top") - F.col("p"), 9) >= margin)).drop("r", "top")
    return best_entry(kept)


def number_penalty(pairs: DataFrame, factor: float = 0.1) -> DataFrame:
    """p times the factor where both house numbers are there and differ."""
    differ = F.col("num_q").isNotNull() & F.col("num_s").isNotNull() & (F.col("num_q") != F.col("num_s"))
    return pairs.withColumn("p", F.round(F.when(differ, F.col("p") * factor).otherwise(F.col("p")), 9))


def brier(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 6).alias("brier"))


def decode(p: np.ndarray) -> int:
    """How many of the probabilities, in falling order, to keep for the greatest exact expected F0.5.

    hits among the kept and among the rest are Poisson-binomial; their distributions grow one probability at a time.
    """
    p = np.clip(p, 1e-5, 1 - 1e-5)
    n = len(p)

    def grow(probs):
        out = [np.ones(1)]
        for x in probs:
            out.append(np.convolve(out[-1], [1 - x, x]))
        return out

    head, tail = grow(p), grow(p[::-1])[::-1]
    values = [tail[0][0]]
    for k in range(1, n + 1):
        x, z = np.arange(k + 1)[:, None], np.arange(n - k + 1)[None, :]
        values.append(float((head[k][:, None] * tail[k][None, :] * 1.25 * x / (k + 0.25 * (x + z))).sum()))
    # values that differ by rounding alone are ties, and the smaller k wins
    return int(np.argmax(np.round(values, 12)))


def decode_entries(pairs: DataFrame, longest: int = 400) -> DataFrame:
    """q, s1, p of the observations that decode() keeps.

    An entry's list is the observations whose best entry it is.  decode() takes cubic time, so a list of more than `longest` goes by
    the closed form of expected_f() instead.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for probs in f["p"]:
                keep.append(decode(np.asarray(probs)))
            yield pd.DataFrame({"s1": f["s1"], "k": keep})

    order = Window.partitionBy("s1").orderBy(F.desc("p"), "q")
    best = best_entry(pairs).withColumn("r", F.row_number().over(order))
    size = best.groupBy("s1").agg(F.count("*").alias("n"))
    few, hubs = (best.join(size.filter(f"n {test} {longest}"), "s1", "left_semi") for test in ("<=", ">"))
    lists = few.groupBy("s1").agg(F.reverse(F.array_sort(F.collect_list("p"))).alias("p"))
    exact = few.join(lists.mapInPandas(run, "s1 string, k int"), "s1").filter("r <= k").select("q", "s1", "p")
    return exact.unionByName(expected_f(hubs.select("q", "s1", "p")))
