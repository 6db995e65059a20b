"""Lexicons mined from records and labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.config import Thresholds
from kinmatch.functions.text import STOP, words

#: The tokens of a record and the kind of lexicon that they go by.
KINDS = {"nm": "name", "ad": "addr"}


def pair_tokens(truth: DataFrame, norm: DataFrame, column: str) -> DataFrame:
    """tq, ts: the tokens of both sides of each true pair."""
    side = lambda name: norm.select(F.col("entity_id").alias(name), words(F.col(column)).alias(f"t{name[0]}"))
    return truth.join(side("s1"), "s1").join(side("q"), "q").select("q", "s1", "tq", "ts")


def spelling_map(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """(bad, good) spellings: tokens that pairs of few differences keep exchanging.

    A token that the catalogue side uses too (over legit_ratio of its uses by observations) is no misspelling.
    """
    uq, us = F.array_except("tq", "ts"), F.array_except("ts", "tq")
    diff = pairs.select(uq.alias("uq"), us.alias("us")).filter("size(uq) between 1 and 3 and size(us) between 1 and 3")
    pair = diff.select(F.explode("uq").alias("bad"), "us").select("bad", F.explode("us").alias("good")).groupBy("bad", "good").agg(F.count("*").alias("n"))
    best = Window.partitionBy("bad").orderBy(F.desc("n"), "good")
    top = pair.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")
    total = diff.select(F.explode("uq").alias("bad")).groupBy("bad").agg(F.count("*").alias("nt"))
    uses = lambda c, n: pairs.select(F.explode(c).alias("bad")).groupBy("bad").agg(F.count("*").alias(n))
    legit = uses("ts", "ns").join(uses("tq", "nq"), "bad").filter(F.col("ns") > t.legit_ratio * F.col("nq")).select("bad")
    ok = (F.col("n") >= t.map_support) & (F.col("n") / F.col("nt") >= t.map_share) & ~F.col("bad").rlike("[0-9]") & ~((F.char_length("bad") >= 12) & F.contains("bad", "good")) & (F.char_length("good") > 1) & ~F.col("good").isin("the", "and", "of", "dba")
    return top.join(total, "bad").filter(ok).join(legit, "bad", "left_anti").select("bad", "good", "n", "nt")


def filler_words(tokens: DataFrame, records: DataFrame, kind: str, lift: float, share: float) -> DataFrame:
    """(country, tok, s1, s23) that observations use far more often than the catalogue; tokens from respelt()."""
    totals = records.groupBy("country").agg(F.count_if(F.expr("src = 1")).alias("n1"), F.count_if(F.expr("src > 1")).alias("n23"))
    tok = tokens.filter(F.col("kind") == kind).select("entity_id", "country", "src", "tok").distinct()
    uses = tok.groupBy("country", "tok").agg(F.count_if(F.expr("src = 1")).alias("s1"), F.count_if(F.expr("src > 1")).alias("s23"))
    rate = F.col("s23") * F.col("n1") >= lift * (F.col("s1") + 1) * F.col("n23")
    return uses.join(totals, "country").filter(rate & (F.col("s23") >= share * F.col("n23")) & ~F.col("tok").rlike("^[0-9]+$")).select("country", "tok", "s1", "s23")


def decoy_words(candidates: DataFrame, meta: DataFrame, t: Thresholds) -> DataFrame:
    """dec(country, tok): how often a word that only the observation has goes with another house number, smoothed."""
    q = meta.select(F.col("entity_id").alias("q"), "country", F.col("full").alias("full_q"), F.col("num1").alias("num1_q"))
    s = meta.select(F.col("entity_id").alias("s1"), F.col("full").alias("full_s"), F.col("num1").alias("num1_s"))
    top = candidates.filter("rank = 0").select("q", "s1")
    x = top.join(q, "q").join(s, "s1").select("country", F.explode(F.array_except("full_q", "full_s")).alias("tok"), (F.col("num1_q") != F.col("num1_s")).cast("int").alias("mm")).filter("mm is not null")
    prior = x.groupBy("country").agg(F.avg("mm").alias("prior"))
    per = x.groupBy("country", "tok").agg(F.count("*").alias("n"), F.sum("mm").alias("mm")).filter(F.col("n") >= t.decoy_support)
    return per.join(prior, "country").select("country", "tok", ((F.col("mm") + t.decoy_prior * F.col("prior")) / (F.col("n") + t.decoy_prior)).alias("dec"))


def marker_words(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """(country, tok, n, share): extra words that mostly go with false pairs.  pairs: country, extra, false."""
    x = pairs.select("country", F.explode(F.array_distinct("extra")).alias("tok"), F.col("false").cast("int").alias("false"))
    return x.groupBy("country", "tok").agg(F.count("*").alias("n"), F.avg("false").alias("share")).filter((F.col("n") >= t.marker_support) & (F.col("share") >= t.marker_share))


def respelt(norm: DataFrame, spellings: DataFrame) -> DataFrame:
    """entity_id, country, src, kind, pos, tok: all tokens through the spelling map (kind, bad, good).

    The map holds only what passed a support threshold; Spark broadcasts it if it's small enough.
    """
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), words(F.col(c)).alias("w")) for c, k in KINDS.items()])
    tok = norm.select("entity_id", "country", "src", F.explode(lists).alias("x")).select("entity_id", "country", "src", "x.kind", F.posexplode("x.w").alias("pos", "tok"))
    known = spellings.select("kind", F.col("bad").alias("tok"), "good")
    return tok.join(known, ["kind", "tok"], "left").select("entity_id", "country", "src", "kind", "pos", F.coalesce("good", "tok").alias("tok"))


def finished(norm: DataFrame, spellings: DataFrame, fillers: DataFrame) -> DataFrame:
    """norm with nm and ad finished, and spelt: the name's tokens through the map only.

    Tokens go through the map, then names lose stop words, and both lose the fillers (kind, country, tok) of their country.
    Where nothing is left: without stop words only; then all.  Lexicons are joined token by token: none travels with a row.
    """
    tok = respelt(norm, spellings).join(fillers.select("kind", "country", "tok", F.lit(True).alias("filler")), ["kind", "country", "tok"], "left")
    stop = (F.col("kind") == "name") & F.col("tok").isin(STOP)
    each = F.struct("pos", "tok", stop.alias("stop"), F.coalesce("filler", F.lit(False)).alias("filler"))
    of = tok.groupBy("entity_id", "kind").agg(F.array_sort(F.collect_list(each)).alias("t"))
    plain, best = F.filter("t", lambda x: ~x["stop"]), F.filter("t", lambda x: ~x["stop"] & ~x["filler"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x["tok"]), " ")
    pick = F.when(F.size(best) > 0, text(best)).when(F.size(plain) > 0, text(plain)).otherwise(text("t"))
    of = of.select("entity_id", "kind", pick.alias("out"), text("t").alias("all"))
    per = of.groupBy("entity_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("out"))).alias(c) for c, k in KINDS.items()], F.max(F.when(F.col("kind") == "name", F.col("all"))).alias("spelt"))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("nm", "ad", "spelt")}
    return norm.drop("nm", "ad").join(per, "entity_id", "left").withColumns(blank)
