"""Pair features: the 61 columns of the linkage model, and the 38 of the forward baseline.

Groups that one window can serve share it: what is taken over a query, and what over a catalogue entry, is one
exchange each.  Where all columns are built, what depends on other pairs comes from a few narrow ones; texts are put
beside a pair last and once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.functions.similarity import levenshtein_similarity, similarity

# The names of the columns.
RETRIEVAL = ["rank", "score", "name_cos", "addr_cos", "via_key"]
CONTEXT = ["top1", "top2", "s1_n", "s1_n0", "s1_rank", "gap", "margin"]
TOKENS = ["n_xq", "n_xs", "g_same_num", "g_same_num_frac", "dec_max", "dec_sum", "s_num_mindiff", "s_num_in_q", "g_uniq_x"]
NAMES = ["amb_s_name", "amb_q_name", "amb_s_addr", "name_eq", "q_name_ties", "q_known_frac"]
SOURCE = ["src", "translit"]
FUZZY = ["n_ratio", "n_tset", "n_tsort", "n_partial", "n_jw", "a_ratio", "a_tset", "a_partial", "raw_n", "raw_a"]
NUMBERS = ["num_inter", "num_union", "num_first_eq", "num_first_diff", "num_jac", "num_q_in_s", "n_extra_q", "n_extra_s", "len_nq", "len_ns", "len_aq", "len_as"]
TIES = [f"{c}_{k}" for c in ("raw_n", "raw_a", "n_ratio", "a_tset") for k in ("qgap", "qbest")] + ["raw_n_qties", "raw_a_qties"]
ALL = RETRIEVAL + CONTEXT + TOKENS + NAMES + SOURCE + FUZZY + NUMBERS + TIES
CLIP = 1_000_000
#: What crowded() adds to a record.
CROWD = ["n_name", "n_addr", "known"]


def clip(c: Column) -> Column:
    """At most CLIP; null stays null (F.least would skip it)."""
    return F.when(c.isNotNull(), F.least(c, F.lit(CLIP)))


def metadata(norm: DataFrame) -> DataFrame:
    """entity_id, src, country, nm, ad, raw_name, raw_addr, translit, nums, num1, full (unique words of the respelt, unfinished name)."""
    raw = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return norm.select(
        "entity_id", "src", "country", "nm", "ad", raw("business_name").alias("raw_name"), raw("business_address").alias("raw_addr"),
        F.coalesce(F.col("business_name"), F.lit("")).rlike(r"[^\x00-\x7F]").cast("int").alias("translit"),
        T.numbers(F.col("ad")).alias("nums"), T.first_number(F.col("ad")).alias("num1"), F.array_distinct(T.words(F.col("spelt"))).alias("full"),
    )


def context(c: DataFrame) -> DataFrame:
    """Best and second score of the query (the best again if alone), crowding and rank at the entry."""
    q, s = Window.partitionBy("q"), Window.partitionBy("s1")
    # by entry first: pruned candidates lie by entry
    c = c.withColumns({"s1_n": F.count("*").over(s), "s1_n0": F.count_if(F.col("rank") == 0).over(s), "s1_rank": F.row_number().over(s.orderBy(F.desc("score"), "q"))})
    c = c.withColumns({"r": F.row_number().over(q.orderBy(F.desc("score"), "s1")), "top1": F.max("score").over(q)})
    c = c.withColumn("top2", F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))).over(q), F.col("top1")))
    return c.withColumns({"gap": F.round(F.col("top1") - F.col("score"), 6), "margin": F.round(F.col("top1") - F.col("top2"), 6)}).drop("r")


def pair_up(c: DataFrame, meta: DataFrame, last: str = "s1") -> DataFrame:
    """Candidates with the metadata of both sides, as *_q and *_s; they lie by `last` (q or s1) after it."""
    both = [x for x in ("nm", "ad", "raw_name", "raw_addr", "nums", "num1", "full", *CROWD) if x in meta.columns]
    side = lambda name: meta.select(F.col("entity_id").alias(name), *([F.col("country"), F.col("src"), F.col("translit")] if name == "q" else []), *[F.col(x).alias(f"{x}_{name[0]}") for x in both])
    first = "q" if last == "s1" else "s1"
    return c.join(side(first), first).join(side(last), last)


def token_extras(p: DataFrame) -> DataFrame:
    return p.withColumns({"n_xq": F.size(F.array_except("full_q", "full_s")), "n_xs": F.size(F.array_except("full_s", "full_q"))})


def same_number(p: DataFrame) -> DataFrame:
    """Other candidates of the entry with the query's house number, and their share."""
    n = F.count(F.col("num1_q")).over(Window.partitionBy("s1", "num1_q"))
    all_ = F.count("*").over(Window.partitionBy("s1"))
    p = p.withColumn("g_same_num", F.greatest(n - 1, F.lit(0)))
    return p.withColumn("g_same_num_frac", F.round(F.col("g_same_num") / F.greatest(all_ - 1, F.lit(1)), 6))


def _decoy_weights(p: DataFrame, dec: DataFrame) -> DataFrame:
    x = p.select("q", "s1", "country", F.explode(F.array_except("full_q", "full_s")).alias("tok")).join(dec, ["country", "tok"])
    return x.groupBy("q", "s1").agg(F.round(F.max("dec"), 6).alias("dec_max"), F.round(F.sum("dec"), 6).alias("dec_sum"))


def decoys(p: DataFrame, dec: DataFrame) -> DataFrame:
    """Largest and summed decoy weight of the words that only the query has; null if none is known."""
    return p.join(_decoy_weights(p, dec), ["q", "s1"], "left")


def number_distance(p: DataFrame) -> DataFrame:
    """Least distance of any number of the query to the entry's house number."""
    far = F.array_min(F.transform("nums_q", lambda n: F.abs(n.try_cast("bigint") - F.col("num1_s").try_cast("bigint"))))
    p = p.withColumn("s_num_mindiff", clip(far))
    return p.withColumn("s_num_in_q", (F.col("s_num_mindiff") == 0).cast("int"))


def _lone_words(p: DataFrame) -> DataFrame:
    df = p.select("s1", F.explode("full_q").alias("tok")).groupBy("s1", "tok").agg(F.count("*").alias("df")).filter("df = 1")
    return p.select("q", "s1", F.explode(F.array_except("full_q", "full_s")).alias("tok")).join(df, ["s1", "tok"]).groupBy("q", "s1").agg(F.count("*").alias("g_uniq_x"))


def unique_words(p: DataFrame) -> DataFrame:
    """Words that only the query has and no other candidate of the entry."""
    return p.join(_lone_words(p), ["q", "s1"], "left").withColumn("g_uniq_x", F.coalesce("g_uniq_x", F.lit(0)))


def crowded(meta: DataFrame) -> DataFrame:
    """meta plus n_name, n_addr (entries of the record's country of its name, its address) and known (an observation's share of known words)."""
    s = meta.filter("src = 1")
    nm = s.groupBy("country", "nm").agg(F.count("*").alias("n_name"))
    ad = s.filter("ad <> ''").groupBy("country", "ad").agg(F.count("*").alias("n_addr"))
    vocab = s.select("country", F.explode(T.words(F.col("nm"))).alias("tok")).groupBy("country", "tok").count().filter("count >= 2").select("country", "tok", F.lit(1).alias("k"))
    tok = meta.filter("src > 1").select("entity_id", "country", F.explode(T.words(F.col("nm"))).alias("tok"))
    known = tok.join(vocab, ["country", "tok"], "left").groupBy("entity_id").agg(F.round(F.avg(F.coalesce("k", F.lit(0))), 6).alias("known"))
    return meta.join(nm, ["country", "nm"], "left").join(ad, ["country", "ad"], "left").join(known, "entity_id", "left")


def ambiguity(p: DataFrame) -> DataFrame:
    """Catalogue entries of the same name and address, ties of equal names, share of known words.  p: pairs of crowded records, of one country each."""
    p = p.withColumns({"amb_s_name": F.col("n_name_s"), "amb_q_name": F.coalesce("n_name_q", F.lit(0)), "amb_s_addr": F.col("n_addr_s"), "q_known_frac": F.col("known_q"), "name_eq": (F.col("nm_q") == F.col("nm_s")).cast("int")})
    return p.withColumn("q_name_ties", F.sum("name_eq").over(Window.partitionBy("q")))


def fuzzy(p: DataFrame) -> DataFrame:
    """The ten string similarities."""
    use = similarity
    flat = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    name, addr, raw_n, raw_a = [(F.col(f"{c}_q"), F.col(f"{c}_s")) for c in ("nm", "ad", "raw_name", "raw_addr")]
    cols = {
        "n_ratio": use("ratio", *name), "n_tset": use("token_set", *name), "n_tsort": use("token_sort", *name), "n_partial": use("partial", *name),
        "n_jw": use("jaro_winkler", flat("nm_q"), flat("nm_s")), "a_ratio": use("ratio", *addr), "a_tset": use("token_set", *addr),
        "a_partial": use("partial", *addr), "raw_n": use("ratio", *raw_n), "raw_a": use("ratio", *raw_a),
    }
    return p.withColumns({k: F.round(v, 6) for k, v in cols.items()})


def number_sets(p: DataFrame) -> DataFrame:
    both, any_ = F.size(F.array_intersect("nums_q", "nums_s")), F.size(F.array_union("nums_q", "nums_s"))
    first = lambda c: F.get(c, F.lit(0))
    p = p.withColumns({"num_inter": both, "num_union": any_, "num_first_eq": (first("nums_q") == first("nums_s")).cast("int")})
    return p.withColumns({
        "num_first_diff": clip(F.abs(first("nums_q").try_cast("bigint") - first("nums_s").try_cast("bigint"))),
        "num_jac": F.round(F.try_divide("num_inter", "num_union"), 6),
        "num_q_in_s": (F.col("num_inter") == F.size("nums_q")).cast("int"),
        "n_extra_q": F.size(F.array_except(T.words(F.col("nm_q")), T.words(F.col("nm_s")))),
        "n_extra_s": F.size(F.array_except(T.words(F.col("nm_s")), T.words(F.col("nm_q")))),
        **{f"len_{a}{b}": F.char_length(f"{c}_{b}") for a, c in (("n", "nm"), ("a", "ad")) for b in "qs"},
    })


def ties(p: DataFrame) -> DataFrame:
    """How far each similarity is below the best of its query, over all its candidates."""
    q = Window.partitionBy("q")
    p = p.withColumns({f"{c}_qgap": F.round(F.max(c).over(q) - F.col(c), 6) for c in ("raw_n", "raw_a", "n_ratio", "a_tset")})
    p = p.withColumns({f"{c}_qbest": (F.col(f"{c}_qgap") == 0).cast("int") for c in ("raw_n", "raw_a", "n_ratio", "a_tset")})
    return p.withColumns({f"{c}_qties": F.sum(f"{c}_qbest").over(q) for c in ("raw_n", "raw_a")})


def label(p: DataFrame, truth: DataFrame) -> DataFrame:
    return p.join(truth.withColumn("label", F.lit(1)), ["q", "s1"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def build(c: DataFrame, meta: DataFrame, dec: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """q, s1, the 61 features in their order, and the label where there is a truth."""
    out, words = ["q", "s1", *ALL], pair_up(c.select("q", "s1"), meta)
    p = token_extras(same_number(pair_up(context(c), meta)))
    p = p.select("q", "s1", *[x for x in ALL if x in p.columns and x not in SOURCE])  # no text goes through the joins by pair
    p = p.join(_lone_words(words), ["q", "s1"], "left").withColumn("g_uniq_x", F.coalesce("g_uniq_x", F.lit(0))).join(_decoy_weights(words, dec), ["q", "s1"], "left")
    if truth is not None:
        p, out = label(p, truth), [*out, "label"]
    # by query from here on: its windows need no exchange
    p = number_distance(number_sets(pair_up(p, crowded(meta), last="q")))
    return ties(fuzzy(ambiguity(p))).select(*out)


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


# The names of the forward columns.
BASELINE = [
    "name_lev_sim", "name_jw_sim", "name_fuzz_ratio", "name_token_sort", "name_token_set", "name_partial_ratio", "core_name_ratio", "core_name_token_sort", "compact_name_ratio",
    "consonant_skeleton_match", "consonant_skeleton_ratio", "name_token_jaccard", "name_token_overlap_count", "name_length_diff", "name_token_count_diff", "name_prefix_4_match",
    "first_token_match", "first_token_lev", "first_token_skel_match", "name_token_diff_count",
    "addr_lev_sim", "addr_jw_sim", "addr_fuzz_ratio", "addr_token_sort", "addr_token_set", "addr_token_jaccard", "addr_token_overlap_count", "addr_len_diff", "addr_missing",
    "primary_number_match", "number_jaccard", "number_overlap_count", "num_conflict", "postal_pin_match",
    "name_x_addr_sim", "name_strong_and_addr_strong", "missing_addr_strong_name", "source_is_s2",
]


def baseline(pairs: DataFrame, keys: DataFrame, records: DataFrame) -> DataFrame:
    """s1, q and the 38 features; keys from block.forward_keys."""
    addr = records.select("entity_id", T.addr_tokens(F.col("business_address")).alias("addr"))
    k = keys.join(addr, "entity_id").withColumns({"aw": T.words(F.col("addr")), "pin": F.regexp_extract_all("addr", F.lit(r"\b([0-9]{5,6})\b"), 1)})
    cols = ["clean", "compact", "core", "skeleton", "all_tokens", "nums", "addr", "aw", "pin"]
    p = pairs.join(k.select(F.col("entity_id").alias("s1"), *[F.col(c).alias(f"{c}_s") for c in cols]), "s1")
    p = p.join(k.select(F.col("entity_id").alias("q"), F.col("src").alias("q_src"), *[F.col(c).alias(f"{c}_q") for c in cols]), "q")
    use = similarity
    both = lambda c: (F.col(f"{c}_s"), F.col(f"{c}_q"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    first = [F.get(c, F.lit(0)) for c in both("all_tokens")]
    first_skel = [T.skeleton(c) for c in first]
    ts, tq = (F.array_distinct(c) for c in both("all_tokens"))
    missing = F.col("addr_q") == ""
    there = ~missing & (F.col("addr_s") != "")
    a = lambda c: F.when(there, c).otherwise(0.0)
    ns, nq = (F.array_distinct(c) for c in both("nums"))
    same_first = F.get("nums_s", F.lit(0)) == F.get("nums_q", F.lit(0))
    out = {
        "name_lev_sim": levenshtein_similarity(*both("clean")), "name_jw_sim": use("jaro_winkler", *both("clean")), "name_fuzz_ratio": use("ratio", *both("clean")),
        "name_token_sort": use("token_sort", *both("clean")), "name_token_set": use("token_set", *both("clean")), "name_partial_ratio": use("partial", *both("clean")),
        "core_name_ratio": use("ratio", *both("core")), "core_name_token_sort": use("token_sort", *both("core")), "compact_name_ratio": use("ratio", *both("compact")),
        "consonant_skeleton_match": flag((F.col("skeleton_s") == F.col("skeleton_q")) & (F.col("skeleton_s") != "")),
        "consonant_skeleton_ratio": F.when((F.col("skeleton_s") != "") & (F.col("skeleton_q") != ""), use("ratio", *both("skeleton"))).otherwise(0.0),
        "name_token_jaccard": _jaccard(ts, tq), "name_token_overlap_count": F.size(F.array_intersect(ts, tq)).cast("double"),
        "name_length_diff": F.abs(F.char_length("clean_s") - F.char_length("clean_q")).cast("double"), "name_token_count_diff": F.abs(F.size(ts) - F.size(tq)).cast("double"),
        "name_prefix_4_match": flag((F.char_length("clean_s") >= 4) & (F.char_length("clean_q") >= 4) & (F.left("clean_s", F.lit(4)) == F.left("clean_q", F.lit(4)))),
        "first_token_match": flag(first[0] == first[1]), "first_token_lev": F.coalesce(levenshtein_similarity(*first), F.lit(0.0)),
        "first_token_skel_match": flag((first_skel[0] == first_skel[1]) & (first_skel[0] != "")),
        "name_token_diff_count": (F.size(F.array_except(ts, tq)) + F.size(F.array_except(tq, ts))).cast("double"),
        "addr_lev_sim": a(levenshtein_similarity(*both("addr"))), "addr_jw_sim": a(use("jaro_winkler", *both("addr"))), "addr_fuzz_ratio": a(use("ratio", *both("addr"))),
        "addr_token_sort": a(use("token_sort", *both("addr"))), "addr_token_set": a(use("token_set", *both("addr"))), "addr_token_jaccard": a(_jaccard(*both("aw"))),
        "addr_token_overlap_count": a(F.size(F.array_intersect(*both("aw"))).cast("double")),
        "addr_len_diff": F.when(there, F.abs(F.char_length("addr_s") - F.char_length("addr_q"))).otherwise(F.char_length("addr_s")).cast("double"),
        "addr_missing": flag(missing), "primary_number_match": flag(same_first), "number_jaccard": _jaccard(ns, nq),
        "number_overlap_count": F.size(F.array_intersect(ns, nq)).cast("double"), "num_conflict": flag((F.size("nums_s") > 0) & (F.size("nums_q") > 0) & ~F.arrays_overlap("nums_s", "nums_q")),
        "postal_pin_match": flag(F.arrays_overlap("pin_s", "pin_q")), "source_is_s2": flag(F.col("q_src") == 2),
    }
    p = p.select("s1", "q", *[F.round(v, 6).alias(n) for n, v in out.items()])
    strong = F.col("name_token_sort") >= 0.85
    p = p.withColumns({
        "name_x_addr_sim": F.round(F.col("name_token_sort") * F.col("addr_token_sort"), 6),
        "name_strong_and_addr_strong": (strong & (F.col("addr_token_sort") >= 0.7)).cast("double"),
        "missing_addr_strong_name": ((F.col("addr_missing") == 1) & strong).cast("double"),
    })
    return p.select("s1", "q", *BASELINE)
