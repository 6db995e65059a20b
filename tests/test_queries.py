"""The linkage queries against their SQL on the smallest tables, and what must hold of their results."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from kinmatch import __main__ as cli
from kinmatch.operators import augment, decide, features, learn
from kinmatch.plans import oracle, queries
from kinmatch.plans.queries import View
from kinmatch.sources import io

SF = "/root/testdata/sf0.001"
FAST = ["records_view", "tsv_round_trip", "name_tokens", "addr_tokens", "exact_keys", "key_pairs_top2", "tfidf_topk_join", "candidates_pruned", "feat_context", "feat_numbers", "feat_mindiff", "feat_fuzzy", "finish_tokens", "features_61", "baseline_features_38", "dp_decoder", "synth_decoys", "streaming_link", "text_lines", "expected_f", "threshold_curve", "error_taxonomy", "validator_errors", "gt_profile", "evidence_topk", "shift_number"]


def tidy(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want, got = con.sql(oracle.ORACLE[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda d: sorted(map(str, (tuple(map(tidy, r)) for r in d[sorted(d.columns)].itertuples(index=False))))
    assert rows(got) == rows(want)


def test_every_twin_has_a_query():
    assert set(oracle.ORACLE) <= set(queries.QUERIES)


def test_candidates(spark):
    v = View(spark, SF)
    cand, full = v.cand.cache(), v.full
    assert cand.groupBy("q", "s1").count().filter("count > 1").isEmpty()
    assert full.filter("rank = 0").join(cand, ["q", "s1"], "left_anti").isEmpty()
    assert cand.filter("rank > 0").groupBy("s1").count().filter("count > 30").isEmpty()


def test_results_have_every_entry_once(spark):
    out = queries.QUERIES["results_tsv_shape"](spark, SF)
    assert out.count() == out.select("source1_entity_id").distinct().count() == View(spark, SF).entries.count()
    ids = out.select(F.explode(F.split("matched_entity_ids", ",")).alias("q")).filter("q <> ''")
    assert ids.count() == ids.distinct().count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_synthetic_decoys_go_again(spark):
    v = View(spark, SF)
    assert queries.QUERIES["decoys_removed"](spark, SF).count() == v.rec.count()


def test_missing_numbers_stay_missing(spark):
    rows = spark.createDataFrame([(["5"], None, []), ([], "7", ["7"]), (["9999999"], "1", ["1"])], "nums_q array<string>, num1_s string, nums_s array<string>")
    wide = rows.select("*", *[F.lit("a").alias(c) for c in ("nm_q", "nm_s", "ad_q", "ad_s")])
    got = features.number_sets(features.number_distance(wide)).select("s_num_mindiff", "s_num_in_q", "num_first_diff").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, None), (None, None, None), (1_000_000, 0, 1_000_000)], key=str)


def test_finished_records(spark):
    rows = [("1", 1, "US", "acme praivet shop lc", "12 mn st"), ("2", 2, "US", "shop lc", ""), ("3", 2, "FR", "lc", "shop")]
    norm = spark.createDataFrame(rows, "entity_id string, src int, country string, nm string, ad string")
    spell = spark.createDataFrame([("name", "praivet", "private"), ("addr", "mn", "main")], "kind string, bad string, good string")
    filler = spark.createDataFrame([("name", "US", "shop"), ("addr", "FR", "shop")], "kind string, country string, tok string")
    got = {r.entity_id: (r.nm, r.ad, r.spelt) for r in learn.finished(norm, spell, filler).collect()}
    assert got == {"1": ("acme", "12 main st", "acme private shop lc"), "2": ("shop", "", "shop lc"), "3": ("lc", "shop", "lc")}


def test_draws_with_replacement(spark):
    rows = spark.range(20000).withColumn("k", F.col("id").cast("string"))
    drawn = augment.resample(rows, 1.5, "s", "k")
    assert abs(drawn.count() - 30000) < 900
    assert drawn.groupBy("k", "copy").count().filter("count > 1").isEmpty()
    assert abs(augment.sample_fraction(rows, 0.3, "s", "k").count() - 6000) < 300


def test_long_lists_take_the_closed_form(spark):
    pairs = spark.createDataFrame([(f"q{i}", "a", 0.9 - i / 100) for i in range(30)] + [("x", "b", 0.9)], "q string, s1 string, p double")
    short = decide.decode_entries(pairs, longest=5)
    assert {r.q for r in short.filter("s1 = 'a'").collect()} == {r.q for r in decide.expected_f(pairs).filter("s1 = 'a'").collect()}
    assert short.filter("s1 = 'b'").count() == 1


def test_command_lines(spark, tmp_path, capsys):
    v, paths = View(spark, SF), []
    for src in (1, 2, 3):
        paths.append(str(tmp_path / f"s{src}"))
        io.write_tsv(v.rec.filter(F.col("src") == src).select("entity_id", "business_name", "business_address", "country"), paths[-1])
    io.write_lists(v.entries, v.gt, "matched_entity_ids", str(tmp_path / "truth"))
    assert cli.main(["link", "--sources", *paths, "--truth", str(tmp_path / "truth"), "--out", str(tmp_path / "out")], spark) == 0
    assert io.read_json(spark, str(tmp_path / "out" / "report"))["entries"] > 0
    assert cli.main(["validate", "--result", str(tmp_path / "out" / "results"), "--entries", paths[0]], spark) == 0
    bad = tmp_path / "bad"
    bad.write_text("source1_entity_id,matched_entity_ids\nS1-0 S2-1\n")
    assert cli.main(["validate", "--result", str(bad), "--entries", paths[0]], spark) == 1
    assert "comma_header" in capsys.readouterr().out


def test_nearest_is_the_join_of_all_terms(spark, monkeypatch):
    """Cells of a few vectors, ties at every cut, queries without any known term: as from the join of all terms."""
    import random

    from kinmatch.config import SMALL
    from kinmatch.operators import block

    monkeypatch.setattr(block, "BLOCK", 20)
    monkeypatch.setattr(block, "CHUNK", 15)
    rng, rows = random.Random(7), []
    for i in range(160):
        src, kin = i % 3 + 1, [rng.randrange(12) for _ in range(6)]
        for space, ts in (("n", set(kin[:3])), ("a", set(kin[3:]))):
            rows += [(f"S{src}-{i}", src, "xy"[i % 2] if i < 150 else "z", space, f"t{x}", 1 / math.sqrt(len(ts))) for x in ts]
    w = spark.createDataFrame(rows, "entity_id string, src int, country string, space string, term string, w double").cache()
    got = block.nearest(w, SMALL)
    con, _ = duckdb.connect(), w.toPandas()
    con.register("wt", _)
    n, a = (f"round(coalesce(sum(q.w * s.w) FILTER (space = '{c}'), 0), 6)" for c in "na")
    want = con.sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) AS r FROM (SELECT *, round({SMALL.name_weight}::DOUBLE * n + {1 - SMALL.name_weight}::DOUBLE * a, 6) AS score FROM (SELECT q.entity_id AS q, s.entity_id AS s1, {n} AS n, {a} AS a FROM wt q JOIN wt s USING (country, space, term) WHERE q.src > 1 AND s.src = 1 GROUP BY ALL))) WHERE r <= {SMALL.top_k}").fetchall()
    assert sorted((x.q, x.s1, x.name_cos, x.addr_cos, x.score) for x in got.collect()) == sorted((q, s, n, a, p) for q, s, n, a, p, _ in want)


def test_tsv_keeps_empty_and_missing_apart(spark, tmp_path):
    rows = [("S1-0", "a", "", "en"), ("S1-3", "", None, "de"), ("S1-6", None, "1 b", None), ("S1-9", "\\N", "\\\\N", ""), ("S1-12", " c", "N", "\\")]
    rec = spark.createDataFrame(rows, io.RECORD)
    io.write_records(rec, str(tmp_path / "1"))
    assert sorted(map(tuple, io.read_records(spark, str(tmp_path / "1")).collect())) == sorted(rows)


@pytest.mark.parametrize("name", ["evidence_topk", "shared_key_top20"])
def test_kinds_of_records_meet(spark, tmp_path, name):
    """Copies of texts with other lengths, more of them than places: as in SQL."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    copies = d.filter("doc_id % 10 = 0").crossJoin(spark.range(9).withColumnRenamed("id", "k"))
    copies = copies.select((F.col("doc_id") + 1000 * (F.col("k") + 1) + F.col("k")).alias("doc_id"), "text", "lang", "source", (F.col("n_chars") + F.col("k") % 2).alias("n_chars"))
    d.unionByName(copies).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want, got = con.sql(oracle.ORACLE[name]).df(), queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    rows = lambda d: sorted(map(str, (tuple(map(tidy, r)) for r in d[sorted(d.columns)].itertuples(index=False))))
    assert rows(got) == rows(want)


def test_bundled_keys_meet_once(spark):
    """Records alike meet once, by all their keys at once."""
    from kinmatch.operators import block

    rows = [(f"S{i % 3 + 1}-{i}", i % 3 + 1, "en", 1, c, f"{c} x") for i in range(90) for c in ("clean", "compact", "core")]
    members, kinds = block.alike(spark.createDataFrame(rows, "entity_id string, src int, country string, tier int, channel string, key string"))
    assert members.count() == 90 and sorted((r.q_src, r.n) for r in block.meet_kinds(kinds).collect()) == [(2, 3), (3, 3)]


def test_texts_of_pairs_travel_once(spark):
    """Where all features are built, one exchange of pairs carries raw texts, and that of one side only."""
    import re

    cand = spark.createDataFrame([], "q string, s1 string, score double, name_cos double, addr_cos double, via_key int, rank int")
    norm = spark.createDataFrame([], "entity_id string, src int, country string, business_name string, business_address string, nm string, ad string, spelt string")
    dec, truth = spark.createDataFrame([], "country string, tok string, dec double"), spark.createDataFrame([], "s1 string, q string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.debug.maxToStringFields": "1000", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        out = features.build(cand, features.metadata(norm), dec, truth)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    sent = [set(re.findall(r"(\w+)#\d+", x)) for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]
    wide = [x & {"raw_name_q", "raw_addr_q", "raw_name_s", "raw_addr_s"} for x in sent if {"q", "s1"} <= x]
    assert [x for x in wide if x] == [{"raw_name_s", "raw_addr_s"}]
