"""One query for each operator, over the linkage view of documents (and other tables where an operator is about them).

Thresholds for millions of records are parameters; the view has thousands, so the queries pass config.SMALL.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.config import SMALL
from kinmatch.functions import similarity as K
from kinmatch.functions import text as T
from kinmatch.operators import augment, block, decide, features, learn, model, quality, stack
from kinmatch.sources import fixture, io
from kinmatch.plans import flow
from kinmatch.streaming import link

QUERIES = {}
GRID = [round(0.1 + 0.05 * i, 2) for i in range(18)]
THRESHOLD = 0.4
ALPHAS = [1.0, 0.0, 0.7, 0.5, 0.3]


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(View(spark, sf_dir))
    return f


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class View:
    """The frames that queries start from, each a lazy plan: of the linkage view over documents, or of records and truth (s1, q) given."""

    def __init__(self, spark: SparkSession, sf_dir: str = "", records: DataFrame | None = None, truth: DataFrame | None = None):
        self.spark, self.dir = spark, sf_dir
        if records is not None:
            self.rec = records
        if truth is not None:
            self.gt = truth

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @functools.cached_property
    def rec(self):
        return fixture.records(self.spark, self.dir)

    @functools.cached_property
    def base(self):
        """Tokens, written once: the lexicons, the truth and the finished records start from them."""
        return io.stage(fixture.normalised(self.rec), scratch(self.spark, "tokens"))

    @functools.cached_property
    def gt(self):
        return fixture.truth(self.base)

    @functools.cached_property
    def spellings(self):
        """kind, bad, good, n, nt of both maps."""
        one = lambda pairs, c, kind: learn.spelling_map(learn.pair_tokens(pairs, self.base, c), SMALL).withColumn("kind", F.lit(kind))
        return one(truth_by_address(self), "nm", "name").unionByName(one(self.gt, "ad", "addr"))

    @functools.cached_property
    def tokens(self):
        return learn.respelt(self.base, self.spellings)

    def fill(self, kind):
        lift = SMALL.noise_lift_name if kind == "name" else SMALL.noise_lift_addr
        return learn.filler_words(self.tokens, self.base, kind, lift, SMALL.noise_share)

    @functools.cached_property
    def norm(self):
        """Finished records, written once."""
        fillers = [self.fill(kind).withColumn("kind", F.lit(kind)) for kind in ("name", "addr")]
        return io.stage(learn.finished(self.base, self.spellings, fillers[0].unionByName(fillers[1])), scratch(self.spark, "norm"))

    @functools.cached_property
    def entries(self):
        return self.norm.filter("src = 1").select(F.col("entity_id").alias("s1"), "country")

    @functools.cached_property
    def wide(self):
        return io.lists(self.entries, self.gt, "matched_entity_ids")

    @functools.cached_property
    def keys(self):
        return block.exact_keys(self.norm)

    @functools.cached_property
    def keyed(self):
        return block.key_pairs(self.keys, SMALL)

    @functools.cached_property
    def tf(self):
        return block.terms(self.norm)

    @functools.cached_property
    def weights(self):
        """Written once: both kinds of candidates start from them."""
        return io.stage(block.weights(self.tf, block.vocabulary(self.tf, self.norm, SMALL)), scratch(self.spark, "weights"))

    @functools.cached_property
    def top(self):
        """Written once: candidates take them as they are and keep them apart from those that only a key found."""
        return io.stage(block.nearest(self.weights, SMALL), scratch(self.spark, "top"))

    @functools.cached_property
    def full(self):
        """All candidates, written once: what follows reads them several times."""
        both = block.key_union(self.keyed)
        return io.stage(block.assemble(self.top, both, block.key_only(both, self.top, self.weights, SMALL)), scratch(self.spark, "candidates"))

    @functools.cached_property
    def cand(self):
        return block.prune(self.full, SMALL)

    @functools.cached_property
    def meta(self):
        return features.metadata(self.norm)

    @functools.cached_property
    def pairs(self):
        """Candidates with their metadata."""
        return features.pair_up(self.cand, self.meta)

    @functools.cached_property
    def scored(self):
        """The score as a probability."""
        return self.cand.select("q", "s1", F.col("score").alias("p"))

    @functools.cached_property
    def dec(self):
        return learn.decoy_words(self.full, self.meta, SMALL)

    @functools.cached_property
    def matrix(self):
        """The labelled features with their fold, written once: every fit reads them several times."""
        f = features.build(self.cand, self.meta, self.dec, truth=self.gt).withColumn("fold", model.id_fold(F.col("s1")))
        return io.stage(f, scratch(self.spark, "matrix"))

    @functools.cached_property
    def fwd(self):
        return block.forward_keys(self.rec)

    @functools.cached_property
    def channel_pairs(self):
        return block.meet(block.channels(self.fwd), ["country", "channel", "key"], 25)

    @functools.cached_property
    def tier_keys(self):
        """Written once: both sides and both kinds of tokens start from them."""
        fwd = io.stage(self.fwd, scratch(self.spark, "forward"))
        return io.stage(block.tier_channels(fwd), scratch(self.spark, "tiers"))

    @functools.cached_property
    def tier_pairs(self):
        return block.meet(block.tier_channels(self.fwd), ["country", "tier", "channel", "key"])


# Sources, projections, sinks


@query
def records_view(v):
    return v.rec


@query
def tsv_round_trip(v):
    """Writes the records as TSV by source and reads them back."""
    root = scratch(v.spark, "tsv")
    for src in (1, 2, 3):
        io.write_records(v.rec.filter(F.col("src") == src), f"{root}/{src}")
    return io.read_sources(v.spark, {src: f"{root}/{src}" for src in (1, 2, 3)}, io.read_records)


@query
def ground_truth_long(v):
    return io.read_truth(v.wide.select("source1_entity_id", F.nullif("matched_entity_ids", F.lit("")).alias("matched_entity_ids")))


@query
def truth_pairs_assembly(v):
    """True pairs with the texts of both sides."""
    side = lambda key, end: v.base.select(F.col("entity_id").alias(key), F.col("nm").alias(f"nm_{end}"), F.col("ad").alias(f"ad_{end}"))
    return v.gt.join(side("s1", "s"), "s1").join(side("q", "q"), "q")


@query
def results_tsv_shape(v):
    return io.lists(v.entries, decide.assign(v.scored, THRESHOLD), "matched_entity_ids")


@query
def candidates_tsv_shape(v):
    return io.lists(v.entries, v.cand, "candidate_entity_ids")


@query
def results_tsv_round_trip(v):
    path = scratch(v.spark, "results")
    io.write_lists(v.entries, decide.assign(v.scored, THRESHOLD), "matched_entity_ids", path)
    return io.read_tsv(v.spark, path, io.TRUTH)


@query
def text_lines(v):
    """A file with a byte-order mark and carriage returns, read line by line."""
    path = scratch(v.spark, "lines")
    marked = F.concat(F.lit("\ufeff"), F.col("entity_id"), F.lit("\t"), F.col("business_name"), F.lit("\r"))
    v.rec.select(marked.alias("value")).write.text(path)
    return io.read_lines(v.spark, path)


@query
def country_partitions(v):
    """A table by partition of country, of which two are read."""
    path = scratch(v.spark, "countries")
    v.norm.write.partitionBy("country").parquet(path)
    return io.read_countries(v.spark, path, ["de", "fr"]).select("entity_id", "country", "nm")


@query
def staged_norm(v):
    """Normalised records written once and reread by every later stage."""
    path = scratch(v.spark, "stage")
    io.stage(v.norm, path)
    return io.stage(v.norm, path).select("entity_id", "nm", "ad")


@query
def float_matrix(v):
    """Features as single-precision columns, written and read back."""
    path = scratch(v.spark, "matrix")
    io.write_matrix(features.context(v.cand).select("q", "s1", "score", "gap", "margin"), ["score", "gap", "margin"], path)
    return io.read_matrix(v.spark, path, ["q", "s1", "score", "margin"])


@query
def error_sample(v):
    """The errors as a TSV, read back."""
    path = scratch(v.spark, "errors")
    io.write_tsv(decide.errors(v.scored, decide.assign(v.scored, THRESHOLD), v.gt).select("kind", "p", "s1", "q"), path)
    return io.read_tsv(v.spark, path, "kind string, p double, s1 string, q string")


@query
def json_artefacts(v):
    """The mined lexicons as a JSON artefact, written, read back and laid out again.  They hold only what passed a support threshold."""
    path = scratch(v.spark, "noise")
    noise: dict = {}
    for r in v.fill("name").collect():
        noise.setdefault(r["country"], []).append(r["tok"])
    io.write_json(v.spark, noise, path)
    return v.spark.createDataFrame([(c, t) for c, words in io.read_json(v.spark, path).items() for t in words], "country string, tok string")


@query
def experiment_log(v):
    """Two runs, logged with their verdicts; the log is read back."""
    path = scratch(v.spark, "log")
    f = [decide.macro_f05(decide.assign(v.scored, t), v.gt, v.entries).first()["f05"] for t in (THRESHOLD, 0.6)]
    for i, x in enumerate(f):
        io.append_log(v.spark, path, {"run": i, "f05": x}, i == 0 or x > f[i - 1])
    return v.spark.read.schema("result string, verdict string").json(path)


@query
def frequent_words(v):
    """The ten most frequent name words of each country."""
    from pyspark.sql import Window

    n = v.norm.select("country", F.explode(T.words(F.col("nm"))).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "tok"))
    return n.withColumn("place", place).filter("place <= 10")


# Text


@query
def name_tokens(v):
    return v.base.select("entity_id", "nm")


@query
def addr_tokens(v):
    return v.base.select("entity_id", "ad")


@query
def metadata_projection(v):
    return v.meta.select("entity_id", "raw_name", "raw_addr", "translit", F.array_join("nums", ",").alias("nums"), "num1")


@query
def full_names(v):
    return v.meta.select("entity_id", F.array_join("full", " ").alias("full_name"))


@query
def consonant_skeleton(v):
    return v.rec.select("entity_id", T.skeleton(T.plain(F.col("business_name"))).alias("skeleton"))


@query
def transliterated(v):
    return v.rec.select("entity_id", T.plain(F.col("business_name")).alias("name"))


@query
def baseline_keys_fast(v):
    return v.fwd.select("entity_id", "clean", "compact", "core", F.array_join("tokens", " ").alias("tokens"), "num", F.array_join("addr_tokens", " ").alias("addr_tokens"), "skeleton")


@query
def learned_map(v):
    return v.spellings


def truth_by_address(v):
    """Pairs by equal first two address words and country: names may differ."""
    key = F.concat_ws(" ", F.slice(T.words(F.col("ad")), 2, 2))
    first = v.base.filter("src = 1 and ad <> ''").groupBy("country", key.alias("k")).agg(F.min("entity_id").alias("s1"))
    return v.base.filter("src > 1").select("country", key.alias("k"), F.col("entity_id").alias("q")).join(first, ["country", "k"]).select("s1", "q")


@query
def filler_lexicon(v):
    return v.fill("name")


@query
def filler_lexicon_addr(v):
    return v.fill("addr")


@query
def decoy_lexicon(v):
    return v.dec.withColumn("dec", F.round("dec", 6))


def _extras(v):
    """country, extra words of the query, and whether the pair is false, of first candidates."""
    p = features.pair_up(v.full.filter("rank = 0"), v.meta)
    return features.label(p, v.gt).select("country", F.array_except("full_q", "full_s").alias("extra"), (F.col("label") == 0).alias("false"))


@query
def marker_words(v):
    return learn.marker_words(_extras(v), SMALL).withColumn("share", F.round("share", 6))


@query
def finish_tokens(v):
    """Names and addresses through the mined spellings and without fillers."""
    return v.norm.select("entity_id", "nm", "ad", "spelt")


# Candidates


@query
def exact_keys(v):
    return v.keys.select("entity_id", "bit", "key")


@query
def hub_guard(v):
    return block.catalogue_keys(v.keys, 2).select("entity_id", "bit", "key")


@query
def key_pairs_top2(v):
    return v.keyed


@query
def key_bitmask_union(v):
    return block.key_union(v.keyed)


def _rounded(v, space):
    return v.weights.filter(F.col("space") == space).select("entity_id", "term", F.round("w", 6).alias("w"))


@query
def tfidf_name_terms(v):
    return _rounded(v, "n")


@query
def tfidf_addr_terms(v):
    return _rounded(v, "a")


@query
def tfidf_vocabulary(v):
    return block.vocabulary(v.tf, v.norm, SMALL).withColumn("idf", F.round("idf", 6))


@query
def tfidf_topk_join(v):
    return v.top


@query
def key_only_pairs(v):
    return block.key_only(block.key_union(v.keyed), v.top, v.weights, SMALL)


@query
def candidates_full(v):
    return v.full


@query
def candidates_pruned(v):
    return v.cand


@query
def candidate_volume(v):
    return block.volume(v.cand)


@query
def blocking_recall(v):
    return block.recall(v.cand, v.gt)


@query
def baseline_channels(v):
    return v.channel_pairs.select("channel", "s1", "q").distinct()


@query
def channel_report(v):
    return block.channel_report(v.channel_pairs, v.gt)


@query
def fifo_cap(v):
    return block.fifo_cap(v.channel_pairs, 3)


@query
def tier_quota(v):
    return block.tier_quota(v.tier_pairs, 3, 2)


@query
def evidence_topk(v):
    return block.evidence(v.tier_keys, v.fwd, 3)


@query
def shared_key_top20(v):
    return block.shared_keys(v.tier_keys, 20)


# Pair features


@query
def feat_context(v):
    return features.context(v.cand).select("q", "s1", *features.CONTEXT)


@query
def feat_tokens(v):
    return features.token_extras(v.pairs).select("q", "s1", "n_xq", "n_xs")


@query
def feat_same_num(v):
    return features.same_number(v.pairs).select("q", "s1", "g_same_num", "g_same_num_frac")


@query
def feat_decoy(v):
    return features.decoys(v.pairs, v.dec).select("q", "s1", "dec_max", "dec_sum")


@query
def feat_mindiff(v):
    return features.number_distance(v.pairs).select("q", "s1", "s_num_mindiff", "s_num_in_q")


@query
def feat_uniq(v):
    return features.unique_words(v.pairs).select("q", "s1", "g_uniq_x")


@query
def feat_ambiguity(v):
    return features.ambiguity(features.pair_up(v.cand, features.crowded(v.meta))).select("q", "s1", *features.NAMES)


@query
def feat_numbers(v):
    return features.number_sets(v.pairs).select("q", "s1", "src", "translit", *features.NUMBERS)


@query
def feat_fuzzy(v):
    return features.fuzzy(v.pairs).select("q", "s1", *features.FUZZY)


@query
def feat_jaro_winkler(v):
    return v.pairs.select("q", "s1", F.round(K.similarity("jaro_winkler", F.col("nm_q"), F.col("nm_s")), 6).alias("jw"))


@query
def feat_tiebreaks(v):
    return features.ties(features.fuzzy(v.pairs)).select("q", "s1", *features.TIES)


@query
def feat_label(v):
    return features.label(v.cand, v.gt).select("q", "s1", "label")


@query
def features_61(v):
    return features.build(v.cand, v.meta, v.dec, truth=v.gt)


@query
def baseline_features_38(v):
    return features.baseline(v.channel_pairs.select("s1", "q").distinct(), v.fwd, v.rec)


# Decisions


@query
def assign_argmax(v):
    return decide.assign(v.scored, THRESHOLD)


@query
def expected_f(v):
    return decide.expected_f(v.scored)


@query
def decide_rules(v):
    """Both rules, each under its name."""
    one = lambda rule: decide.decide(v.scored, rule, THRESHOLD).select(F.lit(rule).alias("rule"), "q", "s1")
    return one("threshold").unionByName(one("expected_f"))


@query
def f05_macro(v):
    return decide.macro_f05(decide.assign(v.scored, THRESHOLD), v.gt, v.entries)


@query
def f05_breakdown(v):
    return decide.breakdown(decide.assign(v.scored, THRESHOLD), v.gt, v.entries)


@query
def threshold_curve(v):
    return decide.threshold_curve(v.scored, v.gt, v.entries, GRID)


@query
def best_threshold(v):
    return decide.best_threshold(decide.threshold_curve(v.scored, v.gt, v.entries, GRID))


def _number(c):
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("bigint")


@query
def sim_dense(v):
    """The curve once half of the true observations are gone."""
    pairs, truth = decide.thin_out(v.scored, v.gt, _number("q") * 7919 % 1000 < 500)
    return decide.threshold_curve(pairs, truth, v.entries, GRID)


@query
def error_taxonomy(v):
    return decide.errors(v.scored, decide.assign(v.scored, THRESHOLD), v.gt)


@query
def unseen_country_override(v):
    return decide.override_unseen(decide.assign(v.scored, THRESHOLD), v.scored, v.entries.filter("country = 'fr'"), 0.7)


@query
def pseudo_labels(v):
    return decide.pseudo_labels(v.scored, v.entries.filter("country = 'fr'"), 0.7, 0.1)


@query
def country_report(v):
    return decide.country_report(v.entries, v.cand, decide.assign(v.scored, THRESHOLD))


@query
def margin_threshold(v):
    return decide.margin_assign(v.scored.join(v.meta.select(F.col("entity_id").alias("q"), "src"), "q"), {2: 0.5, 3: 0.35}, 0.05)


@query
def number_penalty(v):
    p = v.pairs.select("q", "s1", F.col("score").alias("p"), F.col("num1_q").alias("num_q"), F.col("num1_s").alias("num_s"))
    return decide.number_penalty(p).select("q", "s1", "p")


@query
def brier(v):
    return decide.brier(features.label(v.scored, v.gt))


@query
def dp_decoder(v):
    return decide.decode_entries(v.scored)


# Checks and profiles


def _lines(v):
    """A result file with faults, one of each kind at rows that the ids decide."""
    w = v.wide.withColumn("i", _number("source1_entity_id"))
    m = F.col("matched_entity_ids")
    m = F.when(F.col("i") % 7 == 0, F.concat(m, F.lit(",S2-1,S2-1"))).when(F.col("i") % 7 == 1, F.concat(F.lit("S1-5, "), m)).when(F.col("i") % 7 == 2, F.lit("S2-1,,nan")).when(F.col("i") % 7 == 3, F.lit('"X-9"')).otherwise(m)
    line = F.when(F.col("i") % 11 == 0, F.concat("source1_entity_id", F.lit(" "), m)).when(F.col("i") % 11 == 1, F.concat("source1_entity_id", F.lit("\t"), m, F.lit("\tx"))).when(F.col("i") % 11 == 2, F.concat(F.lit("\t"), m)).otherwise(F.concat("source1_entity_id", F.lit("\t"), m))
    rows = w.select((F.col("i") + 1).alias("n"), line.alias("line"))
    again = rows.filter("n % 5 = 1").select((F.col("n") + 1_000_000).alias("n"), "line")
    head = v.spark.createDataFrame([(0, "source1_entity_id,matched_entity_ids")], "n long, line string")
    return head.unionByName(rows).unionByName(again)


@query
def validator_header(v):
    return quality.header_checks(_lines(v), ["source1_entity_id", "matched_entity_ids"])


@query
def validator_errors(v):
    return quality.row_errors(_lines(v))


@query
def validator_messages(v):
    return quality.messages(quality.row_errors(_lines(v)), "error", "n")


@query
def completeness(v):
    listed = decide.assign(v.scored, THRESHOLD).select("s1").distinct().unionByName(v.entries.select(F.concat("s1", F.lit("x")).alias("s1")).filter("s1 like '%1x'"))
    return quality.completeness(listed, v.entries)


@query
def unknown_ids(v):
    """Candidates that aren't among the observations of one source."""
    return quality.unknown_ids(v.cand, v.rec.filter("src = 2").select(F.col("entity_id").alias("q")))


@query
def validator_warnings(v):
    return quality.warnings(v.top.filter("score > 0.3").select("s1", "q"), v.cand.select("s1", "q"), v.entries)


@query
def target_collisions(v):
    m = v.cand.groupBy("q").agg(F.countDistinct("s1").alias("n_s1"))
    return m.filter("n_s1 > 1")


@query
def gt_profile(v):
    return quality.truth_profile(v.wide)


@query
def source_profile(v):
    return quality.source_profile(v.rec)


@query
def country_profile(v):
    return quality.country_profile(v.rec)


@query
def pair_samples(v):
    return quality.pair_samples(v.gt, v.rec, 20)


@query
def stratified_split(v):
    links = v.gt.groupBy("s1").agg(F.count("*").alias("links"))
    e = v.entries.join(links, "s1", "left").fillna(0, ["links"]).withColumn("turn", _number("s1") * 7919 % 10007)
    return quality.strata_split(e, "turn", 0.25)


@query
def group_folds(v):
    return v.cand.select("q", "s1", model.id_fold(F.col("s1"), 5, 7919, 3).alias("fold"))


@query
def seeded_sample(v):
    """As many records as asked for, in a hashed order."""
    return v.rec.orderBy(_number("entity_id") * 7919 % 10007, "entity_id").limit(100).select("entity_id")


@query
def sample_fraction(v):
    return augment.sample_fraction(v.rec, 0.3, "share", "entity_id").select("entity_id")


@query
def sample_with_replacement(v):
    return augment.resample(v.rec, 0.8, "again", "entity_id").select("entity_id", "copy")


# Stacking and augmentation


@query
def stack_q_context(v):
    return stack.query_context(v.scored)


@query
def stack_s_context(v):
    return stack.entry_context(v.scored)


@query
def sibling_pairs(v):
    return stack.sibling_likeness(v.scored, v.meta)


@query
def shift_number(v):
    return v.rec.select("entity_id", augment.shift_number(F.col("business_address"), _number("entity_id") * 7919 % 10007).alias("shifted"))


def _decoys(v):
    q = v.rec.filter("src > 1").select(F.col("entity_id").alias("q"), "src", "country", "business_name", "business_address")
    quota = int(1.2 * v.entries.count())
    return augment.make_decoys(q.join(v.gt, "q", "left_semi"), q.join(v.gt, "q", "left_anti"), learn.marker_words(_extras(v), SMALL), quota)


@query
def synth_decoys(v):
    return _decoys(v)


@query
def decoys_removed(v):
    """Records with decoys put in and taken out."""
    cols = ["entity_id", "src", "country", "business_name", "business_address"]
    return augment.without_decoys(v.rec.select(cols).unionByName(_decoys(v).select(cols)))


# Models


def _training(v):
    return v.matrix


COLUMNS = features.ALL


@query
def linked_end_to_end(v):
    """Records to results: the whole flow with a model, and what its held-out fold says."""
    return flow.run(v).report


@query
def gbt_scores(v):
    f = _training(v).withColumn("late", F.col("fold") == 1)
    m = model.fit(f.filter("fold > 0"), COLUMNS, valid="late", maxIter=10, maxDepth=3)
    return model.score(m, f.filter("fold = 0"), COLUMNS).select("q", "s1", "label", "p")


@query
def feature_gain(v):
    m = model.fit(_training(v), COLUMNS, maxIter=5, maxDepth=3)
    return v.spark.createDataFrame(model.gain(m, COLUMNS), "feature string, gain double")


@query
def model_round_trip(v):
    """A model saved, loaded and used."""
    f, path = _training(v), scratch(v.spark, "model")
    model.fit(f, COLUMNS, maxIter=3, maxDepth=3).save(path)
    return model.score(model.PipelineModel.load(path), f, COLUMNS).select("q", "s1", "label", "p")


@query
def ensemble_grid(v):
    """F0.5 of blends of two models over weights and thresholds, scored out of sample."""
    f = _training(v)
    train, test = f.filter("fold > 0"), f.filter("fold = 0")
    a = model.score(model.fit(train, COLUMNS, maxIter=5, maxDepth=3), test, COLUMNS, "p_a")
    b = model.score(model.fit(train, COLUMNS, "forest", numTrees=5, maxDepth=4), test, COLUMNS, "p_b").select("q", "s1", "p_b")
    blends = model.blend(a.join(b, ["q", "s1"]), ALPHAS)
    held = test.select("s1").distinct()
    tag = lambda d, c: d.withColumn(c, F.concat_ws("~", F.col("alpha").cast("string"), c))
    alphas = F.explode(F.array(*map(F.lit, ALPHAS)))
    # ids that carry the alpha: one pass for all of them
    pairs = tag(tag(blends.select("alpha", "q", "s1", "p"), "q"), "s1").drop("alpha")
    truth = tag(tag(v.gt.join(held, "s1", "left_semi").withColumn("alpha", alphas), "q"), "s1").drop("alpha")
    curve = decide.per_threshold(pairs, truth, tag(held.withColumn("alpha", alphas), "s1").drop("alpha"), GRID)
    return curve.groupBy(F.substring_index("s1", "~", 1).cast("double").alias("alpha"), "t").agg(F.round(F.avg("f"), 6).alias("f05"))


@query
def two_step_scores(v):
    f = _training(v)
    a, b = model.fit(f, COLUMNS, maxIter=3, maxDepth=3), model.fit(f, COLUMNS, "forest", numTrees=5, maxDepth=4)
    return model.two_step(a, b, f, COLUMNS, 0.5, 0.1).select("q", "s1", "p_a", "p_b", "p")


@query
def oof_scores(v):
    return model.out_of_fold(_training(v).drop("fold"), COLUMNS, 3, maxIter=3, maxDepth=3).select("q", "s1", "label", "p")


@query
def stage2_scores(v):
    """A second model over the first features and the context of out-of-fold scores."""
    f = _training(v).drop("fold")
    oof = model.out_of_fold(f, COLUMNS, 3, maxIter=3, maxDepth=3).select("q", "s1", "p")
    ctx = stack.contexts(oof, v.meta).drop("sib").withColumnRenamed("p", "p1")
    both = f.join(ctx, ["q", "s1"])
    cols = [c for c in both.columns if c not in ("q", "s1", "label")]
    return model.score(model.fit(both, cols, maxIter=3, maxDepth=3), both, cols).select("q", "s1", "label", "p")


@query
def isotonic_calibration(v):
    s = features.label(v.scored, v.gt)
    return model.calibrated(model.calibrate(s), s.withColumn("label", F.col("label").cast("double"))).select("q", "s1", F.round("calibrated", 6).alias("calibrated"))


@query
def streaming_link(v):
    """Observations as a stream against the static catalogue."""
    source, out = scratch(v.spark, "observations"), scratch(v.spark, "links")
    v.rec.filter("src > 1").write.parquet(source)
    stream = v.spark.readStream.schema(v.rec.schema).parquet(source)
    link.write_links(link.link_stream(stream, v.rec.filter("src = 1")), out, scratch(v.spark, "state"))
    return v.spark.read.parquet(out)
