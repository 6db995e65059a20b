"""Temperature mixing of sources, in DataFrame operations only.

Source s has the share p_s of all tokens (words) and gets the weight p_s**a / sum(p**a).  The exponent
a in [0, 1] is bisected: the largest that reaches a target entropy (a share of log(number of sources)), raised,
if need be, to the least that keeps every source within a repetition limit.

A weight times the budget is a source's quota of tokens: so many whole epochs, and a last one that is cut.  An
epoch is a block permutation: a source's documents lie in hash blocks of about `block` documents, every epoch
takes the blocks in a hashed order of its own (`turn`), documents within a block in another (`in_block`).  Places
and the cut come from running sums in three levels: over stretches of blocks in an epoch's order, over the
blocks of a stretch, and over the documents of a block.  Neither a source's documents nor its blocks ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import keyed

#: Blocks in a stretch.
STRETCH = 1024
WORD = r"[^\x20\x09-\x0D]+"
ENTROPY, REPEATS, BLOCK, SEED, STEPS = 0.9, 4.0, 64, 7, 50


def weights(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0, steps: int = STEPS) -> DataFrame:
    """sources (src, tokens, docs) with weight, quota, epochs (whole ones) and rest (tokens of the cut one).

    One row for each source goes into one array, where the exponent is bisected.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("src", "tokens", "docs"))).alias("s"), F.sum("tokens").alias("total"))
    one = one.withColumn("p", F.expr("transform(filter(s, x -> x.tokens > 0), x -> cast(x.tokens as double) / cast(total as double))"))
    one = one.withColumn("goal", F.expr(f"{entropy}D * ln(cast(greatest(size(p), 1) as double))"))
    z = "aggregate(p, 0D, (acc, x) -> acc + pow(x, m.e))"
    # entropy of the weights at exponent e: ln z - e / z * sum(p**e ln p)
    reaches = f"ln({z}) - m.e / {z} * aggregate(p, 0D, (acc, x) -> acc + pow(x, m.e) * ln(x)) >= goal"
    within = f"{budget}D * pow(array_min(p), m.e - 1D) / {z} <= {repeats}D"

    def bisect(test: str, low: bool) -> str:
        """The last e of [0, 1] that passes (low), or the first."""
        up, down = ("m.e", "r.hi"), ("r.lo", "m.e")
        yes, no = (up, down) if low else (down, up)
        step = f"element_at(transform(array(named_struct('e', (r.lo + r.hi) / 2D)), m -> if({test}, named_struct('lo', {yes[0]}, 'hi', {yes[1]}), named_struct('lo', {no[0]}, 'hi', {no[1]}))), 1)"
        at = lambda e: f"element_at(transform(array(named_struct('e', {e})), m -> {test}), 1)"
        best, other = ("1D", "0D") if low else ("0D", "1D")
        loop = f"aggregate(sequence(1, {steps}), named_struct('lo', 0D, 'hi', 1D), (r, i) -> {step}, r -> r.{'lo' if low else 'hi'})"
        return f"if(size(p) = 0, 1D, if({at(best)}, {best}, if(not {at(other)}, {other}, {loop})))"

    one = one.withColumn("a", F.expr(f"greatest({bisect(reaches, True)}, {bisect(within, False)})"))
    one = one.withColumn("z", F.expr(z.replace("m.e", "a")))
    out = one.select("a", "z", "total", F.explode("s").alias("x")).select("x.*", F.col("a").alias("exponent"), F.expr("if(x.tokens > 0, round(pow(cast(x.tokens as double) / cast(total as double), a) / z, 9), 0D)").alias("weight"), "total")
    out = out.withColumn("quota", F.expr(f"cast(floor(weight * {budget}D * total) as bigint)"))
    out = out.withColumn("epochs", F.expr("if(tokens > 0, cast(quota div tokens as int), 0)"))
    return out.withColumn("rest", F.expr("if(tokens > 0, quota - epochs * tokens, 0)")).drop("total")


def _salted(*parts) -> Column:
    return F.md5(F.encode(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]), "UTF-8"))


def _number(digest: str, below: Column) -> Column:
    """0 .. below - 1, in the order of the digest."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * below / F.lit(float(2**32)))


def block_turns(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """src, block, turns: for each epoch (turn, before): the block's place and the tokens before it.

    blocks: src, block, held (tokens), n_blocks (of the source), epochs.
    """
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    each = each.withColumn("h", _salted(F.lit(str(seed)), "epoch", "src", "block"))
    each = each.withColumn("stretch", _number("h", F.ceil(F.col("n_blocks") / STRETCH)))
    sums = each.groupBy("src", "epoch", "stretch").agg(F.sum("held").alias("held"), F.count("*").alias("n"))
    ahead = Window.partitionBy("src", "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("src", "epoch", "stretch", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("first"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rank"))
    inside = Window.partitionBy("src", "epoch", "stretch").orderBy("h", "block")
    turn, before = F.row_number().over(inside), F.coalesce(F.sum("held").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.select("src", "epoch", "stretch", "block", turn.alias("turn"), before.alias("before")).join(begins, ["src", "epoch", "stretch"])
    one = F.struct("epoch", (F.col("rank") + F.col("turn")).alias("turn"), (F.col("first") + F.col("before")).alias("before"))
    return placed.groupBy("src", "block").agg(F.collect_list(one).alias("turns"))


def draw(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each time a document is drawn: rid, doc_id, source, n_tokens, weight, epoch, block, turn, in_block.

    An epoch of a source is its rows in the order of (turn, in_block), both from 1.  Rows of a null source are one source.
    Documents without words cost nothing and are drawn once with the cut epoch.  Null texts are empty.  budget is a multiple of
    the corpus' tokens.  A row that repeats another (id and text) is drawn on its own.  An empty table gives an empty table.
    """
    key = _salted(F.lit(str(seed)), "doc_id", F.md5(F.encode("text", "UTF-8")))
    rows = keyed(docs, "source").select("rid", "doc_id", "source", F.coalesce("source", F.lit("\x00")).alias("src"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"))
    sources = rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = weights(sources, entropy, repeats, budget)
    dealt = rows.join(plan.select("src", "weight", "epochs", "rest", F.ceil(F.col("docs") / block).alias("n_blocks")), "src")
    dealt = dealt.withColumn("block", _number("key", F.col("n_blocks")))
    blocks = dealt.groupBy("src", "block").agg(F.sum("n_tokens").alias("held"), F.first("n_blocks").alias("n_blocks"), F.first("epochs").alias("epochs"))
    each = dealt.join(block_turns(blocks, seed), ["src", "block"]).withColumn("t", F.explode("turns")).select("*", "t.*").drop("t", "turns")
    inside = Window.partitionBy("src", "block", "epoch").orderBy(_salted("epoch", "key"), "rid")
    each = each.withColumn("in_block", F.row_number().over(inside)).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return each.filter("epoch < epochs or upto <= rest").select("rid", "doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "turn", "in_block")


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as it is drawn."""
    drawn = draw(docs, **how).select("rid", "epoch").distinct().groupBy("rid").agg(F.count("*").alias("times"))
    # The row travels as one column, so its names can't clash.
    rows = keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "row").select("rid", "row")
    return rows.join(drawn, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: The same in SQL.  Whole words are counted by the same pattern.
MIXING_SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS src, md5(concat_ws('|', '{SEED}', doc_id, md5(coalesce(text, '')))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
sources AS (SELECT src, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM rows_ GROUP BY src),
total AS (SELECT sum(tokens)::DOUBLE AS t FROM sources),
shares AS (SELECT list(tokens::DOUBLE / t ORDER BY src) AS p, {ENTROPY}::DOUBLE * ln(count(*)::DOUBLE) AS goal FROM sources, total WHERE tokens > 0),
up AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN e ELSE lo END, CASE WHEN ok THEN hi ELSE e END FROM (
    SELECT i, lo, hi, e, ln(z) - e / z * w >= goal AS ok FROM (
      SELECT i, lo, hi, e, goal, list_sum(list_transform(p, lambda x: pow(x, e))) AS z, list_sum(list_transform(p, lambda x: pow(x, e) * ln(x))) AS w
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS e, p, goal FROM up, shares WHERE i < {STEPS})))),
down AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE e END, CASE WHEN ok THEN e ELSE hi END FROM (
    SELECT i, lo, hi, e, pow(list_min(p), e - 1) / list_sum(list_transform(p, lambda x: pow(x, e))) <= {REPEATS}::DOUBLE AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS e, p FROM down, shares WHERE i < {STEPS}))),
ends AS (
  SELECT p, CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= goal THEN 1.0::DOUBLE ELSE (SELECT lo FROM up WHERE i = {STEPS}) END AS a1,
    CASE WHEN 1 / list_min(p) / len(p) <= {REPEATS}::DOUBLE THEN 0.0::DOUBLE ELSE (SELECT hi FROM down WHERE i = {STEPS}) END AS a2 FROM shares),
fit AS (SELECT greatest(a1, a2) AS a, p FROM ends),
plan AS (
  SELECT src, tokens, docs, weight, floor(weight * t)::BIGINT AS quota, (floor(weight * t)::BIGINT // greatest(tokens, 1))::INT AS epochs FROM (
    SELECT src, tokens, docs, t, CASE WHEN tokens > 0 THEN round(pow(tokens::DOUBLE / t, a) / list_sum(list_transform(p, lambda x: pow(x, a))), 9) ELSE 0 END AS weight FROM sources, total, fit)),
dealt AS (
  SELECT r.*, weight, epochs, quota - epochs * tokens AS rest, ceil(docs / {BLOCK}.0)::BIGINT AS n_blocks, floor(('0x' || substr(key, 1, 8))::BIGINT * ceil(docs / {BLOCK}.0)::BIGINT / 4294967296.0::DOUBLE)::BIGINT AS block
  FROM rows_ r JOIN plan USING (src)),
turns AS (
  SELECT src, epoch, block, row_number() OVER w AS turn, coalesce(sum(held) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT src, block, held, unnest(range(0, epochs + 1))::INT AS epoch FROM (SELECT src, block, any_value(epochs) AS epochs, sum(n_tokens) AS held FROM dealt GROUP BY src, block))
  WINDOW w AS (PARTITION BY src, epoch ORDER BY md5('{SEED}|' || epoch || '|' || src || '|' || block), block)),
each AS (SELECT d.*, epoch, turn, before FROM dealt d JOIN turns USING (src, block))
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, epoch, block, turn, in_block FROM (
  SELECT *, (row_number() OVER w)::INT AS in_block, before + sum(n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM each WINDOW w AS (PARTITION BY src, block, epoch ORDER BY md5(epoch || '|' || key), doc_id))
WHERE epoch < epochs OR upto <= rest
"""
