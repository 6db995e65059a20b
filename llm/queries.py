"""The queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from llm.bpe import bpe_round_trip, id_digest, token_counts
from llm.covertree import link_embeddings
from llm.minhash import fingerprint_neighbours
from llm.mixing import MIXING_SQL, draw
from llm.simhash import dedup_simhash
from llm.substrings import dedup_substrings
from llm.suffixes import dedup_suffixes
from llm.toxicity import score_toxicity
from llm.warc import capture_index


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_substring_dedup(spark, sf_dir):
    return dedup_substrings(spark, _table(spark, sf_dir, "documents")).drop("kept")


def op1_bpe_round_trip(spark, sf_dir):
    out = bpe_round_trip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_order_minhash(spark, sf_dir):
    return fingerprint_neighbours(spark, _table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return link_embeddings(spark, _table(spark, sf_dir, "embeddings"))


def op4_temperature_mixing(spark, sf_dir):
    return draw(_table(spark, sf_dir, "documents")).drop("rid")


def op5_toxicity(spark, sf_dir):
    return score_toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir):
    return token_counts(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_suffix_dedup(spark, sf_dir):
    return dedup_suffixes(spark, _table(spark, sf_dir, "documents")).drop("kept")


def op9_warc_index(spark, sf_dir):
    return capture_index(spark, _table(spark, sf_dir, "pages")).drop("archive", "offset")


def op10_simhash_dedup(spark, sf_dir):
    return dedup_simhash(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_order_minhash, op3_embedding_dedup, op4_temperature_mixing, op5_toxicity, op6_token_counts, op7_suffix_dedup, op8_substring_dedup, op9_warc_index, op10_simhash_dedup)}

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""

#: A window's first occurrence stays; the words under any later one go.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

#: Of equal payloads of 1000 bytes or more the last is the response.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, lower(coalesce(url, '')) AS u FROM pages),
x AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last, strlen(h) AS n FROM p),
parts AS (SELECT *, regexp_extract(u, '^https?://(?:www[0-9]*\.)?([^/?#:]*)', 1) AS host, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS query FROM x)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND last > page_id THEN last END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
  strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM parts
"""

ORACLE = {"op3_embedding_dedup": EMBEDDING_SQL, "op8_substring_dedup": SUBSTRING_SQL, "op9_warc_index": WARC_SQL, "op4_temperature_mixing": MIXING_SQL}
