"""SQL twins of the queries, written for DuckDB from the definitions and not from the DataFrame code.

Each is one statement: a chain of common tables, of which a statement takes those that it needs.
"""

from __future__ import annotations

import re

from kinmatch import config as C
from kinmatch.config import SMALL as S
from kinmatch.operators.features import ALL
from kinmatch.plans.queries import GRID, THRESHOLD
from kinmatch.sources.fixture import FOREIGN

_nulls = ", ".join(f"'{x}'" for x in C.NULL_LITERALS)
_stop = ", ".join(f"'{x}'" for x in sorted({re.sub(r"([a-z])\1+", r"\1", w) for w in C.NAME_STOP}))
_generic = ", ".join(f"'{x}'" for x in C.GENERIC_WORDS)
_grid = ", ".join(f"({t}::DOUBLE)" for t in GRID)


#: What the foreign words of the view are in ASCII.
SPOKEN = {"москва": "moskva", "दिल्ली": "dillii"}


def _latin(x: str) -> str:
    x = f"translate(lower({x}), '{C.LATIN_FROM}', '{C.LATIN_TO}')"
    for a, b in (C.LATIN_DOUBLE | SPOKEN).items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _single(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = _gsub(x, f"{c}{c}+", c)
    return x


def _phrases(x: str) -> str:
    for a, b in C.ADDRESS_PHRASES.items():
        x = _gsub(x, rf"\b{a}\b", b)
    return x


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _present(x: str) -> str:
    t = f"trim({_gsub(f'coalesce({x}, $$$$)', chr(92) + 's+', ' ')})"
    return f"CASE WHEN lower({t}) IN ({_nulls}) THEN '' ELSE {t} END"


def _skeleton(x: str) -> str:
    return _gsub(f"replace(replace(replace(replace(lower({x}), 'sh', 's'), 'ph', 'f'), 'w', 'v'), 'b', 'v')", "[^b-df-hj-np-tv-z0-9]", "")


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def _lcs(x: str, y: str, tag: str) -> str:
    """Length of the longest common subsequence: bits of x's places in a hugeint (120 characters at most), one step for each character of y."""
    c, r, h, i = f"c{tag}", f"r{tag}", f"h{tag}", f"i{tag}"
    full = f"((1::HUGEINT << length({x})) - 1)"
    mask = f"coalesce(list_sum(list_transform(list_filter(range(0, length({x})), lambda {i}: substr({x}, {i}::INT + 1, 1) = {c}), lambda {i}: 1::HUGEINT << {i}::INT)), 0)::HUGEINT"
    step = f"(({r} + ({r} & {h})) | ({r} - ({r} & {h}))) & {full}"
    return f"CASE WHEN length({x}) = 0 OR length({y}) = 0 THEN 0 ELSE length({x}) - bit_count(list_reduce(list_transform(string_split({y}, ''), lambda {c}: {mask}), lambda {r}, {h}: {step}, {full})) END"


def _ratio(x: str, y: str, tag: str = "") -> str:
    return f"CASE WHEN length({x}) + length({y}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({_lcs(x, y, tag)}) / (length({x}) + length({y})) END"


def _tidy(x: str) -> str:
    return f"array_to_string(list_sort({_words(x)}), ' ')"


def _kernels(pairs: str) -> str:
    """x, y and every similarity (0..1) of the distinct pairs (x, y) that a query gives."""
    both, left, right = "array_to_string(bs, ' ')", "array_to_string(ls, ' ')", "array_to_string(rs, ' ')"
    part = lambda a, b: f"list_max(list_transform(range(1 - length({a}), length({b})), lambda i: {_ratio(a, f'substr({b}, greatest(i, 0)::INT + 1, (length({a}) + least(i, 0))::INT)', 'p')}))"
    return f"""SELECT x, y, ({_ratio('x', 'y')}) / 100 AS ratio, ({_ratio('tx', 'ty')}) / 100 AS token_sort, jaro_winkler_similarity(x, y) AS jaro_winkler, {_lev('x', 'y')} AS lev,
      CASE WHEN len(wx) = 0 OR len(wy) = 0 THEN 0 WHEN len(bs) > 0 AND (len(ls) = 0 OR len(rs) = 0) THEN 1 WHEN len(bs) = 0 THEN ({_ratio('one', 'two')}) / 100
        ELSE greatest({_ratio('one', 'two')}, {_ratio('bt', 'one')}, {_ratio('bt', 'two')}) / 100 END AS token_set,
      CASE WHEN s = '' THEN (l = '')::INT WHEN contains(l, s) THEN 1 ELSE greatest({part('s', 'l')}, CASE WHEN length(s) = length(l) THEN {part('l', 's')} ELSE 0 END) / 100 END AS partial
      FROM (SELECT *, {both} AS bt, trim({both} || ' ' || {left}) AS one, trim({both} || ' ' || {right}) AS two FROM (
        SELECT *, list_sort(list_filter(wx, lambda w: list_contains(wy, w))) AS bs, list_sort(list_filter(wx, lambda w: NOT list_contains(wy, w))) AS ls, list_sort(list_filter(wy, lambda w: NOT list_contains(wx, w))) AS rs FROM (
          SELECT x, y, {_tidy('x')} AS tx, {_tidy('y')} AS ty, list_distinct({_words('x')}) AS wx, list_distinct({_words('y')}) AS wy, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l
          FROM (SELECT DISTINCT x, y FROM ({pairs})))))"""


_abbr = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in C.ADDRESS_WORDS.items()) + "}"
_alias = "(?i)^.*" + chr(92) + "b(?:" + "|".join(C.ALIAS_PHRASES) + ")" + chr(92) + "b[" + chr(92) + "s:." + chr(92) + "-]*"
_minus = lambda a, b: f"list_filter(list_distinct({a}), lambda w: NOT list_contains({b}, w))"

def _keys(source: str) -> str:
    return rf"""SELECT entity_id, src, country, bit, key, other FROM (
      SELECT entity_id, src, country, 1 AS bit, array_to_string(list_sort(string_split(nm, ' ')), ' ') AS key, ad AS other FROM {source}
      UNION ALL SELECT entity_id, src, country, 2, nullif(regexp_extract(ad, '\b([0-9]+)\b', 1), '') || ' ' || nullif(regexp_extract(ad, '\b[0-9]+\b[^a-z]*?(?:\b[a-z]{{1,2}}\b\s+)*\b([a-z]{{3,}})', 1), ''), nm FROM {source}
      UNION ALL SELECT entity_id, src, country, 4, array_to_string(list_sort(string_split({_gsub('nm', chr(92) + 'B[aeiou]', '')}, ' ')), ' '), ad FROM {source}
      UNION ALL SELECT entity_id, src, country, 8, replace(nm, ' ', ''), ad FROM {source}
      UNION ALL SELECT entity_id, src, country, 16, array_to_string(string_split(nm, ' ')[1:2], ' '), ad FROM {source}) WHERE key <> ''"""


def _per(chosen: str) -> str:
    return f"SELECT s1, tp, np, nt, CASE WHEN nt = 0 THEN (np = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END AS f FROM (SELECT ent.s1, coalesce(tp, 0)::DOUBLE AS tp, coalesce(np, 0)::DOUBLE AS np, coalesce(nt, 0)::DOUBLE AS nt FROM ent LEFT JOIN (SELECT s1, count(*) AS np, count(gt.q) AS tp FROM {chosen} LEFT JOIN gt USING (s1, q) GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS nt FROM gt GROUP BY s1) USING (s1))"


def _dice(seed: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(parts)})), 1, 8))::BIGINT % 1000000)"


def _copies(rate: str, seed: str, key: str) -> str:
    """How often a row is drawn at the rate: the quantile of a Poisson law."""
    return f"len(list_filter(range(0, 12), lambda k: {_dice(seed, key)} >= 1000000 * list_sum(list_transform(range(0, k + 1), lambda j: exp(-({rate})) * pow({rate}, j) / factorial(j::INT)))))"


#: name -> (what it needs, its body)
TABLES: dict[str, tuple[str, str]] = {
    "d": ("", rf"SELECT doc_id, lang, n_chars, string_split(trim({_gsub('coalesce(text, $$$$)', chr(92) + 's+', ' ')}), ' ') AS w FROM documents"),
    "rec": ("d", "SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, (doc_id % 3 + 1)::INT AS src, lang AS country, concat_ws(' ', CASE doc_id % 29 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in FOREIGN.items()) + " END, array_to_string(w[1:5], ' ')) AS business_name, CASE WHEN n_chars % 7 = 3 THEN '' ELSE (n_chars % 1000) || ' ' END || array_to_string(w[6:11], ' ') AS business_address FROM d"),
    "n1": ("rec", f"SELECT *, {_present('business_name')} AS n1, {_present('business_address')} AS a1 FROM rec"),
    "n2": ("n1", f"SELECT *, {_latin(f'CASE WHEN trim(regexp_replace(n1, $${_alias}$$, $$$$)) <> $$$$ THEN regexp_replace(n1, $${_alias}$$, $$$$) ELSE n1 END')} AS n2, {_latin('a1')} AS a2 FROM n1"),
    "n3": ("n2", "SELECT *, " + _gsub(_gsub("replace(" + _gsub(_gsub("n2", r"\bwww\.|\.(?:com|net|org|in|co|fr|us|biz|info)\b|@", " "), "[0-9]{6,}", " ") + ", '&', ' and ')", "[.''`]", ""), "[^a-z0-9]+", " ") + " AS n3, " + _phrases(_gsub(_gsub(_gsub("a2", r"\bn/a\b|\bndeg|\bn°", " "), "[^a-z0-9]+", " "), r"\b0+([0-9])", r"\1")) + " AS a3 FROM n2"),
    "base": ("n3", f"SELECT entity_id, src, country, business_name, business_address, {_single('trim(n3)')} AS nm, array_to_string(list_transform(list_filter({_words('trim(a3)')}, lambda w: w NOT IN ('none', 'na')), lambda w: coalesce(({_abbr})[w], w)), ' ') AS ad FROM n3"),
    "gt": ("base", "SELECT s1, q.entity_id AS q FROM (SELECT country, nm, min(entity_id) AS s1 FROM base WHERE src = 1 AND nm <> '' GROUP BY ALL) JOIN base q USING (country, nm) WHERE q.src > 1"),
    "ent": ("base", "SELECT entity_id AS s1, country FROM base WHERE src = 1"),
    "wide": ("ent gt", "SELECT ent.s1 AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM ent LEFT JOIN (SELECT s1, string_agg(q, ',' ORDER BY q) AS m FROM gt GROUP BY s1) g ON g.s1 = ent.s1"),
    # spellings and fillers, finished records
    "akey": ("base", f"SELECT *, array_to_string({_words('ad')}[2:3], ' ') AS k FROM base"),
    "tpairs_nm": ("akey", f"SELECT s1, q.entity_id AS q, {_words('q.nm')} AS tq, {_words('s.nm')} AS ts FROM (SELECT country, k, min(entity_id) AS s1 FROM akey WHERE src = 1 AND ad <> '' GROUP BY ALL) JOIN akey q USING (country, k) JOIN base s ON s.entity_id = s1 WHERE q.src > 1"),
    "tpairs_ad": ("gt base", f"SELECT s1, q, {_words('o.ad')} AS tq, {_words('s.ad')} AS ts FROM gt JOIN base s ON s.entity_id = s1 JOIN base o ON o.entity_id = q"),
    **{f"diff_{c}": (f"tpairs_{c}", f"SELECT uq, us FROM (SELECT {_minus('tq', 'ts')} AS uq, {_minus('ts', 'tq')} AS us FROM tpairs_{c}) WHERE len(uq) BETWEEN 1 AND 3 AND len(us) BETWEEN 1 AND 3") for c in ("nm", "ad")},
    **{f"spell_{c}": (f"diff_{c} tpairs_{c}", f"""SELECT bad, good, n, nt FROM (SELECT bad, good, n, row_number() OVER (PARTITION BY bad ORDER BY n DESC, good) AS r FROM (
        SELECT bad, good, count(*) AS n FROM (SELECT bad, unnest(us) AS good FROM (SELECT unnest(uq) AS bad, us FROM diff_{c})) GROUP BY ALL)) JOIN (SELECT bad, count(*) AS nt FROM (SELECT unnest(uq) AS bad FROM diff_{c}) GROUP BY bad) USING (bad)
      WHERE r = 1 AND n >= {S.map_support} AND n / nt >= {S.map_share} AND NOT regexp_matches(bad, '[0-9]') AND NOT (length(bad) >= 12 AND contains(bad, good)) AND length(good) > 1 AND good NOT IN ('the', 'and', 'of', 'dba')
      AND bad NOT IN (SELECT bad FROM (SELECT bad, count(*) AS ns FROM (SELECT unnest(ts) AS bad FROM tpairs_{c}) GROUP BY bad) JOIN (SELECT bad, count(*) AS nq FROM (SELECT unnest(tq) AS bad FROM tpairs_{c}) GROUP BY bad) USING (bad) WHERE ns > {S.legit_ratio} * nq)""") for c in ("nm", "ad")},
    "mapped": ("base spell_nm spell_ad", "SELECT base.*, " + ", ".join(f"list_transform({_words(c)}, lambda w: coalesce(k{c}[w], w)) AS w{c}" for c in ("nm", "ad")) + " FROM base, " + ", ".join(f"(SELECT map_from_entries(list({{'k': bad, 'v': good}})) AS k{c} FROM spell_{c})" for c in ("nm", "ad"))),
    **{f"fill_{c}": ("mapped", f"SELECT country, tok, s1, s23 FROM (SELECT country, tok, count(*) FILTER (src = 1) AS s1, count(*) FILTER (src > 1) AS s23 FROM (SELECT country, src, unnest(list_distinct(w{c})) AS tok FROM mapped) GROUP BY ALL) JOIN (SELECT country, count(*) FILTER (src = 1) AS n1, count(*) FILTER (src > 1) AS n23 FROM base GROUP BY country) USING (country) WHERE s23 * n1 >= {lift} * (s1 + 1) * n23 AND s23 >= {S.noise_share} * n23 AND NOT regexp_matches(tok, '^[0-9]+$')") for c, lift in (("nm", S.noise_lift_name), ("ad", S.noise_lift_addr))},
    "norm": ("mapped fill_nm fill_ad", "SELECT entity_id, src, country, business_name, business_address, array_to_string(wnm, ' ') AS spelt, " + ", ".join(f"array_to_string(CASE WHEN len(b{c}) > 0 THEN b{c} WHEN len(a{c}) > 0 THEN a{c} ELSE w{c} END, ' ') AS {c}" for c in ("nm", "ad")) + " FROM (SELECT *, " + ", ".join(f"list_filter(a{c}, lambda w: NOT list_contains(f{c}, w)) AS b{c}" for c in ("nm", "ad"))
      + f" FROM (SELECT mapped.*, list_filter(wnm, lambda w: w NOT IN ({_stop})) AS anm, wad AS aad, coalesce(fnm, []) AS fnm, coalesce(fad, []) AS fad FROM mapped " + " ".join(f"LEFT JOIN (SELECT country, list(tok) AS f{c} FROM fill_{c} GROUP BY country) USING (country)" for c in ("nm", "ad")) + "))"),
    # exact keys
    "keys": ("norm", _keys("norm")),
    "keys0": ("base", _keys("base")),
    "kkeys": ("keys", f"SELECT x, y, ({_ratio('x', 'y')}) / 100 AS ratio FROM (SELECT DISTINCT a.other AS x, b.other AS y FROM keys a JOIN keys b USING (country, bit, key) WHERE a.src > 1 AND b.src = 1)"),
    "keyed": ("keys kkeys", f"""SELECT q, s1, bit, sim FROM (SELECT *, row_number() OVER (PARTITION BY q, bit ORDER BY sim DESC, s1) AS r FROM (
      SELECT a.entity_id AS q, b.entity_id AS s1, bit, round(ratio, 6) AS sim FROM keys a JOIN
      (SELECT *, count(*) OVER (PARTITION BY country, bit, key) AS n FROM keys WHERE src = 1) b USING (country, bit, key) JOIN kkeys ON x = a.other AND y = b.other WHERE a.src > 1 AND n <= {S.hub})) WHERE r <= {S.key_top}"""),
    "via": ("keyed", "SELECT q, s1, sum(bit)::INT AS via_key FROM keyed GROUP BY q, s1"),
    # TF-IDF
    "padded": ("norm", f"SELECT entity_id, src, country, nm, ' ' || replace(nm, ' ', '') || ' ' AS pad, {_words('ad')} AS w FROM norm"),
    "tf": ("padded", """SELECT entity_id, src, country, space, term, count(*) AS tf FROM (
      SELECT entity_id, src, country, 'n' AS space, unnest(list_transform(range(1, greatest(length(pad) - 3, 1) + 1), lambda i: substr(pad, i, 4))) AS term FROM padded WHERE nm <> ''
      UNION ALL SELECT entity_id, src, country, 'a', unnest(w) FROM padded
      UNION ALL SELECT entity_id, src, country, 'a', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM padded WHERE len(w) > 1) GROUP BY ALL"""),
    "vocab": ("tf norm", f"SELECT country, space, term, df, ln((1.0 + n)::DOUBLE / (1.0 + df)) + 1 AS idf FROM (SELECT country, space, term, count(*) AS df FROM tf WHERE src = 1 GROUP BY ALL) JOIN (SELECT country, count(*) AS n FROM norm WHERE src = 1 GROUP BY country) USING (country) WHERE df <= greatest({S.max_df} * n, {S.max_df_floor})"),
    "wt": ("tf vocab", "SELECT entity_id, src, country, space, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id, space)) AS w FROM (SELECT tf.*, tf * idf AS w FROM tf JOIN vocab USING (country, space, term))"),
    "cos": ("wt", f"SELECT *, round({S.name_weight}::DOUBLE * name_cos + {1 - S.name_weight}::DOUBLE * addr_cos, 6) AS score FROM (SELECT a.entity_id AS q, b.entity_id AS s1, round(coalesce(sum(a.w * b.w) FILTER (space = 'n'), 0), 6) AS name_cos, round(coalesce(sum(a.w * b.w) FILTER (space = 'a'), 0), 6) AS addr_cos FROM wt a JOIN wt b USING (country, space, term) WHERE a.src > 1 AND b.src = 1 GROUP BY ALL)"),
    "topk": ("cos", f"SELECT q, s1, name_cos, addr_cos, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) AS r FROM cos) WHERE r <= {S.top_k}"),
    "alone": ("via topk cos", "SELECT q, s1, via_key, coalesce(name_cos, 0) AS name_cos, coalesce(addr_cos, 0) AS addr_cos, coalesce(score, 0) AS score FROM via ANTI JOIN topk USING (q, s1) LEFT JOIN cos USING (q, s1)"),
    "cfull": ("topk via alone", "SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) - 1 AS rank FROM (SELECT q, s1, score, name_cos, addr_cos, coalesce(via_key, 0) AS via_key FROM topk LEFT JOIN via USING (q, s1) UNION ALL SELECT q, s1, score, name_cos, addr_cos, via_key FROM alone)"),
    "cand": ("cfull", f"""SELECT q, s1, score, name_cos, addr_cos, via_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, q) AS place FROM (
      SELECT *, max(score) OVER (PARTITION BY q) AS top FROM cfull) WHERE rank = 0 OR via_key > 0 OR (rank < {S.prune_rank} AND score >= round({S.prune_rel}::DOUBLE * top, 6))) WHERE rank = 0 OR place <= {S.prune_cap}"""),
    # pairs with metadata
    "meta": ("norm", rf"""SELECT entity_id, src, country, nm, ad, lower(coalesce(business_name, '')) AS raw_name, lower(coalesce(business_address, '')) AS raw_addr, regexp_matches(coalesce(business_name, ''), '[^\x00-\x7F]')::INT AS translit,
      (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT regexp_extract_all(ad, '[0-9]+') AS l)) GROUP BY x)) AS nums,
      nullif(regexp_extract(ad, '\b([0-9]+)\b', 1), '') AS num1, {_words('nm')} AS nw, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest({_words('spelt')}) AS x, unnest(range(len({_words('spelt')}))) AS i) GROUP BY x)) AS fullw FROM norm"""),
    "p": ("cand meta", "SELECT c.*, q.country, q.src, q.translit, q.nm AS nm_q, s.nm AS nm_s, q.ad AS ad_q, s.ad AS ad_s, q.raw_name AS rn_q, s.raw_name AS rn_s, q.raw_addr AS ra_q, s.raw_addr AS ra_s, coalesce(q.nums, []) AS nums_q, coalesce(s.nums, []) AS nums_s, q.num1 AS num1_q, s.num1 AS num1_s, coalesce(q.fullw, []) AS full_q, coalesce(s.fullw, []) AS full_s, q.nw AS nw_q, s.nw AS nw_s FROM cand c JOIN meta q ON c.q = q.entity_id JOIN meta s ON c.s1 = s.entity_id"),
    "p0": ("cfull meta", f"SELECT c.q, c.s1, q.country, {_minus('coalesce(q.fullw, [])', 'coalesce(s.fullw, [])')} AS extra, (q.num1 <> s.num1)::INT AS mm FROM cfull c JOIN meta q ON c.q = q.entity_id JOIN meta s ON c.s1 = s.entity_id WHERE rank = 0"),
    "dec": ("p0", f"SELECT country, tok, (mm + {S.decoy_prior}::DOUBLE * prior) / (n + {S.decoy_prior}) AS dec FROM (SELECT country, tok, count(*) AS n, sum(mm) AS mm FROM (SELECT country, mm, unnest(extra) AS tok FROM p0 WHERE mm IS NOT NULL) GROUP BY ALL) JOIN (SELECT country, avg(mm) AS prior FROM (SELECT country, mm, unnest(extra) AS tok FROM p0 WHERE mm IS NOT NULL) GROUP BY country) USING (country) WHERE n >= {S.decoy_support}"),
    "marks": ("p0 gt", f"SELECT country, tok, count(*) AS n, avg(f) AS share FROM (SELECT country, unnest(extra) AS tok, (gt.q IS NULL)::INT AS f FROM p0 LEFT JOIN gt ON gt.q = p0.q AND gt.s1 = p0.s1) GROUP BY ALL HAVING count(*) >= {S.marker_support} AND avg(f) >= {S.marker_share}"),
    "kname": ("p", _kernels("SELECT nm_q AS x, nm_s AS y FROM p")),
    "kaddr": ("p", _kernels("SELECT ad_q AS x, ad_s AS y FROM p")),
    "kraw": ("p", f"SELECT x, y, ({_ratio('x', 'y')}) / 100 AS ratio FROM (SELECT DISTINCT rn_q AS x, rn_s AS y FROM p UNION SELECT DISTINCT ra_q, ra_s FROM p)"),
    "fuzz": ("p kname kaddr kraw", """SELECT p.*, round(n.ratio, 6) AS n_ratio, round(n.token_set, 6) AS n_tset, round(n.token_sort, 6) AS n_tsort, round(n.partial, 6) AS n_partial, round(jaro_winkler_similarity(replace(nm_q, ' ', ''), replace(nm_s, ' ', '')), 6) AS n_jw,
      round(a.ratio, 6) AS a_ratio, round(a.token_set, 6) AS a_tset, round(a.partial, 6) AS a_partial, round(rn.ratio, 6) AS raw_n, round(ra.ratio, 6) AS raw_a
      FROM p JOIN kname n ON n.x = nm_q AND n.y = nm_s JOIN kaddr a ON a.x = ad_q AND a.y = ad_s JOIN kraw rn ON rn.x = rn_q AND rn.y = rn_s JOIN kraw ra ON ra.x = ra_q AND ra.y = ra_s"""),
    # forward keys
    "f1": ("rec", "SELECT entity_id, src, country, trim(" + _gsub(_gsub(_gsub(_gsub(_latin("business_name"), r"\b([a-z0-9])\.([a-z0-9])\.?(?:\b|$)", r"\1\2"), r"[-_/\\,:;*#~^|!?.''`\x22\[\]<>]+", " "), "[&+]", " and "), r"\s+", " ") + f") AS clean, {_latin('business_address')} AS a FROM rec"),
    "f2": ("f1", f"SELECT *, {_words('clean')} AS toks, list_filter(range(1, len({_words('clean')}) + 1), lambda i: {_words('clean')}[i] NOT IN ({_generic})) AS own, regexp_extract_all(a, '\\b([0-9]+)\\b', 1) AS rawnums FROM f1"),
    "fwd": ("f2", f"SELECT entity_id, src, country, clean, {_gsub('clean', '[^a-z0-9]', '')} AS compact, CASE WHEN len(own) > 0 THEN array_to_string(toks[own[1]:own[len(own)]], ' ') ELSE clean END AS core, list_filter(toks, lambda w: length(w) >= 4 AND w NOT IN ({_generic})) AS tokens, list_transform(rawnums, lambda n: regexp_replace(n, '^0+([0-9])', '\\1')) AS nums, list_filter(string_split(trim({_gsub('a', chr(92) + 's+', ' ')}), ' '), lambda w: length(w) >= 4 AND w NOT IN ({_generic})) AS addr_tokens, toks FROM f2"),
    "chan": ("fwd", """SELECT DISTINCT entity_id, src, country, channel, key FROM (
      SELECT entity_id, src, country, 'clean' AS channel, CASE WHEN length(clean) >= 3 THEN clean END AS key FROM fwd
      UNION ALL SELECT entity_id, src, country, 'compact', CASE WHEN length(compact) >= 3 THEN compact END FROM fwd
      UNION ALL SELECT entity_id, src, country, 'core', CASE WHEN length(core) >= 3 AND core <> clean THEN core END FROM fwd
      UNION ALL SELECT entity_id, src, country, 'num_name', nums[1] || ' ' || tokens[1] FROM fwd
      UNION ALL SELECT entity_id, src, country, 'num_addr', nums[1] || ' ' || addr_tokens[1] FROM fwd
      UNION ALL SELECT entity_id, src, country, 'distinctive', unnest(tokens[1:2]) FROM fwd) WHERE key IS NOT NULL"""),
    "cpairs": ("chan", "SELECT channel, s.entity_id AS s1, q.entity_id AS q, q.src AS q_src FROM (SELECT *, count(*) OVER (PARTITION BY country, channel, key) AS n FROM chan WHERE src = 1) s JOIN chan q USING (country, channel, key) WHERE q.src > 1 AND n <= 25"),
    "tiers": ("fwd", f"""SELECT DISTINCT entity_id, src, country, tier, channel, key FROM (
      SELECT entity_id, src, country, 1 AS tier, 'clean' AS channel, CASE WHEN length(clean) >= 3 THEN clean END AS key FROM fwd
      UNION ALL SELECT entity_id, src, country, 1, 'compact', CASE WHEN length(compact) >= 3 THEN compact END FROM fwd
      UNION ALL SELECT entity_id, src, country, 1, 'core', CASE WHEN length(core) >= 3 AND (core <> clean OR src > 1) THEN core END FROM fwd
      UNION ALL SELECT entity_id, src, country, 1, 'skeleton', CASE WHEN length({_skeleton('core')}) >= 5 THEN {_skeleton('core')} END FROM fwd
      UNION ALL SELECT entity_id, src, country, 1, 'num_name', nums[1] || ' ' || tokens[1] FROM fwd
      UNION ALL SELECT entity_id, src, country, 1, 'num_skeleton', CASE WHEN length({_skeleton('tokens[1]')}) >= 4 THEN nums[1] || ' ' || {_skeleton('tokens[1]')} END FROM fwd
      UNION ALL SELECT entity_id, src, country, 2, 'dual_token', CASE WHEN len(tokens) >= 2 THEN array_to_string(list_sort(tokens[1:2]), ' ') END FROM fwd
      UNION ALL SELECT entity_id, src, country, 2, 'rare_token', key FROM (SELECT entity_id, src, country, unnest(tokens) AS key FROM fwd) WHERE key IN (SELECT key FROM (SELECT unnest(tokens) AS key FROM fwd WHERE src = 1) GROUP BY key HAVING count(*) <= 2)) WHERE key IS NOT NULL"""),
    "tmet": ("tiers", "SELECT tier, channel, key, country, s.entity_id AS s1, q.entity_id AS q, q.src AS q_src FROM tiers s JOIN tiers q USING (country, tier, channel, key) WHERE s.src = 1 AND q.src > 1"),
    "fk": ("fwd base", rf"SELECT f.*, {_skeleton('core')} AS skel, b.ad AS addr, {_words('b.ad')} AS aw, regexp_extract_all(b.ad, '\b([0-9]{{5,6}})\b', 1) AS pin FROM fwd f JOIN base b USING (entity_id)"),
    "bp": ("cpairs fk", "SELECT p.s1, p.q, q.src AS q_src, " + ", ".join(f"{e}.{c} AS {c}_{e}" for c in ("clean", "compact", "core", "skel", "toks", "nums", "addr", "aw", "pin") for e in "sq") + " FROM (SELECT DISTINCT s1, q FROM cpairs) p JOIN fk s ON s.entity_id = p.s1 JOIN fk q ON q.entity_id = p.q"),
    **{f"k_{c}": ("bp", _kernels(f"SELECT {c}_s AS x, {c}_q AS y FROM bp")) for c in ("clean", "core", "addr")},
    **{f"k_{c}": ("bp", f"SELECT x, y, ({_ratio('x', 'y')}) / 100 AS ratio FROM (SELECT DISTINCT {c}_s AS x, {c}_q AS y FROM bp)") for c in ("compact", "skel")},
    # synthetic decoys
    "obs": ("rec gt", "SELECT entity_id AS q, src, country, business_name AS name, business_address AS addr, entity_id IN (SELECT q FROM gt) AS linked FROM rec WHERE src > 1"),
    "quota": ("ent obs", "SELECT floor(1.2 * (SELECT count(*) FROM ent))::BIGINT AS n, greatest(1, count(*) FILTER (linked)) AS m, greatest(1, count(*) FILTER (NOT linked)) AS l FROM obs"),
    "drawn": ("obs quota", f"""SELECT q, src, country, name, addr, linked, unnest(range(0, copies))::INT AS copy FROM (SELECT obs.*, {_copies("CASE WHEN linked THEN (n - n // 2)::DOUBLE / m ELSE (n // 2)::DOUBLE / l END", "'decoy' || CASE WHEN linked THEN 'm' ELSE 'l' END", "q")} AS copies FROM obs, quota)"""),
    "rolled": ("drawn marks", "SELECT drawn.*, words, " + ", ".join(f"{_dice(f"'decoy{t}'", 'q', 'copy')} AS r_{t}" for t in ("shift", "by", "word", "mark", "at")) + " FROM drawn LEFT JOIN (SELECT country, list_sort(list_distinct(list(tok))) AS words FROM marks GROUP BY country) USING (country)"),
    "moved": ("rolled", "SELECT *, CASE WHEN (linked AND r_shift >= 800000) OR TRY_CAST(regexp_extract(addr, '([0-9]+)', 1) AS BIGINT) IS NULL THEN addr ELSE regexp_replace(addr, '[0-9]+', greatest(1, TRY_CAST(regexp_extract(addr, '([0-9]+)', 1) AS BIGINT) + CASE WHEN (r_by & 32) > 0 THEN r_by % 30 + 1 ELSE -(r_by % 30 + 1) END)::VARCHAR) END AS to_addr FROM rolled"),
    "marked": ("moved", "SELECT *, CASE WHEN linked AND coalesce(len(words), 0) > 0 AND (r_mark < 600000 OR to_addr = addr) THEN array_to_string(list_concat(list_concat(w[1:spot], [upper(word[1]) || word[2:]]), w[spot + 1:]), ' ') ELSE name END AS to_name FROM (SELECT *, string_split(name, ' ') AS w, words[(r_word % greatest(len(words), 1))::INT + 1] AS word, (CASE WHEN len(string_split(name, ' ')) > 1 THEN r_at % (len(string_split(name, ' ')) - 1) ELSE 0 END + 1)::INT AS spot FROM moved)"),
    # decisions
    "sc": ("cand", "SELECT q, s1, score AS p FROM cand"),
    "best": ("sc", "SELECT q, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s1) AS r FROM sc) WHERE r = 1"),
    "asg": ("best", f"SELECT * FROM best WHERE p >= {THRESHOLD}"),
    "ef0": ("best", "SELECT *, round(1.25 * sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, q ROWS UNBOUNDED PRECEDING) / (0.25 * sum(p) OVER (PARTITION BY s1) + row_number() OVER (PARTITION BY s1 ORDER BY p DESC, q)), 9) AS ef, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, q) AS k, product(1 - p) OVER (PARTITION BY s1) AS none FROM best"),
    "ef": ("ef0", "SELECT q, s1, p FROM ef0 JOIN (SELECT s1, max(ef) AS top, arg_min(k, (-ef, k)) AS bk FROM ef0 GROUP BY s1) USING (s1) WHERE k <= bk AND top > none"),
    "asg6": ("best", "SELECT * FROM best WHERE p >= 0.6"),
    "per": ("asg gt ent", _per("asg")),
    "per6": ("asg6 gt ent", _per("asg6")),
}


def _curve(best: str, truth: str) -> str:
    return f"""SELECT t, round(avg(CASE WHEN nt = 0 THEN (np = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END), 6) AS f05 FROM (
      SELECT ent.s1, g.t, count(b.q)::DOUBLE AS np, count(x.q)::DOUBLE AS tp, any_value(coalesce(nt, 0))::DOUBLE AS nt FROM ent CROSS JOIN (VALUES {_grid}) g(t) LEFT JOIN {best} b ON b.s1 = ent.s1 AND b.p >= g.t
      LEFT JOIN {truth} x ON x.s1 = b.s1 AND x.q = b.q LEFT JOIN (SELECT s1, count(*) AS nt FROM {truth} GROUP BY s1) n ON n.s1 = ent.s1 GROUP BY ALL) GROUP BY t"""


TABLES |= {
    "gt2": ("gt", "SELECT * FROM gt WHERE regexp_extract(q, '([0-9]+)$', 1)::BIGINT * 7919 % 1000 >= 500"),
    "sc2": ("sc gt gt2", "SELECT * FROM sc WHERE q NOT IN (SELECT q FROM gt ANTI JOIN gt2 USING (q, s1))"),
    "best2": ("sc2", "SELECT q, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s1) AS r FROM sc2) WHERE r = 1"),
    "curve": ("best gt ent", _curve("best", "gt")),
    "lines": ("wide", r"""SELECT 0::BIGINT AS n, 'source1_entity_id,matched_entity_ids' AS line UNION ALL SELECT n + o, line FROM (SELECT i + 1 AS n,
      CASE i % 11 WHEN 0 THEN s || ' ' || m WHEN 1 THEN s || chr(9) || m || chr(9) || 'x' WHEN 2 THEN chr(9) || m ELSE s || chr(9) || m END AS line FROM (SELECT source1_entity_id AS s, i,
      CASE i % 7 WHEN 0 THEN matched_entity_ids || ',S2-1,S2-1' WHEN 1 THEN 'S1-5, ' || matched_entity_ids WHEN 2 THEN 'S2-1,,nan' WHEN 3 THEN '"X-9"' ELSE matched_entity_ids END AS m
      FROM (SELECT *, regexp_extract(source1_entity_id, '([0-9]+)$', 1)::BIGINT AS i FROM wide))) CROSS JOIN (VALUES (0), (1000000)) t(o) WHERE o = 0 OR n % 5 = 1"""),
    "parsed": ("lines", "SELECT *, CASE WHEN list = '' THEN [] ELSE string_split(list, ',') END AS ids FROM (SELECT n, line, string_split(line, chr(9)) AS f, string_split(line, chr(9))[1] AS s1, coalesce(string_split(line, chr(9))[2], '') AS list FROM lines WHERE n > 0)"),
    "faults": ("parsed", r"""SELECT n, error FROM (SELECT *, list_transform(ids, lambda x: trim(x)) AS t FROM parsed), LATERAL (SELECT unnest([
      CASE WHEN len(f) < 2 THEN 'no_tab' END, CASE WHEN len(f) > 2 THEN 'extra_tab' END, CASE WHEN trim(s1) = '' THEN 'blank_s1' END, CASE WHEN contains(line, '"') OR contains(line, '''') THEN 'quotes' END,
      CASE WHEN list <> trim(list) OR len(list_filter(ids, lambda x: x <> trim(x))) > 0 THEN 'white_space' END, CASE WHEN len(list_filter(t, lambda x: lower(x) IN ('nan', 'null', 'none', 'na', '<null>', 'undefined'))) > 0 THEN 'null_word' END,
      CASE WHEN len(list_filter(t, lambda x: x = '')) > 0 THEN 'empty_id' END, CASE WHEN len(list_filter(t, lambda x: starts_with(x, 'S1-'))) > 0 THEN 'self_match' END,
      CASE WHEN len(list_filter(t, lambda x: x <> '' AND lower(x) NOT IN ('nan', 'null', 'none', 'na', '<null>', 'undefined') AND NOT regexp_matches(x, '^S[123]-'))) > 0 THEN 'wrong_prefix' END,
      CASE WHEN len(list_filter(t, lambda x: x <> '')) > len(list_distinct(list_filter(t, lambda x: x <> ''))) THEN 'repeated_id' END]) AS error) WHERE error IS NOT NULL
      UNION ALL SELECT n, 'repeated_s1' FROM (SELECT n, row_number() OVER (PARTITION BY s1 ORDER BY n) AS r FROM parsed) WHERE r > 1"""),
}


class Twin(str):
    """A statement that keeps its parts."""

    needs: str
    body: str


def sql(needs: str, body: str) -> Twin:
    """body behind the tables that it needs, in their order."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        if name not in wanted:
            for x in TABLES[name][0].split():
                visit(x)
            wanted.append(name)

    for name in needs.split():
        visit(name)
    out = Twin("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in wanted) + "\n" + body)
    out.needs, out.body = needs, body
    return out


_n = "regexp_extract({}, '([0-9]+)$', 1)::BIGINT".format
_ties = "SELECT q, s1, " + ", ".join(f"round(max({c}) OVER (PARTITION BY q) - {c}, 6) AS {c}_qgap" for c in ("raw_n", "raw_a", "n_ratio", "a_tset")) + " FROM fuzz"
_chosen_lists = lambda pairs, col: f"SELECT ent.s1 AS source1_entity_id, coalesce(m, '') AS {col} FROM ent LEFT JOIN (SELECT s1, string_agg(DISTINCT q, ',' ORDER BY q) AS m FROM {pairs} GROUP BY s1) g ON g.s1 = ent.s1"

ORACLE: dict[str, str] = {
    "records_view": sql("rec", "SELECT * FROM rec"),
    "tsv_round_trip": sql("rec", "SELECT entity_id, business_name, business_address, country, src FROM rec"),
    "ground_truth_long": sql("gt", "SELECT s1, q FROM gt"),
    "truth_pairs_assembly": sql("gt base", "SELECT s1, q, s.nm AS nm_s, s.ad AS ad_s, o.nm AS nm_q, o.ad AS ad_q FROM gt JOIN base s ON s.entity_id = s1 JOIN base o ON o.entity_id = q"),
    "results_tsv_shape": sql("ent asg", _chosen_lists("asg", "matched_entity_ids")),
    "results_tsv_round_trip": sql("ent asg", _chosen_lists("asg", "matched_entity_ids").replace("coalesce(m, '')", "m")),
    "candidates_tsv_shape": sql("ent cand", _chosen_lists("cand", "candidate_entity_ids")),
    "text_lines": sql("rec", "SELECT entity_id || chr(9) || business_name AS line FROM rec"),
    "country_partitions": sql("norm", "SELECT entity_id, country, nm FROM norm WHERE country IN ('de', 'fr')"),
    "staged_norm": sql("norm", "SELECT entity_id, nm, ad FROM norm"),
    "json_artefacts": sql("fill_nm", "SELECT country, tok FROM fill_nm"),
    "frequent_words": sql("norm", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, tok) AS place FROM (SELECT country, tok, count(*) AS n FROM (SELECT country, unnest({_words('nm')}) AS tok FROM norm) GROUP BY ALL)) WHERE place <= 10"),
    "name_tokens": sql("base", "SELECT entity_id, nm FROM base"),
    "addr_tokens": sql("base", "SELECT entity_id, ad FROM base"),
    "metadata_projection": sql("meta", "SELECT entity_id, raw_name, raw_addr, translit, coalesce(array_to_string(nums, ','), '') AS nums, num1 FROM meta"),
    "full_names": sql("meta", "SELECT entity_id, coalesce(array_to_string(fullw, ' '), '') AS full_name FROM meta"),
    "consonant_skeleton": sql("rec", f"SELECT entity_id, {_skeleton(_latin('business_name'))} AS skeleton FROM rec"),
    "transliterated": sql("rec", f"SELECT entity_id, {_latin('business_name')} AS name FROM rec"),
    "baseline_keys_fast": sql("fwd", f"SELECT entity_id, clean, compact, core, array_to_string(tokens, ' ') AS tokens, nums[1] AS num, array_to_string(addr_tokens, ' ') AS addr_tokens, {_skeleton('core')} AS skeleton FROM fwd"),
    "learned_map": sql("spell_nm spell_ad", "SELECT *, 'name' AS kind FROM spell_nm UNION ALL SELECT *, 'addr' FROM spell_ad"),
    "filler_lexicon": sql("fill_nm", "SELECT * FROM fill_nm"),
    "filler_lexicon_addr": sql("fill_ad", "SELECT * FROM fill_ad"),
    "decoy_lexicon": sql("dec", "SELECT country, tok, round(dec, 6) AS dec FROM dec"),
    "marker_words": sql("marks", "SELECT country, tok, n, round(share, 6) AS share FROM marks"),
    "finish_tokens": sql("norm", "SELECT entity_id, nm, ad, spelt FROM norm"),
    "exact_keys": sql("keys", "SELECT entity_id, bit, key FROM keys"),
    "hub_guard": sql("keys", "SELECT entity_id, bit, key FROM (SELECT *, count(*) OVER (PARTITION BY country, bit, key) AS n FROM keys WHERE src = 1) WHERE n <= 2"),
    "key_pairs_top2": sql("keyed", "SELECT * FROM keyed"),
    "key_bitmask_union": sql("via", "SELECT * FROM via"),
    "tfidf_name_terms": sql("wt", "SELECT entity_id, term, round(w, 6) AS w FROM wt WHERE space = 'n'"),
    "tfidf_addr_terms": sql("wt", "SELECT entity_id, term, round(w, 6) AS w FROM wt WHERE space = 'a'"),
    "tfidf_vocabulary": sql("vocab", "SELECT country, space, term, df, round(idf, 6) AS idf FROM vocab"),
    "tfidf_topk_join": sql("topk", "SELECT * FROM topk"),
    "key_only_pairs": sql("alone", "SELECT * FROM alone"),
    "candidates_full": sql("cfull", "SELECT * FROM cfull"),
    "candidates_pruned": sql("cand", "SELECT * FROM cand"),
    "candidate_volume": sql("cand", "SELECT sum(n)::BIGINT AS pairs, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.99) AS p99, max(n) AS most FROM (SELECT s1, count(*) AS n FROM cand GROUP BY s1)"),
    "blocking_recall": sql("cand gt", "SELECT count(cand.q) AS found, count(*) AS links, round(count(cand.q)::DOUBLE / count(*), 6) AS recall FROM gt LEFT JOIN cand USING (q, s1)"),
    "baseline_channels": sql("cpairs", "SELECT DISTINCT channel, s1, q FROM cpairs"),
    "channel_report": sql("cpairs gt", """SELECT channel, source, count(*) AS pairs, count(gt.q) AS true_pairs, round(count(gt.q)::DOUBLE / (SELECT count(*) FROM gt), 6) AS recall FROM (SELECT DISTINCT channel, q_src::VARCHAR AS source, s1, q FROM cpairs
      UNION ALL SELECT DISTINCT channel, 'all', s1, q FROM cpairs UNION ALL SELECT DISTINCT 'union', 'all', s1, q FROM cpairs) LEFT JOIN gt USING (s1, q) GROUP BY channel, source"""),
    "fifo_cap": sql("cpairs", "SELECT s1, q, place FROM (SELECT s1, q, row_number() OVER (PARTITION BY s1 ORDER BY q) AS place FROM (SELECT DISTINCT s1, q FROM cpairs)) WHERE place <= 3"),
    "tier_quota": sql("tmet", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, q_src ORDER BY tier, q) AS place FROM (SELECT s1, q, q_src, min(tier) AS tier FROM tmet GROUP BY ALL)) WHERE tier = 1 AND place <= 3 OR tier = 2 AND place <= 2"),
    "evidence_topk": sql("tmet fwd", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, q_src ORDER BY weight DESC, n_channels DESC, num_match DESC, len_diff, q DESC) AS place FROM (
      SELECT s1, q, q_src, weight, n_channels, CASE WHEN s.nums[1] IS NULL OR o.nums[1] IS NULL THEN 0 WHEN s.nums[1] = o.nums[1] THEN 1 ELSE -1 END AS num_match, abs(length(s.clean) - length(o.clean)) AS len_diff FROM (
      SELECT s1, q, q_src, sum(w) AS weight, count(*) AS n_channels FROM (SELECT DISTINCT s1, q, q_src, channel FROM tmet WHERE channel <> 'rare_token' OR q NOT IN (SELECT q FROM tmet WHERE channel <> 'rare_token'))
      JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in C.CHANNEL_WEIGHTS.items())}) cw(channel, w) USING (channel) GROUP BY s1, q, q_src) JOIN fwd s ON s.entity_id = s1 JOIN fwd o ON o.entity_id = q)) WHERE place <= 3"""),
    "shared_key_top20": sql("tmet", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY shared DESC, q) AS place FROM (SELECT s1, q, count(*) AS shared FROM tmet GROUP BY s1, q)) WHERE place <= 20"),
    "feat_context": sql("cand", "SELECT q, s1, top1, top2, s1_n, s1_n0, s1_rank, round(top1 - score, 6) AS gap, round(top1 - top2, 6) AS margin FROM (SELECT *, coalesce(max(CASE WHEN r = 2 THEN score END) OVER (PARTITION BY q), top1) AS top2 FROM (SELECT *, max(score) OVER (PARTITION BY q) AS top1, row_number() OVER (PARTITION BY q ORDER BY score DESC, s1) AS r, count(*) OVER (PARTITION BY s1) AS s1_n, count(*) FILTER (rank = 0) OVER (PARTITION BY s1) AS s1_n0, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, q) AS s1_rank FROM cand))"),
    "feat_tokens": sql("p", f"SELECT q, s1, len({_minus('full_q', 'full_s')}) AS n_xq, len({_minus('full_s', 'full_q')}) AS n_xs FROM p"),
    "feat_same_num": sql("p", "SELECT q, s1, g AS g_same_num, round(g::DOUBLE / greatest(n - 1, 1), 6) AS g_same_num_frac FROM (SELECT q, s1, greatest(count(num1_q) OVER (PARTITION BY s1, num1_q) - 1, 0) AS g, count(*) OVER (PARTITION BY s1) AS n FROM p)"),
    "feat_decoy": sql("p dec", f"SELECT p.q, p.s1, dec_max, dec_sum FROM p LEFT JOIN (SELECT q, s1, round(max(dec), 6) AS dec_max, round(sum(dec), 6) AS dec_sum FROM (SELECT q, s1, country, unnest({_minus('full_q', 'full_s')}) AS tok FROM p) JOIN dec USING (country, tok) GROUP BY q, s1) x ON x.q = p.q AND x.s1 = p.s1"),
    "feat_mindiff": sql("p", "SELECT q, s1, d AS s_num_mindiff, (d = 0)::INT AS s_num_in_q FROM (SELECT q, s1, least(list_min(list_transform(nums_q, lambda n: abs(TRY_CAST(n AS BIGINT) - TRY_CAST(num1_s AS BIGINT)))), 1000000) AS d FROM (SELECT q, s1, nums_q, num1_s FROM p WHERE num1_s IS NOT NULL AND len(nums_q) > 0) UNION ALL SELECT q, s1, NULL FROM p WHERE num1_s IS NULL OR len(nums_q) = 0)"),
    "feat_uniq": sql("p", f"SELECT p.q, p.s1, coalesce(n, 0) AS g_uniq_x FROM p LEFT JOIN (SELECT q, s1, count(*) AS n FROM (SELECT q, s1, unnest({_minus('full_q', 'full_s')}) AS tok FROM p) JOIN (SELECT s1, tok FROM (SELECT s1, unnest(full_q) AS tok FROM p) GROUP BY s1, tok HAVING count(*) = 1) USING (s1, tok) GROUP BY q, s1) x ON x.q = p.q AND x.s1 = p.s1"),
    "feat_ambiguity": sql("p meta", """SELECT p.q, p.s1, a.n AS amb_s_name, coalesce(b.n, 0) AS amb_q_name, c.n AS amb_s_addr, (nm_q = nm_s)::INT AS name_eq, sum((nm_q = nm_s)::INT) OVER (PARTITION BY p.q) AS q_name_ties, q_known_frac FROM p
      LEFT JOIN (SELECT country, nm, count(*) AS n FROM meta WHERE src = 1 GROUP BY ALL) a ON a.country = p.country AND a.nm = nm_s LEFT JOIN (SELECT country, nm, count(*) AS n FROM meta WHERE src = 1 GROUP BY ALL) b ON b.country = p.country AND b.nm = nm_q
      LEFT JOIN (SELECT country, ad, count(*) AS n FROM meta WHERE src = 1 AND ad <> '' GROUP BY ALL) c ON c.country = p.country AND c.ad = ad_s
      LEFT JOIN (SELECT q, round(avg((v.tok IS NOT NULL)::INT), 6) AS q_known_frac FROM (SELECT entity_id AS q, country, unnest(nw) AS tok FROM meta WHERE src > 1) t LEFT JOIN (SELECT country, tok FROM (SELECT country, unnest(nw) AS tok FROM meta WHERE src = 1) GROUP BY ALL HAVING count(*) >= 2) v ON v.country = t.country AND v.tok = t.tok GROUP BY q) k ON k.q = p.q"""),
    "feat_numbers": sql("p", f"""SELECT q, s1, src, translit, i AS num_inter, u AS num_union, (nums_q[1] = nums_s[1])::INT AS num_first_eq, CASE WHEN nums_q[1] IS NOT NULL AND nums_s[1] IS NOT NULL THEN least(abs(TRY_CAST(nums_q[1] AS BIGINT) - TRY_CAST(nums_s[1] AS BIGINT)), 1000000) END AS num_first_diff,
      CASE WHEN u = 0 THEN NULL ELSE round(i::DOUBLE / u, 6) END AS num_jac, (i = len(nums_q))::INT AS num_q_in_s, len({_minus('nw_q', 'nw_s')}) AS n_extra_q, len({_minus('nw_s', 'nw_q')}) AS n_extra_s, length(nm_q) AS len_nq, length(nm_s) AS len_ns, length(ad_q) AS len_aq, length(ad_s) AS len_as
      FROM (SELECT *, len(list_filter(nums_q, lambda x: list_contains(nums_s, x))) AS i, len(list_distinct(list_concat(nums_q, nums_s))) AS u FROM p)"""),
    "feat_fuzzy": sql("fuzz", "SELECT q, s1, n_ratio, n_tset, n_tsort, n_partial, n_jw, a_ratio, a_tset, a_partial, raw_n, raw_a FROM fuzz"),
    "feat_jaro_winkler": sql("p", "SELECT q, s1, round(jaro_winkler_similarity(nm_q, nm_s), 6) AS jw FROM p"),
    "feat_tiebreaks": sql("fuzz", f"SELECT *, sum(raw_n_qbest) OVER (PARTITION BY q) AS raw_n_qties, sum(raw_a_qbest) OVER (PARTITION BY q) AS raw_a_qties FROM (SELECT *, {', '.join(f'({c}_qgap = 0)::INT AS {c}_qbest' for c in ('raw_n', 'raw_a', 'n_ratio', 'a_tset'))} FROM ({_ties}))"),
    "feat_label": sql("cand gt", "SELECT cand.q, cand.s1, (gt.q IS NOT NULL)::INT AS label FROM cand LEFT JOIN gt ON gt.q = cand.q AND gt.s1 = cand.s1"),
    "assign_argmax": sql("asg", "SELECT * FROM asg"),
    "expected_f": sql("ef", "SELECT * FROM ef"),
    "decide_rules": sql("asg ef", "SELECT 'threshold' AS rule, q, s1 FROM asg UNION ALL SELECT 'expected_f', q, s1 FROM ef"),
    "f05_macro": sql("per", "SELECT round(avg(f), 6) AS f05 FROM per"),
    "f05_breakdown": sql("per", 'SELECT round(avg(f), 6) AS f05, round(sum(tp) / nullif(sum(np), 0), 6) AS "precision", round(sum(tp) / nullif(sum(nt), 0), 6) AS recall, round(avg(f) FILTER (nt = 0), 6) AS singleton_accuracy, round(avg(f) FILTER (nt > 0), 6) AS matched_f05, count(*) FILTER (nt = 0) AS singletons, count(*) AS entries FROM per'),
    "threshold_curve": sql("curve", "SELECT * FROM curve"),
    "best_threshold": sql("curve", "SELECT * FROM curve ORDER BY f05 DESC, t LIMIT 1"),
    "sim_dense": sql("best2 gt2 ent", _curve("best2", "gt2")),
    "error_taxonomy": sql("sc asg gt", """SELECT 'false_merge' AS kind, q, s1, p FROM asg ANTI JOIN gt USING (q, s1) UNION ALL SELECT CASE WHEN sc.p IS NULL THEN 'miss:not_in_candidates' WHEN g.q IN (SELECT q FROM asg) THEN 'miss:assigned_elsewhere' ELSE 'miss:not_selected' END, g.q, g.s1, sc.p
      FROM (SELECT * FROM gt ANTI JOIN asg USING (q, s1)) g LEFT JOIN sc ON sc.q = g.q AND sc.s1 = g.s1"""),
    "unseen_country_override": sql("asg best ent", "SELECT q, s1, p FROM asg WHERE s1 NOT IN (SELECT s1 FROM ent WHERE country = 'fr') UNION ALL SELECT q, s1, p FROM best WHERE p >= 0.7 AND s1 IN (SELECT s1 FROM ent WHERE country = 'fr')"),
    "pseudo_labels": sql("sc ent", "SELECT q, s1, (p >= 0.7)::INT AS label FROM sc WHERE s1 IN (SELECT s1 FROM ent WHERE country = 'fr') AND (p >= 0.7 OR p <= 0.1)"),
    "country_report": sql("ent cand asg", "SELECT country, count(*) AS n_s1, round(avg(c), 6) AS candidates, round(avg(m), 6) AS matches, round(100 * avg((m = 0)::INT), 6) AS pct_empty FROM (SELECT ent.s1, country, (SELECT count(*) FROM cand WHERE cand.s1 = ent.s1) AS c, (SELECT count(*) FROM asg WHERE asg.s1 = ent.s1) AS m FROM ent) GROUP BY country"),
    "margin_threshold": sql("sc norm", """SELECT q, s1, p, src FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s1) AS rq FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, q) AS r, max(p) OVER (PARTITION BY s1) AS top FROM (
      SELECT q, s1, p, src FROM sc JOIN norm ON entity_id = q WHERE p >= CASE src WHEN 2 THEN 0.5 ELSE 0.35 END)) WHERE r = 1 OR round(top - p, 9) >= 0.05) WHERE rq = 1"""),
    "number_penalty": sql("p", "SELECT q, s1, round(CASE WHEN num1_q <> num1_s THEN score * 0.1::DOUBLE ELSE score END, 9) AS p FROM p"),
    "brier": sql("sc gt", "SELECT round(avg(pow(p - (gt.q IS NOT NULL)::INT, 2)), 6) AS brier FROM sc LEFT JOIN gt ON gt.q = sc.q AND gt.s1 = sc.s1"),
    "validator_header": sql("lines", """SELECT unnest(['empty_file', 'comma_header', 'wrong_header', 'no_rows']) AS "check", unnest([(r = 0)::INT, coalesce(h = 'source1_entity_id,matched_entity_ids', false)::INT, (r > 0 AND h IS DISTINCT FROM 'source1_entity_id' || chr(9) || 'matched_entity_ids')::INT, (r = 1)::INT]) AS failed FROM (SELECT count(*) AS r, max(lower(trim(line))) FILTER (n = 0) AS h FROM lines)"""),
    "validator_errors": sql("faults", "SELECT * FROM faults"),
    "validator_messages": sql("faults", "SELECT error AS kind, count(*) AS n, array_to_string(list_sort(list_transform((list(DISTINCT n ORDER BY n))[1:5], lambda x: x::VARCHAR)), ', ') AS examples FROM faults GROUP BY error"),
    "completeness": sql("asg ent", "SELECT 'missing' AS kind, s1 FROM ent WHERE s1 NOT IN (SELECT s1 FROM asg) UNION ALL SELECT 'unexpected', s1 || 'x' FROM ent WHERE s1 LIKE '%1'"),
    "unknown_ids": sql("cand rec", "SELECT DISTINCT q FROM cand WHERE q NOT IN (SELECT entity_id FROM rec WHERE src = 2)"),
    "validator_warnings": sql("topk cand ent", """SELECT 'several_entries' AS kind, q AS id FROM topk WHERE score > 0.3 GROUP BY q HAVING count(DISTINCT s1) > 1 UNION ALL SELECT 'no_candidate', s1 || '>' || q FROM (SELECT * FROM topk WHERE score > 0.3) ANTI JOIN cand USING (s1, q)
      UNION ALL SELECT 'no_candidates', s1 FROM ent WHERE s1 NOT IN (SELECT s1 FROM cand)"""),
    "target_collisions": sql("cand", "SELECT q, count(DISTINCT s1) AS n_s1 FROM cand GROUP BY q HAVING count(DISTINCT s1) > 1"),
    "gt_profile": sql("wide", f"""SELECT unnest(['entries', 'singletons', 'only_s2', 'only_s3', 'both', 'links', 'links_s2', 'links_s3', 'most', {', '.join(f"'with_{k}'" for k in range(11))}, 'with_more']) AS measure,
      unnest([count(*), count(*) FILTER (n = 0), count(*) FILTER (a > 0 AND b = 0), count(*) FILTER (b > 0 AND a = 0), count(*) FILTER (a > 0 AND b > 0), sum(n), sum(a), sum(b), max(n), {', '.join(f'count(*) FILTER (n = {k})' for k in range(11))}, count(*) FILTER (n > 10)])::BIGINT AS value
      FROM (SELECT len(i) AS n, len(list_filter(i, lambda x: starts_with(x, 'S2-'))) AS a, len(list_filter(i, lambda x: starts_with(x, 'S3-'))) AS b FROM (SELECT list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS i FROM wide))"""),
    "source_profile": sql("rec", "SELECT src, count(*) AS n_rows, count(*) FILTER (coalesce(trim(business_name), '') = '') AS no_name, count(*) FILTER (coalesce(trim(business_address), '') = '') AS no_address, count(*) FILTER (coalesce(trim(country), '') = '') AS no_country, min(length(business_name)) AS name_min, max(length(business_name)) AS name_max, round(avg(length(business_name)), 6) AS name_mean, min(length(business_address)) AS addr_min, max(length(business_address)) AS addr_max, round(avg(length(business_address)), 6) AS addr_mean FROM rec GROUP BY src"),
    "country_profile": sql("rec", "SELECT src, country, count(*) AS n_rows FROM rec GROUP BY ALL"),
    "pair_samples": sql("gt rec", "SELECT s1, q, s.business_name AS name_s, s.business_address AS addr_s, o.business_name AS name_q, o.business_address AS addr_q FROM (SELECT * FROM gt ORDER BY s1, q LIMIT 20) JOIN rec s ON s.entity_id = s1 JOIN rec o ON o.entity_id = q"),
    "stratified_split": sql("ent gt", f"SELECT s1, country, bucket FROM (SELECT *, row_number() OVER (PARTITION BY country, bucket ORDER BY {_n('s1')} * 7919 % 10007, s1) AS place, round(count(*) OVER (PARTITION BY country, bucket) * 0.25::DOUBLE) AS quota FROM (SELECT s1, country, CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '5+' END AS bucket FROM (SELECT ent.s1, country, (SELECT count(*) FROM gt WHERE gt.s1 = ent.s1) AS n FROM ent))) WHERE place <= quota"),
    "group_folds": sql("cand", f"SELECT q, s1, (({_n('s1')} * 7919 + 3) % 5)::INT AS fold FROM cand"),
    "seeded_sample": sql("rec", f"SELECT entity_id FROM rec ORDER BY {_n('entity_id')} * 7919 % 10007, entity_id LIMIT 100"),
    "stack_q_context": sql("sc", "SELECT q, s1, p, q_pmax, q_n, q_nhi, q_p2, round(q_pmax - p, 9) AS q_gap, round(p - CASE WHEN p = q_pmax THEN q_p2 ELSE q_pmax END, 9) AS q_runner FROM (SELECT *, coalesce(max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY q), q_pmax) AS q_p2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s1) AS r, max(p) OVER (PARTITION BY q) AS q_pmax, count(*) OVER (PARTITION BY q) AS q_n, count(*) FILTER (p > 0.5) OVER (PARTITION BY q) AS q_nhi FROM sc))"),
    "stack_s_context": sql("sc", "SELECT q, s1, p, round(sum(p) OVER (PARTITION BY s1), 6) AS s_sum, count(*) FILTER (p > 0.5) OVER (PARTITION BY s1) AS s_nhi, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, q) AS s_rank, count(*) OVER (PARTITION BY s1) AS s_n FROM sc"),
    "sibling_pairs": sql("sc meta", f"""SELECT q, s1, p, sib, sib_p, CASE WHEN sib IS NOT NULL THEN round(({_ratio('a.nm', 'b.nm')}) / 100, 6) END AS sib_n_ratio, CASE WHEN sib IS NOT NULL THEN round(({_ratio('a.ad', 'b.ad')}) / 100, 6) END AS sib_a_ratio, (a.num1 = b.num1)::INT::DOUBLE AS sib_num_eq FROM (
      SELECT x.q, x.s1, x.p, arg_min(y.q, (-y.p, y.q)) AS sib, max(y.p) AS sib_p FROM sc x LEFT JOIN sc y ON y.s1 = x.s1 AND y.q <> x.q GROUP BY ALL) JOIN meta a ON a.entity_id = q LEFT JOIN meta b ON b.entity_id = sib"""),
    "shift_number": sql("rec", f"SELECT entity_id, CASE WHEN regexp_extract(business_address, '([0-9]+)', 1) = '' THEN business_address ELSE regexp_replace(business_address, '[0-9]+', greatest(1, regexp_extract(business_address, '([0-9]+)', 1)::BIGINT + CASE WHEN (r & 32) > 0 THEN r % 30 + 1 ELSE -(r % 30 + 1) END)::VARCHAR) END AS shifted FROM (SELECT *, {_n('entity_id')} * 7919 % 10007 AS r FROM rec)"),
    "decoys_removed": sql("rec", "SELECT * FROM rec"),
}

_flag = lambda c: f"coalesce(({c}), false)::INT::DOUBLE"
_both = lambda a, b: f"len(list_filter(list_distinct({a}), lambda w: list_contains({b}, w)))"
_jac = lambda a, b: f"coalesce({_both(a, b)}::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"
_there = lambda c: f"CASE WHEN addr_q <> '' AND addr_s <> '' THEN {c} ELSE 0 END"
_FORWARD = {
    "name_lev_sim": "n.lev", "name_jw_sim": "n.jaro_winkler", "name_fuzz_ratio": "n.ratio", "name_token_sort": "n.token_sort", "name_token_set": "n.token_set", "name_partial_ratio": "n.partial",
    "core_name_ratio": "c.ratio", "core_name_token_sort": "c.token_sort", "compact_name_ratio": "o.ratio", "consonant_skeleton_match": _flag("skel_s = skel_q AND skel_s <> ''"),
    "consonant_skeleton_ratio": "CASE WHEN skel_s <> '' AND skel_q <> '' THEN k.ratio ELSE 0 END", "name_token_jaccard": _jac("toks_s", "toks_q"), "name_token_overlap_count": _both("toks_s", "toks_q"),
    "name_length_diff": "abs(length(clean_s) - length(clean_q))", "name_token_count_diff": "abs(len(list_distinct(toks_s)) - len(list_distinct(toks_q)))",
    "name_prefix_4_match": _flag("length(clean_s) >= 4 AND length(clean_q) >= 4 AND clean_s[1:4] = clean_q[1:4]"), "first_token_match": _flag("toks_s[1] = toks_q[1]"),
    "first_token_lev": f"CASE WHEN len(toks_s) > 0 AND len(toks_q) > 0 THEN {_lev('toks_s[1]', 'toks_q[1]')} ELSE 0 END", "first_token_skel_match": _flag(f"{_skeleton('toks_s[1]')} = {_skeleton('toks_q[1]')} AND {_skeleton('toks_s[1]')} <> ''"),
    "name_token_diff_count": f"len({_minus('toks_s', 'toks_q')}) + len({_minus('toks_q', 'toks_s')})",
    "addr_lev_sim": _there("a.lev"), "addr_jw_sim": _there("a.jaro_winkler"), "addr_fuzz_ratio": _there("a.ratio"), "addr_token_sort": _there("a.token_sort"), "addr_token_set": _there("a.token_set"),
    "addr_token_jaccard": _there(_jac("aw_s", "aw_q")), "addr_token_overlap_count": _there(_both("aw_s", "aw_q")), "addr_len_diff": "CASE WHEN addr_q <> '' AND addr_s <> '' THEN abs(length(addr_s) - length(addr_q)) ELSE length(addr_s) END",
    "addr_missing": _flag("addr_q = ''"), "primary_number_match": _flag("nums_s[1] = nums_q[1]"), "number_jaccard": _jac("nums_s", "nums_q"), "number_overlap_count": _both("nums_s", "nums_q"),
    "num_conflict": _flag(f"len(nums_s) > 0 AND len(nums_q) > 0 AND {_both('nums_s', 'nums_q')} = 0"), "postal_pin_match": _flag(f"{_both('pin_s', 'pin_q')} > 0"), "source_is_s2": _flag("q_src = 2"),
}
_grow = lambda probs: f"list_reduce(list_transform({probs}, lambda x: [1 - x, x]), lambda acc, e: list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * e[1] + CASE WHEN i > 1 THEN acc[i - 1] ELSE 0 END * e[2]), [1::DOUBLE])"
_FEATURES = ["feat_context", "feat_tokens", "feat_same_num", "feat_decoy", "feat_mindiff", "feat_uniq", "feat_ambiguity", "feat_numbers", "feat_fuzzy", "feat_tiebreaks", "feat_label"]

ORACLE |= {
    "baseline_features_38": sql("bp k_clean k_core k_addr k_compact k_skel", "SELECT *, round(name_token_sort * addr_token_sort, 6) AS name_x_addr_sim, (name_token_sort >= 0.85 AND addr_token_sort >= 0.7)::INT::DOUBLE AS name_strong_and_addr_strong, (addr_missing = 1 AND name_token_sort >= 0.85)::INT::DOUBLE AS missing_addr_strong_name FROM (SELECT s1, q, "
      + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in _FORWARD.items()) + " FROM bp JOIN k_clean n ON n.x = clean_s AND n.y = clean_q JOIN k_core c ON c.x = core_s AND c.y = core_q JOIN k_addr a ON a.x = addr_s AND a.y = addr_q JOIN k_compact o ON o.x = compact_s AND o.y = compact_q JOIN k_skel k ON k.x = skel_s AND k.y = skel_q)"),
    "features_61": sql(" ".join(["cand", *(ORACLE[f].needs for f in _FEATURES)]), "SELECT q, s1, " + ", ".join(ALL) + ", label FROM cand " + " ".join(f"JOIN ({ORACLE[f].body}) {f} USING (q, s1)" for f in _FEATURES)),
    "float_matrix": sql("cand", f"SELECT q, s1, score::FLOAT AS score, margin::FLOAT AS margin FROM cand JOIN ({ORACLE['feat_context'].body}) f USING (q, s1)"),
    "error_sample": sql(ORACLE["error_taxonomy"].needs, ORACLE["error_taxonomy"].body),
    "sample_fraction": sql("rec", f"SELECT entity_id FROM rec WHERE {_dice("'share'", 'entity_id')} < 300000"),
    "sample_with_replacement": sql("rec", f"SELECT entity_id, unnest(range(0, {_copies('0.8::DOUBLE', "'again'", 'entity_id')}))::INT AS copy FROM rec"),
    "synth_decoys": sql("marked", "SELECT src, country, to_name AS business_name, to_addr AS business_address, 'S' || src || '-SYN' || md5(q || '|' || copy) AS entity_id, CASE WHEN linked THEN 'mark' ELSE 'reshift' END AS kind FROM marked WHERE to_name <> name OR to_addr <> addr"),
    "experiment_log": sql("per per6", """SELECT '{"f05": ' || a || ', "run": 0}' AS result, 'KEEP' AS verdict FROM (SELECT round(avg(f), 6) AS a FROM per) UNION ALL
      SELECT '{"f05": ' || b || ', "run": 1}', CASE WHEN b > a THEN 'KEEP' ELSE 'REJECT' END FROM (SELECT round(avg(f), 6) AS a FROM per), (SELECT round(avg(f), 6) AS b FROM per6)"""),
    "streaming_link": sql("keys0", "SELECT o.entity_id AS q, s.entity_id AS s1, bit FROM (SELECT *, count(*) OVER (PARTITION BY country, bit, key) AS n FROM keys0 WHERE src = 1) s JOIN keys0 o USING (country, bit, key) WHERE o.src > 1 AND n <= 50"),
    "dp_decoder": sql("best", f"""WITH lists AS (SELECT s1, list(q ORDER BY p DESC, q) AS qs, list(p ORDER BY p DESC, q) AS raw, list(least(greatest(p, 0.00001), 0.99999) ORDER BY p DESC, q) AS ps FROM best GROUP BY s1),
      halves AS (SELECT s1, qs, raw, k, len(ps) AS n, {_grow('ps[1:k]')} AS h, {_grow('ps[k + 1:]')} AS t FROM (SELECT *, unnest(range(0, len(ps) + 1)) AS k FROM lists)),
      worth AS (SELECT s1, qs, raw, k, round(CASE WHEN k = 0 THEN t[1] ELSE list_sum(list_transform(range(0, k + 1), lambda x: list_sum(list_transform(range(0, n - k + 1), lambda z: h[x + 1] * t[z + 1] * 1.25 * x / (k + 0.25 * (x + z)))))) END, 12) AS v FROM halves),
      chosen AS (SELECT s1, any_value(qs) AS qs, any_value(raw) AS raw, arg_min(k, (-v, k)) AS k FROM worth GROUP BY s1)
      SELECT unnest(qs[1:k]) AS q, s1, unnest(raw[1:k]) AS p FROM chosen""".replace("WITH lists", ", lists", 1)),
}
