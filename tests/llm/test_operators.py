"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import json
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from llm import bpe, covertree, minhash, mixing, simhash, substrings, suffixes, toxicity, warc
from llm.common import Stages, components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that clash with names the operators use inside.
EXTRA = ", rid long, start int, kh long, spans string, p string, score double, src string, block long, fp long, node long"


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=3, n=60):
    """Texts that share passages, copies with small edits, and the odd ones."""
    r = random.Random(seed)
    passage, base = words(r, 50), words(r, 300)
    out = []
    for i in range(n):
        w = words(r, r.randrange(5, 300), 5000)
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(20) : 50 - r.randrange(8)]
        if i % 7 == 0:
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        out.append((i, r.choice([" ", "  ", "\n"]).join(w), "en", f"s{i % 4 if i % 2 else 0}", None))
    odd = [None, "", " \t\n", "a", "a" * 5000, "ab " * 3000, "é" * 300, "Ünï cödé 日本語 " * 40, "one two", "<|endoftext|> x <|endoftext|>"]
    out += [(n + i, t, None, None, None) for i, t in enumerate(odd)]
    return out + [(n + 50 + i, out[5][1], "de", "s1", 1) for i in range(6)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(5).cache()


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Documents with clashing columns, a null id, and rows that repeat an id."""
    more = spark.createDataFrame([(None, "a null id"), (None, None), (3, "another text of id 3"), (3, "another text of id 3")], "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True).select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA[2:].split(", ")])


OPERATORS = {
    "bpe": lambda s, d: bpe.bpe_round_trip(s, d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "minhash": minhash.fingerprint_neighbours,
    "mixing": lambda s, d: mixing.draw(d),
    "mix": mixing.mix,
    "toxicity": lambda s, d: toxicity.score_toxicity(s, d, s.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")),
    "counts": lambda s, d: bpe.token_counts(s, d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
    "suffixes": suffixes.dedup_suffixes,
    "substrings": substrings.dedup_substrings,
    "simhash": simhash.dedup_simhash,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_repeated_ids(spark, clashing, name):
    out = OPERATORS[name](spark, clashing)
    n = out.count()
    if name not in ("mixing", "mix"):
        assert n == clashing.count()
        assert out.filter("doc_id is null").count() == 2
    else:
        assert n > 0


def test_substrings(spark, docs, rows):
    got = {r.doc_id: r for r in substrings.dedup_substrings(spark, docs).collect()}
    for i, (w, kept) in brute.substrings([x[:2] for x in rows], 20).items():
        text = " ".join(kept)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(w) - len(kept), text)
        assert got[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 3])
def test_suffixes(spark, docs, rows, batches):
    got = {r.doc_id: r for r in suffixes.dedup_suffixes(spark, docs, batches=batches).collect()}
    for i, (x, gone) in brute.repeats([x[:2] for x in rows], 200).items():
        kept = bytes(c for c, g in zip(x, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(x), sum(gone), kept)
        assert got[i].n_spans == sum(b and not a for a, b in zip([False, *gone], gone))


def plain_fingerprint(text):
    w = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("bucket", [1, 32])
def test_simhash(spark, docs, rows, bucket, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    got = {r.doc_id: r for r in simhash.dedup_simhash(spark, docs).collect()}
    fp = [plain_fingerprint(t) for _, t, *_ in rows]
    linked = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2]
    root = brute.classes(len(fp), linked)
    assert any(a != b for a, b in zip(root, range(len(fp))))
    for (i, *_), f, c in zip(rows, fp, root):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", rows[c][0])


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = dict(map(tuple, components(Stages(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()))
    root = brute.classes(300, edges)
    assert got == {n: root[n] for e in edges if e[0] != e[1] for n in e}


def test_bpe_is_the_librarys(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in OPERATORS["bpe"](spark, docs).collect()}
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert (got[i].ids, got[i].n_tokens, bytes(got[i].decoded)) == (ids, len(ids), (text or "").encode())


def test_token_counts_are_the_librarys(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in OPERATORS["counts"](spark, docs).collect()}
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 1024, len((text or "").encode()))


def plain_sketch(text, k, m):
    """Order MinHash from its definition, with the module's hash of a numbered k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = minhash.occurrence_hashes(codes, k)
    grams = [text[j : j + k] for j in range(max(1, len(text) - k + 1))] if text else []
    assert len(h) == len(grams) and len(set(h.tolist())) == len(h)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(minhash.FACTORS[:m], minhash.SHIFTS[:m]):
        value = x * a + b
        pick = sorted(sorted(range(len(x)), key=lambda j: (value[j], j))[:2])
        out.append(tuple(h[j] for j in pick))
    return out


def test_minhash_selects_in_text_order():
    r = random.Random(4)
    for text in ["abc", "abababababababab", "x" * 40, "".join(r.choice("abcd") for _ in range(500))]:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        plain, got = plain_sketch(text, 8, 16), minhash.order_minhash(codes, 8, 16)
        assert len({p for p in plain}) == len(set(got.tolist()))
        assert [a == b for a in plain for b in plain] == [bool(a == b) for a in got for b in got]


def test_minhash_parts_agree(monkeypatch):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(3000))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    whole = minhash.order_minhash(codes)
    monkeypatch.setattr(minhash, "PART", 100)
    assert (minhash.order_minhash(codes) == whole).all()


def test_minhash_neighbours(spark, docs, rows):
    got = {r.doc_id: r for r in minhash.fingerprint_neighbours(spark, docs).collect()}
    order = sorted(rows, key=lambda x: x[0])
    for at, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert got[i].near_edited == 1 or new != text
        assert got[i].near_next == (np.mean([got[i].fingerprint[c : c + 16] == got[order[(at + 1) % len(order)][0]].fingerprint[c : c + 16] for c in range(0, 768, 16)]))
    same = [x[0] for x in rows if x[1] == rows[5][1]]
    assert len({got[i].fingerprint for i in same}) == 1 and len(same) > 5


def vectors():
    r = np.random.default_rng(1)
    x = r.normal(size=(150, 16))
    x[40:60] = x[40] + 0.05 * r.normal(size=(20, 16))
    x[70:75] = x[70]
    out = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    out += [(150, None, 0), (151, [0.0] * 16, 0), (152, [float("nan")] + [1.0] * 15, 0), (153, [None] + [1.0] * 15, 0), (154, [1.0, 2.0], 0), (155, [2.0, 4.0], 0), (156, [float("inf")] * 16, 0), (157, [], 0)]
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_embeddings(spark, block):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "cid": F.lit(2), "n": F.lit(3)})
    got = {r.vec_id: r for r in covertree.link_embeddings(spark, table, block=block).collect()}
    good = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    root = brute.classes(len(rows), linked)
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in e for e in linked), root[i], root[i] == i)


def test_embeddings_of_one_id(spark):
    """Different vectors under one id or a null one have links of their own."""
    x = np.eye(6).tolist()
    rows = [(1, x[0]), (1, x[1]), (2, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0]), (None, x[2]), (None, x[3]), (None, x[4]), (5, [0.0, 0.0, 0.1, 1.0, 0.0, 0.0]), (6, [0.0, 0.0, 0.0, 1.0, 0.1, 0.0]), (7, x[5])]
    got = covertree.link_embeddings(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (None, 0, None, True), (None, 2, None, True), (None, 0, None, True), (5, 2, None, False), (6, 2, None, False), (7, 0, 7, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_embeddings(spark):
    assert covertree.link_embeddings(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_mixing_meets_its_quotas(spark, docs):
    drawn = mixing.draw(docs).cache()
    keyed = docs.select(F.coalesce("source", F.lit("\x00")).alias("src"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).alias("n"))
    sources = keyed.groupBy("src").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    plan = {r.src: r for r in mixing.weights(sources).collect()}
    got = {r.src: r for r in drawn.groupBy(F.coalesce("source", F.lit("\x00")).alias("src")).agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e")).collect()}
    w = np.array([p.weight for p in plan.values()])
    assert w.sum() == pytest.approx(1, abs=1e-6)
    assert -(w * np.log(w)).sum() >= 0.9 * np.log(len(w)) - 1e-6 or max(p.quota / p.tokens for p in plan.values()) == pytest.approx(4, rel=1e-3)
    assert all(p.quota / p.tokens <= 4.001 for p in plan.values())
    for s, p in plan.items():
        assert p.epochs * p.tokens <= got[s].n <= p.quota
    assert drawn.groupBy("doc_id", "epoch").count().filter("count > 1").isEmpty()


def test_mixing_without_words(spark):
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert mixing.draw(empty).count() == 3


def test_toxicity_learns(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = words(r, 40, 3000) + (["vile"] * 2 if bad and i % 8 else ["so", "mean"] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w) + (" you are horrid" if bad else "")))
        labels.append((i, 0, int(bad)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(spark, docs, table).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.95
    assert all(got[i].predicted == (got[i].score >= 0.7) for i in got)
    # held-out labels have no say
    other = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {x.doc_id: x.score for x in toxicity.score_toxicity(spark, docs, other).collect()} == {i: got[i].score for i in got}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(spark, docs, none).collect()} == {0.5}


def pages():
    long, other = "<p>ü\r\n\r\nWARC/1.1\r\n" + "x" * 1500, "y" * 999
    return [(1, "http://B.example.com/a", long), (2, "http://a.example.com/", long), (3, None, other), (4, "http://b.example.com/a", other), (5, "http://www.b.example.com:80/a", None), (6, "not a url", ""), (7, "http://b.example.com/a", "z" * 1000), (8, "x", long), (None, "y", "z" * 1000)]


def test_warc(spark):
    table = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "n": F.lit(1), "last": F.lit(2), "value": F.lit("v")})
    out = warc.capture_index(spark, table, per_file=2)
    got = {r.page_id: r for r in out.collect()}
    for i, _, html in pages():
        data = (html or "").encode()
        same = [p for p, _, h in pages() if h == html and p is not None]
        revisit = len(data) >= 1000 and i is not None and i != max(same)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if i is not None:
            assert (got[i].record_type, got[i].refers_to) == (("revisit", max(same)) if revisit else ("response", None))
    keys = [(r.url_key, r.captured) for r in out.collect()]
    assert keys == sorted(keys)
    assert warc.capture_index(spark, table.limit(0)).count() == 0


def test_loser_tree():
    r = random.Random(6)
    for k in range(0, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_long_words_merge_alike():
    encoder = bpe.rank_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(7)
    for text in ["a" * 3000, "".join(r.choice("abcdeions") for _ in range(2500))]:
        row = encoder.byte[np.frombuffer(text.encode(), np.uint8)]
        assert encoder.pairs._long(row).tolist() == encoder.pairs._matrix(row[None].astype(np.int32), np.zeros(1, int))[0][2].tolist()


def test_vocabulary_files_are_not_copied():
    assert json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["type"] == "BPE"
