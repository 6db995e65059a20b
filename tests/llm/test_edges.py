"""Ids of any size, repeated and null, adversarial words, batches of an index, plain versions of FTRL and order MinHash."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import minhash, mixing, similar, simhash, sketch, substrings, suffixes, toxicity, warc
from llm import windows as W
from llm.common import Stages, keyed

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
FAR = [-(2**62), 2**62, -(2**63), 2**63 - 1, 0, None]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SHAPE).repartition(3)


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def far():
    """Two texts under each far id, that share passages with one another."""
    r = random.Random(1)
    shared = [words(r, 40) for _ in range(3)]
    return [(i, f"{words(r, 30)} {shared[(k + j) % 3]} {words(r, 10)}") for k, i in enumerate(FAR) for j in range(2)]


def test_ids_of_any_size(spark, far):
    docs = table(spark, far)
    n = len(far)
    # distinct ids for the plain versions: which text of an id comes first is settled by hash
    rid = {(r.doc_id, r.text): r.rid for r in keyed(docs).collect()}
    assert len(set(rid.values())) == n
    order = sorted(far, key=lambda x: (x[0] is not None, x[0] or 0, rid[x].h))
    want = brute.substrings([(k, t) for k, (_, t) in enumerate(order)], 20)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(spark, docs).filter("doc_id is not null").collect())
    assert got == sorted((order[k][0], len(w), len(w) - len(s), " ".join(s)) for k, (w, s) in want.items() if order[k][0] is not None)
    cut = brute.repeats([(k, t) for k, (_, t) in enumerate(order)], 200)
    got = sorted((r.doc_id, r.n_removed) for r in suffixes.dedup_suffixes(spark, docs).filter("doc_id is not null").collect())
    assert got == sorted((order[k][0], sum(m)) for k, (_, m) in cut.items() if order[k][0] is not None)
    out = simhash.dedup_simhash(spark, docs).collect()
    assert len(out) == n and all(r.component_id == r.doc_id for r in out)
    assert {r.doc_id for r in mixing.draw(docs).collect()} == set(FAR)


def test_many_texts_of_one_id_keep_apart(spark):
    rows = [(1, f"text {i}") for i in range(4500)] + [(2, "text 7"), (None, "text 7")]
    keys = {tuple(r.rid) for r in keyed(table(spark, rows)).collect()}
    assert len(keys) == 4502 and sum(k[0] == 2 for k in keys) == 1


def thue_morse(levels):
    s = "a"
    for _ in range(levels):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("levels", [10, 11])
def test_words_that_fool_polynomial_hashes(spark, levels):
    one, two = thue_morse(levels)
    rows = [(0, " ".join([one] + [f"w{i}" for i in range(19)])), (1, " ".join([two] + [f"w{i}" for i in range(19)]))]
    assert [r.n_removed for r in substrings.dedup_substrings(spark, table(spark, rows)).collect()] == [0, 0]
    assert sum(r.n_removed for r in suffixes.dedup_suffixes(spark, table(spark, rows)).collect()) == sum(sum(m) for _, m in brute.repeats(rows, 200).values())


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(W.pieces, "__defaults__", (700,))
    r = random.Random(2)
    p = words(r, 400)
    rows = [(i, f"{words(r, 300)} {p} {words(r, 200)}") for i in range(3)]
    symbols = [W.word_symbols(t.encode())[0] for _, t in rows]
    short = W.all_runs(symbols, 20, 5)
    monkeypatch.undo()
    whole = W.all_runs(symbols, 20, 5)
    covered = lambda x: sorted((d, w, a) for d, s, e, a in zip(*(x[c].tolist() for c in ("doc", "start", "stop", "anchor"))) for w in range(s, e))
    assert covered(short) == covered(whole)


def test_very_long_text(spark):
    r = random.Random(3)
    p = words(r, 60)
    long = f"{words(r, 330_000)} {p} {words(r, 20)}"
    assert len(long) > W.PIECE
    got = {x.doc_id: x.n_removed for x in substrings.dedup_substrings(spark, table(spark, [(0, p), (1, long)])).collect()}
    assert got == {0: 0, 1: 60}
    n = len(p)
    got = {x.doc_id: x.n_removed for x in suffixes.dedup_suffixes(spark, table(spark, [(0, p), (1, long)]), batches=1).collect()}
    assert got[0] == n and n <= got[1] <= n + 2


def index(spark, name, parts):
    family = suffixes.Family(Stages(spark, name))
    for p in parts:
        family.add(p)
    out = sorted((r.kh, r.sx) for r in family.live().collect())
    levels = {size: spark.table(t).groupBy("kh", "suffix").count().filter("count > 1").count() for size, t in family.levels.items()}
    n = sum(spark.table(t).count() for t in family.levels.values())
    family.drop()
    return out, levels, n


def test_batches_of_an_index_equal_one(spark):
    r = random.Random(4)
    shared = [words(r, 60) for _ in range(4)]
    rows = [(i, f"{words(r, 40)} {shared[i % 4]} {words(r, 40)}") for i in range(40)]
    docs = keyed(table(spark, rows))
    whole, levels, n = index(spark, "one", [docs])
    assert list(levels) == [1] and whole
    for k in (2, 3, 4):
        parts = [docs.filter(F.pmod(F.xxhash64("rid"), F.lit(k)) == i) for i in range(k)]
        live, levels, _ = index(spark, f"by{k}", parts)
        assert live == whole
        assert sorted(levels) == {2: [2], 3: [1, 2], 4: [4]}[k]
        assert not any(levels.values())  # a suffix is one entry of a level


def test_order_minhash_from_its_definition(spark):
    """Fingerprints and likenesses end to end, from hashes of numbered 8-mers made one at a time."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(r.randrange(60)))) for i in range(12)] + [(12, None), (13, "abc"), (14, "abc")]

    def prints(text):
        grams = [text[j : j + 8] for j in range(max(1, len(text) - 7))] if text else []
        h = minhash.occurrence_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), 8)
        seen, names = {}, {}
        for g, x in zip(grams, h.tolist()):
            seen[g] = seen.get(g, 0) + 1
            names[g, seen[g]] = x
        assert len(set(names.values())) == len(grams)
        out = []
        high = [np.uint32(x >> 32) for x in h.tolist()]
        for a, b in zip(minhash.FACTORS[: minhash.M], minhash.SHIFTS[: minhash.M]):
            with np.errstate(over="ignore"):
                value = [int(np.uint32(x * a + b)) for x in high]
            out.append(tuple(int(h[j]) for j in sorted(sorted(range(len(value)), key=lambda j: (value[j], j))[:2])))
        return out

    like = lambda a, b: np.mean([x == y for x, y in zip(a, b)])
    got = {x.doc_id: x for x in minhash.fingerprint_neighbours(spark, table(spark, rows)).collect()}
    for at, (i, text) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        assert got[i].near_edited == pytest.approx(like(prints(text), prints(new)))
        assert got[i].near_next == pytest.approx(like(prints(text), prints(after)))
        assert (got[i].fingerprint == got[rows[(at + 1) % len(rows)][0]].fingerprint) == (prints(text) == prints(after))
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()


def test_ftrl_from_its_definition():
    r = np.random.default_rng(6)
    rows = [(np.unique(np.r_[r.integers(0, 64, 12), 64]), int(r.random() < 0.4)) for _ in range(60)]
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(2):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            at, label = rows[k]
            w = {int(i): weight(i) for i in at}
            g = 1 / (1 + np.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i, wi in w.items():
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * wi
                n[i] += g * g
    at, got = toxicity.train(rows, bits=6, epochs=2)
    want = {i: weight(i) for i in range(65) if weight(i)}
    assert at.tolist() == sorted(want) and got.tolist() == pytest.approx([want[i] for i in sorted(want)])


def test_epochs_are_permutations_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 4)
    r = random.Random(7)
    docs = spark.createDataFrame([(i, words(r, 5 + i % 9), "en", "big" if i % 10 else "small", None) for i in range(900)], SHAPE).repartition(3)
    drawn = mixing.draw(docs, block=8).cache()
    sizes = {x.source: x.blocks for x in drawn.groupBy("source").agg(F.countDistinct("block").alias("blocks")).collect()}
    last = {x.source: x.e for x in drawn.groupBy("source").agg(F.max("epoch").alias("e")).collect()}
    orders = {}
    for (source, epoch), places in {(k.source, k.epoch): k for k in drawn.groupBy("source", "epoch").agg(F.collect_set(F.struct("turn", "block")).alias("p")).collect()}.items():
        turns = sorted(map(tuple, places.p))
        assert len({t for t, _ in turns}) == len({b for _, b in turns}) == len(turns)
        if epoch < last[source]:
            assert [t for t, _ in turns] == list(range(1, sizes[source] + 1))
            orders.setdefault(source, []).append([b for _, b in turns])
    assert all(a != b for o in orders.values() for a, b in zip(o, o[1:])) and orders


def test_sketch_never_estimates_too_low(spark):
    r = random.Random(8)
    rows = [(i, " ".join(str(r.randrange(300)) for _ in range(20))) for i in range(60)]
    hashes = lambda data: (W.word_symbols(x)[0] for x in data)
    two, ten = sketch.sketch(keyed(table(spark, rows)), hashes, 10, (2, 10))
    n = {}
    for _, t in rows:
        for h in W.word_symbols(t.encode())[0].tolist():
            n[h] = n.get(h, 0) + 1
    for bitmap, least in ((two, 2), (ten, 10)):
        hit = sketch.reached(np.array(list(n), np.uint64), np.frombuffer(bitmap, np.uint8), 10)
        assert all(ok for ok, c in zip(hit, n.values()) if c >= least)


def test_outlines_never_estimate_too_low():
    r = np.random.default_rng(9)
    for _ in range(50):
        x = np.unique(r.integers(0, 2**64, r.integers(1, 900), dtype=np.uint64))
        y = np.unique(np.r_[x[: r.integers(0, len(x) + 1)], r.integers(0, 2**64, r.integers(0, 900), dtype=np.uint64)])
        if len(y):
            assert similar.shared_at_most(similar.outline(x), similar.outline(y)) >= len(np.intersect1d(x, y))


def test_pages_of_any_id_and_size(spark):
    rows = [(i, f"http://a.b/{k}", "x" * (1500 if k % 2 else 200_000)) for k, i in enumerate([-(2**62), 2**62, 2**63 - 1, -(2**63), 0, 5])]
    got = {r.page_id: r for r in warc.capture_index(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        last = max(j for j, _, h in rows if h == html)
        assert (got[i].payload_bytes, got[i].refers_to) == (len(html), None if i == last else last)
