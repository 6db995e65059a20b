"""The pipeline's stages, on null and repeated ids among others, and the whole of it."""

import base64
import hashlib
import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm import similar as similar_module
from llm import toxicity as toxicity_module

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SHAPE).repartition(3)


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def kept(stage, spark, rows):
    return sorted(((x.doc_id, x.text, x.n_chars) for x in stage(spark, table(spark, rows), "").collect()), key=repr)


def sized(rows):
    return sorted(((i, t, len(t)) for i, t in rows), key=repr)


def test_simhash_stage_keeps_one_row_of_a_group(spark):
    r = random.Random(1)
    a, b, c, d, e = (words(r, 60) for _ in range(5))
    # copies under a null id, under the id of a kept row, and a document listed twice
    rows = [(None, a), (None, a), (7, a), (None, b), (1, c), (1, d), (2, d), (2, e), (3, c), (5, e), (5, e)]
    assert kept(corpus_pipeline.simhash_dedup, spark, rows) == sized([(None, a), (None, b), (1, c), (1, d), (2, e)])


def test_simhash_stage_drops_a_copy_under_a_kept_id(spark):
    r = random.Random(2)
    a, b = words(r, 60), words(r, 60)
    assert kept(corpus_pipeline.simhash_dedup, spark, [(1, a), (2, a), (2, b)]) == sized([(1, a), (2, b)])


def test_substring_stage_cuts_each_row_by_itself(spark):
    r = random.Random(3)
    p, a, b, c, d, e = (words(r, 30) for _ in range(6))
    rows = [(0, p), (4, f"{a} {p}"), (4, b), (4, p), (6, f"{p} {c}"), (6, f"{d}  {e}"), (9, p), (9, "short"), (9, None)]
    want = [(0, p, len(p)), (4, a, len(a)), (4, b, len(b)), (6, c, len(c)), (6, f"{d}  {e}", len(d) + len(e) + 2), (9, "short", 5), (9, None, None)]
    assert kept(corpus_pipeline.substring_dedup, spark, rows) == sorted(want, key=repr)


def test_substring_stage_keeps_null_ids_apart(spark):
    r = random.Random(4)
    a, b, c, d = (words(r, 30) for _ in range(4))
    got = kept(corpus_pipeline.substring_dedup, spark, [(None, f"{a} {b}"), (None, f"{c} {a}"), (None, d), (None, None), (3, f"{d} {b}"), (8, c)])
    # which of the null rows keeps the passage follows their hashes; nothing is lost or overwritten
    text = [x[1] for x in got]
    assert len(got) == 4 and sum(x[0] is None for x in got) == 4 and None in text and d in text
    left = " ".join(t for t in text if t).split()
    assert sorted(left) == sorted(f"{a} {b} {c} {d}".split())


def similar(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return 10 * len(x & y) >= 8 * len(x | y)


@pytest.mark.parametrize("bucket, rounds, block", [(32, 4, 256), (2, 4, 256), (2, 0, 256), (2, 0, 4)])
def test_simhash_stage_finds_all_similar_texts(spark, bucket, rounds, block, monkeypatch):
    monkeypatch.setattr(similar_module, "BUCKET", bucket)
    monkeypatch.setattr(similar_module, "ROUNDS", rounds)
    monkeypatch.setattr(similar_module, "FEWEST", block)
    monkeypatch.setattr(similar_module, "MOST", block)
    r = random.Random(5)
    rows, line = [], words(r, 12)
    for size in (3, 40, 90, 200):
        base = words(r, size).split()
        for edits in (0, 0, 1, 2, 3, 4, 5):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = words(r, 1)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, f"{line} {words(r, i % 3)}".strip()) for i in range(9)]
    rows += [(100, ""), (101, None), (102, " \n")]
    base = words(r, 70).split()  # a crowd: variants of one text, most of them less alike than asked
    for i in range(60):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice((1, 2, 2, 3))):
            w[at] = words(r, 1)
        rows.append((200 + i, " ".join(w)))
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if similar(rows[a][1] or "", rows[b][1] or "")]
    root = brute.classes(len(rows), linked)
    want = sorted(i for at, (i, _) in enumerate(rows) if root[at] == at)
    assert sorted(x[0] for x in kept(corpus_pipeline.simhash_dedup, spark, rows)) == want


def test_overlaps_of_sets_in_slices(monkeypatch):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 20, 40, 40, 80)]
    left, right = np.array([0, 2, 4, 6]), np.array([1, 3, 5, 0])
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
    for cells in (7, 1 << 22):
        monkeypatch.setattr(similar_module, "CELLS", cells)
        assert similar_module.overlaps(sets, left, right).tolist() == want


def test_forest_joins_labels_as_all_links_do():
    r = random.Random(7)
    for _ in range(200):
        n, m, k = r.randrange(1, 9), r.randrange(0, 9), r.randrange(1, 12)
        x, y = np.array([r.randrange(k) for _ in range(n)], int), np.array([r.randrange(k) for _ in range(m)], int)
        linked = np.array([[r.random() < 0.2 for _ in range(m)] for _ in range(n)], bool).reshape(n, m)
        every = [(x[i], y[j]) for i, j in np.argwhere(linked)]
        got = similar_module.forest(linked, x, y)
        assert all(linked[e] for e in got) and len(got) < max(2, len({*x, *y}))
        assert brute.classes(k, every) == brute.classes(k, [(x[i], y[j]) for i, j in got])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, near copies, a shared passage, null and repeated ids and a column of a clashing name."""
    r, where = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    bad, passage, rows, toxic = ["slur", "hate", "scum"], words(r, 60), [], []
    for i in range(240):
        text = words(r, 50)
        if i % 4 == 0:
            text = " ".join(f"{w} {r.choice(bad)}" for w in text.split())
        elif i % 10 == 1:
            text = f"{text} {passage}"
        elif i % 10 == 3:
            text = f"{rows[i - 1][1]} more"
        toxic.append(int(i % 4 == 0))
        rows.append((i, text, "en", f"s{i % 3}", len(text), f"x{i}"))
    rows += [(None, words(r, 30), None, None, None, None), (239, words(r, 30), "en", "s1", 1, "again"), (300, None, "en", "s0", None, None), (301, "", "en", "s0", 0, "")]
    spark.createDataFrame(rows, f"{SHAPE}, predicted string").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows, toxic


def test_toxicity_stage_takes_the_rejected_alone(spark, corpus):
    where, rows, toxic = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    got = corpus_pipeline.toxicity(spark, docs, where)
    assert got.columns == docs.columns
    left = Counter(map(tuple, got.collect()))
    scored = toxicity_module.score_toxicity(spark, docs, spark.read.parquet(f"{where}/labels.parquet")).select("doc_id", "predicted").collect()
    assert not left - Counter(rows) and sum(left.values()) == sum(x.predicted == 0 for x in scored)
    assert Counter(x[0] for x in left.elements()) == Counter(x.doc_id for x in scored if x.predicted == 0)
    assert not [x for x in left if x[0] in range(239) and toxic[x[0]]] and all(left[x] for x in rows if x[0] is None or x[0] > 239 or not toxic[x[0]])


def test_mixing_stage_repeats_whole_rows(spark, corpus):
    where, rows, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    got = corpus_pipeline.mixing(spark, docs, where)
    assert got.columns == docs.columns
    drawn = Counter(map(tuple, got.collect()))
    assert drawn and set(drawn) <= set(rows)


def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(library, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), tuple(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_tokens_stage_is_the_library(spark, corpus):
    where, rows, _ = corpus
    library = encoding()
    got = corpus_pipeline.tokens(spark, spark.read.parquet(f"{where}/documents.parquet"), where).collect()
    assert Counter((x.doc_id, x.n_tokens, tuple(x.ids), x.ids_sha256, x.decoded_sha256) for x in got) == Counter((x[0], *tokens_of(library, x[1])) for x in rows)


def test_run_is_its_stages_one_after_another(spark, corpus, tmp_path):
    where, rows, toxic = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    plain = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, where)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        plain[name] = [tuple(x) for x in docs.collect()]
    clean = [x for x in rows if not (x[0] is not None and x[0] < 240 and x[0] % 4 == 0)]
    assert Counter(plain["toxicity"]) == Counter(clean)
    one = []  # the first of each group of near copies, null and empty texts being one group
    for x in sorted(clean, key=lambda x: (x[0] is not None, x[0] or 0)):
        if not any(similar(x[1] or "", y[1] or "") or not (x[1] or y[1]) for y in one):
            one.append(x)
    assert Counter(plain["simhash near-dedup"]) == Counter(one)
    library = encoding()
    want = Counter((x[0], *tokens_of(library, x[1])) for x in plain["source mixing"])
    got = corpus_pipeline.run(spark, where).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()
    assert Counter((x[0], x[1], tuple(x[2]), x[3], x[4]) for x in got) == want
    assert set(plain["source mixing"]) <= set(plain["substring dedup"])
