"""Vectors for text normalisation, properties of the similarity kernels."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import similarity as K
from kinmatch.functions import text as T

NAMES = {
    "SOLOVA FÁCT L.L.C.": "solova fact lc",
    "Xylozeta Co formerly known as Cervantes Select Mountain LLC": "cervantes select mountain lc",
    "Viozeta formerly: New Delhi Communications": "new delhi comunications",
    "internationalforteanimation.com": "internationalforteanimation",
    "None": "", "   ": "", "N/A": "",
}
FINISHED = {"SOLOVA FÁCT L.L.C.": "solova fact", "Fire Master (India) Pvt (Ltd) - 9832661323": "fire master india", "lc": "lc", "": ""}
ADDRESSES = {
    "##1824 Brittany Lane, N/A, Edmond, Oklahoma": "1824 brittany ln edmond ok",
    "00806-807 Trinity Orion, GJ, Surat": "806 807 trinity orion gj surat",
    "12 MG Road, Chennai, Tamil Nadu": "12 mg rd chennai tn",
    "N°3 Rue Kant": "3 rue kant",
    "None": "",
}


def _apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column.alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_names(spark):
    assert _apply(spark, [*NAMES, None], T.name_tokens(F.col("v"))) == [*NAMES.values(), ""]


def test_addresses(spark):
    assert _apply(spark, [*ADDRESSES, None], T.addr_tokens(F.col("v"))) == [*ADDRESSES.values(), ""]


def test_finish(spark):
    empty = F.create_map().cast("map<string,string>")
    done = T.finish(T.name_tokens(F.col("v")), empty, F.array().cast("array<string>"), T.STOP)
    assert _apply(spark, [*FINISHED, None], done) == [*FINISHED.values(), ""]


def test_finish_uses_map_and_noise(spark):
    known = F.create_map(F.lit("praivet"), F.lit("pvt"))
    done = T.finish(F.col("v"), known, F.array(F.lit("shop")), T.STOP)
    assert _apply(spark, ["acme praivet shop", "shop", "praivet"], done) == ["acme", "shop", "pvt"]


def test_skeleton(spark):
    assert _apply(spark, ["Shiphwab 12", ""], T.skeleton(F.col("v"))) == ["sfvv12", ""]


SPOKEN = {"Straße": "strasse", "abc": "abc", "दिल्ली": "dillii", "Москва": "moskva", "Łódź": "lodz", "Škoda": "skoda", "Αθήνα": "athena", "подъезд": "podezd", "さくら": "sakura"}


def test_any_script_becomes_ascii(spark):
    assert _apply(spark, [*SPOKEN, None], T.plain(F.col("v"))) == [*SPOKEN.values(), None]
    assert _apply(spark, ["दिल्ली Traders Ltd", "ŠKODA ŁÓDŹ", "東京"], T.name_tokens(F.col("v"))) == ["dili traders ltd", "skoda lodz", ""]
    assert _apply(spark, ["12 улица Ленина", "5 Łódzka Street"], T.addr_tokens(F.col("v"))) == ["12 ulitsa lenina", "5 lodzka st"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    return 200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(plain_ratio(one, two), plain_ratio(both, one), plain_ratio(both, two)) if both else plain_ratio(one, two)


def plain_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n = len(a)
    best = max(plain_ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))
    return max(best, max(plain_ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n))) if len(b) == n else best


def plain_jaro(a, b):
    if a == b:
        return 1.0
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    m = len(hits)
    if not m:
        return 0.0
    turned = sum(x != b[j] for x, j in zip(hits, sorted(used))) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4]))))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


PLAIN = {"ratio": plain_ratio, "token_sort": lambda a, b: plain_ratio(*(" ".join(sorted(x.split())) for x in (a, b))), "token_set": plain_set, "partial": plain_partial, "jaro_winkler": plain_jaro}


@pytest.mark.parametrize("name", K.KERNELS)
def test_kernels_are_the_plain_ones(name):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    pairs = [("", ""), ("", "a"), ("a", ""), ("a" * 70 + "b" * 5, "a" * 60 + "c" * 20), ("x" * 64, "x" * 63 + "y"), ("ab" * 33, "ba" * 32), ("ab" * 32, "ba" * 32), ("\x00a", "a\x00")]
    for _ in range(1200):
        a = " ".join(word() for _ in range(r.randrange(6)))
        pairs.append((a, " ".join(word() for _ in range(r.randrange(6))) if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.9) + r.choice(["", "x", " ab"])))
    got = K.KERNELS[name]([p[0] for p in pairs], [p[1] for p in pairs])
    assert got.tolist() == pytest.approx([PLAIN[name](*p) for p in pairs], abs=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_kernel_properties(a, b):
    for name, k in K.KERNELS.items():
        top = 1 if name == "jaro_winkler" else 100
        x, y, z = k([a, b, a], [b, a, a]).tolist()
        assert 0 <= x <= top + 1e-9
        if name != "token_set" or a.split():
            assert z == pytest.approx(top)
        if name != "jaro_winkler":
            assert x == pytest.approx(y)


def test_kernel_values():
    one = lambda k, a, b: k([a], [b])[0]
    assert one(K.ratio, "abcd", "abxd") == 75 and one(K.token_set, "a b", "a b c") == 100 and one(K.token_set, "", "a") == 0
    assert one(K.partial, "abc", "xxabcxx") == 100
    assert one(K.jaro_winkler, "MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)


def test_similarity_of_null(spark):
    rows = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None)], "x string, y string")
    assert [r[0] for r in rows.select(K.similarity("ratio", F.col("x"), F.col("y"))).collect()] == [1.0, None, None]
