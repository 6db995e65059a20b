"""Text normalisation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch import config as C
from kinmatch.functions.similarity import transliterate

ALIAS = r"(?i)^.*\b(?:" + "|".join(C.ALIAS_PHRASES) + r")\b[\s:.\-]*"


def squeeze(c: Column) -> Column:
    """Single blanks between words, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def latin(c: Column) -> Column:
    """Lower case without Latin marks, on the JVM."""
    c = F.translate(F.lower(c), C.LATIN_FROM, C.LATIN_TO)
    for a, b in C.LATIN_DOUBLE.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain(c: Column) -> Column:
    """Lower-case ASCII of any script.  Only what is left of other scripts than Latin goes through Arrow."""
    t = latin(c)
    return F.coalesce(transliterate(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def present(c: Column) -> Column:
    """The trimmed text; missing, blank and stand-ins for missing are ''."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(C.NULL_LITERALS), "").otherwise(t)


def single_letters(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z])\1+", "$1")


def name_tokens(c: Column) -> Column:
    t = present(c)
    rest = F.regexp_replace(t, ALIAS, "")
    t = plain(F.when(F.trim(rest) != "", rest).otherwise(t))
    # The patterns that a name loses.
    t = F.regexp_replace(t, r"\bwww\.|\.(?:com|net|org|in|co|fr|us|biz|info)\b|@", " ")
    t = F.regexp_replace(t, r"[0-9]{6,}", " ")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[.'`]", "")
    return single_letters(F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " ")))


def addr_tokens(c: Column) -> Column:
    # The patterns that an address loses.
    t = F.regexp_replace(plain(F.regexp_replace(present(c), r"(?i)\bn°", " ")), r"\bn/a\b|\bndeg", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", " "), r"\b0+([0-9])", "$1")
    short = t
    for phrase, to in C.ADDRESS_PHRASES.items():
        short = F.regexp_replace(short, rf"\b{phrase}\b", to)
    # one pass finds the few rows that have a phrase at all
    t = F.when(t.rlike(rf"\b(?:{'|'.join(C.ADDRESS_PHRASES)})\b"), short).otherwise(t)
    words = F.filter(F.split(F.trim(t), " "), lambda w: (w != "") & ~w.isin("none", "na"))
    short = F.create_map(*[F.lit(x) for kv in C.ADDRESS_WORDS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def words(c: Column) -> Column:
    """Words of a normalised text, none for ''."""
    return F.filter(F.split(c, " "), lambda w: w != "")


STOP = sorted({re.sub(r"([a-z])\1+", r"\1", w) for w in C.NAME_STOP})


def finish(tokens: Column, known: Column, noise: Column, stop: list[str]) -> Column:
    """Tokens through the map of spellings, without stop and noise words.  Where nothing is left: without stop words only; then all."""
    mapped = F.transform(words(tokens), lambda w: F.coalesce(F.try_element_at(known, w), w))
    stops = F.array(*map(F.lit, stop)).cast("array<string>")
    plain = F.filter(mapped, lambda w: ~F.array_contains(stops, w))
    best = F.filter(plain, lambda w: ~F.array_contains(noise, w))
    pick = F.when(F.size(best) > 0, best).when(F.size(plain) > 0, plain).otherwise(mapped)
    return F.array_join(pick, " ")


def skeleton(c: Column) -> Column:
    """Consonants and digits, with spellings of one sound folded."""
    t = F.lower(c)
    for a, b in (("sh", "s"), ("ph", "f"), ("w", "v"), ("b", "v")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, "[^b-df-hj-np-tv-z0-9]", "")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b([0-9]+)\b", 1), F.lit(""))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), 0))
