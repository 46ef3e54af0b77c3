import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from hiresift.functions import text as T
from tests.helpers import column


def one(spark, value, fn):
    return column(spark, [(value,)], "x string", lambda: fn(F.col("x")))[0]


@pytest.mark.parametrize("raw,expected", [
    ("<p>a</p><br>b", "a b"), ("x &amp; y", "x & y"), ("&amp;lt;b&amp;gt;", "<b>"), ("&quot;q&#39;", "&quot;q&#39;"),
    ("a&nbsp;\n  b", "a b"), (None, ""), ("", ""), ("<unclosed", "<unclosed"),
])
def test_strip_html(spark, raw, expected):
    assert one(spark, raw, T.strip_html) == expected


def test_fast_patterns_equal_plain_ones(spark):
    rng = random.Random(11)
    some = [" ", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\x00", "a", "Z", "é", "ß", "9", "٣", "_", ".", ",", "!", "?", "-", "~", "#", "€", "\U0001f600", "字"]
    texts = [("".join(rng.choice(some) for _ in range(rng.randint(0, 25))),) for _ in range(600)]
    plain_runs, plain_rest = f"[{T.SPACE}]+", f"[^{T.WORD}{T.SPACE}.,!?-]"
    for fast, plain in ((T.RUNS, plain_runs), (T.UNKEPT, plain_rest)):
        got, want = (column(spark, texts, "x string", lambda r=r: F.regexp_replace("x", r, " ")) for r in (fast, plain))
        assert got == want
    # single spaces, which are most, are not replaced by themselves
    assert one(spark, "a b, c d", lambda x: F.regexp_count(x, F.lit(T.RUNS))) == 0


def test_clean_text_drops_symbols_and_is_idempotent(spark):
    once = one(spark, "<b>C++</b> & C#: ci/cd, Zürich (now)!", T.clean_text)
    assert once == "C C ci cd, Zürich now !"
    assert one(spark, once, T.clean_text) == once


@pytest.mark.parametrize("raw,expected", [
    (None, "unknown"), ("", "unknown"), ("  ", ""), ("Full-Time", "full_time"), (" Contract ", "contract"),
    ("External", "external"), ("\tINTERN\n", "internship"),
])
def test_job_type(spark, raw, expected):
    assert one(spark, raw, T.standardize_job_type) == expected


def test_ascii_fold_equals_unicodedata_for_every_character(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.decomposition(chr(c))]
    rows = [("a" + c + "Z",) for c in chars if not 0xAC00 <= ord(c) <= 0xD7A3]
    got = column(spark, rows, "x string", lambda: T.ascii_fold(F.col("x")))
    assert got == [unicodedata.normalize("NFKD", r[0]).encode("ascii", "ignore").decode().lower() for r in rows]


def test_strip_accents_equals_unicodedata(spark):
    rng = random.Random(1)
    alphabet = "abc éÜñøß½ﬁ…№Ⅻ日本ж́̈ÅΩ"
    rows = [("".join(rng.choices(alphabet, k=rng.randint(0, 30))),) for _ in range(300)]
    got = column(spark, rows, "x string", lambda: T.strip_accents(F.col("x")))
    want = ["".join(c for c in unicodedata.normalize("NFKD", r[0]) if not unicodedata.combining(c)) for r in rows]
    assert got == want


def test_words_and_hyphens(spark):
    assert one(spark, "A state-of-the-art -API- x1 b É-tude --", T.words_and_hyphens) == ["state-of-the-art", "api", "x1", "e-tude"]


@pytest.mark.parametrize("raw,expected", [
    ("Südwind GmbH", "sudwind"), ("SUDWIND Inc.", "sudwind"), ("Nordwind-LinkedIn", "nordwind"), ("Nordwindlinkedin", "nordwind"),
    ("LinkedIn", "linkedin"), ("abLinkedIn", "ablinkedin"), ("Café Ltd", "cafe"), ("GmbH & Co. KG", ""), (None, ""),
])
def test_company(spark, raw, expected):
    assert one(spark, raw, T.normalize_company) == expected


def key(spark, *parts):
    got = column(spark, [parts], "c string, t string, l string", lambda: T.dedup_key(F.col("c"), F.col("t"), F.col("l")))[0]
    return None if got is None else tuple(got)


@pytest.mark.parametrize("a,b,same", [
    # channel, legal form, gender tag, accents, and what follows the city do not count
    (("Bäckerei Ölmann KG", "Koch (w/m/x)", "Köln, Germany"), ("Backerei Olmann", "KOCH", "Koln"), True),
    (("Nordwind AG", "Pilot f/m/d", "Oslo"), ("nordwind-LinkedIn", "pilot", "Oslo, Norway"), True),
    # everything else does
    (("Nordwind", "Pilot", "Oslo"), ("Nordwind", "Pilot", "Bergen"), False),
    (("Nordwind", "Pilot", "Oslo"), ("Nordwind", "Copilot", "Oslo"), False),
    (("Nordwind", "Pilot", "Oslo"), ("Südwind", "Pilot", "Oslo"), False),
    (("Nordwind", "C# Pilot", "Oslo"), ("Nordwind", "C Pilot", "Oslo"), False),
])
def test_dedup_pairs(spark, a, b, same):
    assert (key(spark, *a) == key(spark, *b)) == same


def test_dedup_key_edges(spark):
    assert key(spark, "GmbH", "Pilot", "Oslo") is None
    assert key(spark, "Nordwind", None, "Oslo") is None
    assert key(spark, "Nordwind", "F# / C++ Pilot", None) == ("nordwind", "f# c++ pilot", "")


@pytest.mark.parametrize("title,tech", [
    ("Senior Data Engineer", True), ("Engineering lead", True), ("Reengineer", False), ("Office Clerk", False),
    ("DIRECTOR", False), (None, False), ("CTO", True),
])
def test_tech_title(spark, title, tech):
    assert one(spark, title, T.is_tech_title) is tech


def test_category_order(spark):
    got = column(spark, [("Data Scientist, NLP platform engineer",), ("Big Data QA engineer",), ("Chef",), (None,)],
                 "x string", lambda: T.assign_category(F.col("x")))
    assert got == ["data_science", "data_engineering", "other_tech", "other_tech"]


def test_parse_tags(spark):
    assert one(spark, " Python , SQL,, \tR ", T.parse_tags) == ["python", "sql", "r"]
    assert one(spark, None, T.parse_tags) == []
