"""Text scalars: HTML stripping, cleaning, folding to ASCII, tokens."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, JOB_TYPES, Dims

# Explicit classes instead of \w and \s: they mean the same as Python's Unicode-aware ones.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# Runs of blanks other than a single space, which most are and which stays as it is.
RUNS = f"(?![!-~])(?:[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+)"
# All but word characters, blanks and . , ! ? -; the letters and spaces that most characters are go by one look.
UNKEPT = f"(?![a-zA-Z ])[^{WORD}{SPACE}.,!?-]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, RUNS, " "))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def str_map(values: dict[str, str]) -> Column:
    """Literal map; parsed in one piece, which is much faster than one literal at a time."""
    return F.expr("map(" + ", ".join(_sql_text(x) for pair in values.items() for x in pair) + ")")


def str_array(values: list[str]) -> Column:
    items = ", ".join(map(_sql_text, values))
    return F.expr(f"array({items})") if values else F.expr("cast(array() as array<string>)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value that an expression needs several times, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_html(text: Column) -> Column:
    """Tags become blanks; &amp; is decoded first, so "&amp;lt;" ends as "<"."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def clean_text(text: Column) -> Column:
    """Strip HTML, then blank out all but word characters, spaces and . , ! ? -"""
    return squeeze(F.regexp_replace(strip_html(text), UNKEPT, " "))


def br_to_newline(text: Column) -> Column:
    for tag in ("<br>", "<br/>", "<br />"):
        text = F.replace(text, F.lit(tag), F.lit("\n"))
    return text


def standardize_job_type(job_type: Column, mapping: dict[str, str] = JOB_TYPES) -> Column:
    key = strip(F.lower(job_type))
    known = let(key, lambda k: F.coalesce(F.try_element_at(str_map(mapping), k), k))
    return F.when(F.coalesce(job_type, F.lit("")) == "", F.lit("unknown")).otherwise(known)


def parse_tags(tags: Column) -> Column:
    """Comma list -> array of trimmed, lower-cased, non-blank tags."""
    parts = F.transform(F.split(F.lower(F.coalesce(tags, F.lit(""))), ","), strip)
    return F.filter(parts, lambda t: t != "")


# --- folding ------------------------------------------------------------------------------------


@cache
def _folds(keep_letters: bool) -> tuple[str, str, dict[str, str]]:
    """Translate strings for one-to-one folds, and a map for one-to-many folds.

    ``keep_letters`` drops combining marks only; otherwise all that is not ASCII goes.
    Hangul syllables are left alone: they decompose by rule, not by table.
    """
    single, many = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        mark = keep_letters and unicodedata.combining(char)
        if not unicodedata.decomposition(char) and not mark:
            continue
        parts = unicodedata.normalize("NFKD", char)
        if keep_letters:
            out = "".join(c for c in parts if not unicodedata.combining(c))
        else:
            out = parts.encode("ascii", "ignore").decode("ascii")
            if not out:
                continue
        if code < 0x10000 and len(out) <= 1 and all(ord(c) < 0x10000 for c in out):
            single[char] = out
        else:
            many[char] = out
    # translate() deletes characters that have no partner, so those go last
    order = sorted(single, key=lambda c: single[c] == "")
    return "".join(order), "".join(single[c] for c in order), many


_MARK = "\uf8ff"


def _fold(text: Column, keep_letters: bool) -> Column:
    source, target, many = _folds(keep_letters)
    rare = "".join(many)
    # the map is given as one text, which Spark folds to a literal before the job starts
    table = F.str_to_map(
        F.lit("\x1e".join(f"{char}\x1f{out}" for char, out in many.items())), F.lit("\x1e"), F.lit("\x1f")
    )

    def expand(marked: Column) -> Column:
        """Put the letters of each marked character in its place."""
        return F.array_join(F.zip_with(
            F.split(text, ""), F.split(marked, ""),
            lambda c, m: F.when(m == _MARK, F.coalesce(F.try_element_at(table, c), c)).otherwise(c),
        ), "")

    # one-to-many characters become a mark at first; only texts with a mark go character by character
    folded = let(F.translate(text, rare, _MARK * len(rare)), lambda m: F.translate(
        F.when(F.contains(m, F.lit(_MARK)), expand(m)).otherwise(m), source, target
    ))
    # pure ASCII, the usual case, needs no table at all
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)


def ascii_fold(text: Column) -> Column:
    """NFKD, drop what is not ASCII, lower case; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.regexp_replace(_fold(text, keep_letters=False), r"[^\x00-\x7F]", ""))


def strip_accents(text: Column) -> Column:
    """NFKD without combining marks; letters of other scripts stay."""
    return _fold(F.coalesce(text, F.lit("")), keep_letters=True)


def normalize_words(text: Column, keep: str = "a-z0-9") -> Column:
    """Folded text with one blank between runs of the kept characters."""
    return F.trim(F.regexp_replace(ascii_fold(text), f"[^{keep}]+", " "))


# --- tokens -------------------------------------------------------------------------------------


def words_and_hyphens(text: Column) -> Column:
    """Bag-of-words tokens: lower case, no accents, two or more word characters, hyphens inside."""
    pattern = f"[{WORD}][{WORD}-]*[{WORD}]"
    return F.regexp_extract_all(folded(text), F.lit(pattern), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case, no accents: the text that tokens are cut from."""
    return F.lower(strip_accents(text))


def long_words(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def model_text(title: Column, tags: Column, description: Column) -> Column:
    """Model input: title, tags and the whole description."""
    empty = F.lit("")
    return F.concat_ws(
        " ", F.coalesce(title, empty), F.coalesce(tags, empty),
        F.coalesce(description, empty),
    )


def model_text_no_title(tags: Column, description: Column) -> Column:
    """Model input with the title hidden: tags and the whole description."""
    empty = F.lit("")
    return F.concat_ws(
        " ", F.coalesce(tags, empty), F.coalesce(description, empty)
    )


def combined_text(title: Column, description: Column, tags: Column) -> Column:
    """Text for TF-IDF."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, description, tags)])


# --- categories and relevance -------------------------------------------------------------------


def contains_any(text: Column, words: list[str]) -> Column:
    """Any word as a substring: one regex scan instead of one search per word."""
    return F.regexp_like(text, F.lit("|".join(map(re.escape, words))))


def is_relevant(title: Column, tags: Column, description: Column, dims: Dims = DEFAULT) -> Column:
    """Any keyword is a substring; short ones such as "it" make this nearly always true."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, tags, description)]))
    return contains_any(text, dims.relevant)


def is_tech_title(title: Column, dims: Dims = DEFAULT) -> Column:
    """Any title phrase as whole words; a null title is not tech."""
    phrases = "|".join(map(re.escape, sorted(dims.tech_titles, key=len, reverse=True)))
    pattern = f"(?<![{WORD}])(?:{phrases})(?![{WORD}])"
    return F.regexp_like(F.lower(F.coalesce(title, F.lit(""))), F.lit(pattern))


def assign_category(title: Column, dims: Dims = DEFAULT) -> Column:
    """First category in rule order with a keyword inside the title."""
    from hiresift.dims import OTHER_CATEGORY

    text = F.lower(F.coalesce(title, F.lit("")))
    return let(text, lambda t: F.coalesce(*[
        F.when(contains_any(t, words), F.lit(name)) for name, words in dims.categories.items()
    ], F.lit(OTHER_CATEGORY)))


# --- duplicate keys -----------------------------------------------------------------------------


def normalize_company(name: Column) -> Column:
    """Folded name without legal forms, squashed; a channel suffix goes if 3 characters remain."""
    from hiresift.dims import CHANNEL_SUFFIXES, LEGAL_FORMS

    padded = F.concat(F.lit(" "), normalize_words(name), F.lit(" "))
    bare = F.regexp_replace(padded, f" (?:{'|'.join(LEGAL_FORMS)})(?= )", "")
    out = F.replace(bare, F.lit(" "), F.lit(""))
    for suffix in CHANNEL_SUFFIXES:
        out = F.regexp_replace(out, f"^(.{{3,}}){suffix}$", "$1")
    return out


def normalize_title(title: Column) -> Column:
    from hiresift.dims import GENDER_TAG

    text = F.regexp_replace(ascii_fold(title), GENDER_TAG, " ")
    return F.trim(F.regexp_replace(text, "[^a-z0-9+#]+", " "))


def normalize_city(location: Column) -> Column:
    """Folded words before the first comma."""
    first = F.substring_index(ascii_fold(location), ",", 1)
    return F.trim(F.regexp_replace(first, "[^a-z0-9]+", " "))


def dedup_key(company: Column, title: Column, location: Column) -> Column:
    """Same company, title and city mean the same job; null if company or title is empty."""
    key = F.struct(
        normalize_company(company).alias("company"), normalize_title(title).alias("title"),
        normalize_city(location).alias("city"),
    )
    return let(key, lambda k: F.when((k["company"] != "") & (k["title"] != ""), k))
