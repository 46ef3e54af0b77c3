"""Find many fixed phrases in a text with one regex scan, as a plain Column expression."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.functions.text import let, str_map

_SEP = "\x1f"


def _alternation(phrases: list[str]) -> str:
    """Alternatives grouped by first character, the longest of a group first."""
    groups = defaultdict(list)
    for phrase in sorted(phrases, key=len, reverse=True):
        groups[phrase[0]].append(re.escape(phrase[1:]))
    return "|".join(f"{re.escape(head)}(?:{'|'.join(tails)})" for head, tails in groups.items())


def find_phrases(text: Column, phrases: list[str], inner: str) -> Column:
    """Distinct phrases that stand in ``text`` without an ``inner`` character on either side.

    A zero-width match at each position keeps overlapping phrases. Phrases that start at the
    same place are prefixes of the longest one, so they follow from a fixed map.
    """
    if not phrases:
        return F.array().cast("array<string>")
    pattern = f"(?<![{inner}])(?=({_alternation(phrases)})(?![{inner}]))"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    boundary = re.compile(inner_class(inner))
    prefixes = {
        p: shorter
        for p in phrases
        if (shorter := [q for q in phrases if len(q) < len(p) and p.startswith(q)
                        and not boundary.match(p[len(q)])])
    }
    if not prefixes:
        return F.array_distinct(found)
    # one text per phrase instead of an array keeps the literal map flat
    nested = str_map({p: _SEP.join(shorter) for p, shorter in prefixes.items()})

    def with_prefixes(hits: Column) -> Column:
        implied = F.array_join(F.transform(hits, lambda p: F.try_element_at(nested, p)), _SEP)
        return F.array_distinct(F.concat(hits, F.split(implied, _SEP)))

    return F.filter(let(found, with_prefixes), lambda p: p != "")


def inner_class(inner: str) -> str:
    """The same character class in Python's own regex syntax."""
    return "[" + inner.replace(r"\p{L}\p{N}_", r"\w") + "]"
