"""Skill scalars: extraction, normalisation, required / nice split, match score."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.dims import AMBIGUOUS, DEFAULT, HINTS, NICE_HEADER, NICE_INLINE, Dims
from hiresift.functions.phrases import find_phrases
from hiresift.functions.text import SPACE, WORD, let, squeeze, str_array, str_map

# Letters beyond ASCII that a case-blind match takes for s, k and i.
_CASE_TWINS = (("ſ", "s"), ("K", "k"), ("İ", "i"), ("ı", "i"))
# Joins pieces of text so that no phrase or context pattern reaches across.
_BREAK = "\n.\n"


def extract_skills(text: Column, dims: Dims = DEFAULT) -> Column:
    """Vocabulary items in the text, in vocabulary order; null text gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    plain = [s for s in dims.skills if s not in dims.ambiguous]
    found = find_phrases(_plain_low(text), plain, WORD + "+#")
    in_context = [F.when(hits_context(text, s, dims), F.lit(s)) for s in dims.skills if s in dims.ambiguous]
    if in_context:
        found = F.concat(found, F.array(*in_context))
    return F.array_intersect(str_array(dims.skills), found)


def extract_ambiguous(text: Column, dims: Dims = DEFAULT) -> Column:
    """Only the skills that need context."""
    text = F.coalesce(text, F.lit(""))
    names = [s for s in dims.skills if s in dims.ambiguous]
    return F.array_compact(F.array(*[F.when(hits_context(text, s, dims), F.lit(s)) for s in names]))


def hits_context(text: Column, skill: str, dims: Dims = DEFAULT) -> Column:
    patterns = dims.ambiguous[skill]
    hits = F.regexp_like(text, F.lit("(?mdU)" + "|".join(patterns)))
    # look-behinds are slow, and most texts do not need them; patterns of one's own have no hint
    return F.regexp_like(text, F.lit(HINTS[skill])) & hits if patterns == AMBIGUOUS.get(skill) else hits


def normalize_skill(skill: Column, dims: Dims = DEFAULT) -> Column:
    name = squeeze(F.lower(skill))
    return let(name, lambda n: F.coalesce(F.try_element_at(str_map(dims.synonyms), n), n))


def normalize_skills(skills: Column, dims: Dims = DEFAULT) -> Column:
    """Normalised names of an array, without blanks and repeats, first occurrence first."""
    names = F.transform(skills, lambda s: normalize_skill(s, dims))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def split_list(text: Column) -> Column:
    """Comma list -> array; null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), ",")


def known_skills(tags: Column, dims: Dims = DEFAULT) -> Column:
    """Normalised tags that are in the vocabulary."""
    return F.array_intersect(normalize_skills(split_list(tags), dims), str_array(dims.skills))


def split_required_nice(description: Column, skills: Column, dims: Dims = DEFAULT) -> Column:
    """struct(required, nice) of a skill array, by the wording of the description.

    All sentences of one kind are joined and scanned once; the break between them stops any
    phrase or context pattern from reaching across.
    """
    text = F.coalesce(description, F.lit(""))
    header, inline = _marker(NICE_HEADER), _marker(NICE_INLINE)
    none = str_array([])
    all_required = F.struct(skills.alias("required"), none.alias("nice"))

    def pieces(head: Column) -> Column:
        tail = F.substring(text, F.length(head) + 1, F.length(text))
        return let(F.split(head, rf"(?<=[.!?;])[{SPACE}]+"), lambda sentences: F.struct(
            F.array_join(F.filter(sentences, lambda s: ~F.regexp_like(s, F.lit(inline))), _BREAK).alias("needed"),
            F.array_join(F.concat(
                F.filter(sentences, lambda s: F.regexp_like(s, F.lit(inline))), F.array(tail)
            ), _BREAK).alias("extra"),
        ))

    def split(part: Column) -> Column:
        # of the skills in the extra part, those that are not needed; the other part is read only if there are any
        nice = let(present(skills, part["extra"], dims), lambda extra: F.when(F.size(extra) == 0, extra).otherwise(
            F.array_except(extra, present(extra, part["needed"], dims))))
        return let(nice, lambda n: let(F.array_except(skills, n), lambda r: F.when(
            F.size(r) == 0, all_required
        ).otherwise(F.struct(r.alias("required"), n.alias("nice")))))

    # texts that hold none of the skills, and those without any marker, the most frequent kinds, skip both scans
    has_marker = F.regexp_like(text, F.lit(_marker(f"{NICE_HEADER}|{NICE_INLINE}")))
    head = F.get(F.split(text, header, 2), F.lit(0))
    return F.when(
        (F.size(skills) > 0) & may_hold(skills, text, dims) & has_marker, let(let(head, pieces), split)
    ).otherwise(all_required)


def _plain_low(text: Column) -> Column:
    for twin, letter in _CASE_TWINS:
        text = F.replace(text, F.lit(twin), F.lit(letter))
    return F.lower(text)


def may_hold(skills: Column, text: Column, dims: Dims = DEFAULT) -> Column:
    """False only where no part of the text can hold one of the skills; a plain search, without a regex."""
    return let(_plain_low(text), lambda low: F.exists(skills, lambda s: s.isin(list(dims.ambiguous)) | F.contains(low, s)))


def present(skills: Column, text: Column, dims: Dims = DEFAULT) -> Column:
    """Those of a few vocabulary items that the text holds, as ``extract_skills`` finds them, by one search for each."""
    inner = WORD + "+#"

    def held(low: Column) -> Column:
        def one(s: Column) -> Column:
            plain = F.contains(low, s) & F.regexp_like(low, F.concat(F.lit(f"(?<![{inner}])\\Q"), s, F.lit(f"\\E(?![{inner}])")))
            for name in dims.ambiguous:
                plain = F.when(s == name, hits_context(text, name, dims)).otherwise(plain)
            return plain
        return F.filter(skills, one)

    return let(_plain_low(text), held)


def _marker(pattern: str) -> str:
    return "(?iuU)" + pattern


def match_score(user: Column, required: Column) -> Column:
    """struct(pct, matched, missing) of two normalised arrays; rounding is half to even."""
    def score(matched: Column) -> Column:
        n = F.size(required)
        pct = F.when(n == 0, F.lit(0)).otherwise(match_percent(F.size(matched), F.nullif(n, F.lit(0))))
        return F.struct(
            pct.cast("int").alias("pct"),
            matched.alias("matched"),
            F.array_except(required, user).alias("missing"),
        )

    return let(F.array_intersect(required, user), score)


def match_percent(n_matched: Column, n_required: Column) -> Column:
    return F.bround(n_matched / n_required * 100).cast("int")


def onehot_name(skill: str) -> str:
    return "skill_" + re.sub("[ /]", "_", skill)
