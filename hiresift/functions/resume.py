"""Resume scalars: experience, education, name, e-mail, phone; text checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.dims import (
    CLAIMS, DEFAULT, EDUCATION, EMAIL, EXPERIENCE, NAME_STOP, PHONE, PLACEHOLDER, Dims,
)
from hiresift.functions.skills import extract_skills
from hiresift.functions.text import SPACE, contains_any, let, strip

_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def experience_years(text: Column) -> Column:
    """First pattern that hits, in priority order; students 0, anybody else 1."""
    low = F.lower(_text(text))
    years = [
        F.nullif(F.regexp_extract(low, "(?U)" + p, 1), F.lit("")).try_cast("bigint") for p in EXPERIENCE
    ]
    student = contains_any(low, ["fresher", "fresh graduate", "intern"])
    return F.coalesce(*years, F.when(student, F.lit(0)).otherwise(F.lit(1)).cast("bigint"))


def education(text: Column) -> Column:
    """Education keywords inside the text, in list order."""
    low = F.lower(_text(text))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in EDUCATION]))


def person_name(text: Column) -> Column:
    """First of the first five lines that looks like a name."""
    lines = F.transform(F.slice(F.split(strip(_text(text)), "\n"), 1, 5), strip)

    def plausible(line: Column) -> Column:
        size = F.length(line)
        return (
            (size > 2) & (size < 50)
            & ~F.regexp_like(line, F.lit(_DIGIT))
            & ~contains_any(F.lower(line), NAME_STOP)
        )

    return F.coalesce(F.get(F.filter(lines, plausible), F.lit(0)), F.lit("Unknown"))


def _first(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(_text(text), "(?U)" + pattern, 0)
    return F.when(hit == "", F.lit("Not found")).otherwise(hit)


def email(text: Column) -> Column:
    return _first(text, EMAIL)


def phone(text: Column) -> Column:
    return _first(text, PHONE)


def resume_record(text: Column, dims: Dims = DEFAULT) -> Column:
    skills = extract_skills(text, dims)
    return F.struct(
        person_name(text).alias("name"),
        email(text).alias("email"),
        phone(text).alias("phone"),
        skills.alias("skills"),
        F.array_join(skills, ", ").alias("skills_str"),
        experience_years(text).alias("experience_years"),
        education(text).alias("education"),
    )


def claim_flags(text: Column) -> Column:
    """One 'label: hit' entry per claim found, rules in order, hits in text order."""
    def flags(label: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(_text(text), F.lit("(?iuU)" + pattern), F.lit(0))
        return F.transform(hits, lambda h: F.concat(F.lit(f"{label}: '"), h, F.lit("'")))

    return F.concat(*[flags(label, pattern) for label, pattern in CLAIMS.items()])


def placeholder_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(PLACEHOLDER))


def word_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(f"[^{SPACE}]+"))


def keyword_context(text: Column, patterns: list[str], width: int = 40) -> Column:
    """Text around the first hit of the first pattern that hits, newlines as blanks; null if none."""
    text = _text(text)

    def window(pattern: str) -> Column:
        hit = F.regexp_substr(text, F.lit(pattern))
        before = F.get(F.split(text, pattern, 2), F.lit(0))
        return let(before, lambda b: F.concat(
            F.right(b, F.lit(width)), hit,
            F.substring(text, F.length(b) + F.length(hit) + 1, F.lit(width)),
        ))

    windows = [window("(?mdU)" + pattern) for pattern in patterns]
    return F.replace(F.coalesce(*windows), F.lit("\n"), F.lit(" "))
