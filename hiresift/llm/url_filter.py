"""URL filters: pattern rules that are indexed by their rarest literal token.

A pattern is plain text with a few signs: a leading || begins at a host label, a leading | at the host's
start, a trailing | demands the end, * stands for any characters and ^ for a separator or the end. It is
matched against host and path written together. Any address that a pattern fits must hold the
pattern's whole literal tokens, so a rule is filed under the one that the addresses use least, and an
address runs the regular expressions of only those rules that its own tokens call up. Rules without a
whole token are filed under the empty token, which every address calls up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import bind

TOKEN = re.compile(r"[A-Za-z0-9]+")
MAX_RULE_CHARS = 32_000_000


@dataclass(frozen=True)
class Rule:
    """A host rule is known by host and path ('net/'); its longest fitting one decides before any pattern."""

    verdict: str
    pattern: str
    name: str | None = None

    @classmethod
    def host(cls, verdict: str, host: str, path: str = "") -> Rule:
        return cls(verdict, f"||{host}{path}", f"{host}{path}")


# Addresses that seldom hold prose: accounts, carts, searches, feeds, archives and media files.
DEFAULT_PATTERNS = tuple(Rule("block", p) for p in (
    "/login^", "/signin^", "/logout^", "/signup^", "/register^", "/account^", "/cart^", "/checkout^", "/wp-admin^",
    "/cgi-bin/", "/search^", "/feed/", "/rss^", "/tag/", "||ads.", "||tracker.", "||doubleclick.", "/casino^", "/porn^",
    ".zip|", ".exe|", ".gz|", ".mp4|", ".jpg|", ".png|", ".css|", ".js|", ".apk|"))


def regex_of(pattern: str) -> str:
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"\A(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], r"\A"
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    signs = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
    return head + "".join(signs.get(c) or re.escape(c) for c in body) + tail


def tokens_of(pattern: str) -> list[str]:
    """Literal tokens that every fitting address holds as whole tokens."""
    body = pattern.lstrip("|")
    bare_start, bare_end = body == pattern, not pattern.endswith("|")
    body = body.rstrip("|")
    found = []
    for m in TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else ("*" if bare_start else "/")
        after = body[m.end()] if m.end() < len(body) else ("*" if bare_end else "/")
        if before != "*" and after != "*":
            found.append(m.group())
    return found


def with_address(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path; both empty for a null address or one without '://'."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"))


def token_counts(addresses: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many addresses hold each of the rules' tokens; the tokens are bounded by the rules."""
    words = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit("([A-Za-z0-9]+)"), F.lit(1)))
    wanted = addresses.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = addresses.select(F.explode(words).alias("token")).join(F.broadcast(wanted), "token")
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    index: dict[str, list[int]] = {}
    for at, rule in enumerate(rules):
        best = min(tokens_of(rule.pattern), key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(best, []).append(at)
    return index


@lru_cache(maxsize=100_000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(regex_of(pattern))


def verdict_of(address: str, rules: tuple[Rule, ...], index: dict[str, list[int]]) -> tuple[str | None, str, str | None, int]:
    """(host rule, verdict, deciding pattern, regular expressions run)."""
    called = [i for t in {"", *TOKEN.findall(address)} for i in index.get(t, ())]
    fits = [rules[i] for i in called if _compiled(rules[i].pattern).search(address)]
    named = max((r for r in fits if r.name is not None),
                key=lambda r: (len(r.name), r.name.find("/"), r.name, r.verdict), default=None)
    if named:
        return named.name, named.verdict, named.pattern, len(called)
    for verdict in ("allow", "block"):
        found = min((r.pattern for r in fits if r.verdict == verdict), default=None)
        if found:
            return None, verdict, found, len(called)
    return None, "allow", None, len(called)


def _judge(batches, rules: tuple[Rule, ...], index: dict[str, list[int]]):
    for batch in batches:
        hosts, paths = batch.column("host"), batch.column("path")
        out = [verdict_of(h.as_py() + p.as_py(), rules, index) for h, p in zip(hosts, paths)]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        more = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), hosts, paths, *more],
                                         ["page_id", "host", "path", "rule", "verdict", "pattern", "n_tried"])


def judge(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern, n_tried.

    The longest fitting host rule decides (equal ones: the longer host, then by name); else an allowing pattern
    before a blocking one; else 'allow'. Null and strange addresses have an empty host and path and go the same
    way. Repeated rows and null ids come out as they went in; html and extra columns are not read; an empty table
    gives no rows. Rules travel with the tasks: over MAX_RULE_CHARS characters of them are refused.
    """
    if sum(len(r.pattern) for r in rules) > MAX_RULE_CHARS:
        raise ValueError("too many rules to send to every task; judge in several calls")
    addresses = with_address(pages)
    tokens = sorted({t for r in rules for t in tokens_of(r.pattern)})
    index = index_rules(rules, token_counts(addresses, tokens)) if tokens else index_rules(rules, {})
    run = bind(_judge, rules=rules, index=index)
    return addresses.drop("url").mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, pattern string, n_tried long")
