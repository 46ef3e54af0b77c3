"""Personal data under disguise, by transducers that keep offsets.

A text passes through transducers, each of which rewrites some parts and keeps for every character of its output the
span of the source that it came from:

1. characters: compatibility forms of ASCII (full-width, mathematical), decimal digits of any script, Cyrillic and Greek letters in
   words that could be read as ASCII from end to end, invisible characters, dashes and spaces between digits;
2. entities: &#64; &commat; %40 &#46; &period;
3. letters for digits (O, o, l, I, |) in numbers;
4. spelled digits in four languages, alone in runs of three or more, or between spelled dots of an address;
5. "plus" before a number;
6. at and dot: in brackets, with blanks around them, or spelled; a spelled at only with a spelled dot of the
   same language before a known top-level domain.

The detectors of the base run over the output, and a span found there is mapped to the source. It is added where it holds something
that was rewritten and no base span of its kind contains it. Base spans all stay. Where a base match fails because an identifier
runs into other digits, the parts between blanks are tried as well: the longest beginning of a phone number with 10 to 15
digits, and single blocks of 14 to 19 digits (or four of four) that pass Luhn.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiresift.llm.common import bind, id_and_text, text_batches

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

# --- detectors: all linear in the text ------------------------------------------------------------

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their @: the local part is the run before it, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[Span]:
    """Of each chain of dotted numbers the groups of four, from the left; each part at most 255."""
    for chain in NUMBERS.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def cards(text: str, again: bool = False) -> Iterator[Span]:
    for run in DIGITS.finditer(text):
        if run.end() - run.start() < 14:
            continue
        if is_card(run.group().replace(" ", "").replace("-", "")):
            yield run.span()
        elif again:
            yield from (block.span() for block in BLOCKS.finditer(text, *run.span()) if is_card(NO_DIGIT.sub("", block.group())))


BLOCKS = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")


def phones(text: str, again: bool = False) -> Iterator[Span]:
    for run in PHONE.finditer(text):
        if 10 <= len(NO_DIGIT.sub("", run.group())) <= 15:
            yield run.span()
        elif again:
            count, best, start = 0, None, run.start()
            for token in re.finditer(r"[^ ]+", run.group()):
                count += sum(c in "0123456789" for c in token.group())
                if count > 15:
                    break
                if count >= 10 and token.group()[-1] in "0123456789":
                    best = start + token.end()
            if best:
                yield start, best


BASE = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(find(text)) for kind, find in BASE.items()}


# --- transducers ----------------------------------------------------------------------------------

class Mapped:
    """A rewritten text; start[i] and end[i] are the source span of its i-th character, changed[i] whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace [s, e) by out for all pieces, which stand in order and do not overlap."""
        if not pieces:
            return
        texts, starts, ends, marks, last, size, gaps = [], [], [], [], 0, 0, []
        for s, e, out in pieces:
            size += s - last + len(out)
            if not out:
                gaps.append(size)
            texts += [self.text[last:s], out]
            starts += [self.start[last:s], np.full(len(out), self.start[s])]
            ends += [self.end[last:s], np.full(len(out), self.end[e - 1])]
            marks += [self.changed[last:s], np.ones(len(out), bool)]
            last = e
        self.text = "".join([*texts, self.text[last:]])
        self.start, self.end, self.changed = (np.concatenate([*parts, old[last:]]) for parts, old in
                                              ((starts, self.start), (ends, self.end), (marks, self.changed)))
        # what was taken out is marked on the character after it
        self.changed[[g for g in gaps if g < len(self.text)]] = True

    def source(self, s: int, e: int) -> Span:
        return int(self.start[s]), int(self.end[e - 1])


# Letters of other scripts that look like ASCII letters.
LOOKALIKE = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ",
    "ABESIJKMHOPCTYXaesijopcyxhdqw" "ABEZHIKMNOPTYXovp"))
# Characters that are not seen.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
BLANKS = "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f"
_LETTERS = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 16)
def plain_char(c: str) -> str | None:
    """The ASCII character of a compatibility form or of a decimal digit."""
    if (value := unicodedata.decimal(c, None)) is not None:
        return str(value)
    plain = unicodedata.normalize("NFKC", c)
    form = unicodedata.decomposition(c).split(" ")[0]
    return plain if form in ("<wide>", "<font>", "<small>", "<narrow>") and plain.isascii() and len(plain) == 1 else "." if c == "․" else None


def characters(m: Mapped) -> None:
    if m.text.isascii():
        return
    seen = {c for c in set(m.text) if c > "\x7f"}
    swap = {c: p for c in seen if (p := plain_char(c))}
    swap |= {c: "" for c in seen if c in UNSEEN}
    if swap:
        some = re.compile("[" + re.escape("".join(swap)) + "]")
        m.rewrite([(x.start(), x.end(), swap[x.group()]) for x in some.finditer(m.text)])
    if any(c in LOOKALIKE for c in seen):
        pieces = []
        for word in _LETTERS.finditer(m.text):
            if not word.group().isascii() and all(c < "\x80" or c in LOOKALIKE for c in word.group()):
                pieces += [(word.start() + i, word.start() + i + 1, LOOKALIKE[c]) for i, c in enumerate(word.group()) if c in LOOKALIKE]
        m.rewrite(pieces)
    if any(c in DASHES or c in BLANKS for c in seen):
        m.rewrite([(x.start(), x.end(), "-" if x.group() in DASHES else " ") for x in _BETWEEN.finditer(m.text)])


_BETWEEN = re.compile(f"(?<=[0-9)])[{DASHES}{BLANKS}](?=[(0-9])")
_ENTITY = re.compile(r"&(?:#0*64|#[xX]0*40|commat);|%40|&(?:#0*46|#[xX]0*2[eE]|period);")
_LIKE_NUMBER = re.compile(r"(?<![A-Za-z0-9|])[0-9]*[OolI|][0-9OolI|]+(?![A-Za-z0-9|])")
_MIXED = re.compile(r"[0-9][OolI|]|[OolI|][0-9]")
_AS_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}


def entities(m: Mapped) -> None:
    if "&" in m.text or "%40" in m.text:
        m.rewrite([(x.start(), x.end(), "@" if x.group() == "%40" or "64" in x.group() or "40" in x.group() or "com" in x.group() else ".")
                   for x in _ENTITY.finditer(m.text)])


def numbers(m: Mapped) -> None:
    if not _MIXED.search(m.text):
        return
    pieces = []
    for x in _LIKE_NUMBER.finditer(m.text):
        letters = [(x.start() + i, x.start() + i + 1, _AS_DIGIT[c]) for i, c in enumerate(x.group()) if c in _AS_DIGIT]
        if 2 * len(letters) <= len(x.group()):
            pieces += letters
    m.rewrite(pieces)


# Digits 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
_VALUE = {w: str(i) for line in DIGIT_WORDS for i, w in enumerate(line.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=lambda w: (-len(w), w))) + ")"
_ONE = rf"(?:(?:double|triple) )?\b{_WORD}\b"
_RUN = re.compile(rf"\b{_ONE}(?:[ ,-]{{1,2}}{_ONE}){{2,}}", re.IGNORECASE)
_PART = rf"(?:[0-9]{{1,3}}|{_WORD}(?:[ -]{_WORD}){{0,2}})"
_SPELLED_DOT = r"(?: ?[\[({<] ?(?:\.|dot|punkt|point|punto) ?[\])}>] ?| (?:dot|punkt|point|punto) )"
_CHAIN = re.compile(rf"(?<![A-Za-z0-9.]){_PART}(?:(?:\.|{_SPELLED_DOT}){_PART}){{3}}(?![A-Za-z0-9])", re.IGNORECASE)
_DOT = re.compile(_SPELLED_DOT, re.IGNORECASE)
_TOKEN = re.compile(rf"(?:(double|triple) )?\b({_WORD})\b", re.IGNORECASE)
_DOT_WORDS = frozenset(["dot", "punkt", "point", "punto"])
_BRACKETED = re.compile(r"[\[({<] ?(?:\.|dot|punkt|point|punto|at|ät|arroba|arobase|@) ?[\])}>]", re.IGNORECASE)
_SAYS_PLUS = frozenset(["plus", "más", "mas"])
_PLUS = re.compile(r"\b(?:plus|más|mas) ?(?=[0-9])", re.IGNORECASE)


_IN_RUN = frozenset([*_VALUE, "double", "triple"])


def _bare(word: str) -> str:
    return word if word[-1].isalpha() and word[0].isalpha() else word.strip("()[]{}<>.:;!?\"'+0123456789")


def _digits_in(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Each spelled digit, together with the blanks before it in its run."""
    out, last = [], None
    for x in _TOKEN.finditer(text, start, end):
        times = {None: 1, "double": 2, "triple": 3}[x.group(1) and x.group(1).lower()]
        out.append((x.start() if last is None else last, x.end(), _VALUE[x.group(2).lower()] * times))
        last = x.end()
    return out


def spelled_digits(m: Mapped) -> None:
    # plain looks at the words first: most texts hold nothing that the patterns could find
    words = m.text.lower().replace(",", " ").replace("-", " ").split()
    if sum(map(_DOT_WORDS.__contains__, words)) > 1 or _BRACKETED.search(m.text):
        pieces = []
        for chain in _CHAIN.finditer(m.text):
            at, dots = chain.start(), list(_DOT.finditer(m.text, *chain.span()))
            if len(dots) < 2 and not any(c in d.group() for d in dots for c in "[({<"):
                continue  # "1.2.3 point four"
            for dot in [*dots, None]:
                stop = dot.start() if dot else chain.end()
                for part in re.finditer(r"[^.]+", m.text[at:stop]):
                    pieces += _digits_in(m.text, at + part.start(), at + part.end())
                if dot:
                    pieces.append((*dot.span(), "."))
                    at = dot.end()
        m.rewrite(pieces)
    digits = bytes(map(_IN_RUN.__contains__, map(_bare, words)))
    if b"\1\1" in digits:
        m.rewrite([p for run in _RUN.finditer(m.text) for p in _digits_in(m.text, *run.span())])
    if not _SAYS_PLUS.isdisjoint(words):
        m.rewrite([(*x.span(), "+") for x in _PLUS.finditer(m.text)])


# Top-level domains that end an address in words; those that are common words are left out.
TOP = "com org net edu gov mil int info biz name pro app dev io ai co eu uk de fr es ch nl pl pt ru se dk fi cz jp cn br mx ca au nz example test"
_TOP = "(?:" + "|".join(TOP.split()) + ")"
_ARTICLE = r"(?!(?:the|a|an|this|that|some|any|der|die|das|le|la|les|el|los|un|une|una)\b)"
# At and dot as they are said in English, German, French and Spanish.
SAID = [("at", "dot"), ("ät|at|klammeraffe", "punkt"), ("arobase|arobas|at", "point"), ("arroba", "punto")]
_NAME = r"[A-Za-z0-9_%+-]+"
_HOST = r"[A-Za-z0-9-]+"
_PLAIN_DOT = r"(?:\.| \. )"
_IN_WORDS = [(re.compile(rf"(?<![A-Za-z0-9._%+-])(?<! {dot} ){_NAME}(?:(?:\.| {dot} ){_NAME})* (?:{at}) {_ARTICLE}{_HOST}(?:(?:\.| {dot} ){_HOST})* {dot} {_TOP}\b", re.IGNORECASE),
              re.compile(rf" ({at}|{dot}) ", re.IGNORECASE), at, dot) for at, dot in SAID]
_BRACKET_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])[ _]?[\[({<] ?(?:at|ät|arroba|arobase|@) ?[\])}>][ _]?(?=[A-Za-z0-9])", re.IGNORECASE)
_WIDE_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]) ?@ ?(?={_HOST}(?:{_PLAIN_DOT}{_HOST})*?{_PLAIN_DOT}{_TOP}\b)", re.IGNORECASE)
_AFTER_AT = re.compile(rf"(?<=@){_HOST}(?:(?:{_PLAIN_DOT}|{_SPELLED_DOT}){_HOST})+", re.IGNORECASE)
_ANY_DOT = re.compile(rf" \. |{_SPELLED_DOT}", re.IGNORECASE)
_BEFORE_AT = re.compile(r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?: ?[\[({<] ?(?:\.|dot|punkt|point|punto) ?[\])}>] ?[A-Za-z0-9_%+-]+)+(?=@)", re.IGNORECASE)
_BRACKET_DOT = re.compile(r" ?[\[({<] ?(?:\.|dot|punkt|point|punto) ?[\])}>] ?", re.IGNORECASE)
_KNOWN_END = re.compile(rf"(?:{_PLAIN_DOT}|{_SPELLED_DOT}){_TOP}\b", re.IGNORECASE)


def at_and_dot(m: Mapped) -> None:
    low = m.text.lower()
    for pattern, word, at, dot in _IN_WORDS:
        if f" {dot} " in low and any(f" {a} " in low for a in at.split("|")):
            pieces = []
            for x in pattern.finditer(m.text):
                pieces += [(*w.span(), "@" if w.group(1).lower() in at.split("|") else ".") for w in word.finditer(m.text, *x.span())]
            m.rewrite(pieces)
    if _BRACKETED.search(m.text):
        m.rewrite([(*x.span(), "@") for x in _BRACKET_AT.finditer(m.text)])
    if "@" not in m.text:
        return
    m.rewrite([(*x.span(), "@") for x in _WIDE_AT.finditer(m.text) if len(x.group()) > 1])
    pieces = []
    for x in _AFTER_AT.finditer(m.text):
        # brackets say enough by themselves; blanks and words count before a known end, and where no plain dot came before them
        stop = max([e.end() for e in _KNOWN_END.finditer(m.text, *x.span())], default=0)
        for d in _ANY_DOT.finditer(m.text, *x.span()):
            bracket = any(c in d.group() for c in "[({<")
            if bracket or (d.end() < stop and "." not in _ANY_DOT.sub("", m.text[x.start():d.start()])):
                pieces.append((*d.span(), "."))
    m.rewrite(pieces)
    m.rewrite([(*d.span(), ".") for x in _BEFORE_AT.finditer(m.text) for d in _BRACKET_DOT.finditer(m.text, *x.span())])


TRANSDUCERS = (characters, entities, numbers, spelled_digits, at_and_dot)


def normalise(text: str) -> Mapped:
    m = Mapped(text)
    for run in TRANSDUCERS:
        run(m)
    return m


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of the method: disguised identifiers, and those that run into other digits; none within a base span of its kind."""
    out: dict[str, set[Span]] = {kind: set() for kind in KINDS}
    out["card"] |= set(cards(text, again=True))
    out["phone"] |= set(phones(text, again=True))
    m = normalise(text)
    if m.changed.any():
        for kind, find in BASE.items():
            more = {"again": True} if kind in ("card", "phone") else {}
            out[kind] |= {m.source(s, e) for s, e in find(m.text, **more) if m.changed[s:e].any()}
    return {kind: sorted(x for x in found if not _within(x, base[kind])) for kind, found in out.items()}


def _within(span: Span, sorted_: list[Span]) -> bool:
    lo, hi = 0, len(sorted_)
    while lo < hi:  # the last base span that begins at or before this one; base spans do not overlap
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if sorted_[mid][0] <= span[0] else (lo, mid)
    return lo > 0 and sorted_[lo - 1][1] >= span[1]


def written(spans: dict[str, list[Span]]) -> str:
    rows = sorted((s, k, e) for k, kind in enumerate(KINDS) for s, e in spans[kind])
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        found = []
        for text in texts:
            base = base_spans(text)
            more = added_spans(text, base)
            found.append((*(len(base[k]) for k in KINDS), written(base), written({k: base[k] + more[k] for k in KINDS})))
        columns = list(zip(*found))
        digests = [hashlib.sha256(b.encode()).hexdigest() for b in columns[4]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(digests), pa.array(columns[5])],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_spans, base_sha256, spans (all).

    Spans are written kind:start:end in code points, the end exclusive, by start, then kind, then end, joined by commas. A null
    text is empty and has no spans; repeated rows and null ids come out as they went in. Every text is scanned whole, in time linear in its length.
    Only doc_id and text are read, so other columns may have any names; an empty table gives an empty one.
    """
    more = ", ".join(f"n_{k} long" for k in KINDS)
    return id_and_text(docs).mapInArrow(bind(_scan), f"doc_id long, {more}, base_spans string, base_sha256 string, spans string")
