"""Token ids of whole texts by a byte-level BPE file, with a cache of parts.

The tokenizer splits a text into pre-tokens and encodes each on its own. A lone space between two other
characters always begins a pre-token and a line break always ends one, so a text of plain Latin characters is
split at spaces and line breaks, and each distinct part is encoded once by the library. A plain text whose spaces
stand otherwise is split by the tokenizer's own rule; a text with any other character goes to the library in
large parts, and one that holds the string of an added token (such as an end mark) goes there whole. Ids are the same
either way.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from operator import methodcaller

import numpy as np

from hiresift.llm.common import ranges

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
UNUSUAL = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]")
PRE_TOKEN = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
CACHE_WORDS = 1_000_000
PIECE_CHARS = 1_000_000
# Where spaces stand otherwise than alone between two other characters.
OTHER_SPACE = ("  ", " \n", "\n ", "\t", "\r")
CUT = re.compile(r"(?<=\S) (?=\S)")
BREAKS = re.compile(r"(\n+)")
# Names in the cache: a part that follows a space stands as it is, anything else after this mark, which no such part holds.
BARE = "\n"
FLUSH_PARTS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts(text: str):
    start = 0
    while len(text) - start > PIECE_CHARS:
        at = CUT.search(text, start + PIECE_CHARS)
        if at is None:
            break
        yield text[start:at.start()]
        start = at.start()
    yield text[start:] if start else text


def _is_plain(text: str) -> bool:
    if text.isascii() and text.replace("\n", " ").isprintable():
        return True
    return UNUSUAL.search(text) is None


class Index(dict):
    """Numbers of names in the order they are asked for; ``new`` holds those that were not known."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self.new.append(name)
        number = self[name] = len(self)
        return number


class Encoder:
    """encode(texts) -> (all ids, number of ids of each text)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced = [t for t in self.added if " " in t]  # these could arise where parts are joined
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)  # byte-level tokens have one character for each byte
        self._clear()

    def _clear(self) -> None:
        self.index = Index()
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _trim(self) -> None:
        """Forget the parts that were used once, and all if that leaves too much."""
        names = list(self.index)
        keep = np.flatnonzero(self.uses[:len(names)] > 1)
        sizes = self.sizes[keep]
        if len(keep) > CACHE_WORDS // 2 or sizes.sum() > 4 * CACHE_WORDS:
            return self._clear()
        flat, uses = self.flat[ranges(self.starts[keep], sizes)], self.uses[keep] // 2
        self._clear()
        self._room(0, len(keep), len(flat))
        self.index.update(zip((names[k] for k in keep), range(len(keep))))
        self.starts[:len(keep)], self.sizes[:len(keep)], self.uses[:len(keep)] = np.cumsum(sizes) - sizes, sizes, uses
        self.flat[:len(flat)], self.used = flat, len(flat)

    def _room(self, first: int, names: int, ids: int) -> None:
        while first + names > len(self.starts):
            self.starts, self.sizes, self.uses = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes, self.uses))
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])

    def _learn(self, names: list[str], first: int) -> None:
        """Encode names whose numbers begin at first; those that follow a space go to the library joined."""
        bare = np.fromiter(map(methodcaller("startswith", BARE), names), bool, len(names))
        for joined in (False, True):
            chosen = np.flatnonzero(bare != joined)
            for part in (chosen[got:got + 20_000] for got in range(0, len(chosen), 20_000)):
                texts = [names[k] for k in part] if joined else [names[k][1:] for k in part]
                flat, sizes = self._joined(texts) if joined else self._single(texts)
                self._room(first, len(names), len(flat))
                self.starts[first + part] = self.used + np.cumsum(sizes) - sizes
                self.sizes[first + part] = sizes
                self.flat[self.used:self.used + len(flat)] = flat
                self.used += len(flat)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts)
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each after a space, and their number: an id stands for a fixed number of bytes, which tells parts apart."""
        texts = [" " + " ".join(parts[i:i + 256]) for i in range(0, len(parts), 256)]
        if any(t in text for t in self.spaced for text in texts):
            return self._single([" " + x for x in parts])
        flat = np.concatenate(self._ids(texts))
        sizes = map(len, parts if all(map(str.isascii, texts)) else map(str.encode, parts))
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(parts)) + 1)
        reached = np.cumsum(self.bytes[flat])
        last = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[last] != ends).any():
            return self._single([" " + x for x in parts])
        return flat, np.diff(last, prepend=-1)

    def _some(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE_WORDS or self.used > 8 * CACHE_WORDS:
            self._trim()
        index, first = self.index, len(self.index)
        at = np.fromiter(map(index.__getitem__, names), np.int64, len(names))
        if index.new:
            self._learn(index.new, first)
            index.new.clear()
        self.uses += np.bincount(at, minlength=len(self.uses))
        return self.flat[ranges(self.starts[at], self.sizes[at])], self.sizes[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], np.zeros(len(texts), np.int64)
        names: list[str] = []
        ends: list[tuple[int, int]] = []

        def flush() -> None:
            if names:
                got, sizes = self._some(names)
                ids.append(got)
                total = np.concatenate([[0], np.cumsum(sizes)])
                begin = 0
                for row, end in ends:
                    counts[row] += total[end] - total[begin]
                    begin = end
            names.clear()
            ends.clear()

        for row, text in enumerate(texts):
            if any(t in text for t in self.added):
                flush()
                ids.extend(self._ids([text]))
                counts[row] = len(ids[-1])
                continue
            plain = _is_plain(text)
            lone = plain and not any(x in text for x in OTHER_SPACE) and text[:1] != " " != text[-1:]
            for piece in _cuts(text):
                if lone:
                    lines = BREAKS.split(piece)
                    for k, line in enumerate(lines):
                        if k % 2:
                            # The last break before a character is a pre-token of its own.
                            more = lines[k + 1] != ""
                            names.extend(BARE + x for x in ((line[1:], "\n") if more else (line,)) if x)
                        else:
                            first, *parts = line.split(" ")
                            if first:
                                names.append(BARE + first)
                            names.extend(parts)
                elif piece:
                    names.extend(BARE + x for x in (PRE_TOKEN.findall(piece) if plain else [piece]))
                ends.append((row, len(names)))
                if len(names) > FLUSH_PARTS:
                    flush()
        flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder for each Python worker, so that its cache serves all tasks of the worker; the default path is that of the worker."""
    return Encoder(path or default_path())
