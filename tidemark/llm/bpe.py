"""Operator 9: BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands side by side in no vocabulary token can never be joined by a merge, so the place between
them is a certain cut. Every pre-token is cut there, the fragments are merged on their own, and their ids are put
together again. This module has the rules, for one text at a time; `bpe_batch` applies them to tables, many words at once.

The vocabulary file (BPE with word ends, lower case) is a parameter and is opened in the tasks that use it.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm.shared import give_back

#: The white space that the vocabulary's pattern `\s` means.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _planes() -> Iterator[str]:
    """All code points, 65,536 in a string: the library keeps several bytes for each of a string's."""
    for low in range(0, sys.maxunicode + 1, 1 << 16):
        yield "".join([chr(c) for c in range(low, low + (1 << 16)) if not 0xD800 <= c <= 0xDFFF])


def _ranges(kind: str) -> str:
    """A character class's body with every code point of the property `kind`, by the Unicode tables of the tokenizers library."""
    split = pre_tokenizers.Split(Regex(f"\\p{{{kind}}}+"), "removed", invert=True)
    runs = [run for plane in _planes() for run, _ in split.pre_tokenize_str(plane)]
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run in runs)


def _unknown() -> str:
    """A character class's body with the code points that Python's Unicode tables do not know and the library's may."""
    edges: list[int] = []
    for c in range(sys.maxunicode + 1):
        if (unicodedata.category(chr(c)) == "Cn") != len(edges) % 2:
            edges.append(c)
    if len(edges) % 2:
        edges.append(sys.maxunicode + 1)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class _Ranks(dict):
    """(left, right) -> rank of the merge; pairs without one rank last and are not kept."""

    def __missing__(self, pair):
        return sys.maxsize


class ForcedBoundaryBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = _Ranks(((a, b), r) for r, (a, b) in enumerate(merges))
        self.joined = [a + b for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.inner: set[tuple[str, str]] = set()
        for token in vocab:
            body = token.removesuffix(self.end)
            self.inner.update(zip(body, body[1:]))
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letter, number = _ranges("L"), _ranges("N")
        self._white = re.compile(f"[{WHITE}]+")
        self._plain = re.compile("[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r a-z0-9]+")  # the same for lower-case ASCII
        self._unknown = re.compile(f"[{_unknown()}]")
        self._normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        # Letters first: no other alternative begins with one, so the order among the rest decides alone.
        self._parts = re.compile(f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{WHITE}{letter}{number}]+")

    def cuts(self, word: str) -> list[str]:
        """The word (in byte letters) cut wherever two neighbours stand side by side in no token."""
        inner = self.inner
        if inner.issuperset(zip(word, word[1:])):
            return [word]
        places = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in inner]
        return [word[a:b] for a, b in zip([0, *places], [*places, len(word)], strict=True)]

    def _merge(self, fragment: str, last: bool) -> tuple[str, ...]:
        """Join the best-ranked pair, all its places from the left, until none is left. Long fragments use a heap."""
        parts = list(fragment)
        if last:
            parts[-1] += self.end
        if len(parts) > 64:
            return self._merge_long(parts)
        rank, joined = self.ranks.__getitem__, self.joined
        found = list(map(rank, zip(parts, parts[1:])))
        while found and (best := min(found)) != sys.maxsize:
            at = found.index(best)
            parts[at : at + 2] = [joined[best]]
            del found[at]
            if at:
                found[at - 1] = rank((parts[at - 1], parts[at]))
            if at < len(found):
                found[at] = rank((parts[at], parts[at + 1]))
        return tuple(parts)

    def _merge_long(self, parts: list[str]) -> tuple[str, ...]:
        import heapq

        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.ranks]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if not live[i] or j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i] += parts[j]
            live[j], right[i] = False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], a, p))
        return tuple(p for p, alive in zip(parts, live, strict=True) if alive)

    def _stretches(self, text: str) -> list[str]:
        """Normalise a text without special tokens and part it at white space, which no pre-token crosses."""
        if not text.isascii() and self._unknown.search("".join(set(text))):
            text = self._normalizer.normalize_str(text)
        elif not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white to str.split, not to the vocabulary
            return [w for w in self._white.split(text) if w]
        return text.split()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the vocabulary has no decoder of its own."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=1)
def encoder(path: str) -> ForcedBoundaryBpe:
    """The encoder of a Python worker, for the vocabulary file it was last asked for."""
    made = ForcedBoundaryBpe(path)
    gc.collect()
    gc.freeze()  # the vocabulary stays: the collector need not walk it again and again
    give_back()
    return made
