"""Operator 2: personal data by fixed patterns and a semi-Markov conditional random field.

The base spans are what the fixed patterns find. The random field adds spans that no pattern reaches, such as telephone
numbers without a plus sign, addresses written with (at) and (dot), or card numbers grouped by dots. It scores whole
candidate spans by features of the span (digits, check digit, shape, neighbours), and a dynamic program over the tokens
of a zone, with a bound on a span's tokens, chooses boundaries and kinds together. Its weights are fitted in numpy by
gradient ascent on the likelihood of generated sentences, from a fixed seed.

A text without a digit, an @, or a bracket that "at" or "dot" follows holds nothing for either; that is seen from the
bytes of a whole batch at once.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import give_back, lean, small_batches, text_pieces

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")

#: Tokens a candidate span may hold.
MAX_TOKENS = 16

#: Characters that a zone reaches beyond its outermost digits and signs, before it goes on to the end of the word.
NEAR = 24

#: A span is added if its posterior probability reaches its kind's cut. Cuts come from held-out sentences: the lowest from
#: which on this share of what is added is right, between these bounds.
PRECISION, LEAST_CUT, MOST_CUT = 0.995, 0.5, 0.9

Span = tuple[int, int, int]  # kind's place in KINDS, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[*b"0123456789@"]] = True
_BRACKET = np.zeros(256, bool)
_BRACKET[[*b"([{"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the address pattern, found from each @ so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield 0, start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind; failing matches are dropped without a retry."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---- the random field ------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[ \t]+|[^0-9A-Za-z \t]")
_LINK = re.compile(r"[ \t]{1,2}|[-.()+@/_\[\]{}]")
_SIGN = re.compile(r"(?:at|dot)", re.IGNORECASE)
_SIGNED_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.IGNORECASE)
_SIGNED_DOT = re.compile(r"\.|[\[({] ?dot ?[\])}]", re.IGNORECASE)
_OBFUSCATED = re.compile(r"[a-z0-9._%+-]+ ?(?:@|[\[({] ?at ?[\])}]) ?[a-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[a-z0-9-]+)+\Z", re.IGNORECASE)

_PHONED = re.compile(r"(?<![a-z])(?:tel|telephone|phone|call|fax|mobile|cell)[:. ]{1,3}\Z", re.IGNORECASE)
_NAMED = re.compile(r"(?<![a-z])(?:card|mail|e-mail|email|ip|host|visa|address)[:. ]{1,3}\Z", re.IGNORECASE)
_SPACED = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}\Z")

FEATURES = (
    "bias", "tokens", "is_address", "at_sign", "dot_sign", "letters", "digits_7", "digits_10", "digits_11", "digits_16_19", "digits_13_15", "digits_other",
    "luhn", "not_luhn", "four_parts", "parts_to_255", "phone_groups", "area_brackets", "equal_groups", "one_run", "joined_left", "joined_right", "edge_mark", "mixed_marks", "word_before", "long_group", "phone_word", "spaced_parts", "digits_15",
)


def span_features(text: str, start: int, end: int) -> np.ndarray:
    """FEATURES of the whole span text[start:end]."""
    span = text[start:end]
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups]
    marks = {c for c in span if not c.isalnum()}
    letters = any(c.isalpha() for c in span)
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    ahead = text[max(0, start - 16) : start]
    return np.array([
        1, len(groups) / 4, bool(_OBFUSCATED.match(span)), bool(_SIGNED_AT.search(span)), bool(_SIGNED_DOT.search(span)), letters,
        n == 7, n == 10, n == 11, 16 <= n <= 19, 13 <= n <= 15, not (n == 7 or n == 10 or n == 11 or 13 <= n <= 19),
        n >= 13 and luhn(digits), n >= 13 and not luhn(digits), len(groups) == 4 and marks == {"."}, len(groups) == 4 and all(s <= 3 and int(g) <= 255 for s, g in zip(sizes, groups, strict=True)),
        sizes in ([3, 3, 4], [1, 3, 3, 4]) and bool(marks & {"-", "."}), bool(re.match(r"(?:1[-. ]?)?\([0-9]{3}\)[-. ]?[0-9]{3}[-. ][0-9]{4}\Z", span)), len(groups) >= 4 and len(set(sizes[:-1])) == 1 and sizes[0] == 4, len(groups) == 1,
        before.isalnum() or before in "+@_/#=.-" and before != "", after.isalnum() or after in "@_/%=-" and after != "" or after == "." and text[end + 1 : end + 2].isalnum(), not (span[:1].isalnum() or span[:1] == "(") or not span[-1:].isalnum(), len(marks - {"(", ")"}) > 2,
        bool(_NAMED.search(ahead)), max(sizes, default=0) > 4, 7 <= n <= 15 and not letters and bool(_PHONED.search(ahead)), len(groups) == 4 and bool(_SPACED.match(span)), n == 15,
    ], float)


_SPOT = re.compile(r"[0-9@]+|[\[({] ?(?:at|dot) ?[\])}]", re.IGNORECASE)
_BLANK = re.compile(r"\s")


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that can hold an entity: tokens with digits, @ or at-signs, and what links them to their neighbours.

    A zone reaches `NEAR` characters to both sides and on to the end of the word or of the line there, so no word of an
    entity is cut; zones that touch are one.
    """
    low, high = 0, -1
    for m in _SPOT.finditer(text):
        start = _back(text, m.start(), max(high, 0)) if m.start() > high else high
        if start > high:  # else the zone so far reaches over this place
            if high >= 0:
                yield low, high
            low = start
        if m.end() + NEAR > high:
            high = _forward(text, m.end(), max(m.end(), high))
    if high >= 0:
        yield low, high


def _back(text: str, spot: int, floor: int) -> int:
    """The start of the word that holds the place NEAR characters before the spot, at most as far back as its line's start or `floor`."""
    low = max(spot - NEAR, floor, text.rfind("\n", max(spot - NEAR, floor), spot) + 1)
    if low == spot - NEAR and not text[low].isspace():
        while low > floor and not text[low - 1].isspace():
            low -= 1
    return low


def _forward(text: str, spot: int, floor: int) -> int:
    """The end of the word that holds the place NEAR characters after the spot, at most as far as its line's end."""
    high = min(spot + NEAR, len(text))
    line = text.find("\n", spot, high)
    if line >= 0:
        return max(line, floor)
    if high < len(text) and not text[high - 1].isspace():
        end = _BLANK.search(text, high)
        high = end.start() if end else len(text)
    return max(high, floor)


def _tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, min(end, len(text)))]


def _candidates(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For each token, where spans that start at it may end (as token counts): linked tokens with a digit or an at-sign."""
    out = []
    words = [text[a:b] for a, b in tokens]
    kind = ["d" if w[0].isdigit() else "w" if w.isalpha() and w.isascii() else "s" if _LINK.fullmatch(w) else "x" for w in words]
    for i, (a, _) in enumerate(tokens):
        ends: list[tuple[int, int]] = []
        if kind[i] in "dw" or words[i] == "(":
            n_digits, sign = 0, False
            spaced = 0  # plain words after a space end a span: prose is no entity
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                w = words[j]
                if kind[j] == "x":
                    break
                if kind[j] == "d":
                    n_digits += len(w)
                if kind[j] == "w" and j > i and words[j - 1][0] in " \t" and not (j > 1 and words[j - 2] in ")]}@([{") and not _SIGN.fullmatch(w):
                    spaced += 1
                if spaced:
                    break
                sign |= w == "@" or kind[j] == "w" and w.lower() == "at" and j > 0 and words[j - 1] in "([{ "
                if kind[j] in "dw" and (n_digits >= 7 or sign and j > i + 2 or n_digits >= 4 and j >= i + 6):
                    ends.append((j + 1, tokens[j][1]))
        out.append(ends)
    return out


class SpanField:
    """Weights of one score for each kind; plain tokens score 0."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray | None = None):
        self.weights = weights
        self.cuts = np.full(len(KINDS), MOST_CUT) if cuts is None else cuts

    def packed(self) -> bytes:
        return np.column_stack([self.weights, self.cuts]).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> SpanField:
        table = np.frombuffer(data).reshape(len(KINDS), len(FEATURES) + 1)
        return SpanField(table[:, :-1], table[:, -1])

    def lattice(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each token, the spans from it: (token after it, its features, its scores by kind)."""
        out = []
        for (start, _), ends in zip(tokens, _candidates(text, tokens), strict=True):
            row = []
            for after, end in ends:
                x = span_features(text, start, end)
                row.append((after, x, self.weights @ x))
            out.append(row)
        return out

    @staticmethod
    def sums(lattice: list) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the summed weights of all segmentations before and after each token boundary."""
        n = len(lattice)
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        for i in range(n):
            ahead[i + 1] = np.logaddexp(ahead[i + 1], ahead[i])
            for after, _, scores in lattice[i]:
                ahead[after] = np.logaddexp(ahead[after], ahead[i] + np.logaddexp.reduce(scores))
        for i in range(n - 1, -1, -1):
            back[i] = back[i + 1]
            for after, _, scores in lattice[i]:
                back[i] = np.logaddexp(back[i], back[after] + np.logaddexp.reduce(scores))
        return ahead, back

    def spans(self, text: str) -> list[Span]:
        """The best segmentation's spans whose posterior probability reaches their kind's cut."""
        return [span for span, posterior in self.scored(text) if posterior >= self.cuts[span[0]]]

    def scored(self, text: str) -> list[tuple[Span, float]]:
        """The best segmentation's spans with their posterior probabilities."""
        found = []
        for start, end in zones(text):
            tokens = _tokens(text, start, end)
            lattice = self.lattice(text, tokens)
            if not any(lattice):
                continue
            n = len(tokens)
            best, choice = np.full(n + 1, -np.inf), [(0, -1, 0.0)] * (n + 1)
            best[0] = 0.0
            for i in range(n):
                if best[i] > best[i + 1]:
                    best[i + 1], choice[i + 1] = best[i], (i, -1, 0.0)
                for after, _, scores in lattice[i]:
                    k = int(scores.argmax())
                    if best[i] + scores[k] > best[after]:
                        best[after], choice[after] = best[i] + scores[k], (i, k, scores[k])
            ahead, back = self.sums(lattice)
            j = n
            while j > 0:
                i, k, score = choice[j]
                if k >= 0:
                    found.append(((k, tokens[i][0], tokens[j - 1][1]), float(np.exp(ahead[i] + score + back[j] - ahead[n]))))
                j = i
        return found


def _sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A generated sentence with entities in many forms, and with numbers that are none."""
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9)))
    number = lambda k: "".join(rng.choices("0123456789", k=k))

    def card(k: int) -> str:
        body = number(k - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def group(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, len(d), 4))

    words: list[str] = []  # what stands before the next entity

    def entity() -> tuple[int, str]:
        kind = rng.randrange(4)
        named = (["mail", "email", "e-mail:"], ["ip", "host", "IP:"], ["card", "card:", "Visa"], ["tel", "call", "phone:", "Tel."])[kind]
        if rng.random() < 0.25:
            words.append(rng.choice(named) + " ")
        if kind == 0:
            at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", ".")])
            return 0, f"{word()}{rng.choice(['', '.' + number(2), '.' + word()])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net'])}"
        if kind == 1:
            return 1, rng.choice([".", ".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return 2, group(card(rng.choice([16, 16, 16, 15])), rng.choice(["", " ", "-", "."]))
        a, b, c = str(rng.randint(200, 999)), str(rng.randint(200, 999)), number(4)
        if rng.random() < 0.3:  # forms that only a word before them tells from other numbers
            words.append(rng.choice(["tel", "Tel.", "phone", "call", "fax", "Phone:", "mobile", "tel:"]) + " ")
            return 3, rng.choice([f"{a} {b} {c}", f"0{number(2)} {number(4)} {number(4)}", f"{a}-{c}", f"0{number(4)} {number(6)}", a + b + c, f"{a} {c}"])
        return 3, rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    def decoy() -> str:
        while luhn(wrong := number(rng.choice([16, 16, 15, 18]))):
            pass
        return rng.choice([
            wrong, group(wrong, rng.choice([" ", "-", "."])), f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{number(1)}.{number(2)}.{number(1)}", number(rng.randint(1, 14)), card(16) + word()[:1] + number(3),
            f"{rng.randint(256, 999)}.{number(3)}.{rng.randint(256, 999)}.{number(2)}", "".join(rng.choices("0123456789abcdef", k=32)), f"{number(2)}:{number(2)}", f"{number(3)},{number(3)},{number(3)}", f"{number(4)} {number(5)} {number(3)} {number(2)}",
            f"{number(1)}.{number(7)}", f"{word()} at {word()}. {word()} {number(2)}", f"{number(2)}.{number(2)}.{number(4)}", " ".join(number(rng.randint(1, 5)) for _ in range(rng.randint(2, 7))), f"{number(3)}-{number(2)}-{number(4)}", f"{word()}@{word()}", f"{number(8)}-{number(4)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}", number(10),
            f"{word()}{number(3)}-{number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}-{number(3)}",
        ])

    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ": ", ", "])
        if rng.random() < 0.5:
            words.clear()
            kind, what = entity()
            text += "".join(words[-1:])
            spans.append((kind, len(text), len(text) + len(what)))
            text += what
        else:
            text += decoy()
        text += rng.choice([" ", ". ", ", ", "; "])
    return text + word(), spans


@dataclass
class _Lattices:
    """The candidate spans of many texts side by side: of which text, from and to which token, their features and true kinds (-1: none)."""

    lengths: np.ndarray
    case: np.ndarray
    start: np.ndarray
    after: np.ndarray
    x: np.ndarray
    truth: np.ndarray

    @staticmethod
    def of(sentences: list[tuple[str, list[Span]]]) -> _Lattices:
        lengths, rows = [], []
        for text, spans in sentences:
            tokens = _tokens(text, 0, len(text))
            gold = {(a, b): k for k, a, b in spans}
            for i, ((a, _), ends) in enumerate(zip(tokens, _candidates(text, tokens), strict=True)):
                rows += [(len(lengths), i, after, span_features(text, a, end), gold.get((a, end), -1)) for after, end in ends]
            lengths.append(len(tokens))
        case, start, after, x, truth = zip(*rows, strict=True)
        return _Lattices(np.array(lengths), np.array(case), np.array(start), np.array(after), np.stack(x), np.array(truth))

    def sums(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`SpanField.sums` of all texts at once; columns beyond a text's tokens hold nothing."""
        total, most = np.logaddexp.reduce(scores, axis=1), int(self.lengths.max())
        ahead, back = np.full((2, len(self.lengths), most + 1), -np.inf)
        ahead[:, 0] = 0.0
        back[np.arange(len(self.lengths)), self.lengths] = 0.0
        order = np.argsort(self.start, kind="stable")
        edges = np.searchsorted(self.start[order], np.arange(most + 1))
        for i in range(most):
            here, inside = order[edges[i] : edges[i + 1]], self.lengths > i
            ahead[inside, i + 1] = np.logaddexp(ahead[inside, i + 1], ahead[inside, i])
            np.logaddexp.at(ahead, (self.case[here], self.after[here]), ahead[self.case[here], i] + total[here])
        for i in range(most - 1, -1, -1):
            here, inside = order[edges[i] : edges[i + 1]], self.lengths > i
            back[inside, i] = back[inside, i + 1]
            np.logaddexp.at(back, (self.case[here], i), back[self.case[here], self.after[here]] + total[here])
        return ahead, back

    def posteriors(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each span being an entity of each kind."""
        scores = self.x @ weights.T
        ahead, back = self.sums(scores)
        whole = ahead[np.arange(len(self.lengths)), self.lengths]
        return np.exp((ahead[self.case, self.start] + back[self.case, self.after] - whole[self.case])[:, None] + scores)


@lru_cache(maxsize=4)
def fit_field(sentences: int = 1200, steps: int = 120, seed: int = 11) -> SpanField:
    """Weights that maximise the penalised log-likelihood of generated sentences, by scaled gradient steps; cuts from others.

    It depends on no table, so a driver fits once for all its plans.
    """
    rng = random.Random(seed)
    cases = _Lattices.of([_sentence(rng) for _ in range(sentences)])
    weights, seen = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-6)
    hit = np.zeros((len(cases.truth), len(KINDS)))
    hit[np.flatnonzero(cases.truth >= 0), cases.truth[cases.truth >= 0]] = 1
    for _ in range(steps):
        slope = (hit - cases.posteriors(weights)).T @ cases.x - 0.02 * weights
        seen += slope**2
        weights = weights + slope / np.sqrt(seen)
    field = SpanField(weights)
    right: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for text, spans in (_sentence(rng) for _ in range(sentences // 2)):
        for span, posterior in field.scored(text):
            right[span[0]].append((posterior, span in spans))
    for k, found in enumerate(right):
        found.sort(reverse=True)
        good = np.cumsum([ok for _, ok in found]) / np.arange(1, len(found) + 1)
        low = [p for (p, _), share in zip(found, good, strict=True) if share >= PRECISION]
        field.cuts[k] = min(max(low[-1], LEAST_CUT), MOST_CUT) if low else MOST_CUT
    return field


@lru_cache(maxsize=1)
def _worker_field(packed: bytes) -> SpanField:
    return SpanField.unpacked(packed)


def all_spans(text: str, field: SpanField) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: those and the field's that touch none of them. Both by kind, then start."""
    base = base_spans(text)
    places = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in places], list(accumulate((b for _, b in places), max))
    # Of the base spans that begin before a span's end, the one that reaches furthest tells whether any touches it.
    added = [s for s in field.spans(text) if not ((i := bisect_left(starts, s[2])) and ends[i - 1] > s[1])]
    return sorted(base), sorted(base + added)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _signed(data: np.ndarray) -> np.ndarray:
    """Places of brackets that "at" or "dot" follows, after a blank or at once, in any case: where `zones` may see a sign."""
    places = np.flatnonzero(_BRACKET[data])
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    word = places + 1 + (data[places + 1] == 0x20)
    first, second, third = (data[np.minimum(word + i, len(data) - 1)] | 0x20 for i in range(3))
    return places[(first == 0x61) & (second == 0x74) | (first == 0x64) & (second == 0x6F) & (third == 0x74)]


def _flagged(column: pa.Array) -> np.ndarray:
    """Which texts hold a digit, an @ or a bracketed at-sign or dot."""
    out = []
    for _, _, data, offsets in text_pieces(column):
        places = np.sort(np.concatenate([np.flatnonzero(_CANDIDATE[data]), _signed(data)]))
        out.append(np.diff(np.searchsorted(places, offsets)) > 0)
    return np.concatenate(out) if out else np.zeros(0, bool)


def _found(column: pa.Array, weights: bytes) -> Iterator[tuple[str, list[Span], list[Span]]]:
    field = _worker_field(weights)
    for value, flag in zip(column, _flagged(column), strict=True):
        text = value.as_py() or ""
        yield text, *(all_spans(text, field) if flag else ([], []))


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def pii_digest(docs: DataFrame, field: SpanField | None = None) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added).

    Null and empty texts hold nothing. Offsets count code points, ends are exclusive. Repeated rows are each answered;
    other columns are not read. The base spans stand whatever the field says; it adds spans that touch none of them.
    """
    weights = (field or fit_field()).packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows = []
            for _, base, spans in _found(batch.column(1), weights):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
            columns = [*zip(*rows, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], RESULT.names)
        give_back()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, RESULT)


def redacted(text: Column, field: SpanField | None = None) -> Column:
    """The text with every span replaced by its kind in brackets, such as [EMAIL]; of spans that overlap, the whole stretch by the first's kind.

    Null stays null, an empty text stays empty; whole texts are read, however long. The same text gives the same result in
    every row.
    """
    weights = (field or fit_field()).packed()

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        lean()
        out = []
        for (text, _, spans), old in zip(_found(column, weights), column, strict=True):
            parts, done = [], 0
            for k, a, b in sorted(spans, key=lambda s: s[1:]):
                if a >= done:
                    parts += [text[done:a], f"[{KINDS[k].upper()}]"]
                done = max(done, b)
            out.append("".join([*parts, text[done:]]) if old.is_valid else None)
        return pa.array(out, pa.string())

    return run(text)
