"""Personal data: exact base patterns, and more spans from a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns whose checks (parts of an
address, Luhn's sum, numbers of digits) hold; they are always kept.  Around anything that could be personal data the text
is cut into tokens; segments of a bounded number of tokens are candidates, and so are whole addresses, whole runs of
digits and base spans of any number of tokens.  Features of a whole segment (its shape,
digits, separators, checks and neighbours) score it for each type; dynamic programming over segment ends and types finds
the best boundaries and types together.  A found segment becomes a span if it beats reading its tokens as plain text by a
margin and touches no base span.  Weights are learned by gradient steps on the likelihood of segmentations of a sample,
whose labels are base spans and rewritten forms of them (spelled-out at and dot, no plus sign, other separators), next to
numbers that are no personal data; training goes on until nearly all of them are told apart.

Null texts count as empty; positions are code points.  Rows are independent of each other; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from dataclasses import field as attribute

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),  # the same matches as without the look behind, in linear time
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What a text must hold for a base pattern, or for a segment, to be looked for at all.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"([0-9][ -]?){15}[0-9]", "phone": r"\+[0-9]"}
TRIGGER_RE2 = r"@|[0-9][0-9 ()./-]{6,}[0-9]|(?i:[\[(](at|dot)[\])])|(?i: at [\pL\pN_.-]+ dot )"
TRIGGER = re.compile(r"@|[0-9][0-9 ()./-]{6,}[0-9]|[\[(](?:at|dot)[\])]| at (?=[\w.-]+ dot )", re.IGNORECASE)
TOKEN = re.compile(r"[\[(](?:at|dot)[\])]|[^\W\d_]+|[0-9]+|\S", re.IGNORECASE)
#: Whole addresses in any form, and whole runs of digits: candidates of any length.
ADDRESS = re.compile(r"(?<![\w.%+-])[\w.%+-]++(@|\s*[\[(]at[\])]\s*| at )[\w-]++(?:(?:\.|\s*[\[(]dot[\])]\s*| dot )[\w-]++)+", re.IGNORECASE)
GOES_ON = re.compile(r"(?:\.|\s*[\[(]dot[\])]\s*| dot )[\w-]", re.IGNORECASE)
DIALLED = re.compile(r"[+(]?[0-9](?:[ ()./-]*+[0-9])*+")
#: Tokens of other segments, most digits of one, code points looked at on both sides of a sign, and by how much a segment must win.
LONGEST, DIGITS, AROUND, MARGIN = 14, 19, 32, 2.0
#: What the field is fitted on: documents of the sample (chosen by a hash), base spans of each kind (as they are and in two
#: other forms; in order of the sample), tokens of an example's window; passes at most, and the steps' size.
SAMPLE, EXAMPLES, WINDOW, EPOCHS, RATE = 300, 80, 60, 10, 0.3
#: Numbers that are no personal data, as examples of plain text; 9 is any digit.
PLAIN = (
    "on 2099-99-99 99:99:99", "from 99.99.2099 to 99.99.2099", "9999999999 9999999", "pages 999-999 and 9999-9999", "sum 9 999 999.99", "1.999.999,99 in all", "isbn 978-9-99-999999-9",
    "9999/9999 9999/99", "no 99999999999", "9 99 999 9999 99999", "at 99:99 - 99:99", "99999999-9999-9999-9999-999999999999", "v99.99.99.99.99", "9999 9999 9999 9999", "9999999999999999", "room 999 (999) 99", "9.9.9 9.9.9 99",
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def holds(kind: str, text: str) -> bool:
    """The check that a match of a base pattern must pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        own = digits_of(text)
        return 16 <= len(own) <= 19 and luhn(own)
    if kind == "phone":
        return 8 <= len(digits_of(text)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from their at signs: a match begins where the run before the sign begins."""
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and (text[begin - 1] in "._%+-" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
            begin -= 1
        m = PATTERNS["email"].match(text, begin) if begin < at else None
        if m:
            yield begin, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for kind in KINDS[1:]:
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if holds(kind, m[0])]
    return out


# ---------------------------------------------------------------------------------------------------------------------
# semi-Markov conditional random field


@dataclass
class Window:
    """Tokens of a piece of text as (start, end) in the whole text, and spans that are candidates besides all others."""

    text: str
    tokens: list[tuple[int, int]]
    spans: list[tuple[int, int]] = attribute(default_factory=list)


def window(text: str, begin: int, end: int, spans: Iterable[tuple[int, int]]) -> Window:
    """The tokens between two positions, cut where one of the spans begins or ends."""
    spans = [(a, b) for a, b in spans if begin <= a and b <= end]
    cuts = [begin, *sorted({x for span in spans for x in span} - {begin, end}), end]
    return Window(text, [t.span() for a, b in itertools.pairwise(cuts) for t in TOKEN.finditer(text, a, b)], spans)


def windows(text: str, around: int = AROUND, spans: Iterable[tuple[int, int]] = ()) -> Iterator[Window]:
    """The pieces of text around signs of personal data, widened so that no word, address, run of digits or given span is
    cut; pieces that touch are one.  Given spans are candidates there.
    """
    runs: list[list[int]] = []
    for a, b in sorted([*spans, *(m.span() for m in ADDRESS.finditer(text)), *(m.span() for m in DIALLED.finditer(text))]):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    begin = end = -1
    for m in TRIGGER.finditer(text):
        if m.end() + around <= end:
            continue
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        a, b = over_word(text, a, -1), over_word(text, b, 1)
        k = bisect.bisect_left(runs, [a])
        a = runs[k - 1][0] if k and runs[k - 1][1] > a else a
        k = bisect.bisect_left(runs, [b])
        b = runs[k - 1][1] if k and runs[k - 1][1] > b else b
        a, b = over_word(text, a, -1), over_word(text, b, 1)
        if a > end:
            if end > 0:
                yield window(text, begin, end, spans)
            begin = a
        end = max(b, end)
    if end > 0:
        yield window(text, begin, end, spans)


def over_word(text: str, at: int, step: int) -> int:
    """The position moved to the beginning (-1) or end (1) of the word that it lies in."""
    while 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
        at += step
    return at


def whole_spans(w: Window) -> Iterator[tuple[int, int]]:
    """Addresses with their whole names, runs of digits and given spans, however many tokens they have."""
    yield from w.spans
    begin, end = (w.tokens[0][0], w.tokens[-1][1]) if w.tokens else (0, 0)
    for m in ADDRESS.finditer(w.text, begin, end):
        name = m.start() + len(m[0]) - len(m[0].lstrip("._%+-"))
        host = bisect.bisect_left(w.tokens, (m.end(1),))
        ends = {m.end(), m.start() + len(m[0].rstrip("_-")), *(b for _, b in w.tokens[host : host + LONGEST] if b <= m.end() and w.text[b - 1].isalnum())}
        for a in {m.start(), name}:
            yield from ((a, b) for b in ends)
    for m in DIALLED.finditer(w.text, begin, end):
        if len(digits_of(m[0])) >= 7:
            yield m.span()


def segments(w: Window, longest: int = LONGEST) -> Iterator[tuple[int, int, str]]:
    """Candidate segments (first token, token after the last, text): they hold enough digits or an at sign."""
    text, tokens = w.text, w.tokens
    first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: j + 1 for j, (_, b) in enumerate(tokens)}
    whole = {(first[a], last[b]) for a, b in whole_spans(w) if a in first and b in last and first[a] < last[b]}
    yield from ((i, j, text[tokens[i][0] : tokens[j - 1][1]]) for i, j in sorted(whole))
    runs = ["0" <= text[a] <= "9" for a, _ in tokens]
    digits = np.cumsum([0, *(b - a if run else 0 for run, (a, b) in zip(runs, tokens, strict=True))]).tolist()
    groups = np.cumsum([0, *runs]).tolist()
    ats = np.cumsum([0, *(text[a:b].lower() in ("@", "at", "[at]", "(at)", "[at)", "(at]") for a, b in tokens)]).tolist()
    ends = [text[b - 1].isalnum() for _, b in tokens]
    for i, (a, e) in enumerate(tokens):
        if not (text[a].isalnum() or text[a:e] in "+("):
            continue
        for j in range(i + 3, min(len(tokens), i + longest) + 1):
            number = 7 <= digits[j] - digits[i] <= DIGITS and 2 * (digits[j] - digits[i]) >= 3 * (groups[j] - groups[i])
            if ends[j - 1] and (number or ats[j] - ats[i] == 1) and (i, j) not in whole:
                yield i, j, text[a : tokens[j - 1][1]]


def shape(text: str, most: int = 24) -> str:
    """Letters as a, runs of digits by their length, signs as they are, blanks as one."""
    out = re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), re.sub(r"[^\W\d_]+", "a", re.sub(r"\s+", " ", text)))
    return out[:most]


def whole_features(w: Window, i: int, j: int, segment: str) -> list[str]:
    """Features of a whole segment, not of its tokens."""
    own = digits_of(segment)
    before = w.text[w.tokens[i][0] - 1] if w.tokens[i][0] else "^"
    after = w.text[w.tokens[j - 1][1]] if w.tokens[j - 1][1] < len(w.text) else "$"
    edge = lambda c: "_" if c in "^$" or c.isspace() else "a" if c.isalnum() else c
    signs = "".join(sorted({c for c in segment if not c.isalnum()}))
    mail = re.fullmatch(r"[\w.%+-]+(@|\s*[\[(]at[\])]\s*| at )[\w-]+((\.|\s*[\[(]dot[\])]\s*| dot )[\w-]+)+", segment, re.IGNORECASE)
    parts = segment.split(".")
    sizes = [len(g) for g in re.findall("[0-9]+", segment)] if own and len(own) <= DIGITS else []
    number = not any(c.isalpha() for c in segment)
    between = "".join(sorted({c for c in segment[1:-1] if not c.isalnum()}))
    return [
        "one",
        f"shape {'a' if any(c.isalpha() for c in segment) else shape(segment)}",
        f"digits {len(own)}",
        f"signs {signs}",
        f"edges {edge(before)}{edge(after)}",
        f"mail {bool(mail)} {bool(mail and GOES_ON.match(w.text, w.tokens[j - 1][1]))}",
        f"luhn {len(own) >= 16 and luhn(own)} {len(own) in range(16, 20)}",
        f"address {len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"dialled {segment[0] in '+('} {8 <= len(own) <= 15}",
        f"letters {not number} {len(own) > 0}",
        f"groups {number} {min(len(sizes), 6)} {max(sizes, default=0) > 4}",
        f"sizes {number} {'-'.join(map(str, sizes[-3:]))}",
        f"first {number} {min(sizes[0], 5) if sizes else 0} {segment[0] if not segment[0].isalnum() else ''}",
        f"between {number} {between} {len(own) if number else 0}",
        f"fours {bool(sizes) and all(x == 4 for x in sizes[:-1])} {luhn(own) if 16 <= len(own) <= DIGITS else '-'}",
    ]


@dataclass
class Field:
    """Weights of features by type and of one type after another (0 is plain text)."""

    index: dict[str, int]
    weights: np.ndarray
    follows: np.ndarray

    def lattice(self, w: Window, learn: bool = False) -> list[list[tuple[int, list[int], str]]]:
        """For each token end the candidate segments: (first token, known features, text)."""
        out: list[list] = [[] for _ in range(len(w.tokens) + 1)]
        for i, j, segment in segments(w):
            names = whole_features(w, i, j, segment)
            ids = [self.index.setdefault(f, len(self.index)) for f in names] if learn else [self.index[f] for f in names if f in self.index]
            out[j].append((i, ids, segment))
        return out

    def decode(self, w: Window) -> list[tuple[str, int, int, float]]:
        """The best segmentation's entities: (kind, start, end, how much they win over plain text)."""
        n, kinds = len(w.tokens), len(KINDS)
        best = np.full((n + 1, kinds + 1), -np.inf)
        back: list[list] = [[None] * (kinds + 1) for _ in range(n + 1)]
        best[0, 0] = 0
        lattice = self.lattice(w)
        on = float(self.follows[0, 0])
        for j in range(1, n + 1):
            if lattice[j - 1]:
                prior = best[j - 1] + self.follows[:, 0]
                k = int(prior.argmax())
                best[j, 0], back[j][0] = prior[k], (j - 1, k, 0.0)
            else:  # only plain text ends there
                best[j, 0], back[j][0] = best[j - 1, 0] + on, (j - 1, 0, 0.0)
            for i, ids, _ in lattice[j]:
                scores = self.weights[ids].sum(0)
                prior = best[i][:, None] + self.follows[:, 1:] + scores
                for y, k in enumerate(prior.argmax(0).tolist()):
                    if prior[k, y] > best[j, y + 1]:
                        best[j, y + 1], back[j][y + 1] = prior[k, y], (i, k, scores[y])
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i, k, score = back[j][y]
            if y:
                out.append((KINDS[y - 1], w.tokens[i][0], w.tokens[j - 1][1], float(score + self.follows[k, y] + self.follows[y, 0] - 2 * self.follows[0, 0])))
            j, y = i, k
        return out[::-1]


def gradient_step(field: Field, w: Window, gold: set[tuple[int, int, str]], rate: float) -> None:
    """One step up the likelihood of the gold segmentation: what it holds less what the field expects."""
    n, kinds = len(w.tokens), len(KINDS)
    lattice = field.lattice(w)
    scored = [[(i, ids, field.weights[ids].sum(0)) for i, ids, _ in own] for own in lattice]
    forward = np.full((n + 1, kinds + 1), -np.inf)
    backward = np.full((n + 1, kinds + 1), -np.inf)
    forward[0, 0], backward[n] = 0, 0
    lse = lambda x: np.logaddexp.reduce(x, axis=0)
    leave, on = field.follows[:, 0], float(field.follows[0, 0])
    begun = [False] * (n + 1)
    for j in range(1, n + 1):
        forward[j, 0] = lse(forward[j - 1] + leave) if scored[j - 1] else forward[j - 1, 0] + on
        for i, _, s in scored[j]:
            forward[j, 1:] = np.logaddexp(forward[j, 1:], lse(forward[i][:, None] + field.follows[:, 1:]) + s)
            begun[i] = True
    for j in range(n, 0, -1):
        plain = leave + backward[j, 0]
        backward[j - 1] = np.logaddexp(backward[j - 1], plain) if begun[j - 1] else plain
        for i, _, s in scored[j]:
            backward[i] = np.logaddexp(backward[i], lse((field.follows[:, 1:] + s + backward[j, 1:]).T))
    total = float(lse(forward[n]))
    expected = np.zeros_like(field.follows)
    for j in range(1, n + 1):
        if scored[j - 1]:
            expected[:, 0] += np.exp(forward[j - 1] + leave + backward[j, 0] - total)
        else:
            expected[0, 0] += math.exp(forward[j - 1, 0] + on + backward[j, 0] - total)
        for i, ids, s in scored[j]:
            p = np.exp(forward[i][:, None] + field.follows[:, 1:] + s + backward[j, 1:] - total)
            expected[:, 1:] += p
            np.subtract.at(field.weights, ids, rate * p.sum(0))
    place = {(w.tokens[i][0], w.tokens[j - 1][1]): (i, j, ids) for j in range(1, n + 1) for i, ids, _ in lattice[j]}
    held, at = np.zeros_like(field.follows), [0] * n
    last, j = 0, 0
    for a, b, kind in sorted(gold):
        if (a, b) not in place:
            raise ValueError(f"a gold span of type {kind} is not a candidate: {a} to {b}")
        i, j2, ids = place[a, b]
        y = KINDS.index(kind)
        np.add.at(field.weights, (ids, y), rate)
        at[i] = j2 * (kinds + 1) + y + 1
    while j < n:
        y = at[j] % (kinds + 1)
        held[last, y] += 1
        last, j = y, at[j] // (kinds + 1) if y else j + 1
    field.follows += rate * (held - expected)


def forms(span: str, kind: str) -> list[str]:
    """Other forms of a base span that people use; the first is the span itself."""
    out = [span]
    if kind == "email":
        name, _, host = span.partition("@")
        short = re.sub("[^A-Za-z]", "", name) or name, ".".join(host.split(".")[-2:])
        for who, where in ((name, host), short):
            out += [who + at + where.replace(".", dot) for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."))]
    elif kind == "phone":
        groups = re.findall("[0-9]+", span)
        out += [span[1:], *(sign.join(groups) for sign in ". -"), "+" + ".".join(groups), "+" + "-".join(groups)]
        if len(groups) > 2 and len("".join(groups[1:])) > 7:
            out += [f"({groups[1]}) {'-'.join(groups[2:])}", f"({groups[1]}) {' '.join(groups[2:])}", f"{groups[1]}-{'-'.join(groups[2:])}", f"{groups[1]}/{''.join(groups[2:])}"]
    elif kind == "card":
        own = digits_of(span)
        out += [sign.join(own[x : x + 4] for x in range(0, len(own), 4)) for sign in (".", " ", "-", "/")]
    return out


def rewritten(text: str, kind: str, start: int, end: int, k: int) -> tuple[str, int, int]:
    """The text with one base span in another of its forms, and where that is."""
    own = forms(text[start:end], kind)
    new = own[k % len(own)]
    text, end = text[:start] + new + text[end:], start + len(new)
    return text, over_word(text, start, -1), over_word(text, end, 1)  # whole words, if the pattern saw a part of one


def examples_of(texts: list[str], most: int = EXAMPLES, longest: int = WINDOW) -> list[tuple[Window, set]]:
    """Windows with their gold spans: of base spans as they are, of other forms of them, and of numbers that are none."""
    out: list[tuple[Window, set]] = []
    have = dict.fromkeys(KINDS, 0)
    for text in texts:
        taken: list[tuple[int, int, str]] = []
        for kind, a, b in base_spans(text):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
        found = [(w, {g for g in taken if w.tokens and w.tokens[0][0] <= g[0] and g[1] <= w.tokens[-1][1]}) for w in windows(text, spans=[g[:2] for g in taken])]
        out += [(w, gold) for w, gold in found if len(w.tokens) <= longest and any(have[kind] < most for _, _, kind in gold or [(0, 0, "ip")])]
        for a, b, kind in taken:
            ways = len(forms(text[a:b], kind))
            for k in {1 + have[kind] % max(1, ways - 1), 1 + (have[kind] + ways // 2) % max(1, ways - 1)} if have[kind] < most else ():
                other, x, y = rewritten(text[max(0, a - 60) : b + 60], kind, min(a, 60), min(a, 60) + b - a, k)
                own = [w for w in windows(other, spans=[(x, y)]) if w.tokens and w.tokens[0][0] <= x and y <= w.tokens[-1][1]]
                if not own:
                    raise ValueError(f"no window for a rewritten span of type {kind}")
                out += [(w, {(x, y, kind)}) for w in own if len(w.tokens) <= longest]
            have[kind] += 1
    rng = np.random.default_rng(0)
    for _ in range(max(have.values()) and 8):
        for way in PLAIN:
            text = "so " + re.sub("9", lambda m: str(rng.integers(10)), way) + " it was"
            if not base_spans(text):
                out += [(w, set()) for w in windows(text)]
    return out


def untouched(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a span (start, end) touches none of some spans."""
    merged: list[list[int]] = []
    for a, b in sorted(s[1:] for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b) - 1  # the last that begins before the end
        return k < 0 or merged[k][1] <= a

    return free


def told_apart(field: Field, w: Window, gold: set[tuple[int, int, str]], margin: float = MARGIN) -> bool:
    """Whether the spans that the field adds to base spans are the gold ones."""
    free = untouched(base_spans(w.text))
    return {(a, b, kind) for kind, a, b, gain in field.decode(w) if gain >= margin and free(a, b)} == {g for g in gold if free(*g[:2])}


def train(texts: list[str], epochs: int = EPOCHS, rate: float = RATE) -> Field:
    """Learn a field from the base spans of texts and other forms of them.

    After two passes over all examples, passes go over those that are not told apart and some others, until there are hardly
    any (one in a hundred: base patterns drop some spans that the field is right to find).
    """
    field = Field({}, np.zeros((0, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    examples = examples_of(texts)
    for w, _ in examples:
        field.lattice(w, learn=True)
    field.weights = np.zeros((max(1, len(field.index)), len(KINDS)))
    field.weights[: len(field.index)] -= 0.1
    rng = np.random.default_rng(0)
    todo = list(range(len(examples)))
    for epoch in range(epochs):
        for k in rng.permutation(todo).astype(int):
            gradient_step(field, *examples[k], rate / (1 + epoch / 4))
        # Plain tokens must weigh nothing at last, or a long segment would lose to the number of its tokens; gains stay as they are.
        field.follows[0, 1:] -= 2 * field.follows[0, 0]
        field.follows[0, 0] = 0
        if epoch:
            todo = [k for k, x in enumerate(examples) if not told_apart(field, *x)]
            if 100 * len(todo) <= len(examples):
                break
            todo += rng.choice(len(examples), min(len(examples), len(todo) + 100), replace=False).tolist()
    return field


def more_spans(field: Field, text: str, base: list[tuple[str, int, int]], margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """The field's spans that touch no base span."""
    if not field.index:
        return []
    free = untouched(base)
    return [(kind, a, b) for w in windows(text, spans=[s[1:] for s in base]) for kind, a, b, gain in field.decode(w) if gain >= margin and free(a, b)]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = SAMPLE) -> Field:
    """Learn from about `documents` of the texts with signs of personal data, chosen by a hash.

    One pass looks for signs and writes hashes; a second reads the texts below the hash that bounds the sample.
    """
    rows = df.select(F.xxhash64(key, text).alias("_hash"), F.col(text).alias("text"))
    hashes = common.materialize(rows.where(F.col("text").rlike(r"@|\+[0-9]|[0-9][0-9 ().-]{7,}[0-9]")).select("_hash"), "signs")
    bound = hashes.distinct().orderBy("_hash").limit(documents).agg(F.max("_hash")).first()[0]
    if bound is None:
        return train([])
    low = rows.where(F.col("_hash") <= bound).join(F.broadcast(hashes.where(F.col("_hash") <= bound).distinct()), "_hash", "left_semi")
    return train([t for _, t in sorted({(r["_hash"], r.text) for r in low.collect()})])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def by_kind(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(field: Field, texts: pa.Array) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text; only texts with a sign of personal data are searched."""
    signs = pc.match_substring_regex(texts, f"{TRIGGER_RE2}|\\+[0-9]|{SIGNS['ip']}").to_pylist()
    for text, some in zip(texts, signs, strict=True):
        if not some:
            yield [], []
            continue
        text = text.as_py()
        base = base_spans(text)
        more = more_spans(field, text, base)
        yield base, by_kind(base + more) if more else base


def spans_of(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans."""
    kind = df.schema[key].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text):
                found = list(find(field, common.texts_of(part, text)))
                columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(key), *columns, digest, pa.array([joined(x) for _, x in found], pa.string())], [key, *counts, "base_sha256", "spans"])

    common.bounded_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string")


def redact(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`df` with each span of its text replaced by the kind in angle brackets; other columns, and texts without spans, stay."""
    schema, names = df.schema, df.columns

    def one(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text):
                column = part.column(text)
                new = [one(t.as_py(), spans) if spans else t.as_py() for t, (_, spans) in zip(column, find(field, common.texts_of(part, text)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else part.column(c) for c in names], names)

    common.bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
