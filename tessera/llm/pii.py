"""Personal data: fixed base patterns, and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) always count.  The field adds spans
that the patterns miss, such as written-out addresses or phone numbers without a
country code.  Candidate segments are runs of digit groups, dotted quads with
odd separators and written-out addresses; overlapping candidates form a window.
A labelled segmentation of a window is scored by features of its whole segments
(lengths, group shapes, checks, the words around) and of neighbouring types.
The best one is found by dynamic programming over segment ends and the type of
the last entity.  Entities are bounded in length: digit groups to LEAST_DIGITS to
MAX_DIGITS digits, addresses by their pattern.  So a place starts a bounded number
of candidates and the programme takes time in proportion to the text, whatever the
number of entities.

The weights are fitted here by gradient ascent on the likelihood of generated
texts, in which entities and look-alikes are written in many ways.

Edge cases: a null text is empty.  Scanning is linear in the text's length.
Added spans never overlap base ones.  Of segmentations that score alike, the one
found first counts.  Rows that repeat give equal results; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
#: Digits of a candidate made of digit groups: a short phone number has 7, and no kind has more than 19.
LEAST_DIGITS, MAX_DIGITS = 7, 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out = []
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    out += [("ip", m.start(), m.end()) for m in _QUAD.finditer(text) if _octets(m.group())]
    for kind, pattern, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = _digits(m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


_GROUPS = re.compile(r"\(?\+?[0-9]+\)?(?:[ .()-]{1,3}[0-9]+\)?)*")
_GROUP = re.compile(r"[0-9]+")
_ODD_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\. ?|\[dot\]| dot )[0-9]{1,3}){3}(?![0-9])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at |\[@\]|\(@\)) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\[dot\]|\(dot\)|\[\.\]) ?| dot |\.)[A-Za-z0-9-]{1,63}+){1,4}", re.IGNORECASE | re.ASCII)
#: What every match of _WRITTEN holds: an at in brackets, or ` at ` before a label and a dot in some form.
_AT_FORM = r"[\[(](?:at|@)[\])]| (?=at  ?[a-z0-9-]{1,63}+(?:\.| dot | ?[\[(]))"
_AT = re.compile(_AT_FORM, re.IGNORECASE | re.ASCII)
_AT_BYTES = re.compile(_AT_FORM.encode(), re.IGNORECASE)
#: What the words before an entity often say (fixed values).
_CUES = {"phone": ("phone", "call", "tel", "mobile", "fax"), "card": ("card", "visa", "pay", "credit"), "ip": ("ip", "host", "server", "addr"), "email": ("mail", "contact", "write", "reach")}
_SUFFIXES = frozenset("com org net edu gov io de fr es uk info".split())

#: A segment: start, end and the key that its features follow from.
Candidate = tuple[int, int, tuple]


def _cues(text: str, start: int) -> tuple[str, ...]:
    before = text[max(0, start - 24) : start].lower()
    return tuple(kind for kind, cues in _CUES.items() if any(c in before for c in cues)) or ("none",)


def _glued(text: str, start: int, end: int) -> bool:
    return any(c.isalnum() or c in "-/$#" for c in text[max(0, start - 1) : start] + text[end : end + 1])


def _separators(span: str) -> str:
    return "".join(sorted({c for c in span if not c.isalnum()}))[:4]


def _of_groups(text: str, first: int, end: int) -> Iterator[Candidate]:
    """Segments of whole digit groups that hold LEAST_DIGITS to MAX_DIGITS digits."""
    groups = [m.span() for m in _GROUP.finditer(text, first, end)]
    if sum(e - s for s, e in groups) < LEAST_DIGITS:
        return
    for i, (start, _) in enumerate(groups):
        cues = None
        seen, seps, shape, n, wide, digits = set(), "", [], 0, False, ""
        for j in range(i, len(groups)):
            s, e = groups[j]
            n += e - s
            if n > MAX_DIGITS:
                break
            if j > i and not seen.issuperset(between := text[groups[j - 1][1] : s]):
                seen.update(between)
                seps = "".join(sorted(seen))[:4]
            shape.append(e - s)
            wide |= e - s > 8
            digits += text[s:e]
            if n < LEAST_DIGITS:
                continue
            own, own_seps = start, seps
            if start and text[start - 1] == "(" and ")" in seen:
                own, own_seps = start - 1, "".join(sorted({*seen, "("}))[:4]
            cues = cues or _cues(text, start)
            yield own, e, ("digits", n, tuple(shape[:6]), own_seps, min(len(shape), 7), cues, _glued(text, own, e), 16 <= n <= 19 and luhn(digits), own < start, wide)


def features(key: tuple) -> list[str]:
    """Features of a whole segment."""
    family, n, shape, seps, groups, cues, glued, *more = key
    out = [f"family={family}", f"{family} digits={min(n, 20)}", f"{family} shape={'-'.join(map(str, shape))}", f"{family} seps={seps}", f"{family} groups={groups}"]
    if family == "digits":
        checked, paren, wide = more
        out += [f"luhn={checked} sixteen={16 <= n <= 19}", f"paren={paren} ten={n == 10}", f"wide={wide}"]
    elif family == "quad":
        out.append(f"octets={more[0]}")
    else:
        out += [f"suffix={more[0]}", f"bracket={more[1]}", f"dots={more[2]}"]
    return out + [f"{family} cue={kind}" for kind in cues] + [f"{family} glued={glued}"]


def _whole(text: str, start: int, end: int, family: str) -> Candidate:
    span = text[start:end]
    groups = _GROUP.findall(span)
    low = span.lower()
    if family == "quad":
        more = (all(int(g) <= 255 for g in groups),)
    else:
        more = (low.rsplit(".")[-1].split()[-1].split("]")[-1].split(")")[-1].strip() in _SUFFIXES, "[" in span or "(" in span, "dot" in low)
    return start, end, (family, sum(map(len, groups)), tuple(len(g) for g in groups[:6]), _separators(span), min(len(groups), 7), _cues(text, start), _glued(text, start, end), *more)


def candidates(text: str) -> list[Candidate]:
    """All segments that may be an entity, by start and end; whether one is here follows from it and the 24 characters before."""
    out = [c for m in _GROUPS.finditer(text) for c in _of_groups(text, *m.span())]
    out += [_whole(text, *m.span(), "quad") for m in _ODD_QUAD.finditer(text)]
    if _AT.search(text):
        out += [_whole(text, *m.span(), "written") for m in _WRITTEN.finditer(text)]
    return sorted(out, key=lambda c: c[:2])


def windows(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Groups of candidates that overlap, directly or through others."""
    group: list[Candidate] = []
    reach = -1
    for c in found:
        if group and c[0] >= reach:
            yield group
            group, reach = [], -1
        group.append(c)
        reach = max(reach, c[1])
    if group:
        yield group


class _Lockstep:
    """Windows of a training set, whose sums over segmentations run side by side.

    The starts and ends of a window's candidates in order are its steps, ends
    first where they meet: at its start a candidate sees the sum over all that
    ended before.
    """

    def __init__(self, groups: list[list[Candidate]]) -> None:
        groups = sorted(groups, key=len, reverse=True)
        self.groups = groups
        self.first = np.cumsum([0, *map(len, groups)])
        steps: list[tuple[list, list, list]] = [([], [], []) for _ in range(2 * len(groups[0]))] if groups else []
        for w, g in enumerate(groups):
            events = sorted([(c[1], 0, i) for i, c in enumerate(g)] + [(c[0], 1, i) for i, c in enumerate(g)])
            for t, (_, starts, i) in enumerate(events):
                for column, x in zip(steps[t], (w, self.first[w] + i, starts), strict=True):
                    column.append(x)
        self.steps = [tuple(np.array(x, np.int64) for x in step) for step in steps]

    def sums(self, scores: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each candidate and kind: log sums before, with and after it; and each window's log sum of all."""
        n, kinds, none = len(scores), scores.shape[1], scores.shape[1]
        before, forward, backward = (np.full((n, kinds), -np.inf) for _ in range(3))
        run = np.full((len(self.groups), kinds), -np.inf)
        for w, c, starts in self.steps:
            a, b = starts == 1, starts == 0
            before[c[a]] = run[w[a]]
            reached = np.logaddexp.reduce(run[w[a]][:, :, None] + pairs[:none], axis=1) if a.any() else np.zeros((0, kinds))
            forward[c[a]] = np.logaddexp(reached, pairs[none]) + scores[c[a]]
            run[w[b]] = np.logaddexp(run[w[b]], forward[c[b]])
        total = np.logaddexp(0.0, np.logaddexp.reduce(run, axis=1))
        run = np.full_like(run, -np.inf)
        for w, c, starts in reversed(self.steps):
            a, b = starts == 1, starts == 0
            if b.any():
                backward[c[b]] = np.logaddexp(np.logaddexp.reduce(pairs[:none] + run[w[b]][:, None, :], axis=2), 0.0)
            run[w[a]] = np.logaddexp(run[w[a]], scores[c[a]] + backward[c[a]])
        return before, forward, backward, total


class Field:
    """Weights by (feature, kind) and by neighbouring kinds."""

    #: Segment keys whose scores are remembered.
    REMEMBERED = 1 << 16

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS)))  # last row: no entity before
        self._known: dict[tuple, tuple] = {}

    def _own(self, key: tuple) -> list[int]:
        """Numbers of the features; what training saw less than twice is one feature a family."""
        rare = self.numbers[f"{key[0]} rare"]
        return [self.numbers.get(f, rare) for f in features(key)]

    def scores(self, key: tuple) -> tuple[np.ndarray, bool]:
        """Scores of a segment by kind, and whether it may be an entity at all.

        Leaving a segment out changes two neighbours to one, so a kind whose score is
        less than that can cost is in no best segmentation.
        """
        got = self._known.get(key)
        if got is None:
            own = self.weights[self._own(key)].sum(axis=0)
            none = len(KINDS)
            gain = own + self.pairs.max(axis=0) + np.maximum(0, self.pairs[:none].max(axis=1)) - min(0.0, self.pairs.min())
            if len(self._known) >= self.REMEMBERED:
                self._known.clear()
            got = self._known[key] = (own, bool((gain >= 0).any()))
        return got

    def decode(self, group: list[Candidate]) -> list[tuple[str, int, int]]:
        """The best labelled segmentation of a window, by dynamic programming over segment ends and kinds."""
        able = [(s, e, own.tolist()) for s, e, key in group for own, may in (self.scores(key),) if may]
        if not able:
            return []
        none, pairs = len(KINDS), self.pairs.tolist()
        alone = pairs[none]
        reached: list[tuple[float, tuple | None]] = [(-math.inf, None)] * none  # best that has ended, by its last kind
        waiting: list[tuple[int, int, list]] = []  # candidates that have not, by their ends
        top: tuple[float, tuple | None] = (0.0, None)
        for number, (start, end, own) in enumerate(able):
            while waiting and waiting[0][0] <= start:
                for k, x in enumerate(heapq.heappop(waiting)[2]):
                    if x[0] > reached[k][0]:
                        reached[k] = x
            here = []
            for k in range(none):
                value, chain = alone[k], None
                for j in range(none):
                    if reached[j][0] + pairs[j][k] > value:
                        value, chain = reached[j][0] + pairs[j][k], reached[j][1]
                here.append((value + own[k], (KINDS[k], start, end, chain)))
                if here[k][0] > top[0]:
                    top = here[k]
            heapq.heappush(waiting, (end, number, here))
        out, chain = [], top[1]
        while chain is not None:
            out.append(chain[:3])
            chain = chain[3]
        return out[::-1]

    def learn(self, texts: list[tuple[str, set[tuple[str, int, int]]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent on the likelihood of the texts' segmentations."""
        pairs_of = [(g, truth) for text, truth in texts for g in windows(candidates(text))]
        steps = _Lockstep([g for g, _ in pairs_of])
        truth_of = {id(g): truth for g, truth in pairs_of}
        seen = Counter(f for g in steps.groups for c in g for f in features(c[2]))
        names = [f"{family} rare" for family in ("digits", "quad", "written")] + [f for f, n in seen.items() if n > 1]
        self.numbers = {f: i for i, f in enumerate(names)}
        self._known.clear()
        own = [self._own(c[2]) for g in steps.groups for c in g]
        flat, at = np.array([f for x in own for f in x], np.int64), np.cumsum([0, *map(len, own)])
        n, none, many = len(own), len(KINDS), len(names)
        right, right_pairs = np.zeros((n, none)), np.zeros_like(self.pairs)
        for w, g in enumerate(steps.groups):
            last = none
            for i, c in enumerate(g):
                for k, kind in enumerate(KINDS):
                    if (kind, c[0], c[1]) in truth_of[id(g)]:
                        right[steps.first[w] + i, k] = 1
                        right_pairs[last, k] += 1
                        last = k
        window = np.repeat(np.arange(len(steps.groups)), [len(g) for g in steps.groups])
        self.weights = np.zeros((many, none))
        squares, pair_squares = np.full_like(self.weights, 1e-6), np.full_like(self.pairs, 1e-6)
        for _ in range(rounds if n else 0):
            scores = np.add.reduceat(self.weights[flat], at[:-1], axis=0)
            before, forward, backward, total = steps.sums(scores, self.pairs)
            total = total[window][:, None]
            delta = np.repeat(right - np.exp(forward + backward - total), np.diff(at), axis=0)
            grad = np.stack([np.bincount(flat, delta[:, k], many) for k in range(none)], axis=1) - decay * self.weights * len(steps.groups)
            ahead = scores + backward - total
            expected = np.vstack([np.exp(before[:, :, None] + self.pairs[:none] + ahead[:, None, :]).sum(axis=0), np.exp(self.pairs[none] + ahead).sum(axis=0)])
            pair_grad = right_pairs - expected - decay * self.pairs * len(steps.groups)
            squares += grad**2
            pair_squares += pair_grad**2
            self.weights += rate * grad / np.sqrt(squares)
            self.pairs += rate * pair_grad / np.sqrt(pair_squares)


def generated(rows: int, seed: int) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Texts with entities and look-alikes, and the spans of the entities."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    octet = lambda: str(rng.randint(0, 255))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice([lambda: ".".join(whole[i : i + 4] for i in (0, 4, 8, 12)), lambda: "  ".join(whole[i : i + 4] for i in (0, 4, 8, 12))])()

    def phone() -> str:
        a, b, c = rng.choice("23456789") + number(2), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}"])

    def quad() -> str:
        return rng.choice(["[.]", "(.)", "[dot]", " dot ", " . "]).join(octet() for _ in range(4))

    def email() -> str:
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), ("[@]", ".")])
        return f"{word()}{rng.choice(['', '.', '_'])}{rng.choice([word(), number(2)])}{at}{word()}{dot}{rng.choice(sorted(_SUFFIXES))}"

    def decoy() -> str:
        return rng.choice(
            [
                lambda: number(rng.randint(7, 20)),
                lambda: f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}",
                lambda: f"{number(2)}.{number(2)}.{rng.randint(1900, 2030)} {number(2)} {number(2)}",
                lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}",
                lambda: " ".join(number(rng.randint(1, 4)) for _ in range(rng.randint(3, 9))),
                lambda: f"978-{number(1)}-{number(3)}-{number(5)}-{number(1)}",
                lambda: "-".join(number(rng.randint(2, 6)) for _ in range(rng.randint(2, 4))),
                lambda: f"{word()} at {word()}.{word()}",
                lambda: f"{word()} at {word()} dot {word()} {word()}",
                lambda: ".".join(number(3) for _ in range(4)),
                lambda: f"{number(3)},{number(3)}.{number(2)}",
                lambda: f"{number(3)} {number(3)} {number(4)}",
            ]
        )()

    out = []
    makers = {"card": card, "phone": phone, "ip": quad, "email": email}
    for _ in range(rows):
        text, truth = " ".join(word() for _ in range(3)) + " ", set()
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice([*KINDS, "none", "none", "none"])
            if kind == "none":
                text += decoy()
            else:
                text += rng.choice(["", "", f"{rng.choice(_CUES[kind])} ", f"{rng.choice(_CUES[kind])}: "])
                piece = makers[kind]()
                truth.add((kind, len(text), len(text) + len(piece)))
                text += piece
            text += rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        out.append((text, truth))
    return out


@lru_cache(maxsize=2)
def trained(rows: int = 700, seed: int = 11) -> Field:
    field = Field()
    field.learn(generated(rows, seed))
    return field


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    return [span for group in windows(_clear(candidates(text), sorted((s, e) for _, s, e in base))) for span in field.decode(group)]


def _clear(found: list[Candidate], taken: list[tuple[int, int]]) -> list[Candidate]:
    """Candidates that overlap none of the sorted spans."""
    if not taken:
        return found
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    return [c for c in found if (i := bisect_left(starts, c[1])) == 0 or reach[i - 1] <= c[0]]


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, base and added: lists of (kind, start, end) by kind as listed, then start; ends are exclusive, in code points."""
    field = field or trained()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred features
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            n = len(batch)
            base, added = [[]] * n, [[]] * n
            for first, _, raw, offsets in kernel.slices(batch.column(1)):
                for t in worth_reading(raw, offsets):
                    text = raw[offsets[t] : offsets[t + 1]].tobytes().decode("utf-8")
                    own = base_spans(text)
                    more = added_spans(text, own, shared.value)
                    base[first + t], added[first + t] = own, sorted(more, key=lambda s: (order[s[0]], s[1]))
            as_column = lambda lists: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in lists], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_column(base), as_column(added)], names=["id", "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    out = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel.lean(run), f"id {kind}, base {spans}, added {spans}")
    return out.withColumnRenamed("id", id_col)


def worth_reading(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that hold a digit, an at sign or a written-out at: no pattern matches without."""
    at = np.flatnonzero(((raw >= 48) & (raw <= 57)) | (raw == 64))
    found = {*np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist()}
    for m in _AT_BYTES.finditer(raw.tobytes()):
        found.add(int(np.searchsorted(offsets, m.start(), side="right")) - 1)
    return sorted(found)
