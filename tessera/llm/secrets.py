"""Secret scans: fixed base patterns, and automata inferred from labelled credentials.

The base patterns (assign, access, hex) always count.  Their matches in all
documents are the labelled credentials, of which each kind keeps the `max_strings`
with the smallest hashes.  They are written as strings of character classes and put in a prefix tree, whose
states are merged while their outcomes are statistically compatible (Hoeffding
bounds, as in ALERGIA), which gives a probabilistic automaton of the format.
Ordinary long words and numbers of all documents, again `max_strings` of them, give
one of the background; those that a format explains better than the background are
bare credentials, and are taken out of it until none is left.

Every run of credential characters of at least MIN_LENGTH that holds a digit, or
of LONG_LENGTH without, is a candidate, in whole documents.  It is scored by the
log-likelihood ratio per character of the best format against the background,
and added as a span of that kind above a threshold that keeps all but
`false_share` of the strings drawn from the background out.  The rule is the same
at every size of the sample, and bare credentials in the sample don't move it.

Edge cases: a null text is empty; without enough labelled credentials of a kind
(LEAST) that kind adds nothing.  Added spans never overlap base ones.  Repeated
rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches

KINDS = ("assign", "access", "hex")
MIN_LENGTH, LONG_LENGTH, LEAST = 12, 24, 10
#: The ratio per character that a candidate must reach in any case.
LEAST_RATIO = 0.35


@dataclass(frozen=True)
class Settings:
    #: Different matches of each kind, and different ordinary candidates, that automata are inferred from at most.
    max_strings: int = 2_000
    #: Confidence of the merge test, and the share of ordinary strings that may pass, among so many drawn ones.
    alpha: float = 0.05
    false_share: float = 1e-3
    draws: int = 20_000


_CI = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_ASSIGN = re.compile(rf"""({"|".join(_CI(w) for w in ("password", "passwd", "secret", "token"))}|{_CI("api")}_?{_CI("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_CLASS = kernel._table(lambda b: 48 <= b <= 57 or 97 <= b <= 102)
#: Characters of credentials, so that any character outside ASCII ends a run; dots and equals signs end sentences, so a candidate is stripped of them.
_RUN = kernel._table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b"+/_.=-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def classes(s: str) -> str:
    """One letter for each character: digit, hex letter or other letter by case, and symbols as they are."""
    return "".join("9" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "z" if "g" <= c <= "z" else "H" if "A" <= c <= "F" else "Z" if "G" <= c <= "Z" else c for c in s)


SYMBOLS = 12  # five classes, six symbols and the end


class Automaton:
    """Probabilistic automaton: transitions and counts of each state; state 0 is the start."""

    def __init__(self, strings: list[str], alpha: float) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in strings:
            state = 0
            for c in s:
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][c]
            self.count[state]["$"] = self.count[state].get("$", 0) + 1
        self._merge(alpha)

    def _differ(self, a: int, b: int, bound: float) -> bool:
        na, nb = sum(self.count[a].values()), sum(self.count[b].values())
        if not na or not nb:
            return False
        limit = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        return any(abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > limit for c in {*self.count[a], *self.count[b]})

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b, bound):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self, alpha: float) -> None:
        """Red states are final; a blue one, the target of a red one, is merged into the first compatible red or made red."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, known = [0], {0}
        while True:
            blue = next(((r, c, t) for r in red for c, t in sorted(self.next[r].items()) if t not in known), None)
            if blue is None:
                break
            r, c, t = blue
            for other in red:
                if self._compatible(other, t, bound):
                    self.next[r][c] = other
                    self._fold(other, t)
                    break
            else:
                red.append(t)
                known.add(t)
        number = {s: i for i, s in enumerate(red)}
        self.next = [{c: number[t] for c, t in self.next[s].items()} for s in red]
        self.count = [self.count[s] for s in red]

    def log_likelihood(self, s: str) -> float:
        """Per character, smoothed; characters without a transition lead back to the start."""
        state, total = 0, 0.0
        for c in s + "$":
            own = self.count[state]
            total += math.log((own.get(c, 0) + 0.05) / (sum(own.values()) + 0.05 * SYMBOLS))
            state = self.next[state].get(c, 0)
        return total / (len(s) + 1)

    def draw(self, rng: random.Random, most: int) -> str:
        """A string of the automaton, ended at `most` characters at the latest."""
        state, out = 0, []
        while len(out) < most:
            own = self.count[state]
            (c,) = rng.choices([*own], [*own.values()])
            if c == "$":
                break
            out.append(c)
            state = self.next[state][c]
        return "".join(out)


@dataclass(frozen=True)
class Model:
    formats: dict[str, Automaton]
    background: Automaton | None
    threshold: float

    def score(self, s: str) -> tuple[float, str]:
        """Log-likelihood ratio per character of the best format, and its kind."""
        own = classes(s)
        ground = self.background.log_likelihood(own) if self.background else -math.log(SYMBOLS)
        return max(((a.log_likelihood(own) - ground, k) for k, a in self.formats.items()), default=(-math.inf, ""))


def candidates(raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By text, byte spans of runs of credential characters that are long enough, without dots and equals signs at the ends."""
    mapped, starts, ends, at = kernel.spans(raw, offsets, _RUN)
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    length = ends - starts
    fits = (length >= MIN_LENGTH) & (digits[ends] > digits[starts]) | (length >= LONG_LENGTH)
    out: dict[int, list[tuple[int, int]]] = {}
    for w in np.flatnonzero(fits).tolist():
        s, e = int(starts[w]), int(ends[w])
        while e > s and raw[e - 1] in b".=-_/+":
            e -= 1
        while e > s and raw[s] in b".=-_/+":
            s += 1
        if e - s >= MIN_LENGTH:
            t = int(np.searchsorted(at, w, side="right")) - 1
            out.setdefault(t, []).append((s - int(offsets[t]), e - int(offsets[t])))
    return out


def worth_reading(raw: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts that may hold a base match: a key word, AKIA, or 32 hexadecimal characters."""
    data = raw.tobytes()
    spots = [m.start() for m in re.finditer(rb"(?i)passw|secret|token|api_?key|AKIA", data)]
    _, starts, ends, _ = kernel.spans(raw, offsets, _HEX_CLASS)
    spots += starts[ends - starts >= 32].tolist()
    return set((np.searchsorted(offsets, spots, side="right") - 1).tolist()) if spots else set()


class _Smallest:
    """The strings of the smallest hashes, each once."""

    def __init__(self, most: int) -> None:
        self.most, self.bound, self.held = most, 1 << 64, {}

    def add(self, value: bytes) -> None:
        h = xxhash.xxh64_intdigest(value)
        if h < self.bound:
            self.held[h] = value
            if len(self.held) > 2 * self.most:
                self._cut()

    def _cut(self) -> None:
        self.held = dict(sorted(self.held.items())[: self.most])
        if len(self.held) == self.most:
            self.bound = max(self.held)

    def strings(self) -> list[tuple[int, str]]:
        self._cut()
        return [(h - (1 << 63), value.decode()) for h, value in self.held.items()]


def learn(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {kind: _Smallest(settings.max_strings) for kind in ("", *KINDS)}
        for batch in batches:
            for _, _, raw, offsets in kernel.slices(batch.column(0)):
                read = worth_reading(raw, offsets)
                found = candidates(raw, offsets)
                for t in read | {*found}:
                    data = raw[offsets[t] : offsets[t + 1]]
                    base = []
                    if t in read:
                        text = data.tobytes().decode("utf-8")
                        base = base_spans(text)
                        for kind, s, e in base:
                            own[kind].add((_ASSIGN.match(text, s).group(2) if kind == "assign" else text[s:e]).encode())
                    for (s, e), _ in clear_of(found.get(t, []), base, data):
                        own[""].add(data[s:e].tobytes())
        rows = [(kind, h, value) for kind, x in own.items() for h, value in x.strings()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["kind", "h", "value"])

    rows = bounded_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(kernel.lean(run), "kind string, h long, value string")
    # What is among the smallest of all is among the smallest of its task, and of its share.
    for by in (["kind", F.pmod("h", F.lit(64))], ["kind"]):
        rows = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h", "value"))).where(F.col("place") <= settings.max_strings).drop("place")
    rows = rows.collect()  # four times max_strings at most
    strings: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["h"], r["value"])):
        own = strings.setdefault(r["kind"], [])
        own.append(classes(r["value"]))
    formats = {k: Automaton(strings[k], settings.alpha) for k in KINDS if len(strings.get(k, ())) >= LEAST}
    if not formats:
        return Model(formats, None, math.inf)
    background = _background(strings.get("", []), formats, settings.alpha)
    return Model(formats, background, _threshold(formats, background, settings))


def _ratio(s: str, formats: dict[str, Automaton], background: Automaton) -> float:
    return max(a.log_likelihood(s) for a in formats.values()) - background.log_likelihood(s)


def _background(plain: list[str], formats: dict[str, Automaton], alpha: float) -> Automaton | None:
    """The automaton of the strings that no format explains better than the automaton itself."""
    while plain:
        background = Automaton(plain, alpha)
        ordinary = [s for s in plain if _ratio(s, formats, background) <= 0]
        if len(ordinary) == len(plain):
            return background
        plain = ordinary
    return None


def _threshold(formats: dict[str, Automaton], background: Automaton | None, settings: Settings) -> float:
    """The ratio that the share `false_share` of the strings drawn from the background exceed, and a margin."""
    if background is None:
        return LEAST_RATIO
    rng = random.Random(1)
    drawn = (background.draw(rng, 4 * LONG_LENGTH) for _ in range(settings.draws))
    ratios = sorted((_ratio(s, formats, background) for s in drawn if len(s) >= MIN_LENGTH), reverse=True)
    edge = ratios[int(len(ratios) * settings.false_share)] if ratios else 0.0
    return max(LEAST_RATIO, edge + 0.05)


def clear_of(found: list[tuple[int, int]], base: list[tuple[str, int, int]], data: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Byte spans of candidates and their spans in code points, but for those that overlap a base span."""
    if not found:
        return
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for s, e in found:
        a, b = int(lead[s]), int(lead[e])
        before = bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            yield (s, e), (a, b)


def added_spans(data: np.ndarray, found: list[tuple[int, int]], base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """data: the bytes of a text; found: byte spans of candidates."""
    out = []
    for (s, e), (a, b) in clear_of(found, base, data):
        score, kind = model.score(data[s:e].tobytes().decode())
        if score > model.threshold:
            out.append((kind, a, b))
    return out


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, base and added: lists of (kind, start, end) by start, then kind as listed; ends are exclusive, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_strings strings a kind
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            base, added = [[]] * n, [[]] * n
            for first, _, raw, offsets in kernel.slices(batch.column(1)):
                read = worth_reading(raw, offsets)
                found = candidates(raw, offsets) if shared.value.formats else {}
                for t in read | {*found}:
                    data = raw[offsets[t] : offsets[t + 1]]
                    own = base_spans(data.tobytes().decode("utf-8")) if t in read else []
                    base[first + t], added[first + t] = own, added_spans(data, found.get(t, []), own, shared.value)
            as_column = lambda lists: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in lists], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_column(base), as_column(added)], names=["id", "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    out = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel.lean(run), f"id {kind}, base {spans}, added {spans}")
    return out.withColumnRenamed("id", id_col)
