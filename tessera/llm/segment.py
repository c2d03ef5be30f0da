"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node for each place between characters and an edge for
each piece that fits; a path from end to end is a segmentation, whose weight is
the product of its pieces' weights.  A piece of rank r weighs (r + 2) ** -alpha;
a character without a piece falls back to its bytes.  No piece crosses from a
word into the space before the next, so the lattice falls apart into units.

The k segmentations with the largest Gumbel-perturbed log-probabilities are a
sample of k without replacement.  They are found from the top by an A-star
search: the largest perturbed value below a node is known for every node in the
queue, so nodes are popped in that order.  A popped node is followed down to a
leaf; of what is left aside there, each unit's other segmentations go into the
queue as one node, with a Gumbel value truncated at the node's own, and are
split along the path that was taken only when they are popped themselves.
The search runs for all texts of a slice in step, on arrays.

A segmentation's inclusion score is its probability of being in the sample given
the next largest perturbed value, 1 - exp(-exp(log p - next)).

Randomness comes from the row's key (a hash of its id), the unit and the round,
so results don't depend on how rows are dealt out.

Edge cases: a null or empty text has one segmentation, without ids.  A text with
fewer than k segmentations gives them all, with inclusion score 1; of a unit
whose other segmentations have a chance below e ** -34 together, which doubles
can't tell from none, they are not drawn.  Decoding
gives the text back exactly, but for U+2581, which the vocabulary's spaces use,
and null, which comes back empty.  Equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches

#: The file of the vocabulary, at any path that the driver or Spark can read; executors get a copy of it.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
SLICE_BYTES = 1 << 17


@dataclass(frozen=True)
class Settings:
    samples: int = 3
    alpha: float = 0.7
    seed: int = 1


class Vocabulary:
    """Pieces with log weights, in a hash table of all their beginnings."""

    BITS = 18

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        usable = []
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usable.append(i)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.plain = pa.array([bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)], pa.large_binary())
        rank = np.array([min(-model.get_score(i), n) for i in range(n)])
        self.log_weight = -alpha * np.log(np.maximum(rank, 0) + 2.0) - np.log(np.log(n))
        self.byte_weight = -alpha * np.log(n + 2.0) - np.log(np.log(n))
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.crossing = any("▁" in self.pieces[i].lstrip("▁") for i in usable)
        known: dict[int, int] = {}
        for i in usable:
            points = [ord(c) for c in self.pieces[i]]
            h = 0
            for j, c in enumerate(points):
                h = (h * 0x5851F42D4C957F2D + c + 1) % (1 << 64)
                known.setdefault(h, -1)
                if j == len(points) - 1:
                    known[h] = i
        keys = np.fromiter(known, np.uint64, len(known))
        values = np.fromiter(known.values(), np.int32, len(known))
        mixed = kernel.mix(keys)
        bits = self.BITS
        while len(keys) * 4 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slot = (mixed >> self.shift).astype(np.int64)
        place = np.full(1 << bits, -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):  # linear probing: of those that want a slot, the first gets it
            free = place[slot[todo]] < 0
            got = todo[free]
            _, first = np.unique(slot[got], return_index=True)
            place[slot[got[first]]] = got[first]
            todo = np.setdiff1d(todo, got[first])
            slot[todo] = (slot[todo] + 1) & self.mask
        # By slot: the hash and its value, -2 where there is none.
        self.keys = np.where(place < 0, np.uint64(0), keys[place])
        self.values = np.where(place < 0, np.int32(-2), values[place])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of the piece that each hash stands for; -1 if it only begins one, -2 if not even that."""
        slot = (kernel.mix(h) >> self.shift).astype(np.int64)
        out = self.values[slot]
        todo = np.flatnonzero((self.keys[slot] != h) & (out > -2))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = slot[todo]
            out[todo] = self.values[at]
            todo = todo[(self.keys[at] != h[todo]) & (out[todo] > -2)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _handed_out(spark: SparkSession, model_file: str) -> str:
    """Has executors fetch the file; its name for SparkFiles."""
    spark.sparkContext.addFile(model_file)
    return model_file.rstrip("/").rsplit("/", 1)[-1]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first .. first + count - 1 of each row, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((kernel.mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def marked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice with marks for spaces and before each text that isn't empty, and the texts' offsets."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    length = np.diff(lead)
    some = (length > 0).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(length + some)])
    out = np.full(at[-1], SPACE, np.uint32)
    out[np.arange(len(points)) + np.repeat(np.cumsum(some), length)] = np.where(points == 32, np.uint32(SPACE), points)
    return out, at


class Lattice:
    """The lattices of distinct units, end to end; take() adds those of a slice's texts.

    edge is the first edge of each node; a unit's last node has none, so a node's edges
    end where those of the next one begin.  Edges are sorted by their start node: size in characters, piece (below 0 for the bytes of
    the character -1 - piece), log, the log-probability given the start node, and
    until, the probability of the edge and those after it.  Long pieces, the
    likeliest, come last and are tried first.
    """

    #: Edges from which the lattice gives up the units that were used least before it takes another slice, and those that it keeps then at most.
    MOST_EDGES, KEPT_EDGES = 2_000_000, 1_000_000

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._sizes: dict[str, int] = {}
        for name, kind in (("first_node", np.int64), ("last_node", np.int64), ("uses", np.int32), ("edge", np.int64), ("size", np.int8), ("piece", np.int32), ("log", np.float64), ("until", np.float32)):
            setattr(self, name, np.zeros(1024, kind))
            self._sizes[name] = 0

    def _shed(self) -> None:
        """Keeps the units that are used most, those used once since the last time never; halves their uses."""
        count = self._sizes["first_node"]
        first, last, uses = self.first_node[:count], self.last_node[:count], self.uses[:count]
        edge, edges = self.edge[first], self.edge[last] - self.edge[first]
        order = np.argsort(-uses, kind="stable")
        order = order[(np.cumsum(edges[order]) <= self.KEPT_EDGES) & (uses[order] > 1)]
        kept = np.sort(order)
        nodes, edges, uses = last[kept] - first[kept] + 1, edges[kept], uses[kept] // 2
        node_at, edge_at = np.cumsum(nodes) - nodes, np.cumsum(edges) - edges
        spot = _ranges(edge[kept], edges)
        own = {name: getattr(self, name)[spot] for name in ("size", "piece", "log", "until")}
        own["edge"] = self.edge[_ranges(first[kept], nodes)] + np.repeat(edge_at - edge[kept], nodes)
        own |= {"first_node": node_at, "last_node": node_at + nodes - 1, "uses": uses}
        for name, values in own.items():
            self._sizes[name] = 0
            self._append(name, values)
        place = np.full(count, -1, np.int64)
        place[kept] = np.arange(len(kept))
        place = place[self.places]
        self.keys, self.places = self.keys[place >= 0], place[place >= 0]

    def _append(self, name: str, values: np.ndarray) -> None:
        own, size = getattr(self, name), self._sizes[name]
        if size + len(values) > len(own):
            wider = np.zeros(max(len(own) * 3 // 2, size + len(values)), own.dtype)
            wider[:size] = own[:size]
            setattr(self, name, own := wider)
        own[size : size + len(values)] = values
        self._sizes[name] = size + len(values)

    def take(self, points: np.ndarray, at: np.ndarray) -> None:
        """Sets unit, the unit of each place of the texts, and units_of, the units of each text."""
        if self._sizes["size"] > self.MOST_EDGES:
            self._shed()
        n = len(points)
        space = points == SPACE
        start = np.zeros(n, bool)
        if n and not self.vocab.crossing:
            start[1:] = space[1:] & ~space[:-1]
        start[at[:-1][np.diff(at) > 0]] = True
        first = np.flatnonzero(start)
        length = np.diff(np.append(first, n))
        self.units_of = np.diff(np.searchsorted(first, at))
        up, down = kernel._power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(kernel.mix(points.astype(np.uint64) + np.uint64(7)) * up[:n], out=total[1:])
        key = kernel.mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))
        own, where, unit, uses = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        spot = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == own[inside]
        place = np.full(len(own), -1, np.int64)
        place[known] = self.places[spot[known]]
        new = np.flatnonzero(~known)
        place[new] = self._sizes["first_node"] + np.arange(len(new))
        if len(new):
            self._build(points[_ranges(first[where[new]], length[where[new]])], length[where[new]])
            self.keys, self.places = np.insert(self.keys, spot[new], own[new]), np.insert(self.places, spot[new], place[new])
        self.uses[place] += uses.astype(np.int32)
        self.unit = place[unit]

    def _build(self, chars: np.ndarray, length: np.ndarray) -> None:
        """Adds the lattices of units whose characters stand one after the other."""
        vocab, m = self.vocab, len(chars)
        node_at = np.concatenate([[0], np.cumsum(length + 1)])
        unit_of = np.repeat(np.arange(len(length)), length)
        node_of = np.arange(m) + unit_of
        rest = node_at[1:][unit_of] - 1 - node_of  # characters from here to the unit's end

        # Every character begins an edge of its own; of longer pieces, where they begin and which they are.
        todo, h, longer = np.arange(m), np.zeros(m, np.uint64), []
        degree = np.ones(m, np.int64)
        for size in range(vocab.longest):
            h = h * np.uint64(0x5851F42D4C957F2D) + chars[todo + size].astype(np.uint64) + np.uint64(1)
            found = vocab.find(h)
            if size:
                hit = np.flatnonzero(found >= 0)
                longer.append((todo[hit], found[hit]))
                degree[longer[-1][0]] += 1
            else:
                single = found
            go = np.flatnonzero((found > -2) & (rest[todo] > size + 1))
            todo, h = todo[go], h[go]
            if not len(todo):
                break
        first = np.cumsum(degree) - degree
        total = int(degree.sum())
        piece, size = np.zeros(total, np.int32), np.ones(total, np.int8)
        free = first + 1
        piece[first] = np.maximum(single, 0)
        for i, (begins, found) in enumerate(longer):
            spot = free[begins]
            piece[spot], size[spot] = found, i + 2
            free[begins] = spot + 1
        log = vocab.log_weight[piece]
        alone = np.flatnonzero(single < 0)  # bytes in place of a piece
        wide = chars[alone]
        piece[first[alone]] = -1 - wide.astype(np.int32)
        log[first[alone]] = vocab.byte_weight * (1 + (wide >= 0x80) + (wide >= 0x800) + (wide >= 0x10000))
        dst = np.repeat(node_of, degree) + size

        back = np.zeros(int(node_at[-1]))  # log weight of all paths to the unit's end
        chance = np.empty(total)
        most = int(rest.max(initial=0))
        order = np.argsort(rest.astype(np.int16) if most < 1 << 15 else rest, kind="stable")
        cuts = np.cumsum(np.bincount(rest, minlength=most + 1))
        for d in range(len(cuts) - 1):
            level = order[cuts[d] : cuts[d + 1]]
            if len(level) < 16:  # the beginnings of a few long units
                for c in level.tolist():
                    own = slice(first[c], first[c] + degree[c])
                    ways = log[own] + back[dst[own]]
                    back[node_of[c]] = np.logaddexp.reduce(ways)
                    log[own] = ways - back[node_of[c]]
                    chance[own] = np.exp(log[own])
            else:
                number = degree[level]
                edges, head = _ranges(first[level], number), np.cumsum(number) - number
                ways = log[edges] + back[dst[edges]]
                top = np.maximum.reduceat(ways, head)
                share = np.exp(ways - np.repeat(top, number))
                whole = np.add.reduceat(share, head)
                back[node_of[level]] = to_end = top + np.log(whole)
                log[edges] = ways - np.repeat(to_end, number)
                chance[edges] = share / np.repeat(whole, number)
        log = np.minimum(log, 0.0)
        running = np.cumsum(chance)
        until = np.repeat(running[first + degree - 1], degree) - (running - chance)
        until[first] = 2.0  # whatever rounding has left

        edge = np.empty(int(node_at[-1]), np.int64)
        edge[node_of] = first
        ends = node_at[1:] - 1
        edge[ends] = np.append(first, total)[np.cumsum(length)]
        node, edges = self._sizes["edge"], self._sizes["size"]
        for name, values in (("first_node", node_at[:-1] + node), ("last_node", ends + node), ("uses", np.zeros(len(length), np.int32)), ("edge", edge + edges), ("size", size), ("piece", piece), ("log", log), ("until", until)):
            self._append(name, values)

    def draw(self, node: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path from each node to the last of its unit: edges one after the other, their number and log-probability."""
        n = len(node)
        now = np.flatnonzero(node != last)
        current, end, seed = node[now], last[now], seed[now]
        rows, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(now):
            edge = self.edge[current + 1] - 1
            u = _uniform(seed + np.uint64((len(steps) - 1) * 0xD1342543DE82EF95 % 2**64))
            todo = np.flatnonzero(u > self.until[edge])
            while len(todo):
                edge[todo] -= 1
                todo = todo[u[todo] > self.until[edge[todo]]]
            rows.append(now)
            steps.append(edge)
            current = current + self.size[edge]
            go = np.flatnonzero(current != end)
            now, current, end, seed = now[go], current[go], end[go], seed[go]
        row, edge = np.concatenate(rows), np.concatenate(steps)
        count, log = np.bincount(row, minlength=n), np.bincount(row, self.log[edge], n)
        first = np.cumsum(count) - count
        out = np.zeros(len(edge), np.int64)
        out[first[row] + np.repeat(np.arange(len(rows)) - 1, [len(x) for x in rows])] = edge
        return out, count, log


def _truncated(location, most, u):
    """A Gumbel value at the location, given that it is below `most`."""
    return location - np.logaddexp(location - most, np.log(-np.log(u)))


@dataclass
class _Path:
    """A segmentation: edges, their number by unit, the log-probability before each unit and of the whole."""

    edges: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    total: float
    value: float


class _Search:
    """The queue and the results of one text."""

    def __init__(self) -> None:
        self.paths: list[_Path] = []
        self.queue: list[tuple] = []  # (value, path, unit, edges kept of the unit, edge or None, log-probability up to there)


def _taken(search: _Search, node: tuple, lattice: Lattice) -> int:
    """Characters of a unit that a node's kept edges and its edge take."""
    _, at, unit, kept, edge, _ = node
    path = search.paths[at]
    first = int(path.counts[:unit].sum())
    return int(lattice.size[path.edges[first : first + kept]].sum(dtype=np.int64)) + int(lattice.size[edge])


def _expand(search: _Search, node: tuple, lattice: Lattice, of: int, seed: np.uint64) -> tuple:
    """Splits `all other paths of this unit` into the edges beside the path; one of them inherits the value."""
    value, at, unit, kept, _, before = node
    path = search.paths[at]
    first = int(path.counts[:unit].sum())
    own = path.edges[first : first + int(path.counts[unit])]
    log = before
    beside, location = [], []
    src = int(lattice.first_node[of]) + int(lattice.size[own[:kept]].sum(dtype=np.int64))
    for i, (taken, size) in enumerate(zip(own[kept:].tolist(), lattice.size[own[kept:]].tolist(), strict=True), kept):
        begin, end = lattice.edge[src : src + 2].tolist()
        logs = lattice.log[begin:end].tolist()
        for e in range(begin, end):
            if e != taken:
                beside.append((i, e))
                location.append(log + logs[e - begin])
        log += logs[taken - begin]
        src += size
    location = np.array(location)
    u = _uniform(seed + np.arange(2 * len(beside), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    chosen = int((location - np.log(-np.log(u[: len(beside)]))).argmax())
    values = _truncated(location, value, u[len(beside) :])
    for j, (i, e) in enumerate(beside):
        if j != chosen:
            search.queue.append((float(values[j]), at, unit, i, e, float(location[j])))
    i, e = beside[chosen]
    return (value, at, unit, i, e, float(location[chosen]))


def search(lattice: Lattice, keys: np.ndarray, settings: Settings) -> list[_Search]:
    """The samples of all texts of a slice; keys: a hash of each text's row."""
    count, k = len(keys), settings.samples
    unit_at = np.concatenate([[0], np.cumsum(lattice.units_of)])
    seeds = kernel.mix(keys.astype(np.uint64) + np.uint64(settings.seed * 0xA0761D6478BD642F % 2**64))
    searches = [_Search() for _ in range(count)]
    # What each text follows down: (value, path, unit, edges kept, edge, log-probability); at first the root.
    popped: list[tuple | None] = [(float(x), -1, 0, 0, None, 0.0) for x in -np.log(-np.log(_uniform(seeds)))]
    for turn in range(k):
        live = [t for t in range(count) if popped[t] is not None]
        if not live:
            break
        texts = np.array(live)
        unit = np.array([popped[t][2] for t in live], np.int64)
        first = unit_at[texts] + unit
        width = unit_at[texts + 1] - first
        row = np.repeat(np.arange(len(live)), width)
        spot = _ranges(first, width)
        own = lattice.unit[spot]
        node, last = lattice.first_node[own].copy(), lattice.last_node[own]
        head = np.cumsum(width) - width
        inside = np.array([popped[t][4] is not None for t in live], bool)
        node[head[inside]] += np.array([_taken(searches[t], popped[t], lattice) for t in live if popped[t][4] is not None], np.int64)
        seed = seeds[texts][row] + (spot - unit_at[texts][row]).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64((turn + 1) * 0xE7037ED1A0B428DB % 2**64)
        seed = kernel.mix(seed)
        edges, number, log = lattice.draw(node, last, seed)
        start = np.array([popped[t][5] for t in live])
        running = np.cumsum(log)
        before = running - log
        before = before - before[head[row]] + start[row]
        value = np.array([popped[t][0] for t in live])
        # Of each unit, all other paths together.
        with np.errstate(divide="ignore"):
            others = np.log(-np.expm1(np.minimum(log, -1e-300)))
        location = before + others
        aside = np.where(others > -34, _truncated(location, value[row], _uniform(seed ^ np.uint64(0x1D8E4E27C47D124F))), -np.inf)
        edge_at = np.concatenate([[0], np.cumsum(number)])
        best = aside.copy()
        tops = []
        for _ in range(k + 1 - turn):  # as many as can still be popped
            if not len(best):
                break
            most = np.maximum.reduceat(best, head[width > 0])
            tops.append(most)
            hit = np.flatnonzero(best == np.repeat(most, width[width > 0]))
            best[hit] = -np.inf
        limit = np.full(len(live), np.inf)
        if tops:
            limit[width > 0] = tops[-1]
        picked = np.flatnonzero((aside >= limit[row]) & (aside > -np.inf))
        by_row: list[list[int]] = [[] for _ in live]
        for p in picked.tolist():
            by_row[row[p]].append(p)
        for r, t in enumerate(live):
            s, (own_value, at, u, kept, e, _) = searches[t], popped[t]
            a, b = int(head[r]), int(head[r] + width[r])
            new, counts, befores = edges[edge_at[a] : edge_at[b]], number[a:b], before[a:b]
            held = 0
            if at >= 0:
                old = s.paths[at]
                held_edges = int(old.counts[:u].sum()) + kept
                new = np.concatenate([old.edges[:held_edges], [e], new])
                counts = np.concatenate([old.counts[:u], counts])
                counts[u] += kept + 1
                befores = np.concatenate([old.before[:u], befores])
                held = kept + 1
            total = float(befores[-1] + log[b - 1]) if b > a else 0.0
            s.paths.append(_Path(new, counts, befores, total, own_value))
            for p in by_row[r]:
                here = u + (p - a)
                s.queue.append((float(aside[p]), len(s.paths) - 1, here, held if p == a else 0, None, float(before[p])))
            s.queue.sort(key=lambda x: -x[0])
            del s.queue[k + 1 - turn :]
            popped[t] = None
            if turn + 1 < k and s.queue:
                node_ = s.queue.pop(0)
                if node_[4] is None:
                    node_ = _expand(s, node_, lattice, int(lattice.unit[unit_at[t] + node_[2]]), kernel.mix(seeds[t : t + 1] + np.uint64(turn * 64 + 9))[0])
                    s.queue.sort(key=lambda x: -x[0])
                popped[t] = node_
    return searches


_SAMPLE = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"


def encode(docs: DataFrame, settings: Settings | None = None, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and samples: distinct segmentations with ids, log_prob, perturbed and inclusion, in order of perturbed."""
    settings = settings or Settings()
    file = _handed_out(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(file), settings.alpha)
        lattice = Lattice(vocab)
        for batch in batches:
            keys = np.asarray(batch.column(1)).view(np.uint64)
            for first, end, raw, offsets in kernel.slices(batch.column(2), SLICE_BYTES):
                points, at = marked(raw, offsets)
                lattice.take(points, at)
                found = search(lattice, keys[first:end], settings)
                paths = [p for s in found for p in s.paths]
                ids, lengths = _ids(lattice, [p.edges for p in paths], vocab)
                inclusion = [1.0 if not s.queue else float(-np.expm1(-np.exp(min(700.0, p.total - s.queue[0][0])))) for s in found for p in s.paths]
                ids_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()))
                flat = pa.StructArray.from_arrays([ids_of, pa.array([p.total for p in paths], pa.float64()), pa.array([p.value for p in paths], pa.float64()), pa.array(inclusion, pa.float64())], names=["ids", "log_prob", "perturbed", "inclusion"])
                of = np.concatenate([[0], np.cumsum([len(s.paths) for s in found])])
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.ListArray.from_arrays(pa.array(of, pa.int32()), flat)], names=["id", "samples"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col).alias("text"))
    return own.mapInArrow(kernel.lean(run), f"id {kind}, samples {_SAMPLE}").withColumnRenamed("id", id_col)


def _ids(lattice: Lattice, paths: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all paths, one after the other, and their number by path."""
    lengths = np.array([len(p) for p in paths], np.int64)
    piece = lattice.piece[np.concatenate([np.zeros(0, np.int64), *paths])].astype(np.int64)
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        return piece, lengths
    path = np.repeat(np.arange(len(paths)), lengths)
    point = -1 - piece[odd]
    size = np.ones(len(piece), np.int64)
    size[odd] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    at = np.cumsum(size) - size
    out = np.repeat(piece, size)
    out[_ranges(at[odd], size[odd])] = vocab.byte_ids[np.frombuffer("".join(map(chr, point)).encode("utf-8", "surrogatepass"), np.uint8)]
    return out, np.bincount(path, size, len(paths)).astype(np.int64)


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    data = b"".join(bytes([int(vocab.pieces[i][3:5], 16)]) if vocab.is_byte[i] else vocab.pieces[i].encode() for i in ids)
    return data.decode("utf-8", "replace").replace("▁", " ")[1:]


def decode_lists(ids: pa.Array, vocab: Vocabulary) -> pa.Array:
    """decode_ids of each list of a column; null for null."""
    flat = ids.flatten()
    at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))])
    joined = vocab.plain.take(flat)
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(flat) else np.zeros(0, np.uint8)
    cut = (ends - ends[0])[at]
    head = cut[:-1][np.diff(cut) > 0]
    if (data[head] == 32).all():  # the space before each text
        keep = np.ones(len(data), bool)
        keep[head] = False
        cut = cut - np.concatenate([[0], np.cumsum(np.diff(cut) > 0)])
        texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data[keep].tobytes()))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no text
            pass
        else:
            return pc.if_else(ids.is_valid(), texts, None).cast(pa.string())
    return pa.array([None if x is None else decode_ids(x, vocab) for x in ids.to_pylist()], pa.string())


def decode(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL_FILE, text_col: str = "text") -> DataFrame:
    """encoded with the column text_col, which replaces one of that name: the text of the ids; null for null."""
    names = [c for c in encoded.columns if c != text_col]
    file = _handed_out(encoded.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(file), Settings.alpha)
        for batch in batches:
            texts = decode_lists(batch.column(len(names)), vocab)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), texts], names=[*names, text_col])

    return bounded_batches(encoded).select(*names, F.col(ids_col).alias("__ids")).mapInArrow(kernel.lean(run), StructType([*(encoded.schema[c] for c in names), StructField(text_col, StringType())]))
