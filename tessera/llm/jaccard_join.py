"""Jaccard self-join over word shingles by token-combination prefixes, and its components.

Texts with equal shingle sets are one class; only classes are joined.  All
tokens (shingles) have one order: those not known to be frequent come first, by
hash, then the frequent ones from rare to common.  Two classes tokens' overlap
must be at least t = 80 % of either size, so with one token a signature the
first n - t + 1 tokens of each must share one.  The most common tokens form a
second class: there a signature is a pair of tokens, and the prefix is extended
by one token that doesn't count, which keeps the guarantee: of tokens that two
prefixes share, one at most may be of the second class when they share no
signature.  So a passage that much of the corpus shares makes candidates only of
texts that share two such tokens and have few of their own.

Classes that share a signature meet in its bucket.  Not all pairs of a bucket are
looked at: first each member is compared with the bucket's pivot, and the links
found make components; then only pairs of different components remain.  These
are made directly in small buckets, and in large ones block by block within a
task, which returns only links that join components.  A parity sketch of each set, whose differing bits are at most the sets'
differing tokens, drops pairs that cannot link; the rest are verified on whole
sets.  Every link between different sets either is found or joins classes that
are in one component already.

Which tokens are frequent is estimated from tokens that repeat within a task,
and kept in a list of FREQUENT at most; it only sets the order, so the result
does not depend on it.  Sets are compared by 64-bit hashes of their tokens.

Edge cases: a text of fewer words than a shingle has its whole sequence as one;
a null text or one without words has an empty set, links with nothing and is
its own component.  Repeated ids are joined by their texts only.  A component of
null ids alone has a null id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.bits import bit_table, passes
from tessera.llm.common import Scratch, bounded_batches, persisted
from tessera.llm.components import components

#: Tokens in the list of frequent ones at most, and of the second class at most.
FREQUENT, PAIRED = 1 << 18, 256
#: Members of a bucket up to which its pairs are made directly, and of a block.
SMALL, BLOCK = 24, 2048
#: Classes that a task remembers, so as to send each once.
REMEMBERED = 1 << 20


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Two sets link when 100 * intersection >= percent * union.
    percent: int = 80
    #: Estimated documents from which a token may be of the second class.
    paired_from: int = 64


def needed(n: int, percent: int) -> int:
    """The smallest overlap that a set of n tokens has with any set it links with."""
    return -(-n * percent // 100)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct tokens of each text."""
    for first, _, raw, offsets in kernel.slices(column):
        mapped, starts, ends, at = kernel.spans(raw, offsets, kernel.SPACE_WORDS)
        tokens, where = kernel.shingles(kernel.hashes(mapped, starts, ends), at, k)
        for t in range(len(where) - 1):
            yield first + t, np.unique(tokens[where[t] : where[t + 1]])


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number; 0 for the empty set."""
    if not len(tokens):
        return 0
    mixed = kernel.mix(tokens + np.uint64(0x632BE59BD9B4E019))
    x = kernel.mix(np.array([int(mixed.sum(dtype=np.uint64)) ^ (len(tokens) * 0x9E3779B97F4A7C15 % 2**64)], np.uint64) ^ np.bitwise_xor.reduce(kernel.mix(mixed)))
    return int(x.view(np.int64)[0]) or 1


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash slot, with 4 to 8 slots a token."""
    bits = 64 << max(0, (len(tokens) // 16).bit_length())
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities for fewer slots."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(na: np.ndarray, nb: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many tokens can link: the union is at least (na + nb + differing) / 2."""
    return 100 * (na + nb - differing) >= percent * (na + nb + differing)


def _digests(docs: DataFrame, s: Settings) -> DataFrame:
    """A row for each document (n, cls, sketch), and rows for tokens that repeat within a task (token, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        size = 0

        def repeated() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *pending]), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            none = lambda kind: pa.nulls(len(tokens), kind)
            return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), id_kind), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], names=names)

        id_kind, names = None, ["id", "key", "n", "cls", "sketch", "token", "count"]
        for batch in batches:
            id_kind = batch.column(0).type
            n, cls, sketches = [], [], []
            for _, tokens in _sets(batch.column(2), s.shingle):
                c = class_of(tokens)
                n.append(len(tokens))
                cls.append(c)
                sketches.append(sketch(tokens))
                if c not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(c)
                    pending.append(tokens)
                    size += len(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
            if size > 2_000_000:
                yield repeated()
                pending, size = [], 0
        if size:
            yield repeated()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(kernel.lean(run), f"id {kind}, key long, n long, cls long, sketch binary, token long, count long")


def signatures(tokens: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, paired: int, percent: int) -> np.ndarray:
    """Signatures of a set; ranks[i] is the place of frequent[i] (sorted) in the order, the last `paired` places being of the second class."""
    n = len(tokens)
    need = n - needed(n, percent) + 1
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        known = frequent[at] == tokens
        rank[known] = ranks[at[known]] + 1
    order = np.argsort(rank, kind="stable")
    tokens, rank = tokens[order], rank[order]
    second = rank > len(frequent) - paired
    first = int(np.searchsorted(second, True)) if second.any() else n
    if first >= need:
        return tokens[:need]
    # One token of the second class doesn't count.
    pairs_of = tokens[first : need + 1]
    i, j = np.triu_indices(len(pairs_of), 1)
    return np.concatenate([tokens[:first], kernel.mix(pairs_of[i] + kernel.mix(pairs_of[j] ^ np.uint64(0x2545F4914F6CDD1D)))])


def _postings(docs: DataFrame, order, s: Settings) -> DataFrame:
    """sig, cls and n: each task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranks, paired = order.value
        seen: set[int] = set()
        for batch in batches:
            sigs, cls, n = [np.zeros(0, np.uint64)], [], []
            for _, tokens in _sets(batch.column(0), s.shingle):
                c = class_of(tokens)
                if not c or c in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(c)
                sigs.append(signatures(tokens, frequent, ranks, paired, s.percent))
                cls.append(c)
                n.append(len(tokens))
            lengths = [len(x) for x in sigs[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(cls, np.int64), lengths)), pa.array(np.repeat(np.array(n, np.int32), lengths))], names=["sig", "cls", "n"])

    return docs.select("text").mapInArrow(kernel.lean(run), "sig long, cls long, n int")


def _met(postings: DataFrame) -> DataFrame:
    """Rows of signatures that more than one class has, without repeats; the input is sorted by sig and cls within partitions, and no signature is in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits to see whether its signature goes on
        previous, started = None, False
        names = ["sig", "cls", "n"]
        for batch in batches:
            if not len(batch):
                continue
            sig, cls, n = (np.asarray(batch.column(i)) for i in range(3))
            if held is not None:
                sig, cls, n = (np.append(h, x) for h, x in zip(held, (sig, cls, n), strict=True))
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            sig, cls, n = sig[new], cls[new], n[new]
            same = np.zeros(len(sig) + 1, bool)
            same[1:-1] = sig[1:] == sig[:-1]
            same[0] = started and previous == sig[0]  # the held row has met its kind before
            keep = (same[:-1] | same[1:])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (sig, cls, n)], names=names)
            started, previous = (bool(same[-2]) if len(sig) > 1 else bool(same[0])), sig[-1]
            held = (sig[-1:], cls[-1:], n[-1:])
        if held is not None and started:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)

    return postings.mapInArrow(kernel.lean(run), "sig long, cls long, n int")


def _sketched(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""
    joined = pairs.join(sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    joined = joined.join(sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            differing = np.zeros(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(x), len(y))
                differing[i] = np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum()
            keep = pa.array(may_link(na, nb, differing, s.percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return joined.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(kernel.lean(run), "a long, b long")


def _sets_of(classes: DataFrame, docs: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """cls and tokens of the wanted classes (a column cls), and of a few others, read from the texts once more."""
    wanted = classes.sparkSession.sparkContext.broadcast(bit_table(classes, "cls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            cls, sets = [], []
            for _, tokens in _sets(batch.column(0), s.shingle):
                c = class_of(tokens)
                if c and c not in seen and passes(bits, np.array([c], np.int64).view(np.uint64))[0]:
                    if len(seen) < REMEMBERED:
                        seen.add(c)
                    cls.append(c)
                    sets.append(tokens)
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), kernel.lists(np.concatenate([np.zeros(0, np.uint64), *sets]), at)], names=["cls", "tokens"])

    return scratch.persisted(docs.select("text").mapInArrow(kernel.lean(run), "cls long, tokens array<long>").dropDuplicates(["cls"]), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) that link, by whole sets."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")), docs, s, scratch)
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * common >= s.percent * (F.size("ta") + F.size("tb") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))


class _Roots:
    """Components of the members of a block, as they grow together."""

    def __init__(self, roots: np.ndarray) -> None:
        _, self.of = np.unique(roots, return_inverse=True)

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def spanning_links(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of left and of right (places) that join what was apart; roots tells what is together already."""
    n = np.array([len(x) for x in sets])
    width = 1 << max(6, min(13, int(16 * n.max()).bit_length()))
    sketches = np.zeros((len(sets), width // 8), np.uint8)
    for i, x in enumerate(sets):
        sketches[i] = np.packbits((np.bincount((x >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little")
    sketches = sketches.view(np.uint64)
    together, out = _Roots(roots), []
    for i in left.tolist():
        spot = right[(together.of[right] != together.of[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        if not len(spot):
            continue
        differing = np.bitwise_count(sketches[spot] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        for j in spot[may_link(n[i], n[spot], differing, percent)].tolist():
            if together.of[i] == together.of[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (n[i] + n[j] - common):
                together.join(i, j)
                out.append((i, j))
    return out


def _across(rows: DataFrame, docs: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Links (u, v) between different roots in large buckets.

    Buckets of one pivot, which mostly hold the same classes, are one group (grp,
    cls, root); its members are dealt into blocks, and each pair of blocks is
    compared in one task, which returns only links that join what is apart.
    """
    rows = scratch.persisted(rows.distinct(), "groups")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    own = rows.join(sizes.select("grp", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "grp")
    own = scratch.persisted(own.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "blocks")
    sets = _sets_of(own.select("cls"), docs, s, scratch)
    # A row goes to each pair of blocks that its own is in; a group of one block is a pair with itself.
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("grp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "root").join(sets, "cls")

    def run(table: pa.Table) -> pa.Table:
        block, cls = np.asarray(table.column("block")), np.asarray(table.column("cls"))
        tokens = table.column("tokens").combine_chunks()
        flat, at = np.asarray(tokens.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(tokens.value_lengths()))])
        sets_of = [np.sort(flat[at[i] : at[i + 1]]) for i in range(len(cls))]
        left, right = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("x", "y"))
        found = spanning_links(sets_of, np.asarray(table.column("root")), left, right, s.percent)
        return pa.table([pa.array([int(cls[p[i]]) for p in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return own.select("grp", "x", "y", "block", "cls", "root", "tokens").groupBy("grp", "x", "y").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: id, n_shingles, cls (equal for equal sets) and component_id (the smallest id of its component)."""
    s = settings or Settings()
    spark = bounded_batches(docs).sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digests = persisted(_digests(docs, s), "digests")
    own = digests.where(F.col("n").isNotNull()).select("id", "key", "n", "cls", "sketch")
    # The list is FREQUENT rows at most.
    counted = digests.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token, count = np.asarray(counted.column(0)).astype(np.int64).view(np.uint64), np.asarray(counted.column(1)).astype(np.int64)
    by = np.lexsort((token, count))
    token, count = token[by], count[by]
    paired = min(PAIRED, int((count >= s.paired_from).sum()))
    place = np.argsort(token)
    order = spark.sparkContext.broadcast((token[place], place.astype(np.int64), paired))

    scratch = Scratch()
    postings = _postings(docs, order, s).repartition("sig").sortWithinPartitions("sig", "cls")
    buckets = scratch.persisted(_met(postings), "buckets")
    sketches = scratch.persisted(own.where("n > 0").join(buckets.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

    fits = 100 * F.least("n", "m") >= s.percent * F.greatest("n", "m")
    pivots = buckets.groupBy("sig").agg(F.min(F.struct("cls", "n")).alias("p")).select("sig", F.col("p.cls").alias("a"), F.col("p.n").alias("m"))
    starred = buckets.join(pivots, "sig").where((F.col("cls") != F.col("a")) & fits).select("a", F.col("cls").alias("b")).distinct()
    links = scratch.persisted(_verified(scratch.persisted(_sketched(starred, sketches, s), "star-pairs"), docs, s, scratch), "links")

    roots = scratch.persisted(components(links), "roots")
    rooted = buckets.join(roots, buckets["cls"] == roots["node"], "left").select("sig", "cls", "n", F.coalesce("root", "cls").alias("root"))
    open_ = rooted.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    sizes = scratch.persisted(open_.select("sig", "members"), "open")
    rooted = scratch.persisted(rooted.join(sizes, "sig").select("sig", "cls", "n", "root", "members"), "rooted")
    few = rooted.where(F.col("members") <= SMALL)
    left, right = few.select("sig", F.col("cls").alias("a"), "n", F.col("root").alias("ra")), few.select("sig", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"))
    direct = left.join(right, "sig").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits).select("a", "b").distinct()
    rest = scratch.persisted(_sketched(direct, sketches, s), "rest-pairs")
    grouped = rooted.where(F.col("members") > SMALL).join(pivots, "sig").select(F.col("a").alias("grp"), "cls", "root")
    more = scratch.persisted(_verified(rest, docs, s, scratch).union(_across(grouped, docs, s, scratch)), "links")

    whole = persisted(components(links.union(more)).withColumnRenamed("node", "cls"), "components")
    scratch.discard()
    placed = own.select("id", "key", "n", "cls").join(whole, "cls", "left").select("id", "key", "n", "cls", F.coalesce("root", "cls").alias("root"))
    # Written out, so that the join can split a component that holds much of the corpus.
    least = persisted(placed.where("n > 0").groupBy("root").agg(F.min("id").alias("least")), "least")
    out = placed.join(least, "root", "left")
    some = F.col("n") > 0
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_hash"), F.col("n").alias("n_shingles"), "cls", F.when(some, F.col("root")).alias("component"), F.when(some, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def deduplicated(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (nulls last; ties by the text's hash), with the columns of docs.

    Rows with empty sets all stay.
    """
    found = persisted(near_duplicates(docs, settings, id_col, text_col), "near-duplicates")
    own = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))
    first = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(own).alias("k")).select("k.__id", "k.__hash")
    empty = found.where(F.col("component").isNull()).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = lambda x, y: (F.col(id_col).eqNullSafe(y["__id"])) & (x == y["__hash"])
    keep = persisted(first.unionByName(empty).distinct(), "kept")
    kept = docs.join(keep, same(F.xxhash64(text_col), keep), "left_semi")
    # Rows that repeat both id and text can't be told apart by a join.
    twice = persisted(found.where(F.col("component").isNotNull()).groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).count().where("count > 1").select("__id", "__hash"), "repeated")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same(F.xxhash64(text_col), twice), "left_anti")
    return once.unionByName(kept.join(twice, same(F.xxhash64(text_col), twice), "left_semi").withColumn("__hash", F.xxhash64(text_col)).dropDuplicates([id_col, "__hash"]).drop("__hash"))


def oracle(shingle: int = 5, percent: int = 80) -> str:
    """DuckDB SQL for near_duplicates over the view documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
with recursive w as (select doc_id, {words} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {shingle} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle} - 1], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= {percent} * (nx.n + ny.n - c)),
e as (select x, y from l union select y, x from l),
r as (select x as a, y as b from e union select r.a, e.y from r join e on r.b = e.x),
m as (select a, min(b) as b from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) as component_id from w left join n on n.doc_id = w.doc_id left join m on m.a = w.doc_id"""
