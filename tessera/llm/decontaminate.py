"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of an item (the whole item, if shorter).
Its tokens are shingles of up to `shingle` words.  A document that holds the
window holds each of its shingles, so one necessary prefix token is enough: the
rarest, by the number of documents that have it.  The steps:

1. windows and shingles of the items;
2. one pass over the documents counts the shingles that items have;
3. each window is indexed under its rarest shingle alone;
4. a second pass finds these tokens in the documents, with the words around;
5. an equi-join on the token, with the bounds that the token's place in the
   window sets, compares the window's words one by one.

Both passes use a bit table of fixed size to skip what no item
has; what it lets through by chance finds no partner in the joins.

Edge cases: a null text has no words; an item without words has no windows; an
item id may repeat and may be null (then it counts as the string `null`).
Documents are told apart by id and text, so repeated rows get equal results.
An empty table on either side leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.bits import bit_table, passes
from tessera.llm.common import bounded_batches, persisted


def _words(raw: np.ndarray, offsets: np.ndarray):
    mapped, starts, ends, at = kernel.spans(raw, offsets, kernel.ALNUM_WORDS)
    return mapped, starts, ends, at, kernel.hashes(mapped, starts, ends)


def _strings(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, end: int) -> list[str]:
    return mapped[starts[first] : ends[end - 1]].tobytes().replace(b"\0", b" ").decode("utf-8", "replace").split(" ") if end > first else []


def _plain(words: list[str]) -> list[str]:
    return [w for w in words if w]


def item_windows(items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words (of the window), size (of its shingles) and tokens (their hashes, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for first, _, raw, offsets in kernel.slices(batch.column(1)):
                mapped, starts, ends, at, hashed = _words(raw, offsets)
                for t in range(len(at) - 1):
                    n = int(at[t + 1] - at[t])
                    if not n:
                        continue
                    w, k = min(window, n), min(shingle, n)
                    words = _plain(_strings(mapped, starts, ends, at[t], at[t + 1]))
                    tokens, _ = kernel.grams(hashed[at[t] : at[t + 1]], np.array([0, n]), k)
                    tokens = tokens.view(np.int64)[: n - k + 1].tolist()
                    out += [(ids[first + t], words[i : i + w], k, tokens[i : i + w - k + 1]) for i in range(n - w + 1)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "words", "size", "tokens"])

    out = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return out.mapInArrow(kernel.lean(run), "item string, words array<string>, size int, tokens array<long>").distinct()


def _sizes(windows: DataFrame) -> list[int]:
    """At most `shingle` different ones."""
    return sorted(r[0] for r in windows.select("size").distinct().collect())


def _frequencies(docs: DataFrame, table, sizes: list[int]) -> DataFrame:
    """token, docs: in how many texts each token of the table occurs, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            found = []
            for _, _, raw, offsets in kernel.slices(batch.column(0)):
                _, _, _, at, hashed = _words(raw, offsets)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for k in sizes:
                    tokens, whole = kernel.grams(hashed, at, k)
                    hit = np.flatnonzero(whole & passes(bits, tokens))
                    pairs = np.unique(np.rec.fromarrays([text[hit], tokens[hit]]))
                    found.append(pairs["f1"] if len(pairs) else np.zeros(0, np.uint64))
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], names=["token", "docs"])

    return docs.select("text").mapInArrow(kernel.lean(run), "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))


def _occurrences(docs: DataFrame, table, sizes: list[int], reach: int) -> DataFrame:
    """Of each document: n_words and hits (token, pos, first, words): words holds those from position first, up to `reach` on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            counts, hits = [], []
            for _, _, raw, offsets in kernel.slices(batch.column(2)):
                mapped, starts, ends, at, hashed = _words(raw, offsets)
                counts += np.diff(at).tolist()
                own: list[list] = [[] for _ in range(len(at) - 1)]
                for k in sizes:
                    tokens, whole = kernel.grams(hashed, at, k)
                    for p in np.flatnonzero(whole & passes(bits, tokens)).tolist():
                        t = int(np.searchsorted(at, p, side="right")) - 1
                        first, end = max(int(at[t]), p - reach), min(int(at[t + 1]), p + reach)
                        own[t].append({"token": int(tokens[p : p + 1].view(np.int64)[0]), "pos": p - int(at[t]), "first": first - int(at[t]), "words": _plain(_strings(mapped, starts, ends, first, end))})
                hits += own
            kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["id", "key", "n_words", "hits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", "text").mapInArrow(kernel.lean(run), f"id {kind}, key long, n_words long, hits array<struct<token:long,pos:int,first:int,words:array<string>>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: the id, text_hash (that of the text), n_words, n_hit, n_items, items (sorted ids as strings) and contaminated."""
    spark = bounded_batches(docs).sparkSession
    windows = persisted(item_windows(items, window, shingle), "windows")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    sizes = _sizes(windows)
    tokens = windows.select(F.explode("tokens").alias("token"))
    seen = spark.sparkContext.broadcast(bit_table(tokens, "token"))
    common = persisted(_frequencies(own, seen, sizes), "token-counts")

    placed = windows.withColumn("wid", F.xxhash64("item", "words")).select("wid", "item", "words", "size", F.posexplode("tokens").alias("place", "token"))
    ranked = placed.join(common, "token", "left").groupBy("wid", "item", "words").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "token", "place", "size")).alias("rarest"))
    # A window whose rarest token is in no document at all needs no join.
    index = persisted(ranked.where("rarest.docs > 0").select("item", "words", F.col("rarest.token").alias("token"), F.col("rarest.place").alias("place")), "prefixes")
    prefixes = spark.sparkContext.broadcast(bit_table(index, "token"))

    found = persisted(_occurrences(own, prefixes, sizes, window), "occurrences")
    hits = found.select("id", "key", F.explode("hits").alias("hit")).select("id", "key", "hit.*").withColumnRenamed("words", "around")
    start = F.col("pos") - F.col("place")
    fits = (start >= F.col("first")) & (start - F.col("first") + F.size("words") <= F.size("around"))
    pairs = hits.join(index, "token").where(fits).where(F.slice("around", start - F.col("first") + 1, F.size("words")) == F.col("words"))
    pairs = pairs.select("id", "key", start.alias("start"), (start + F.size("words")).alias("end"), "item").distinct()

    named = pairs.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    before = Window.partitionBy("id", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = pairs.select("id", "key", "start", "end").distinct().withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = covered.groupBy("id", "key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    found, named, covered = found.alias("f"), named.alias("n"), covered.alias("c")
    same = lambda x: F.col("f.id").eqNullSafe(F.col(f"{x}.id")) & F.col("f.key").eqNullSafe(F.col(f"{x}.key"))
    out = found.join(named, same("n"), "left").join(covered, same("c"), "left")
    n_hit = F.coalesce("c.n_hit", F.lit(0))
    items_of = F.coalesce("n.items", F.array().cast("array<string>"))
    return out.select(F.col("f.id").alias(id_col), F.col("f.key").alias("text_hash"), F.col("f.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that hold no window of an item."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col)
    gone = persisted(found.where("contaminated").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")


def oracle(window: int = 10) -> str:
    """DuckDB SQL for the digest of contamination over the views documents and benchmark."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, {words} as w from documents),
b as (select cast(item_id as varchar) as item, {words} as w from benchmark),
bw as (select distinct item, least(len(w), {window}) as n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') as s
  from (select item, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), sizes where i + n - 1 <= len(w)),
m as (select doc_id, i, dw.n, item from dw join bw on dw.n = bw.n and dw.s = bw.s),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id"""
