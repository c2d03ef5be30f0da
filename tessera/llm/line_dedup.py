"""Line deduplication with DataFrame operations only.

Each line is a 128-bit key hash with its document and position.  The hashes are
range-partitioned together with a salt of the document, so that a line that a
third of all rows share is spread over many ranges; within a range they are
sorted by document and position, and a window streams over them marking first
occurrences.  Their sums, a row for each key, decide what is dropped.  What goes
back to the documents is a sparse bitmap of dropped lines, 64 to a word, not
text; a word without a dropped line is left out.

Edge cases: a null or empty text is one empty line; keys below min_chars are
never dropped.  A document is an id: rows that repeat an id count once, and each
of them loses the same keys.  A null id is an id of its own.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import persisted

#: A hot key is dealt over this many windows.
SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text"), F.col(text_col).alias("__lines"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __text (hash of the text) and dropped, a map from word number to 64 bits, for documents that lose lines.

    keep_first keeps a key's first line, in the smallest document id at the
    smallest position; otherwise every line of such a key is dropped.
    """
    keyed = F.transform(lines_of(F.col("__lines")), line_key)
    long_enough = F.length("key") >= min_chars
    rows = _identified(docs, id_col, text_col).select("__id", "__text", F.posexplode(keyed).alias("pos", "key")).where(long_enough)
    rows = rows.select("__id", "__text", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS))).repartitionByRange(F.col("h"), F.col("salt"))
    inside = Window.partitionBy("h", "salt").orderBy("g", "__id", "pos")
    same = F.lag("g").over(inside).eqNullSafe(F.col("g")) & F.lag("__id").over(inside).eqNullSafe(F.col("__id")) & F.lag(F.lit(1)).over(inside).isNotNull()
    firsts = dealt.select("h", "g", "__id", "pos", (~same).alias("first")).where("first")
    counts = firsts.groupBy("h", "g").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("__id", "pos")).alias("at"))
    # Written out, so that the join deals both its sides anew and can split a hot key, or broadcasts a small table.
    hit = persisted(counts.where(F.col("docs") >= min_docs), "lines")
    gone = rows.join(hit.select("h", "g", "at"), ["h", "g"])
    if keep_first:
        gone = gone.where(~(F.col("at.__id").eqNullSafe(F.col("__id")) & (F.col("at.pos") == F.col("pos"))))
    words = gone.groupBy("__id", "__text", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits"))
    return words.groupBy("__id", "__text").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with n_lines, n_dropped and kept_text after them; input columns of these names are replaced."""
    maps = keep_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col)
    maps = maps.select(F.col("__id").alias("__m_id"), F.col("__text").alias("__m_text"), F.col("dropped").alias("__m_dropped"))
    own = docs.withColumn("__hash", F.xxhash64(F.col(text_col)))
    joined = own.join(maps, own[id_col].eqNullSafe(maps["__m_id"]) & (own["__hash"] == maps["__m_text"]), "left")
    lines = lines_of(F.col(text_col))
    kept = F.when(F.col("__m_dropped").isNull(), lines).otherwise(
        F.filter(lines, lambda x, i: F.getbit(F.coalesce(F.try_element_at(F.col("__m_dropped"), F.shiftright(i, 6)), F.lit(0).cast("long")), i % 64) == 0)
    )
    joined = joined.withColumn("__kept", kept)
    return joined.select(*(F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept_text"))


def oracle(min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB SQL for the digest of dedup_lines over the view documents."""
    return f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{_UPPER}', '{_LOWER}') as key from l),
c as (select key from k where length(key) >= {min_chars} group by key having count(distinct doc_id) >= {min_docs}),
d as (select k.*, c.key is not null as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from d group by doc_id"""
