"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-cased letters with one space for each run of anything
else.  Every training text is counted, but for those kept for the calibration:
each task sums the grams of the highest order by language, and a shuffle sums the
tasks.  The lower orders count in how many contexts a gram continues, and below the
first lies the same chance for each of Unicode's code points, so that a language's
probabilities after any context sum to 1.  Counts of counts, contexts and
probabilities are computed by Spark over all grams of all languages.  The
probabilities, and the weights that contexts leave to the lower order, stand in
sorted arrays of gram hashes, in files of the shared folder that every executor
gets and maps, so the model may be larger than memory.  A gram that a language lacks
gets from it what its context leaves times the chance in the next lower order.  The
language with the lowest cross-entropy per character wins.

The score is the winner's posterior from the differences of cross-entropies times a
slope.  The slope is fitted on labelled rows that are not counted: the share
`calibration_share` of the training rows, and `calibration_rows` at most.  `rejected`
says that the score is below `reject_below` or that the text is farther from
every model than those rows' texts are.

Edge cases: a text that is null or has no letter is `und` with score 0.  Rows
without a language or with a null text teach nothing.  If no row can teach,
everything is `und`.  Ties between languages go to the alphabetically first.
The columns text, lang and the id are read; others are ignored.
"""

from __future__ import annotations

import functools
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches, checkpoint_folder, delete_at_end, fold, persisted


@dataclass(frozen=True)
class Settings:
    order: int = 4
    #: Labelled rows kept for the calibration: their share, and about how many at most.
    calibration_share: float = 0.05
    calibration_rows: int = 2000
    reject_below: float = 0.6


@dataclass(frozen=True)
class Model:
    """The arrays are in files that SparkFiles has by name."""

    languages: list[str]
    order: int
    files: dict[tuple[int, str], str]  # by table and part
    floors: tuple[float, ...]  # by language: log probability of a character that it lacks, after no context
    slope: float
    limit: float  # cross-entropy above which a text is rejected


#: The characters that the lowest order deals its chance out to.
ALPHABET = sys.maxunicode + 1
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Of each code point: its lower-case letter, or a space."""
    if not _letters:
        out = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def letters(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column as (first row, end row, letters, offsets); every text starts and ends with a space."""
    table = _letter_table()
    for first, end, raw, offsets in kernel.slices(column):
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]  # offsets in code points
        n = end - first
        out = np.full(len(points) + 2 * n, 32, np.uint32)
        of = np.repeat(np.arange(n), np.diff(lead))
        out[np.arange(len(points)) + 2 * of + 1] = table[points]
        at = lead + 2 * np.arange(n + 1)
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        keep[at[:-1]] = True
        yield first, end, out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _hash(chars: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the grams that end at each character from order - 1 on."""
    n = max(0, len(chars) - order + 1)
    out = np.zeros(n, np.uint64)
    for i in range(order):
        out = out * np.uint64(0x5851F42D4C957F2D) + chars[i : i + n].astype(np.uint64) + np.uint64(1)
    return kernel.mix(out)


def _pack(grams: np.ndarray) -> np.ndarray:
    """Rows of code points as strings of fixed width."""
    return np.ascontiguousarray(grams.astype(np.uint32)).view(f"<U{grams.shape[1]}").ravel()


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """lang, gram and n over all rows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list] = {}
            langs = batch.column(1).to_pylist()
            for first, end, chars, at in letters(batch.column(0)):
                hashed = _hash(chars, order)
                whole = np.arange(len(hashed)) + order <= np.repeat(at[1:], np.diff(at))[: len(hashed)]
                of = np.repeat(np.arange(end - first), np.diff(at))[: len(hashed)]
                names = sorted(set(langs[first:end]))
                number = np.array([names.index(x) for x in langs[first:end]])
                for i, name in enumerate(names):
                    own = np.flatnonzero(whole & (number[of] == i))
                    _, where, n = np.unique(hashed[own], return_index=True, return_counts=True)
                    spots = own[where]
                    grams = _pack(chars[spots[:, None] + np.arange(order)]) if len(spots) else np.zeros(0, f"<U{order}")
                    total.setdefault(name, []).append((grams, n))
            for name, parts in total.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(kernel.lean(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smooth(counts: dict[str, dict[str, int]], order: int) -> list[dict[str, dict[str, float]]]:
    """Of each order from 1 and each language: gram to interpolated Kneser-Ney probability of its last character.

    The plain form of probabilities(), for tables that fit in memory.
    """
    out: list[dict[str, dict[str, float]]] = [{} for _ in range(order)]
    for lang, top in counts.items():
        tables = [top]
        for _ in range(order - 1):  # lower orders count distinct contexts to the left
            lower: dict[str, int] = {}
            for gram in tables[0]:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            tables.insert(0, lower)
        below: dict[str, float] = {}
        for k, table in enumerate(tables):
            once, twice = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
            cut = once / (once + 2 * twice) if once and twice else 0.5
            mass: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for gram, n in table.items():
                mass[gram[:-1]] = mass.get(gram[:-1], 0) + n
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            below = {g: (n - cut) / mass[g[:-1]] + cut * kinds[g[:-1]] / mass[g[:-1]] * (below[g[1:]] if k else 1.0 / ALPHABET) for g, n in table.items()}
            out[k][lang] = below
            # The weight that a context leaves to the lower order, under the context itself.
            out[k][lang + "\0left"] = {c: cut * kinds[c] / mass[c] for c in mass}
    return out


def probabilities(grams: DataFrame, order: int) -> DataFrame:
    """place, lang, gram and value: at place k - 1 log probabilities of the grams of order k, at order + k - 1 log weights that contexts of k - 1 characters leave to the lower order."""
    tables = [grams]
    for k in range(order, 1, -1):  # lower orders count distinct contexts to the left
        tables.insert(0, persisted(tables[0].groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n")), f"grams{k - 1}"))
    out, below = [], None
    for k, table in enumerate(tables, 1):
        once, twice = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
        cut = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
        by_lang = table.groupBy("lang").agg(cut.alias("cut"))  # a row a language
        context = F.substring("gram", 1, k - 1).alias("context")
        left = table.groupBy("lang", context).agg(F.sum("n").alias("mass"), F.count("*").alias("kinds")).join(F.broadcast(by_lang), "lang")
        left = left.withColumn("left", F.col("cut") * F.col("kinds") / F.col("mass"))
        each = table.select("lang", "gram", "n", context, F.substring("gram", 2, k - 1).alias("suffix")).join(left, ["lang", "context"])
        out.append(left.select(F.lit(order + k - 1).alias("place"), "lang", F.col("context").alias("gram"), F.log("left").alias("value")))
        if below is not None:
            each = each.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["lang", "suffix"])
        else:
            each = each.withColumn("low", F.lit(1.0 / ALPHABET))
        below = persisted(each.select("lang", "gram", ((F.col("n") - F.col("cut")) / F.col("mass") + F.col("left") * F.col("low")).alias("p")), f"probabilities{k}")
        out.append(below.select(F.lit(k - 1).alias("place"), "lang", "gram", F.log("p").alias("value")))
    return functools.reduce(DataFrame.union, out)


_TOP = np.uint64(1 << 63)  # turned over, unsigned hashes are in the order of signed ones
_PARTS = {"keys": np.uint64, "at": np.int64, "lang": np.int32, "log": np.float32}


def _write(values: DataFrame, langs: list[str], order: int) -> dict[tuple[int, str], str]:
    """Writes what probabilities() gives to files of sorted arrays in the shared folder, and hands them to the executors; their names by place and part."""
    length = [*range(1, order + 1), *range(order)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            for k in np.unique(place).tolist():
                own = batch.filter(pa.array(place == k))
                chars = np.frombuffer("".join(own.column(2).to_pylist()).encode("utf-32-le"), np.uint32)
                h = (_hash(chars, length[k])[:: length[k]] ^ _TOP).view(np.int64)  # of the grams one after the other
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(h), own.column(1), own.column(3)], names=["place", "h", "lang", "value"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs, pa.string())
        for batch in batches:
            place = batch.column(0).to_numpy()
            for k in np.unique(place).tolist():
                own = batch.filter(pa.array(place == k))
                keys = own.column(1).to_numpy().view(np.uint64) ^ _TOP
                n = pc.list_value_length(own.column(2)).to_numpy().astype(np.int64)
                each = own.column(2).flatten()
                lang = pc.index_in(each.field(0), value_set=names).to_numpy().astype(np.int32)
                log = each.field(1).to_numpy().astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, n, lang, log))], names=["place", *_PARTS])

    rows = values.mapInArrow(kernel.lean(hashed), "place int, h long, lang string, value double").groupBy("place", "h").agg(F.collect_list(F.struct("lang", "value")).alias("each"))
    blobs = rows.orderBy("place", "h").mapInArrow(kernel.lean(packed), "place int, keys binary, at binary, lang binary, log binary")
    spark = values.sparkSession
    jvm = spark.sparkContext._jvm
    name = f"tessera-language-{uuid.uuid4().hex}"
    folder = f"{checkpoint_folder(spark)}/{name}"
    delete_at_end(spark, folder)
    at = jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, streams, last = {}, {}, {}
    try:
        for row in blobs.toLocalIterator():
            k = row["place"]
            for part in _PARTS:
                data = row[part]
                if part == "at":  # offsets, from numbers of entries
                    ends = np.cumsum(np.frombuffer(data, np.int64)) + last.get(k, 0)
                    data = ends.tobytes() if k in last else np.append(0, ends).tobytes()
                    last[k] = int(ends[-1])
                if (k, part) not in streams:
                    files[k, part] = f"{name}-{k}-{part}"
                    streams[k, part] = system.create(jvm.org.apache.hadoop.fs.Path(at, files[k, part]))
                streams[k, part].write(bytearray(data))
    finally:
        for stream in streams.values():
            stream.close()
    for file in files.values():
        spark.sparkContext.addFile(system.makeQualified(jvm.org.apache.hadoop.fs.Path(at, file)).toString())
    return files


class _Table:
    """Log values by gram hash and language."""

    def __init__(self, model: Model, place: int) -> None:
        read = lambda x, kind: np.memmap(SparkFiles.get(model.files[place, x]), kind, "r") if (place, x) in model.files else np.zeros(0, kind)
        part = {x: read(x, kind) for x, kind in _PARTS.items()}
        self.finder, self.at, self.lang, self.log = _Lookup(part["keys"]), part["at"], part["lang"], part["log"]

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What there is of the wanted hashes: their indices, languages and log values."""
        place = self.finder.find(wanted)
        row = np.flatnonzero(place >= 0)
        first, n = self.at[place[row]], self.at[place[row] + 1] - self.at[place[row]]
        spot = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return np.repeat(row, n), self.lang[spot], self.log[spot]


class _Tables:
    """The mapped arrays of a model in a worker."""

    CELLS = 1 << 21

    def __init__(self, model: Model) -> None:
        self.width, self.floors = len(model.languages), np.array(model.floors)
        self.grams = [_Table(model, k) for k in range(model.order)]
        self.left = [None, *(_Table(model, model.order + k) for k in range(1, model.order))]

    def values(self, hashed: list[np.ndarray], spots: np.ndarray, level: int) -> np.ndarray:
        """Log probabilities by language of the characters at spots, each given the level - 1 before; a language that lacks the gram has there what its lower orders give."""
        out = np.zeros((len(spots), self.width))
        todo = np.ones(out.shape, bool)
        for k in range(level, 0, -1):
            row, lang, log = self.grams[k - 1].entries(hashed[k - 1][spots - k + 1])
            own = todo[row, lang]
            out[row[own], lang[own]] += log[own]
            todo[row, lang] = False
            if k > 1 and todo.any():
                row, lang, log = self.left[k - 1].entries(hashed[k - 2][spots - k + 1])
                own = todo[row, lang]
                out[row[own], lang[own]] += log[own]
        return np.where(todo, out + self.floors, out)


class _Lookup:
    """Sorted arrays with a table of the places where each leading hash part begins."""

    PART = 16

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.part = np.uint64(64 - min(20, max(self.PART, len(keys).bit_length())))
        self.begin = np.searchsorted(keys, np.arange(1 << (64 - int(self.part)), dtype=np.uint64) << self.part)
        self.steps = int(np.diff(np.append(self.begin, len(keys))).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted hashes, or -1."""
        place = self.begin[(wanted >> self.part).astype(np.int64)]
        last = len(self.keys) - 1
        todo = np.arange(len(wanted))
        out = np.full(len(wanted), -1, np.int64)
        for i in range(self.steps):
            spot = np.minimum(place[todo] + i, last)
            got = self.keys[spot]
            hit = got == wanted[todo]
            out[todo[hit]] = spot[hit]
            todo = todo[got < wanted[todo]]
            if not len(todo):
                break
        return out


def entropies(tables: _Tables, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: cross-entropy per character for each language, and its number of letters."""
    count = len(at) - 1
    of = np.repeat(np.arange(count), np.diff(at))
    n = len(chars)
    use = np.ones(n, bool)
    use[at[:-1][np.diff(at) > 0]] = False  # the leading space is context only
    spot = np.flatnonzero(use)
    order, width = len(tables.grams), tables.width
    level = np.minimum(order, spot - at[:-1][of[spot]] + 1)  # a text's first characters have less context
    hashes = [_hash(chars, k) for k in range(1, order + 1)]
    sums = np.zeros((count, width))
    step = max(1, tables.CELLS // max(1, width))
    for k in range(1, order + 1):
        own = np.flatnonzero(level == k)
        gram = hashes[k - 1][spot[own] - k + 1]
        by = np.argsort(gram, kind="stable")
        own, gram = own[by], gram[by]
        new = np.ones(len(own), bool)
        new[1:] = gram[1:] != gram[:-1]
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        for a in range(0, len(first), step):  # each gram is looked up once
            some = slice(*np.searchsorted(number, (a, a + step)))
            values = tables.values(hashes, spot[own[first[a : a + step]]], k)
            text, place = of[spot[own[some]]], number[some] - a
            for j in range(width):
                sums[:, j] += np.bincount(text, values[place, j], count)
    letters_of = np.bincount(of[chars != 32], minlength=count)
    scored = np.bincount(of[spot], minlength=count)
    return -sums / np.maximum(1, scored)[:, None], letters_of


def _judge(model: Model, per: np.ndarray, letters_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the winner, its score, and the lowest cross-entropy."""
    best = per.argmin(axis=1)
    low = per[np.arange(len(per)), best]
    # A longer text is surer, but not in proportion: its characters are not independent.
    gain = -(per - low[:, None]) * model.slope * np.sqrt(np.maximum(1, letters_of))[:, None]
    return best, 1 / np.exp(np.maximum(gain, -50)).sum(axis=1), low


def fit(docs: DataFrame, settings: Settings | None = None, folds: int = 5, held_out: int = 0) -> Model:
    """Learns from rows whose id is not in the held-out fold."""
    settings = settings or Settings()
    rows = bounded_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", "text", "lang")
    total = rows.count()
    slots = 1_000_003
    share = min(settings.calibration_share, settings.calibration_rows / max(1, total))
    kept = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)) < int(slots * share)
    grams = persisted(count_grams(rows.where(~kept), settings.order), "grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return Model([], settings.order, {}, (), 1.0, 0.0)
    values = persisted(probabilities(grams, settings.order), "language")
    first = {r["lang"]: r["value"] for r in values.where(F.col("place") == settings.order).collect()}  # a row a language
    files = _write(values.where(F.col("place") != settings.order), langs, settings.order)
    model = Model(langs, settings.order, files, tuple(first[x] - float(np.log(ALPHABET)) for x in langs), 1.0, float("inf"))

    # Copies of one row may all be kept; those with the smallest hashes do.
    sample = _measured(rows.where(kept).select("text", "lang"), model)
    got = sample.orderBy(F.xxhash64("per", "lang"), "letters").limit(settings.calibration_rows).toArrow()
    per = np.array(got.column(0).to_pylist(), np.float64).reshape(got.num_rows, len(langs))
    letters_of, truth = np.asarray(got.column(1)), got.column(2).to_pylist()
    known = np.array([t in langs for t in truth], bool) & (letters_of > 0)
    return replace(model, **calibrate(per[known], letters_of[known], np.array([langs.index(t) for t, k in zip(truth, known, strict=True) if k], np.int64)))


def calibrate(per: np.ndarray, letters_of: np.ndarray, right: np.ndarray) -> dict[str, float]:
    """The slope of the highest likelihood of the right languages, and the limit of cross-entropy, from rows' cross-entropies by language."""
    if not len(right):
        return {"slope": 1.0, "limit": float("inf")}
    best = None
    for slope in np.geomspace(0.05, 20, 25):
        gain = -(per - per.min(axis=1)[:, None]) * slope * np.sqrt(letters_of)[:, None]
        like = (gain[np.arange(len(right)), right] - np.log(np.exp(np.maximum(gain, -50)).sum(axis=1))).sum()
        best = max(best or (-np.inf, 0), (like, slope))
    return {"slope": float(best[1]), "limit": float(np.quantile(per.min(axis=1), 0.999) * 1.25)}


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(model)
        for batch in batches:
            for first, end, chars, at in letters(batch.column(0)):
                per, letters_of = entropies(tables, chars, at)
                width = tables.width
                yield pa.RecordBatch.from_arrays([kernel.lists(per.ravel(), np.arange(len(per) + 1) * width, pa.float64()), pa.array(letters_of.astype(np.int64)), batch.column(1)[first:end]], names=["per", "letters", "lang"])

    return rows.mapInArrow(kernel.lean(run), "per array<double>, letters long, lang string")


def predict(docs: DataFrame, model: Model, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score, cross_entropy and rejected."""
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        tables = _Tables(m) if m.languages else None
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for first, end, chars, at in letters(batch.column(1)):
                if m.languages:
                    per, letters_of = entropies(tables, chars, at)
                    best, score, low = _judge(m, per, letters_of)
                else:
                    letters_of = np.zeros(end - first, np.int64)
                    best, score, low = letters_of, letters_of * 0.0, letters_of * 0.0
                none = letters_of == 0
                best, score, low = np.where(none, len(m.languages), best), np.where(none, 0.0, score), np.where(none, 0.0, low)
                rejected = none | (score < settings.reject_below) | (low > m.limit)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel.lean(run), f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
