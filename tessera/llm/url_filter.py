"""URL filter: host rules first, then a weighted vocabulary found by Aho-Corasick.

One automaton holds the strict and the soft terms.  A hit counts only where the
characters beside it are not ASCII letters or digits, so `bets` is found in
`free-bets.example.com` and not in `alphabets.org`.  A url is blocked by one
strict term, or when the weights of the distinct soft terms together reach the
threshold.  The terms below are an example; vocabulary_of reads others from a table.

Edge cases: a null url, or one without `://`, has an empty host and path, no
rule and the verdict `allow`.  Repeated rows give repeated results.  Columns of
the input other than the id and the url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

STRICT = ("porn", "xxx", "hentai", "casino", "escort", "viagra", "adult-x", "malware", "phishing", "warez")
SOFT = {t: 1 for t in ("adult", "ads", "bet", "bets", "bonus", "cheap", "cracked", "dating", "farm", "free", "loans", "nude", "pills", "poker", "sex", "slots", "spam", "torrent", "track", "tracker", "win")}


@dataclass(frozen=True)
class Rule:
    """verdict, host and path; a host fits itself and all its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Terms that a vocabulary may hold: each worker has the automaton in memory.
MOST_TERMS = 1_000_000

RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: dict[str, int] = field(default_factory=lambda: dict(SOFT))
    #: Summed weight of distinct soft terms from which a url is blocked.
    threshold: int = 2


def vocabulary_of(terms: DataFrame, threshold: int = 2) -> Vocabulary:
    """The vocabulary of a table: term, strict (boolean) and weight (of a soft term; 1 where null).

    Terms are lower-cased (A-Z); null and empty ones are ignored.  Of a term that repeats,
    strict goes before soft and the greatest weight counts.  More than MOST_TERMS are a ValueError.
    """
    own = terms.select(F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("weight", F.lit(1)).alias("weight"))
    own = own.where("term <> ''").groupBy("term").agg(F.bool_or("strict").alias("strict"), F.max("weight").alias("weight"))
    rows = own.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return Vocabulary(tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: int(r["weight"]) for r in sorted(rows, key=lambda r: r["term"]) if not r["strict"]}, threshold)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cuts = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(cuts)] if cuts else rest
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def best_rule(host: str, path: str, by_host: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule that fits; at most one probe for each label of the host."""
    best = None
    while host:
        for rule in by_host.get(host, ()):
            if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                best = rule
        host = host.partition(".")[2]
    return best


def hits(text: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Distinct terms of the automaton that stand between boundaries in text."""
    found, n = set(), len(text)
    for end, term in automaton.iter(text):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in _ALNUM) and (end + 1 == n or text[end + 1] not in _ALNUM):
            found.add(term)
    return found


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, vocabulary: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns: the id, host, path, rule, verdict, n_strict and soft_weight."""
    vocabulary = vocabulary or Vocabulary()
    rules, strict = list(rules), frozenset(vocabulary.strict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in {*strict, *vocabulary.soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            by_host.setdefault(rule.host, []).append(rule)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = best_rule(host, path, by_host)
                found = hits(host + path.translate(_LOWER), automaton) if len(automaton) else set()
                n_strict = len(found & strict)
                weight = sum(vocabulary.soft[t] for t in found - strict)
                verdict = rule.verdict if rule else "block" if n_strict or weight >= vocabulary.threshold else "allow"
                out.append((host, path, rule and rule.text, verdict, n_strict, weight))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "n_strict", "soft_weight"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = bounded_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(kernel.lean(run), f"id {kind}, host string, path string, rule string, verdict string, n_strict int, soft_weight int")
    return out.withColumnRenamed("id", id_col)


def oracle(rules: Iterable[Rule] = RULES, vocabulary: Vocabulary | None = None) -> str:
    """DuckDB SQL for filter_urls over the view pages."""
    vocabulary = vocabulary or Vocabulary()
    test = lambda t: f"regexp_matches(x, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [(r, f"(concat('.', host) like '%.{r.host}' and starts_with(path, '{r.path}'))") for r in sorted(rules, key=lambda r: -len(r.text))]
    strict = " + ".join(f"cast({test(t)} as int)" for t in vocabulary.strict)
    soft = " + ".join(f"{w} * cast({test(t)} as int)" for t, w in vocabulary.soft.items() if t not in vocabulary.strict)
    return f"""
with u as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') end as rest from pages),
p as (select page_id, {lower.format("regexp_extract(rest, '^[^/]*')")} as host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from u),
x as (select page_id, host, path, host || {lower.format('path')} as x from p),
s as (select page_id, host, path, case {' '.join(f"when {c} then '{r.text}'" for r, c in fits)} end as rule,
  case {' '.join(f"when {c} then '{r.verdict}'" for r, c in fits)} end as ruled,
  cast({strict} as int) as n_strict, cast({soft} as int) as soft_weight from x)
select page_id, host, path, rule, coalesce(ruled, case when n_strict > 0 or soft_weight >= {vocabulary.threshold} then 'block' else 'allow' end) as verdict, n_strict, soft_weight from s"""
