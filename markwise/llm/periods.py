"""Periodic runs: stretches of words that repeat a block of q words, found on a harmonic grid, and texts with each run's repeats removed.

A run is a stretch of words with smallest period q, of at least max(least, times * q) words, that no neighbouring word extends keeping
that period. Inside a run of period p, word i equals word i + p for at least g(p) = max(least - p, (times - 1) p) places i in a row, so one of the
places 0, g, 2g, ... is among them. Over all p that is a grid of about n ln(n) / (times - 1) pairs (p, i) of a text of n words, each
looked at by array operations, GRID pairs at a time:

1. pairs whose words i and i + p differ go; of the others, one of the windows before or behind i must go on for half of g(p) words, by prefix hashes
2. binary search by prefix hashes finds how far the words at i and i + p agree forwards and backwards, for all pairs at a time
3. equal stretches are one run, of the least period found (a smaller period of a run divides p, and its stretch is the same)
4. the words of each run are compared themselves; should a hash have lied, the text is done again with other bases

Hashes are sums of word numbers times powers of a base, modulo two primes of 31 bits. Rows are independent: nothing is shuffled, and memory follows one text and
GRID. A null or empty text has no words and no runs; a collapsed text is never null. Repeated rows and ties are judged each alike. An empty
table gives an empty result. Other columns pass through, whatever their names; those named like the results, whatever the case, are overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, renamed, small_batches, utf8, worker_state

WORD = r"[^\x20\x09-\x0D]+"
#: Pairs of a period and a grid point that are looked at together.
GRID = 1 << 19
#: Known runs whose inside is left out at larger periods.
LONGEST = 16
#: The two largest primes below 2^31.
PRIMES = (2_147_483_647, 2_147_483_629)
READ_BYTES = 1 << 20

Run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^i modulo prime for i < n at least; a worker keeps the longest."""
    kept = worker_state()
    key = ("powers", base, prime)
    out = kept.get(key, np.ones(1, np.int64))
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    kept[key] = out
    return out


class Prefixes:
    """Prefix hashes of one text's word numbers."""

    def __init__(self, words: np.ndarray, attempt: int = 0) -> None:
        chance = np.random.default_rng(attempt)
        self.parts = []
        for prime in PRIMES:
            base = int(chance.integers(1 << 20, prime - 1))
            up = _powers(base, prime, len(words) + 1)
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum((words + 1) * up[: len(words)] % prime, out=total[1:])  # below 2^63 for less than 2^32 words
            self.parts.append((prime, up, total))

    def agree(self, i: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the m words from i on have the same hashes as the m words from i + p on."""
        out = np.ones(len(i), bool)
        for prime, up, total in self.parts:
            near, far = (total[i + m] - total[i]) % prime, (total[i + p + m] - total[i + p]) % prime
            out &= near * up[p] % prime == far
        return out


def _longest(most: np.ndarray, holds) -> np.ndarray:
    """For each element the greatest m <= most for which holds(m) is true, all of them by one binary search; holds(0) is taken for true."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        good = holds(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _stretches(words: np.ndarray, hashes: Prefixes, first: int, last: int, least: int, times: int, known: np.ndarray) -> np.ndarray:
    """(start, end, period) of the stretches of periods first <= p < last that are long enough; known: stretches of smaller periods.

    A pair inside a known stretch whose period divides p would find that stretch again, so it isn't looked at.
    """
    n = len(words)
    period = np.arange(first, last)
    step = np.maximum(least - period, (times - 1) * period)
    points = -(-(n - period) // step)
    p, g = np.repeat(period, points), np.repeat(step, points)
    i = (np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)) * g
    same = words[i] == words[i + p]
    for start, end, q in known.tolist():
        same &= (i < start) | (i + p >= end) | (p % q != 0)
    i, p, g = i[same], p[same], g[same]
    ahead, behind = (g + 1) >> 1, g >> 1
    fits = i + p + ahead <= n
    forth, back = np.zeros(len(i), bool), i >= behind
    forth[fits] = hashes.agree(i[fits], p[fits], ahead[fits])
    back[back] = hashes.agree(i[back] - behind[back], p[back], behind[back])
    some = forth | back
    i, p = i[some], p[some]
    after = _longest(n - i - p, lambda m: hashes.agree(i, p, m))
    before = _longest(i, lambda m: hashes.agree(i - m, p, m))
    found = np.stack([i - before, i + p + after, p], axis=1)
    return found[found[:, 1] - found[:, 0] >= np.maximum(least, times * found[:, 2])]


def runs_of(words: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, length, period) of all runs of a text's word numbers, by start, then period."""
    n = len(words)
    if n < least:
        return np.zeros((0, 3), np.int64)
    period = np.arange(1, n // times + 1)
    pairs = np.cumsum(-(-(n - period) // np.maximum(least - period, (times - 1) * period)))
    for attempt in range(64):
        hashes, found, first = Prefixes(words, attempt), np.zeros((0, 3), np.int64), 1
        while first <= len(period):
            done = pairs[first - 2] if first > 1 else 0
            last = max(first + 1, int(np.searchsorted(pairs, done + GRID, side="right")) + 1)
            known = found[np.argsort(found[:, 0] - found[:, 1])[:LONGEST]]
            found = _once(np.concatenate([found, _stretches(words, hashes, first, last, least, times, known)]))
            first = last
        if all(np.array_equal(words[s : e - p], words[s + p : e]) for s, e, p in found.tolist()):
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
            return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    raise RuntimeError("64 pairs of bases in a row met false agreements")


def _once(found: np.ndarray) -> np.ndarray:
    """Of equal stretches the one of least period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def collapsed_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(df: DataFrame, text: str = "text", least: int = 24, times: int = 3, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """df without its text, with the runs (start, length, period) of its words by start, then period, and the kept words joined by one space."""
    own, names = renamed(small_batches(df), [text], [runs, collapsed])
    kinds = [own.schema[f"c{i}"] for i in range(len(names))]
    schema = T.StructType([*kinds, T.StructField("_runs", T.ArrayType(Run, False)), T.StructField("_collapsed", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", READ_BYTES):
                lists, texts = [], []
                for raw in utf8(part["_text"]):
                    words = raw.split()
                    number: dict[bytes, int] = {}
                    own = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, times)
                    if len(own):
                        words = [words[i] for i in np.flatnonzero(collapsed_words(len(words), own)).tolist()]
                    lists.append(own)
                    texts.append(b" ".join(words))
                flat = np.concatenate([*lists, np.zeros((0, 3), np.int64)])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in kinds], found, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    out = own.mapInArrow(find, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_runs").alias(runs), F.col("_collapsed").alias(collapsed))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, exactly; of equals the first. Null where there is none."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(Run), lambda a, r: F.when(better(a, r), r).otherwise(a))


def with_planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df in which every tenth text (by the crc32 of its key) repeats some of its words up to its end; a null key repeats none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeated(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    planted = F.get(F.transform(F.array(words), repeated), F.lit(0))  # an array of one, so that the words are cut once
    return df.withColumn(text, F.when((h % 10 == 0) & (F.regexp_like(text, F.lit(WORD))), planted).otherwise(F.col(text)))


def run_digests(df: DataFrame) -> DataFrame:
    """The columns of op13 from doc_id and text."""
    found = periodic_runs(with_planted(df)).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: DuckDB's SQL for run_digests over documents: equal words p apart, in stretches of consecutive places (gaps and islands).
RUNS_SQL = r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, c),
g AS (SELECT doc_id, w, len(w)::BIGINT AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e) GROUP BY doc_id, p, island),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length::DOUBLE / period, start, period)) AS best,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id),
v AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, sha256(string_agg(x.word, ' ' ORDER BY x.i)) AS kept FROM x ANTI JOIN v ON x.doc_id = v.doc_id AND x.i = v.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(kept, sha256('')) AS collapsed_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
