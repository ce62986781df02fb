"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text; the pairwise part learns that two
terms together say more than each alone. Terms are the text's words and their first bytes (PREFIXES) (A-Z lower-cased, cut at
ASCII characters other than letters and digits), hashed to 2^20 buckets. The machine is trained on at most SAMPLE_ROWS
labelled rows, those of the smallest hashed keys, with at most SAMPLE_BYTES of terms; from their terms, those that tell the classes apart best are
kept, alone or in pairs: a pair of the FREQUENT terms of most rows is screened by how its four cells (both, one, the other, neither) interact
with the label, so that terms are kept of which none alone says anything.

Nulls: a null text has no terms, as an empty one has; its score is the machine's for no terms. Labels that are null, or
of keys without a document, are left out; a key labelled more than once has its highest label, and of a key with several
documents the least text is learnt from. Very long texts are cut into blocks while they are hashed. Without rows of both
classes every score is the share of label 1 (0.0 without any row). Rows are scored one by one, so repeated rows get equal
scores. Extra columns pass through; columns named like the results are overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE_BASE, _BYTE_CODE, _LOWER, discard, mix64, pieces, plainly, powers, small_batches, stored, utf8

#: Bounds of the labelled sample: keys, and bytes of their distinct terms (4 a term).
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 256 << 20
BUCKETS = 1 << 20
TERMS = 6_000
FACTORS = 8
#: Terms whose pairs are screened, those of most labelled rows; how far from no interaction a kept pair is; pairs kept at most.
FREQUENT = 2048
LEAST_PAIR_Z = 6.0
PAIRS = 256
EPOCHS = 30
#: Text that is hashed at a time: each word makes up to six terms, so a worker holds about 40 times as many bytes.
PIECE_BYTES = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
LEAST_Z = 3.0
DECAY = 1e-2

_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_BLOCK = 1 << 20


def term_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the terms of all texts, repeats included."""
    rows, buckets = [], []
    run: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, x in enumerate(texts):
        at = 0
        while at < len(x):
            stop = min(len(x), at + _BLOCK)  # a long text is cut into blocks at a character that ends a term
            while stop < len(x) and _LETTER[x[stop]]:
                stop += 1
            run.append(x[at:stop])
            owners.append(i)
            size += stop - at
            at = stop
            if size >= _BLOCK:
                _terms(run, owners, rows, buckets)
                run, owners, size = [], [], 0
    _terms(run, owners, rows, buckets)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _terms(run: list[bytes], owners: list[int], rows: list[np.ndarray], buckets: list[np.ndarray]) -> None:
    if not run:
        return
    data = _LOWER[np.frombuffer(b" ".join(run) + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(_LETTER[data].view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return
    up, down = powers(_BYTE_BASE | 1, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up, out=total[1:])
    owner = np.asarray(owners)[np.searchsorted(np.cumsum([len(x) + 1 for x in run]), starts, side="right")]
    for size in (0, *PREFIXES):
        some = slice(None) if not size else ends - starts > size
        a = starts[some]
        b = a + size if size else ends
        rows.append(owner[some])
        buckets.append((mix64((total[b] - total[a]) * down[a] + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int64))


class FactorizationMachine:
    """Weights of the kept terms; terms: bucket -> place, -1 where not kept."""

    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.kept, self.bias, self.linear, self.factors = terms, bias, linear, factors

    def places(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int64)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def score(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from their distinct (row, place) pairs."""
        z = self.bias + np.bincount(rows, self.linear[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            z += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _distinct(rows: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(rows * width + at)
    return pairs // width, pairs % width


def fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Adam on the logistic loss, in batches. rows and buckets: distinct pairs, ordered by row."""
    share = float(labels.mean()) if len(labels) else 0.0
    none = np.zeros(0, np.int64)
    if not 0 < share < 1:
        return FactorizationMachine(none, 30.0 if share else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    ones, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    runs = [slice(at, at + _BLOCK) for at in range(0, len(rows), _BLOCK)]  # the sample is large against the driver's memory
    for r in runs:
        every += np.bincount(buckets[r], minlength=BUCKETS)
        ones += np.bincount(buckets[r][labels[rows[r]] > 0], minlength=BUCKETS)
    n1, n0 = labels.sum(), (1 - labels).sum()
    p1, p0 = (ones + 0.5) / (n1 + 1), (every - ones + 0.5) / (n0 + 1)
    z = np.abs(np.log(p1) - np.log(p0)) / np.sqrt(1 / (ones + 0.5) + 1 / (every - ones + 0.5))
    z[every < 2] = 0
    order = np.lexsort((np.arange(BUCKETS), -z))[:TERMS]
    kept = np.union1d(order[z[order] > LEAST_Z], interacting(rows, buckets, labels, every))
    fm = FactorizationMachine(kept, float(np.log(share / (1 - share))), np.zeros(len(kept)), np.zeros((len(kept), FACTORS)))
    if not len(kept):
        return fm
    places = fm.places()
    found = [(rows[r][own >= 0], own[own >= 0]) for r in runs for own in (places[buckets[r]],)]
    rows, place = (np.concatenate(x) for x in zip(*found, strict=True))
    ends = np.searchsorted(rows, np.arange(len(labels) + 1))
    rng = np.random.default_rng(seed)
    fm.factors = rng.normal(0, 0.05, (len(kept), FACTORS))
    state = [np.zeros_like(x) for x in (fm.linear, fm.factors) for _ in range(2)]
    step, bias_m, bias_v = 0, 0.0, 0.0
    size = max(16, min(256, len(labels) // 16))
    for _ in range(EPOCHS):
        turn = rng.permutation(len(labels))
        for lo in range(0, len(turn), size):
            own = turn[lo : lo + size]
            lengths = ends[own + 1] - ends[own]
            r = np.repeat(np.arange(len(own)), lengths)
            at = place[np.repeat(ends[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
            v = fm.factors[at]
            sums = np.stack([np.bincount(r, v[:, f], len(own)) for f in range(FACTORS)], 1)
            squares = np.bincount(r, (v * v).sum(1), len(own))
            out = fm.bias + np.bincount(r, fm.linear[at], len(own)) + 0.5 * ((sums * sums).sum(1) - squares)
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[own]) / len(own)
            grads = (np.bincount(at, d[r], len(kept)), np.stack([np.bincount(at, d[r] * (sums[r, f] - v[:, f]), len(kept)) for f in range(FACTORS)], 1))
            step += 1
            for k, (x, g) in enumerate(zip((fm.linear, fm.factors), grads, strict=True)):
                m, s = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                x *= 1 - DECAY
                x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            bias_m += 0.1 * (d.sum() - bias_m)
            bias_v += 0.001 * (d.sum() ** 2 - bias_v)
            fm.bias -= 0.02 * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.999**step)) + 1e-8)
    return fm


def interacting(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Terms of the pairs that interact most: the logarithm of the odds ratio of a pair's cells, label 1 against label 0, in standard errors.

    Terms of one in fifty rows at least and of nine in ten at most can show an interaction; of these the FREQUENT ones are taken. A
    pair that is nearly one term (they are together in nine of ten rows that hold either) shows none.
    """
    n = len(labels)
    able = np.flatnonzero((every >= max(8, n / 50)) & (every <= 0.9 * n))
    some = np.sort(able[np.argsort(-every[able], kind="stable")[:FREQUENT]])
    if len(some) < 2:
        return np.zeros(0, np.int64)
    place = np.full(BUCKETS, -1, np.int64)
    place[some] = np.arange(len(some))
    both = [np.zeros((len(some), len(some)), np.float32) for _ in range(2)]
    ends = np.searchsorted(rows, np.arange(n + 1))
    for lo in range(0, n, 512):  # products of 512 rows at a time
        hi = min(n, lo + 512)
        at = place[buckets[ends[lo] : ends[hi]]]
        x = np.zeros((hi - lo, len(some)), np.float32)
        x[(rows[ends[lo] : ends[hi]] - lo)[at >= 0], at[at >= 0]] = 1
        for y in range(2):
            own = x[labels[lo:hi] == y]
            both[y] += own.T @ own
    odds, error = np.zeros_like(both[0]), np.zeros_like(both[0])
    for y, sign in ((1, 1), (0, -1)):
        one, total = np.diag(both[y]).copy(), np.float32((labels == y).sum())
        a = both[y]
        for cell, way in ((a, 1), (one[:, None] - a, -1), (one[None] - a, -1), (total - one[:, None] - one[None] + a, 1)):
            odds += sign * way * np.log(cell + 0.5)
            error += 1 / (cell + 0.5)
    z = np.abs(odds) / np.sqrt(error)
    together, alone = both[0] + both[1], every[some].astype(np.float32)
    z[together > 0.9 * (alone[:, None] + alone[None] - together)] = 0
    i, j = np.nonzero(np.triu(z > LEAST_PAIR_Z, 1))
    best = np.lexsort((j, i, -z[i, j]))[:PAIRS]
    return some[np.union1d(i[best], j[best])]


def held_out(key: str) -> Column:
    """Rows that are never learnt from; those without a key aren't among them, though no label finds them either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> FactorizationMachine:
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(F.col(key).alias("_key"), "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                rows, buckets = _distinct(*term_buckets(utf8(part.column(2))), BUCKETS)
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([buckets[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["_key", "_y", "_terms"])

    own = small_batches(df).select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(sample), F.col("_k") == F.col("_key"))  # SAMPLE_ROWS keys at most
    whole = own.groupBy("_key").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text"))  # one row of a key that repeats
    table = stored(whole.select(F.xxhash64("_key").alias("_key"), "_y", "_text").mapInArrow(run, "_key long, _y int, _terms binary"), "toxicity-terms")
    sizes = table.select("_key", F.octet_length("_terms").alias("n")).orderBy("_key").toArrow()  # a row of SAMPLE_ROWS at most, each 12 bytes
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy().astype(np.int64)), SAMPLE_BYTES, side="right"))
    chosen = table if fits == len(sizes) else table.where(F.col("_key") < sizes["_key"][fits].as_py())
    found = chosen.toArrow().sort_by([("_key", "ascending"), ("_terms", "ascending")])
    discard(table)
    labels, terms = np.array([int(y > 0) for y in found["_y"].to_pylist()], np.float64), found["_terms"].combine_chunks()
    del found
    if not len(labels):
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int32), labels)
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1] // 4
    flat = np.frombuffer(terms.buffers()[2], "<i4")[ends[0] : ends[-1]]
    return fit(np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(ends)), flat, labels)


def with_scores(df: DataFrame, fm: FactorizationMachine, text: str = "text", score: str = "score") -> DataFrame:
    """df and the score of each row's whole text."""
    plain, name, back = plainly(df, [score])
    return back(_with_scores(plain, fm, name[text], score))


def _with_scores(df: DataFrame, fm: FactorizationMachine, text: str, score: str) -> DataFrame:
    shared = small_batches(df).sparkSession.sparkContext.broadcast((fm.kept, fm.bias, fm.linear, fm.factors))  # TERMS x (FACTORS + 2) numbers
    names = [c for c in df.columns if c != score]
    schema = T.StructType([df.schema[c] for c in names]).add(score, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorizationMachine(*shared.value)
        places = model.places()
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                rows, buckets = term_buckets(utf8(column(text)))
                at = places[buckets]
                rows, at = _distinct(rows[at >= 0], at[at >= 0], max(1, len(model.kept)))
                yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(model.score(rows, at, part.num_rows), pa.float64())], [*names, score])

    return df.mapInArrow(run, schema)


def toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted of each row."""
    scored = with_scores(df.select(key, text), train(df, labels, text, key), text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
