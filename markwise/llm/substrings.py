"""Substring dedup: windows of a fixed number of words whose words also start earlier, merged into removal intervals.

Rows are dealt into chunks by ranges of the key, of about CHUNK_BYTES of text, so a chunk's number gives its order. Each
chunk sends the sorted distinct Rabin-Karp hashes of its windows to hash buckets, as packed differences; a bucket counts
them over all chunks and answers one bit per hash, in the order sent: an earlier chunk has it too. The chunk, which knows
the order inside itself, turns the bits into words to remove. A hash that is in every document is one entry per chunk.
Hashes have 64 bits: two different windows among n share one with probability n^2 / 2^65 (4e-4 at 10^8 windows).

Order is by key, then by a hash of the text and the text, so rows of one key are dealt over as many chunks as they fill; a null key
counts as the smallest long. Equal rows stay together. A null or empty text,
and one of fewer words than a window, loses nothing; a null text comes back as an empty one. A very long text makes its
chunk longer. An empty table gives an empty result. Extra columns pass through, whatever
their names; ones named like the results are overwritten. Keys are integers.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import integer_key, quote, small_batches, text_bytes, utf8, window_hashes, word_hashes

CHUNK_BYTES = 8 << 20


def chunk_number(key: Column, hash_: Column, bounds: list[int]) -> Column:
    """A chunk for each (key, hash), in that order: after how many of the sorted bounds the key comes, found in two steps of
    about sqrt(len(bounds)) comparisons. A bound that occurs m times is a key with m chunks' rows; the hash deals those over its chunks."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    first = below(F.lit([p[0] for p in parts]))
    inner = F.get(F.array(*[F.lit(p) for p in parts]), first - 1)
    last = F.when(first == 0, F.lit(0)).otherwise((first - 1) * step + below(inner))
    hot = {b: n for b, n in Counter(bounds).items() if n > 1}
    if not hot:
        return last
    times = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), key), F.lit(1))
    turn = F.floor((F.shiftrightunsigned(hash_, 32) / F.lit(float(1 << 32))) * times).cast("int")
    return F.when(times > 1, last - times + 1 + turn).otherwise(last)


def key_bounds(df: DataFrame, key: Column, n: int) -> list[int]:
    """n - 1 approximate quantiles of the key; a key of several chunks' rows occurs several times."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted(found or [])


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    keys, hashes, texts = table["_key"].to_pylist(), table["_hash"].to_pylist(), utf8(table["_text"].combine_chunks())
    order = sorted(range(len(keys)), key=lambda i: (keys[i], hashes[i], texts[i]))
    return table.take(pa.array(order, pa.int64())), [texts[i] for i in order]


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: the high planes are zeros, which the shuffle's codec removes."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def remove_repeats(
    df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 20, chunk_bytes: int = CHUNK_BYTES, n_words: str = "n_words", n_removed: str = "n_removed", removed: str = "removed"
) -> DataFrame:
    """df with the kept words of each text, joined by one space, and with n_words, n_removed and the removed word intervals."""
    integer_key(df, key)
    chunks = max(1, -(-text_bytes(small_batches(df), text) // chunk_bytes))
    edges = _edges(chunks)
    taken = {c.lower() for c in (n_words, n_removed, removed)}
    names = [c for c in df.columns if c.lower() not in taken]
    rest = [c for c in names if c != text]
    place = F.coalesce(integer_key(df, key), F.lit(-(1 << 63)))
    hash_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # helping columns come first, and by place: whatever names the others have, they travel as c0, c1, ...
    marked = df.select(chunk_number(place, hash_.bitwiseXOR(F.lit(-(1 << 63))), key_bounds(df, place, chunks)).cast("int").alias("_chunk"), place.alias("_key"), hash_.alias("_hash"), F.col(text).alias("_text"), *[quote(c).alias(f"c{i}") for i, c in enumerate(rest)])
    spans = T.ArrayType(T.StructType().add("start", T.LongType()).add("stop", T.LongType()))
    schema = T.StructType([T.StructField(text, T.StringType()) if c == text else df.schema[c] for c in names]).add(n_words, T.LongType()).add(n_removed, T.LongType()).add(removed, spans)

    def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, offsets = word_hashes(texts)
        return (*window_hashes(words, offsets, window), offsets)

    def send(table: pa.Table) -> pa.Table:
        _, texts = _ordered(table.select(["_key", "_hash", "_text"]))
        sent = np.unique(windows(texts)[0])
        parts = np.split(sent, np.searchsorted(sent, edges[1:]))
        full = [i for i, p in enumerate(parts) if len(p)]
        return pa.table({"_chunk": pa.array([table["_chunk"][0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "hashes": pa.array([pack(parts[i]) for i in full], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        own = [unpack(x.as_py()) for x in table["hashes"]]
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")  # equal hashes stay in the order of their chunks
        every = every[order]
        earlier = np.zeros(len(every), bool)
        earlier[order[1:]] = every[1:] == every[:-1]
        bits = np.split(earlier, np.cumsum([len(x) for x in own])[:-1])
        return pa.table({"_chunk": table["_chunk"], "bucket": table["bucket"], "n": pa.array([len(x) for x in own], pa.int64()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        table, texts = _ordered(table)
        hashes, at, offsets = windows(texts)
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        answer = answer.sort_by("bucket")
        bits = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for n, b in zip(answer["n"], answer["bits"], strict=True)]
        earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        repeated = at[earlier[place] | (first[place] != np.arange(len(place)))] if len(place) else at
        edge = np.zeros(offsets[-1] + 1, np.int32)
        edge[repeated] += 1
        edge[repeated + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept, counts, lost, cut = [], np.diff(offsets), [], []
        for i, x in enumerate(texts):
            out = gone[offsets[i] : offsets[i + 1]]
            words = x.split()
            n = int(out.sum())
            lost.append(n)
            if n:
                stay = ~out
                turn = np.flatnonzero(np.diff(out.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                cut.append([{"start": int(a), "stop": int(b)} for a, b in zip(turn[0::2], turn[1::2], strict=True)])
                words = [words[j] for j in np.flatnonzero(stay)]
            else:
                cut.append([])
            kept.append(b" ".join(words))
        new = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table([new if c == text else table[f"c{rest.index(c)}"] for c in names] + [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=[*names, n_words, n_removed, removed])

    sent = marked.groupBy("_chunk").applyInArrow(send, "_chunk int, bucket int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(judge, "_chunk int, bucket int, n long, bits binary")
    return marked.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(remove, schema)


#: DuckDB's SQL for remove_repeats over documents; slow, so for small tables only.
REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + d AS i FROM r, (SELECT unnest(range(20)) AS d)),
o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
k AS (SELECT o.doc_id, count(*) AS n_removed_not, string_agg(o.w[o.i], ' ' ORDER BY o.i) AS kept FROM o ANTI JOIN g ON o.doc_id = g.doc_id AND o.i = g.i GROUP BY o.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(n_removed_not, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
