"""Line dedup: two Bloom filters for once-seen and twice-seen line hashes; only suspected repeats shuffle for exact counts.

Both filters are cut into shards of a fixed size; the number of shards follows the number of lines, so a shard's load, and
a merging task's memory, stay the same at any size. Map tasks send the bit positions they set, sorted and packed. A bit
that was hit once goes to the first filter, one hit again, in the same or another task, also to the second. A line whose
bits are not all in the second filter is in one document only.

The second filter is broadcast up to BROADCAST_BYTES. Beyond, chunks of rows send their distinct 64-bit hashes, sorted and packed, to
the filter's shards, and get back those that pass; the chunk's rows, in compressed blobs, meet these answers. A chunk whose
rows aren't those that asked (made anew after a loss, in another order) counts all its lines. Either way the digests of
suspected repeats alone go on to the exact counts. Keys found in many documents are broadcast, or joined, by the same bound.

A line's key is the line stripped of white space, A-Z lower-cased. Every row counts as a document, also a repeated one.
A null or empty text is one empty line; empty keys are never dropped. Ties of the first place don't occur but in repeated rows, which
then all keep their line. A very long text is held whole, and cut into lines, in one task. An empty table gives an empty result.
Extra columns stay, whatever their names; the text is replaced, and columns named like the two counts are overwritten. Keys are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blob, chunks_of, discard, fresh, integer_key, mix64, pieces, plainly, small_batches, stored, unblob, utf8

SHARD_BITS = 1 << 20
BITS_PER_LINE = 16
#: Twice-seen filters and frequent keys up to this size are broadcast; beyond it, lines are joined to them.
BROADCAST_BYTES = 32 << 20
#: Line hashes that a map task holds before it sends their positions.
FLUSH = 2 << 20
#: Text bytes of a chunk that asks the filter, and of the blobs it travels in; shards that answer in one task.
CHUNK_BYTES = 16 << 20
BLOB_BYTES = 1 << 20
TOGETHER = 16

_SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(_SPACES).lower() for x in text.split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit fingerprints, as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.uint64).reshape(-1, 2)


def bit_places(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, and the two bits in it."""
    shard = (mix64(hashes) >> np.uint64(32)) % np.uint64(shards)
    return shard.astype(np.int64), (hashes & np.uint64(SHARD_BITS - 1)).astype(np.int64), (hashes >> np.uint64(24) & np.uint64(SHARD_BITS - 1)).astype(np.int64)


def _pack(sorted_bits: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(sorted_bits, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint32), dtype=np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def twice_seen(df: DataFrame, text: str, shards: int) -> DataFrame:
    """(shard, twice): the second filter's shards, as packed bit positions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            shard, a, b = bit_places(np.concatenate(held), shards)
            held.clear()
            place, n = np.unique(np.concatenate([shard * SHARD_BITS + a, shard * SHARD_BITS + b]), return_counts=True)
            cuts = np.flatnonzero(np.diff(place // SHARD_BITS)) + 1
            rows = [(int(p[0] // SHARD_BITS), _pack(p % SHARD_BITS), _pack(p[c > 1] % SHARD_BITS)) for p, c in zip(np.split(place, cuts), np.split(n, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["shard", "once", "twice"])

        for batch in batches:
            for part in pieces(batch, "_text"):
                found = [np.unique(digests(keys)[:, 0]) for x in utf8(part.column(0)) if (keys := [k for k in line_keys(x) if k])]
                if found:
                    held.append(np.concatenate(found))
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
        yield from flush()

    def merge(group: pa.Table) -> pa.Table:
        once, twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)
        for first, again in zip(group["once"], group["twice"], strict=True):
            at = _unpack(first.as_py())
            twice[at[once[at]]] = True
            once[at] = True
            twice[_unpack(again.as_py())] = True
        return pa.table({"shard": group["shard"][:1], "twice": pa.array([_pack(np.flatnonzero(twice))], pa.binary())})

    parts = df.select(F.col(text).alias("_text")).mapInArrow(partial, "shard int, once binary, twice binary")
    return parts.groupBy("shard").applyInArrow(merge, "shard int, twice binary")


def _seen(filters: dict[int, np.ndarray], hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which hashes have both bits in the twice-seen filter; filters: shard -> packed bitmap."""
    shard, a, b = bit_places(hashes, shards)
    out = np.zeros(len(hashes), bool)
    for s in np.unique(shard):
        if (bits := filters.get(int(s))) is not None:
            at = np.flatnonzero(shard == s)
            hit = lambda x: bits[x >> 3] >> (x & 7) & 1
            out[at] = (hit(a[at]) & hit(b[at])).astype(bool)
    return out


def _bitmap(packed: bytes) -> np.ndarray:
    bits = np.zeros(SHARD_BITS, bool)
    bits[_unpack(packed)] = True
    return np.packbits(bits, bitorder="little")


_COUNTED = "digest binary, n_docs long, first_doc long, first_line long"


def suspects(df: DataFrame, text: str, key: str, filters: DataFrame, shards: int, broadcast: bool) -> DataFrame:
    """(digest, n_docs, first_doc, first_line) of the keys that pass the twice-seen filter, summed by batch. broadcast: the filter is; else it is asked."""
    rows = df.select(integer_key(df, key).alias("key"), F.col(text).alias("text"))
    if broadcast:
        shared = df.sparkSession.sparkContext.broadcast({r["shard"]: r["twice"] for r in filters.collect()})  # drop_lines() has checked the size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maps = {s: _bitmap(x) for s, x in shared.value.items()}
            for batch in batches:
                for part in pieces(batch, "text"):
                    yield from _counted(part, lambda h: _seen(maps, h, shards))

        return rows.mapInArrow(run, _COUNTED)

    asked = "chunk long, bucket int, hashes binary, rows binary"
    names = ["chunk", "bucket", "hashes", "rows"]

    def message(chunk: int, parts: list[tuple[int, bytes | None]], blobs: list[bytes] | None = None) -> pa.RecordBatch:
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary()), pa.array(blobs or [None] * n, pa.binary())], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's hashes by bucket of shards, and a check of all of them, in a bucket below 0 that has no shards."""
        for chunk, own in groupby(chunks_of(batches, "text", BLOB_BYTES, CHUNK_BYTES), key=lambda x: x[0]):
            hashes = np.zeros(0, np.uint64)
            for _, part in own:
                hashes = np.union1d(hashes, _line_hashes(part.column(1)))
            bucket = bit_places(hashes, shards)[0] // TOGETHER
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            yield message(chunk, [(-1 - chunk % 1024, _check(hashes)), *((int(bucket[p[0]]), hashes[p].tobytes()) for p in np.split(order, cuts) if len(p))])

    def judge(questions: pa.Table, shard: pa.Table) -> pa.Table:
        maps = {s: _bitmap(x) for s, x in zip(shard["shard"].to_pylist(), shard["twice"].to_pylist(), strict=True)}
        out = []
        for bucket, x in zip(questions["bucket"].to_pylist(), questions["hashes"].to_pylist(), strict=True):
            h = np.frombuffer(x, np.uint64)
            out.append(x if bucket < 0 else h[_seen(maps, h, shards)].tobytes())
        return questions.set_column(2, "hashes", pa.array(out, pa.binary()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in chunks_of(batches, "text", BLOB_BYTES, CHUNK_BYTES):
            yield message(chunk, [(0, None)], [blob(part)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk. A chunk's blobs stay compressed until its answers are there."""
        each = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, own in groupby(each, key=lambda r: r[0]):
            check, passed, blobs = b"", [np.zeros(0, np.uint64)], []
            for _, bucket, x, packed in own:
                if packed is not None:
                    blobs.append(packed)
                elif bucket < 0:
                    check = x
                else:
                    passed.append(np.frombuffer(x, np.uint64))
            hashes = np.zeros(0, np.uint64)
            for x in blobs:
                hashes = np.union1d(hashes, _line_hashes(unblob(x)["text"].combine_chunks()))
            known = np.sort(np.concatenate(passed)) if _check(hashes) == check else hashes
            for x in blobs:
                for part in unblob(x).combine_chunks().to_batches():
                    yield from _counted(part, lambda h: np.isin(h, known))  # noqa: B023

    questions = rows.mapInArrow(ask, asked)
    shard = filters.select((F.col("shard") / TOGETHER).cast("int").alias("bucket"), "shard", "twice")
    answers = questions.groupBy("bucket").cogroup(shard.groupBy("bucket")).applyInArrow(judge, asked)
    return rows.mapInArrow(send, asked).union(answers).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(count, _COUNTED)


def _line_hashes(texts: pa.Array) -> np.ndarray:
    """Distinct 64-bit hashes of the keys that aren't empty."""
    keys = {k for x in utf8(texts) for k in line_keys(x) if k}
    return np.unique(digests(list(keys))[:, 0])


def _check(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _counted(part: pa.RecordBatch, seen: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The (key, text) rows' keys whose hashes were seen, counted."""
    rows, lines = [], []
    found: list[bytes] = []
    for i, x in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
        first = {k: at for at, k in reversed(list(enumerate(line_keys(x)))) if k}
        found += first
        rows += [i] * len(first)
        lines += first.values()
    if not found:
        return
    d = digests(found)
    keep = np.flatnonzero(seen(d[:, 0]))
    if not len(keep):
        return
    own = np.ascontiguousarray(d[keep]).view("V16").ravel()
    t = pa.table({"digest": pa.array([x.tobytes() for x in own], pa.binary()), "doc": pa.array([rows[k] for k in keep], pa.int64()), "line": pa.array([lines[k] for k in keep], pa.int64())})
    t = t.sort_by([("doc", "ascending"), ("line", "ascending")]).group_by("digest", use_threads=False).aggregate([([], "count_all"), ("doc", "first"), ("line", "first")])
    yield from t.rename_columns(["digest", "n_docs", "first_doc", "first_line"]).combine_chunks().to_batches()


def drop_lines(
    df: DataFrame, text: str = "text", key: str = "doc_id", least_docs: int = 10, keep_first: bool = False,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """df without the lines whose key is in least_docs documents or more, and with counts of lines and dropped lines.

    keep_first: the first of them, by key and then place, stays.
    """
    integer_key(df, key)
    plain, name, back = plainly(df, [n_lines, n_dropped])
    return back(_drop(plain, name[text], name[key], least_docs, keep_first, n_lines, n_dropped, broadcast_bytes))


def _drop(df: DataFrame, text: str, key: str, least_docs: int, keep_first: bool, n_lines: str, n_dropped: str, broadcast_bytes: int) -> DataFrame:
    lines = small_batches(df).agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(lines) * BITS_PER_LINE // SHARD_BITS))
    filters = stored(twice_seen(df, text, shards), "lines-twice")
    size = filters.agg(F.sum(F.octet_length("twice"))).first()[0] or 0
    small = max(size, shards * SHARD_BITS // 8) <= broadcast_bytes
    found = suspects(df, text, key, filters, shards, small)
    exact = found.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("first_doc", "first_line")).alias("first"))
    frequent = stored(exact.where(F.col("n_docs") >= least_docs).select("digest", "first.first_doc", "first.first_line"), "lines-frequent")
    discard(filters)
    if frequent.count() * 64 <= broadcast_bytes:
        return _drop_broadcast(df, text, key, frequent, keep_first, n_lines, n_dropped)
    return _drop_joined(df, text, key, frequent, keep_first, n_lines, n_dropped)


def _result(df: DataFrame, text: str, n_lines: str, n_dropped: str) -> tuple[list[str], T.StructType]:
    names = [c for c in df.columns if c not in (n_lines, n_dropped)]
    schema = T.StructType([T.StructField(text, T.StringType()) if c == text else df.schema[c] for c in names])
    return names, schema.add(n_lines, T.LongType()).add(n_dropped, T.LongType())


def _rewritten(batch: pa.RecordBatch, text: str, names: list[str], cut: list[list[int]], n_lines: str, n_dropped: str) -> pa.RecordBatch:
    """cut: the dropped lines of each row. A null text stays null: nothing is dropped from it."""
    kept, total = [], []
    for x, gone in zip(_column(batch, text).cast(pa.binary()).to_pylist(), cut, strict=True):
        own = (x or b"").split(b"\n")
        total.append(len(own))
        if gone:
            out = set(gone)
            x = b"\n".join([line for i, line in enumerate(own) if i not in out])
        kept.append(x)
    new = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*(new if c == text else _column(batch, c) for c in names), pa.array(total, pa.int64()), pa.array([len(c) for c in cut], pa.int64())], [*names, n_lines, n_dropped])


def _drop_broadcast(df: DataFrame, text: str, key: str, frequent: DataFrame, keep_first: bool, n_lines: str, n_dropped: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast({bytes(r[0]): (r[1], r[2]) for r in frequent.collect()})
    names, schema = _result(df, text, n_lines, n_dropped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                cut = []
                for i, x in zip(_column(part, key).to_pylist(), utf8(_column(part, text)), strict=True):
                    hits = [(at, known.get(xxhash.xxh3_128_digest(k))) for at, k in enumerate(line_keys(x)) if k]
                    cut.append([at for at, h in hits if h is not None and not (keep_first and h == (i, at))])
                yield _rewritten(part, text, names, cut, n_lines, n_dropped)

    return df.mapInArrow(run, schema)


def _drop_joined(df: DataFrame, text: str, key: str, frequent: DataFrame, keep_first: bool, n_lines: str, n_dropped: str) -> DataFrame:
    """The way for any number of frequent keys: lines meet them in a join, and return to their rows by a 128-bit hash of key and text."""
    names, schema = _result(df, text, n_lines, n_dropped)
    row, cut = fresh(df, "_row", "_cut")
    marked = df.withColumn(row, F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [(r, i, at, xxhash.xxh3_128_digest(k)) for r, i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True) for at, k in enumerate(line_keys(x)) if k]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], ["row", "doc", "line", "digest"])

    own = marked.select(F.col(row).alias("row"), integer_key(marked, key).alias("doc"), F.col(text).alias("text"))
    hits = own.mapInArrow(explode, "row string, doc long, line long, digest binary").join(frequent, "digest")
    if keep_first:
        hits = hits.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    cuts = hits.groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield _rewritten(part, text, names, [x or [] for x in _column(part, cut).to_pylist()], n_lines, n_dropped)

    return marked.join(cuts, row, "left").mapInArrow(run, schema)


#: DuckDB's SQL for drop_lines over documents, with digests of the kept text.
LINES_SQL = """
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT row_id, i, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT row_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
f AS (SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT row_id) >= 10),
g AS (SELECT row_id, count(*) AS n_lines, count(f.k) AS n_dropped, coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept
      FROM x LEFT JOIN f USING (k) GROUP BY row_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN t USING (row_id)
"""
