"""What the corpus operators share: reading tables, shared storage, text batches and word hashes."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word definition `[^\x20\x09-\x0D]+`; also what bytes.split() splits at.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1B54A32D192ED03
_SLICE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="markwise-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts the lineage: df written as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helping columns that df hasn't, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as a long; other kinds of keys are refused here, not in a task."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError(f"the key {key} must be of an integer type, not {df.schema[key].dataType.simpleString()}")
    return df[key].cast("long")


#: Most bytes of an Arrow batch on its way to a Python worker; Spark's own bound is 64 MB.
ARROW_BYTES = "2m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends small batches from now on: what a task holds on both sides of the pipe follows them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def worker_state() -> dict:
    """What a Python worker keeps between tasks; functions that travel by value don't share their modules' globals."""
    return sys.modules.setdefault("_markwise_worker_state", types.ModuleType("_markwise_worker_state")).__dict__


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one aggregation over one column, from which partition counts follow."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"])


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is an empty text."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about `most` text bytes, so that long texts don't add up in a worker."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.binary())]) if len(column) else np.zeros(0)
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def chunks_of(batches: Iterator[pa.RecordBatch], text: str, blob_bytes: int, chunk_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A task's rows in blobs, with the numbers of the chunks that the blobs make up."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for part in pieces(batch, text, blob_bytes):
            yield chunk, part
            size += part.nbytes
            if size >= chunk_bytes:
                chunk, size = chunk + 1, 0


def blob(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as to:
        to.write_batch(part)
    return sink.getvalue().to_pybytes()


def unblob(data: pa.Buffer | bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; base is odd, so that it has an inverse."""
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _CACHE or len(_CACHE[base][0]) < n:
        _CACHE[base] = _powers(base, max(n, _SLICE + 1))
    up, down = _CACHE[base]
    return up[:n], down[:n]


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))
_IS_SPACE = np.isin(np.arange(256), SPACE_BYTES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit Rabin-Karp hashes of all words, and the first word's index of each text (with the total at the end).

    The words of one text follow those of the one before. Bytes are hashed in slices of about _SLICE
    cut at white space, so memory follows the slice, not the text.
    """
    out: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    run: list[bytes] = []
    first, size = 0, 0
    for i, text in enumerate(texts):
        if len(text) > 2 * _SLICE:
            _flush(run, first, counts, out, lower)
            at = 0
            while at < len(text):
                stop = min(len(text), at + _SLICE)
                while stop < len(text) and not _IS_SPACE[text[stop]]:
                    stop += 1
                _flush([text[at:stop]], i, counts, out, lower)
                at = stop
            run, first, size = [], i + 1, 0
            continue
        run.append(text)
        size += len(text) + 1
        if size >= _SLICE:
            _flush(run, first, counts, out, lower)
            run, first, size = [], i + 1, 0
    _flush(run, first, counts, out, lower)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def _flush(run: list[bytes], first: int, counts: np.ndarray, out: list[np.ndarray], lower: bool) -> None:
    if not run:
        return
    data = np.frombuffer(b" ".join(run) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts):
        up, down = powers(_BYTE_BASE | 1, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * up, out=total[1:])
        out.append(mix64((total[ends] - total[starts]) * down[starts]))
        edges = np.cumsum([len(x) + 1 for x in run])
        counts[first + 1 : first + 1 + len(run)] += np.diff(np.searchsorted(starts, edges), prepend=0)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, in ascending order of place; spans of more than _SLICE bytes get 0."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + _SLICE, side="right"))
        if b <= a:
            a += 1
            continue
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = powers(_BYTE_BASE | 1, high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[low:high]] * up[:-1], out=total[1:])
        out[a:b] = mix64((total[ends[a:b] - low] - total[starts[a:b] - low]) * down[starts[a:b] - low])
        a = b
    return out


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, where their words start and end, and each text's first word, with the total."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[data].view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    return data, starts, ends, np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))])


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, one place of each, and each place's number among them."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[b : b + n], one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - (ends - length)).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return flat[at]


def window_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words inside one text, and the index of each window's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(_WORD_BASE | 1, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    whole = np.ones(n, bool)
    for cut in offsets[1:-1]:  # a window that starts less than k words before a text's end is in two texts
        whole[max(0, cut - k + 1) : cut] = False
    at = np.flatnonzero(whole)
    return mix64((total[at + k] - total[at]) * down[at]), at


def quote(name: str) -> Column:
    """The column of that name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [quote(c) for c in df.columns]


def plainly(df: DataFrame, results: list[str]) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """df with columns c0, c1, ..., their names by the old ones, and the way back from a result with these columns and the results.

    On the way back the columns have their names again, and those named like a result, whatever the case, are gone: the result takes their place.
    """
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    taken = {c.lower() for c in results}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for c, n in inner.items() if c.lower() not in taken], *[quote(c) for c in results])

    return df.toDF(*inner.values()), inner, back


def renamed(df: DataFrame, taken: list[str], results: list[str]) -> tuple[DataFrame, list[str]]:
    """df's columns as _<name> for each name in taken and c0, c1, ... for the others, and the others' names.

    Columns named like one of the results, whatever the case, are left out. Names may hold dots or clash with helping columns: they
    come back only with the last select.
    """
    gone = {c.lower() for c in results}
    rest = [c for c in df.columns if c not in taken and c.lower() not in gone]
    return df.select(*[quote(c).alias(f"_{c}") for c in taken], *[quote(c).alias(f"c{i}") for i, c in enumerate(rest)]), rest


#: Keys that dealt_join broadcasts at most, and rows of a key that shuffle in any case.
HOT_KEYS = 100_000
COLD_ROWS = 1000


def dealt_join(rows: DataFrame, keyed: DataFrame, on: str, n: str, hot_keys: int = HOT_KEYS, cold_rows: int = COLD_ROWS) -> DataFrame:
    """The inner join of rows with keyed, which has each key once and in n how many rows have it.

    Keys of more than total / hot_keys rows are hot. There are fewer than hot_keys of them, however large the tables are, so they are
    broadcast, and their rows stay where they are. The rows of the others are shuffled; none of these keys has more than that many.
    keyed is read three times: it should be a stored table.
    """
    total = keyed.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    most = max(cold_rows, total // hot_keys)
    hot, cold = keyed.where(F.col(n) > most), keyed.where(F.col(n) <= most)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold.hint("shuffle_merge"), on)
    return near.unionByName(far)
