"""SentencePiece encoding and decoding with a given model, as a relational lattice.

A text is cut into words where no piece of the vocabulary can span: between two bytes that follow each other inside no
piece. Equal words are segmented once. Words explode into their substrings of at most the longest piece's length, an
equi-join with the piece table (fixed by the vocabulary, so broadcast) leaves the edges of the lattice, edges are grouped
by word, and a higher-order aggregate folds them into the best path: the least sum of costs, ties to the longest last
piece. A cost is a negative log-probability in units of 2^-16. Characters without a piece become byte pieces.

Texts travel in compressed blobs, about CHUNK_BYTES to a chunk; a chunk asks for its distinct words, and gets their ids back
in a cogroup. There words are known by a 64-bit hash: two of a chunk's n words share one with probability n^2 / 2^65, and
round_trip shows it. A word of more than LONG bytes, and one that a chunk made anew after a loss hadn't asked for, is segmented in
the chunk's task by best_path(), the same rule in memory of the word's length.

The given model was made by merges, so its scores are ranks; the lattice takes Zipf log-probabilities of them. Its paths
are best ones, but about a third of the distinct words get other ids than merging gives (measured in the tests).

The text model is the identity: a leading space is put before a text, and pieces write spaces as U+2581. Decoding gives back
every text that holds no U+2581 itself; there that is a space. A null text is an empty one, without ids. Rows are
independent, so ties and repeated rows don't matter; a very long text makes a blob of its own; an empty table gives an empty
result. Extra columns pass through, whatever their names; one named like the ids or the check is overwritten.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blob, chunks_of, distinct, gather, pieces, plainly, small_batches, span_hashes, unblob, utf8

SPACE = "▁"
CHUNK_BYTES = 64 << 20
BLOB_BYTES = 1 << 20
LONG = 2048
#: Words of a batch.
ASKED = 100_000
#: What a character without a piece costs above the worst piece, and the unit of costs.
UNKNOWN = 10.0
UNIT = 1 << 16

#: An edge or a path's last edge as one long: end (edges only), cost, LENGTHS - length, id + 1 (0: no piece). Longs compare
#: as (end, cost, longest last piece), and adding an edge's long to a path's cost gives the longer path.
_END, _COST, _LENGTH = 49, 27, 21
_LENGTHS = 63
#: Bits of the filter that keeps most substrings without a piece out of the join.
_FILTER = 1 << 20


class Vocabulary:
    """Normal pieces (spaces as spaces) with ids and costs, byte pieces' ids, and the pairs of bytes that no piece holds.

    merges: the model was made by merges (BPE), so its scores are ranks; their log-probabilities are taken by Zipf's law.
    Otherwise its scores are log-probabilities themselves.
    """

    def __init__(self, path: str, merges: bool = True) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.texts = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: float(model.get_score(i)) for i in plain}
        if merges:  # normalised Zipf probabilities of the ranks, of which such a model's scores are the negatives
            total = math.fsum(1 / n for n in range(1, len(plain) + 1))
            scores = {i: -math.log((1 - s) * total) for i, s in scores.items()}
        self.pieces = {self.texts[i].replace(SPACE, " "): (i, round(-scores[i] * UNIT)) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.pieces))
        self.unknown = max(c for _, c in self.pieces.values()) + round(UNKNOWN * UNIT)
        if self.longest > _LENGTHS or min(c for _, c in self.pieces.values()) < 0 or self.unknown >> (_END - _COST) or len(self.texts) >= 1 << _LENGTH:
            raise ValueError("pieces of more than 63 characters, scores above 0 or below -54, and more than two million pieces are not supported")
        spelled = [p.encode() for p in self.pieces]
        apart = np.ones((256, 256), bool)
        for p in spelled:
            apart[list(p[:-1]), list(p[1:])] = False
        apart[:, 0x80:0xC0] = False  # inside a character
        #: apart[a << 8 | b]: a word ends between the bytes a and b.
        self.apart = apart.ravel()
        back = {i: p for p, (i, _) in self.pieces.items()}
        #: The bytes that each id stands for.
        self.spelled = [back.get(i, "").encode() for i in ids]
        for b, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([b])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, c << _COST | (_LENGTHS - len(p)) << _LENGTH | i + 1) for p, (i, c) in self.pieces.items()]
        return spark.createDataFrame(rows, "piece string, edge long").select("piece", "edge", F.xxhash64("piece").alias("hash"))


def words_of(texts: list[bytes], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each after its leading space; where words start, with the end; each text's first word, with the end."""
    lengths = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    data = np.frombuffer(b"".join([b" " + x.replace(SPACE.encode(), b" ") for x in texts if x]), np.uint8)
    if len(data) != lengths.sum():  # some text holds U+2581
        lengths = np.array([len(x.replace(SPACE.encode(), b" ")) + 1 if x else 0 for x in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = apart[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
    first[edges] = True
    starts = np.flatnonzero(first)
    return data, starts, np.searchsorted(starts, edges)


def runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


def best_path(word: str, known: dict[str, tuple[int, int]], byte_ids: list[int], longest: int, unknown: int) -> list[int]:
    """The best path of one word, in memory of its length."""
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for end in range(1, len(word) + 1):
        top: tuple[int, int, int] | None = None
        for start in range(max(0, end - longest), end):
            found = known.get(word[start:end]) or ((-1, unknown) if start == end - 1 else None)
            if found and (top is None or best[start][0] + found[1] < top[0]):
                top = (best[start][0] + found[1], start, found[0])
        best.append(top)
    out: list[int] = []
    end = len(word)
    while end:
        _, start, i = best[end]
        out += [i] if i >= 0 else [byte_ids[b] for b in reversed(word[start:end].encode())]
        end = start
    return out[::-1]


def _end(edge: Column) -> Column:
    return F.shiftright(edge, _END).cast("int")


def _length(edge: Column) -> Column:
    return _LENGTHS - F.shiftright(edge, _LENGTH).bitwiseAND(F.lit(_LENGTHS)).cast("int")


def _possible(table: DataFrame) -> Column:
    """Whether a hash has its bit in the table's bitmap, a constant of the plan."""
    bits = [0] * (_FILTER >> 6)
    for r in table.select(F.pmod("hash", F.lit(_FILTER)).alias("at")).collect():  # one row per piece of the vocabulary
        bits[r["at"] >> 6] |= 1 << (r["at"] & 63)
    bitmap = F.split(F.lit(",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)), ",").cast("array<long>")
    at = F.pmod("hash", F.lit(_FILTER))
    return F.call_function("shiftright", F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def lattice(words: DataFrame, table: DataFrame, longest: int, unknown: int, byte_ids: list[int]) -> DataFrame:
    """(word, ids) of distinct words. No exchange, if words are partitioned by word."""
    ends = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    starts = ends.select("word", "end", F.explode(F.sequence(F.greatest(F.lit(1), F.col("end") - (longest - 1)), F.col("end"))).alias("start"))
    exploded = starts.select("word", "end", (F.col("start") == F.col("end")).alias("single"), F.substr("word", F.col("start"), F.col("end") - F.col("start") + 1).alias("part"))
    hashed = exploded.withColumn("hash", F.xxhash64("part")).where(F.col("single") | _possible(table))
    piece = F.broadcast(table.select(F.col("hash").alias("_hash"), "piece", "edge"))
    edges = hashed.join(piece, (F.col("hash") == F.col("_hash")) & (F.col("part") == F.col("piece")), "left").where(F.col("edge").isNotNull() | F.col("single"))
    nameless = unknown << _COST | (_LENGTHS - 1) << _LENGTH
    edges = edges.select("word", F.shiftleft(F.col("end").cast("long"), _END).bitwiseOR(F.coalesce("edge", F.lit(nameless))).alias("edge"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    start = F.struct(F.array().cast("array<long>").alias("done"), F.lit(0).cast("long").alias("last"))

    def step(state: Column, edge: Column) -> Column:
        """done: the best paths to each earlier place; last: the best so far to this one."""
        here = F.size(state["done"])
        same, begin = _end(edge) == here, _end(edge) - _length(edge)
        before = F.when(begin == here, state["last"]).otherwise(F.get(state["done"], begin))
        path = before.bitwiseAND(F.lit(-(1 << _COST))) + edge.bitwiseAND(F.lit((1 << _END) - 1))
        done = F.when(same, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
        return F.struct(done.alias("done"), F.when(same, F.least(state["last"], path)).otherwise(path).alias("last"))

    def back(state: Column) -> Column:
        """From the end along the last edges. A character without a piece is minus its place."""
        n = F.size(state["done"])
        nothing = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))

        def hop(path: Column, place: Column) -> Column:
            edge = F.when(place == n, state["last"]).otherwise(F.get(state["done"], place))
            own = (edge.bitwiseAND(F.lit((1 << _LENGTH) - 1)) - 1).cast("int")
            longer = F.struct((place - _length(edge)).alias("at"), F.concat(F.array(F.when(own < 0, -place).otherwise(own)), path["ids"]).alias("ids"))
            return F.when(path["at"] == place, longer).otherwise(path)

        return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), nothing, hop, lambda path: path["ids"])

    found = grouped.select("word", F.aggregate("edges", start, step, back).alias("ids"))

    def as_bytes(place: Column) -> Column:
        code = F.hex(F.encode(F.substr("word", -place, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.get(F.lit(byte_ids), F.conv(F.substr(code, i, F.lit(2)), 16, 10).cast("int")))

    spelled = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(as_bytes(i))))
    return found.select("word", F.when(F.exists("ids", lambda i: i < 0), spelled).otherwise(F.col("ids")).alias("ids"))


def _strings(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(gather(data, begin, length)))])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", check: str | None = None) -> DataFrame:
    """df and the piece ids of each whole text; check: a column that says whether the ids decode to the text."""
    plain, name, back = plainly(df, [ids, check] if check else [ids])
    return back(_encode(plain, path, name[text], ids, check))


def _encode(
    df: DataFrame, path: str, text: str, ids: str, check: str | None = None, finish: tuple[Callable[[pa.Table], pa.Table], T.StructType] | None = None
) -> DataFrame:
    """encode() of columns with plain names.

    finish: what a task makes of its coded rows, some at a time, and the schema of that.
    """
    spark = small_batches(df).sparkSession
    v = Vocabulary(path)
    shared = spark.sparkContext.broadcast((v.apart, v.pieces, v.byte_ids, v.longest, v.unknown, v.spelled))
    names = [c for c in df.columns if c not in (ids, check)]
    schema = T.StructType([df.schema[c] for c in names]).add(ids, T.ArrayType(T.IntegerType()))
    if check:
        schema = schema.add(check, T.BooleanType())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, word): each chunk's distinct words."""
        for chunk, own in groupby(chunks_of(batches, text, BLOB_BYTES, CHUNK_BYTES), key=lambda x: x[0]):
            hashes, words = np.zeros(0, np.uint64), pa.array([], pa.string())
            for _, rows in own:
                data, starts, _ = words_of(utf8(rows.column(rows.schema.get_field_index(text))), shared.value[0])
                length = np.diff(starts)
                found, at, _ = distinct(span_hashes(data, starts[:-1], starts[1:]))
                new = (length[at] <= LONG) & ~np.isin(found, hashes, assume_unique=True)
                hashes = np.concatenate([hashes, found[new]])
                words = pa.concat_arrays([words, _strings(data, starts[at[new]], length[at[new]])])
            words = words.sort()  # neighbours with common beginnings take less room in the shuffle
            for at in range(0, len(words), ASKED):
                part = words.slice(at, ASKED)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), part], ["chunk", "word"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, word, ids, rows): a chunk's compressed blobs."""
        for chunk, part in chunks_of(batches, text, BLOB_BYTES, CHUNK_BYTES):
            none = [pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *none, pa.array([blob(part)], pa.binary())], ["chunk", "word", "ids", "rows"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, its answers before its blobs."""
        now, heard, known = None, [], None
        for batch in batches:
            chunk, word, said, rows = (batch.column(i) for i in range(4))
            numbers = chunk.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != now:
                    now, heard, known = numbers[a], [], None
                first = a + rows.slice(a, b - a).null_count
                if first > a:
                    heard.append((word.slice(a, first - a), said.slice(a, first - a)))
                for i in range(first, b):
                    known = known or Known(heard, *shared.value[1:])
                    yield from coded(unblob(rows[i].as_buffer()), known)

    def coded(rows: pa.Table, known: Known) -> Iterator[pa.RecordBatch]:
        texts = utf8(rows[text].combine_chunks())
        values, offsets = known.code(*words_of(texts, shared.value[0]))
        column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))
        out = pa.table([*(rows[c] for c in names), column], names=[*names, ids])
        if check:
            same = [x == t for x, t in zip(decoded(values, offsets, known.spell), texts, strict=True)]
            out = out.append_column(check, pa.array(same, pa.bool_()))
        yield from (finish[0](out) if finish else out).combine_chunks().to_batches()

    source = df.select(*names)
    words = source.mapInArrow(ask, "chunk long, word string").repartition("word")
    found = lattice(words.groupBy("word").agg(F.max("chunk").alias("_")).where(F.col("_").isNotNull()).select("word"), v.table(spark), v.longest, v.unknown, v.byte_ids)
    answers = words.join(found, "word").select("chunk", "word", "ids", F.lit(None).cast("binary").alias("rows"))
    met = source.mapInArrow(send, "chunk long, word string, ids array<int>, rows binary").union(answers).repartition("chunk")
    return met.sortWithinPartitions("chunk", F.col("rows").isNotNull()).mapInArrow(answer, finish[1] if finish else schema)


class Known:
    """What a chunk knows of its words: the answers it got, and best_path() for what it didn't ask for."""

    def __init__(self, heard: list[tuple[pa.Array, pa.Array]], *given) -> None:
        *self.given, spelled = given
        self.spell = runs(spelled)
        self.own: dict[bytes, int] = {}
        hashes, ids, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for word, said in heard:
            edges = np.frombuffer(word.buffers()[1], np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
            hashes.append(span_hashes(np.frombuffer(word.buffers()[2], np.uint8), edges[:-1], edges[1:]))
            ids.append(said.flatten().to_numpy())
            lengths.append(said.value_lengths().to_numpy().astype(np.int64))
        self.flat, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        self.begins = np.cumsum(self.lengths) - self.lengths
        hashes = np.concatenate(hashes)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def code(self, data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start, with the end."""
        hashes, size = span_hashes(data, starts[:-1], starts[1:]), np.diff(starts)
        at = np.zeros(len(hashes), np.int64)
        strange = np.ones(len(hashes), bool)
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            at, strange = self.order[near], (self.hashes[near] != hashes) | (size > LONG)
        for j in np.flatnonzero(strange):
            w = data[starts[j] : starts[j + 1]].tobytes()
            if w not in self.own:
                path = np.array(best_path(w.decode(), *self.given), np.int32)
                self.own[w] = len(self.begins)
                self.begins, self.lengths = np.append(self.begins, len(self.flat)), np.append(self.lengths, len(path))
                self.flat = np.append(self.flat, path)
            at[j] = self.own[w]
        return gather(self.flat, self.begins[at], self.lengths[at]), np.concatenate([[0], np.cumsum(self.lengths[at])])[first]


def decoded(ids: np.ndarray, offsets: np.ndarray, spell: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The text of each run of ids, without the leading space."""
    flat, begin, length = spell
    back = gather(flat, begin[ids], length[ids]).tobytes()
    edges = np.concatenate([[0], np.cumsum(length[ids])])[offsets].tolist()
    return [back[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each row's start, with the end; a null is an empty list."""
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


def decode(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """df and the text of each row's ids; ids that give no valid UTF-8 decode with replacement characters, null to null."""
    shared = small_batches(df).sparkSession.sparkContext.broadcast(Vocabulary(path).spelled)
    taken = text.lower()
    names = [c for c in df.columns if c.lower() != taken]
    schema = T.StructType([df.schema[c] for c in names]).add(text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = runs(shared.value)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            own = column(ids)
            out = [x.decode(errors="replace") if ok else None for x, ok in zip(decoded(*_lists(own), spell), own.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(out, pa.string())], [*names, text])

    return df.mapInArrow(run, schema)


def piece_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit integers), decoded_sha256 and round_trip of df's texts, encoded."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path).spelled)
    names = [key, "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
    schema = T.StructType([df.schema[key]]).add(names[1], T.LongType()).add(names[2], T.LongType()).add(names[3], T.StringType()).add(names[4], T.BooleanType())

    def digests(table: pa.Table) -> pa.Table:
        values, offsets = _lists(table["piece_ids"].combine_chunks())
        coded, cuts = values.astype("<u4").tobytes(), (offsets * 4).tolist()
        back = decoded(values, offsets, runs(shared.value))
        out = [
            pa.array(np.diff(offsets)), pa.array([zlib.crc32(coded[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array([x == t for x, t in zip(back, utf8(table[text].combine_chunks()), strict=True)], pa.bool_()),
        ]
        return pa.table([table[key], *out], names=names)

    return _encode(df.select(key, text), path, text, "piece_ids", finish=(digests, schema))
