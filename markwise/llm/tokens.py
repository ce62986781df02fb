"""Token ids in compact files: one zstandard dictionary for all, one frame per document, an offset index.

The dictionary is trained on the serialised ids of a bounded sample (SAMPLE_DOCS, those of the smallest hashed keys).
Rows are range-partitioned and sorted by key before they are encoded, so files follow each other in key order. A file is a
binary value of about FILE_BYTES in a Parquet table, so Spark's commit protocol covers it on any store:

    magic, dictionary hash (32), id bytes (1), documents (4),
    keys (8 each), key is null (1 each), ids per document (8 each), frame offsets (8 each and the end), frames

Nulls: a null text is an empty one, only the end id; a null key comes first. Rows that repeat a key follow each other,
by a hash of the text. An empty table gives no file and an empty result. A text longer than FILE_BYTES makes a longer file. Extra
columns, whatever their names, don't matter and don't come back. Keys are integers.

Distinct words are known by 64-bit hashes in the encoder: two of n distinct words share one with probability n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, gather, integer_key, pieces, small_batches, span_hashes, stored, text_bytes, utf8, word_spans, worker_state

MAGIC = b"MWTOKENS1"
#: Bound of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 1 << 20
#: Text bytes of a partition; a key range that is cut by samples holds more or less.
PARTITION_BYTES = 16 << 20
LEVEL = 3
#: Words that a worker remembers, from task to task; beyond, those that were asked for least lately go.
REMEMBERED = 1_500_000
STEMS = 300_000

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# The normaliser and the word cuts under which a text's ids are those of its words.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Memo:
    """Ids of words by their 64-bit hashes, in sorted arrays."""

    def __init__(self, kind: str) -> None:
        self.hashes, self.begin, self.length, self.asked = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.size, self.turn = np.zeros(1 << 12, kind), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of sorted hashes, -1 where unknown."""
        self.turn += 1
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        self.asked[at[known]] = self.turn
        return np.where(known, at, -1)

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Sorted new hashes."""
        new = np.frombuffer(b"".join(ids), self.ids.dtype)
        length = np.array([len(x) for x in ids], np.int64) // self.ids.itemsize
        if self.size + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.size], np.zeros(max(self.size, len(new)), self.ids.dtype)])
        self.ids[self.size : self.size + len(new)] = new
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.length = np.insert(self.hashes, at, hashes), np.insert(self.length, at, length)
        self.begin, self.asked = np.insert(self.begin, at, self.size + np.cumsum(length) - length), np.insert(self.asked, at, self.turn)
        self.size += len(new)

    def forget(self) -> None:
        """The half that was asked for most lately stays."""
        kept = np.sort(np.argsort(-self.asked, kind="stable")[: len(self.asked) // 2])
        ids = gather(self.ids, self.begin[kept], self.length[kept])
        self.hashes, self.length, self.asked = self.hashes[kept], self.length[kept], self.asked[kept]
        self.begin, self.ids, self.size = np.cumsum(self.length) - self.length, ids, len(ids)


class WordEncoder:
    """Ids of whole texts from a tokenizers file.

    Where the file is a byte-level BPE that normalises as _NORMALIZER and cuts as _WORDS, a text's ids are those of the
    words between its ASCII white space, so each distinct word is coded once. Its ids are those of its lower-case stem and of the
    marks behind it, and a stem of small Latin letters, which normalising and cutting leave as it is, goes straight to the
    library's BPE model. Any other file gets whole texts.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path) as file:
            own = json.load(file)
        cuts = [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) and x["content"].startswith("<|") and not set(x["content"]) & set(" \t\n\v\f\r") for x in own["added_tokens"])
        self.by_words = plain and own["normalizer"] == _NORMALIZER and own["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": cuts} and own["model"]["type"] == "BPE"
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.end = array(self.kind, [end_id]).tobytes()
        self.memo = Memo(f"<u{self.width}")
        self.stems: dict[bytes, bytes] = {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c == c.lower() and unicodedata.is_normalized("NFC", c)]
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.spelled = frozenset(letters)

    def parts(self, word: bytes) -> tuple[bytes, bytes]:
        """Stem and marks; the whole word where it can't be cut (an apostrophe, or a character that may join the marks)."""
        if b"<|" in word:
            return word, b""
        word = word.lower()
        stem = word.rstrip(_MARKS)
        if not stem or stem[-1] >= 128 and not stem.decode()[-1].isalpha() or stem[-1] < 128 and not stem[-1:].isalnum():
            return word, b""
        return stem, word[len(stem) :]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        known, rest = self.stems, set()
        if len(known) > STEMS:
            known.clear()
        cut = [(w, b"") if w.isalpha() and w.islower() else self.parts(w) for w in words]
        for stem, marks in cut:
            if marks and marks not in known:
                rest.add(marks)
            if stem not in known:
                s = stem.decode()
                if self.spelled.issuperset(s):
                    known[stem] = array(self.kind, [t.id for t in self.model.tokenize(s if s.isascii() else s.translate(self.letters))]).tobytes()
                else:
                    rest.add(stem)
        own = list(rest)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = array(self.kind, e.ids).tobytes()
        return [known[stem] + known[marks] if marks else known[stem] for stem, marks in cut]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The serialised ids of each text, with the end id."""
        if not self.by_words:
            return [array(self.kind, e.ids).tobytes() + self.end for e in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        data, starts, ends, first = word_spans(texts)
        hashes, at, number = distinct(span_hashes(data, starts, ends))
        place = self.memo.find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            words = [data[a:b].tobytes() for a, b in zip(starts[at[missing]].tolist(), ends[at[missing]].tolist(), strict=True)]
            self.memo.add(hashes[missing], self.learn(words))
            place = np.searchsorted(self.memo.hashes, hashes)
        place = place[number]
        length = self.memo.length[place]
        out = gather(self.memo.ids, self.memo.begin[place], length).tobytes()
        edges = (np.concatenate([[0], np.cumsum(length)])[first] * self.width).tolist()
        if len(self.memo.hashes) > REMEMBERED:
            self.memo.forget()
        return [out[a:b] + self.end for a, b in zip(edges, edges[1:], strict=False)]


def word_encoder(path: str, end_id: int) -> WordEncoder:
    """The worker's encoder, with what it remembers."""
    kept = worker_state().setdefault("encoders", {})
    if (path, end_id) not in kept:
        kept[path, end_id] = WordEncoder(path, end_id)
    return kept[path, end_id]


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty where the samples are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_file(keys: list[int | None], ids: list[bytes], width: int, dictionary_hash: bytes, compressor: zstandard.ZstdCompressor) -> bytes:
    frames = [compressor.compress(x) for x in ids]
    offsets = np.cumsum([0, *map(len, frames)], dtype="<i8")
    return b"".join([
        MAGIC, dictionary_hash, struct.pack("<BI", width, len(keys)),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], "u1").tobytes(),
        np.array([len(x) // width for x in ids], "<i8").tobytes(), offsets.tobytes(), *frames,
    ])


class TokenFile:
    """Reads single documents of a file without touching the others."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)
        if data[at : at + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.width, n = struct.unpack_from("<BI", data, at + 32)
        at += 37
        part = lambda kind, count, at: np.frombuffer(data, kind, count, at)
        self.keys, self.null = part("<i8", n, at), part("u1", n, at + 8 * n)
        self.lengths, self.offsets = part("<i8", n, at + 9 * n), part("<i8", n + 1, at + 17 * n)
        self.frames = at + 25 * n + 8
        self.data = data
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_as_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, i: int) -> int | None:
        return None if self.null[i] else int(self.keys[i])

    def ids(self, i: int) -> np.ndarray:
        frame = self.data[self.frames + self.offsets[i] : self.frames + self.offsets[i + 1]]
        out = np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")
        if len(out) != self.lengths[i]:
            raise ValueError("a frame has another number of ids than the index says")
        return out


class TokenTable:
    """Files of one table, their dictionary, and the ids before each partition's first file."""

    def __init__(self, files: DataFrame, dictionary: bytes, key: str) -> None:
        self.files, self.dictionary, self.key = files, dictionary, key

    def read(self, row: Callable[[np.ndarray], tuple] = lambda ids: (ids.tolist(),), names: tuple[str, ...] = ("ids",), types: tuple[str, ...] = ("array<long>",), arrow: tuple[pa.DataType, ...] = (pa.list_(pa.int64()),)) -> DataFrame:
        """key, start (ids of all documents before it), n_tokens, and what row() makes of the ids, read from the files."""
        sums = {r["part"]: r["n"] for r in self.files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # as many rows as partitions were written
        before, total = {}, 0
        for part in sorted(sums):
            before[part] = total
            total += sums[part]
        key, dictionary = self.key, self.dictionary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    f = TokenFile(data.as_py(), dictionary)
                    starts = before[part] + at + np.cumsum(f.lengths) - f.lengths
                    rows = [row(f.ids(i)) for i in range(len(f))]
                    yield pa.RecordBatch.from_arrays([pa.array([f.key(i) for i in range(len(f))], pa.int64()), pa.array(starts, pa.int64()), pa.array(f.lengths, pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(arrow))], [key, "start", "n_tokens", *names])

        schema = f"{key} long, start long, n_tokens long" + "".join(f", {n} {t}" for n, t in zip(names, types, strict=True))
        return self.files.select("part", "before", "file").mapInArrow(run, schema)


def sampled(rows: DataFrame) -> list[bytes]:
    """Texts of at most SAMPLE_DOCS keys, those of the smallest hashes, and at most SAMPLE_BYTES together; a key's least text."""
    keys = rows.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE_DOCS).select(F.col("_key").alias("_k"))
    short = rows.where(F.octet_length("_text") <= SAMPLE_BYTES // 8).join(F.broadcast(keys), F.col("_key").eqNullSafe(F.col("_k")))
    out, size = [], 0
    for r in short.groupBy("_key").agg(F.min("_text").alias("_text")).orderBy(F.xxhash64("_key"), "_key").toLocalIterator():
        own = r["_text"].encode()
        if size + len(own) <= SAMPLE_BYTES:
            out.append(own)
            size += len(own)
    return out


def write_tokens(df: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> TokenTable:
    """Encodes every text with the tokenizers file at path (the same on each executor) and writes the token files."""
    rows = small_batches(df).select(integer_key(df, key).alias("_key"), F.col(text).alias("_text"))
    sample = sampled(rows)
    dictionary = train_dictionary(WordEncoder(path, end_id).encode(sample) if sample else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, end_id)
        shared = _as_dictionary(dictionary)
        if shared:
            shared.precompute_compress(LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        digest, width, part = hashlib.sha256(dictionary).digest(), encoder.width, TaskContext.get().partitionId()
        before = 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal before
            n = sum(map(len, ids)) // width
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([write_file(keys, ids, width, digest, compressor)], pa.binary())], ["part", "before", "n_tokens", "file"])
            before += n
            keys.clear()
            ids.clear()
            return out

        for batch in batches:
            for piece in pieces(batch, "_text", 2 * FILE_BYTES):
                keys += piece.column(0).to_pylist()
                ids += encoder.encode(utf8(piece.column(1)))
                if sum(map(len, ids)) >= FILE_BYTES:
                    yield flush()
        if keys:
            yield flush()

    parts = max(1, -(-text_bytes(rows, "_text") // PARTITION_BYTES))
    placed = rows.withColumn("_hash", F.xxhash64("_text"))  # rows of one key go to several partitions too
    ordered = placed.repartitionByRange(parts, "_key", "_hash").sortWithinPartitions("_key", "_hash", "_text").select("_key", "_text")
    return TokenTable(stored(ordered.mapInArrow(run, "part int, before long, n_tokens long, file binary"), "token-files", **{"parquet.block.size": str(16 << 20)}), dictionary, key)


def token_digests(df: DataFrame, path: str, end_id: int) -> DataFrame:
    crc = lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),)
    return write_tokens(df, path, end_id).read(crc, ("ids_crc32",), ("long",), (pa.int64(),))
