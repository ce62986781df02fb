"""Token counts: pieces are counted once per distinct pre-token, joined to the documents' pre-token frequencies, and summed.

A pre-token is a run of a text's bytes (after the leading space that the model puts before a text) between two places where no
piece can span: two bytes that follow each other inside no piece. Merging never crosses such a place, so a text's count is the sum of
its pre-tokens' counts, and no text's ids are ever made.

1. Tasks read texts in blocks of about BLOCK_BYTES. A block gives one row of its distinct pre-tokens, and for each document one
   row of places among them and frequencies. Stored once, so that the blocks' numbers stand.
2. (pre-token, block, place) is shuffled and sorted by the pre-token, and the library counts the pieces of each distinct one, which
   goes to all its rows. However often a pre-token occurs, it has one row a block here: that is what tames hot keys.
3. Documents meet their block's counts in a cogroup, which sums counts times frequencies.

Inside a block, pre-tokens are known by 64-bit hashes: two of a block's n share one with probability n^2 / 2^65 (2e-9 at n = 3 x 10^5).
Between blocks they are compared whole.

A null text is an empty one, of no tokens. U+2581 in a text counts as a space, as in the library. A very long text is a block of its own,
in memory of its length. Repeated rows and ties are counted row by row, each alike. An empty table gives an empty result. Other columns pass
through, whatever their names; the text doesn't come back, and columns named like the results, whatever the case, are overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, pieces, renamed, small_batches, span_hashes, stored, utf8, worker_state
from .sentencepiece import Vocabulary, words_of

BLOCK_BYTES = 16 << 20
#: Rows of a block, so that short texts don't add up.
BLOCK_ROWS = 50_000
READ_BYTES = 1 << 20
COUNTED = 20_000
#: Counts that a task packs by block before it hands them on.
ANSWERS = 1_000_000


def library_model(path: str):
    """The library's model without the leading space, which pre-tokens have already; one per worker."""
    kept = worker_state()
    if ("counts", path) not in kept:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            own = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        if own.normalizer_spec.precompiled_charsmap or own.normalizer_spec.remove_extra_whitespaces or not own.normalizer_spec.add_dummy_prefix:
            raise ValueError(f"{path} normalises texts; counts need a model whose only change is a leading space")
        own.normalizer_spec.add_dummy_prefix = False
        kept["counts", path] = sentencepiece.SentencePieceProcessor(model_proto=own.SerializeToString())
    return kept["counts", path]


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane: the high planes are zeros, which compression removes."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def frequencies(texts: list[bytes], apart: np.ndarray) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The distinct pre-tokens of all texts, and for each text the steps between their ascending places and how often each occurs."""
    data, starts, first = words_of(texts, apart)
    begin, end = starts[:-1], starts[1:]
    hashes = span_hashes(data, begin, end)
    for i in np.flatnonzero(hashes == 0):  # longer than what span_hashes takes
        hashes[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    _, some, number = distinct(hashes)
    order = np.argsort(-np.bincount(number, minlength=len(some)), kind="stable")  # frequent ones first, so that steps are small
    some, place = some[order], np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    number = place[number]
    raw = data.tobytes()
    tokens = [raw[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        places, times = np.unique(number[a:b], return_counts=True)
        out.append((planes(np.diff(places, prepend=0)), planes(times)))
    return tokens, out


def packed(rows: np.ndarray) -> pa.RecordBatch:
    """(block, steps between ascending places, counts), a row for each block; rows: blocks, places, counts."""
    block, place, n = rows[:, np.lexsort((rows[1], rows[0]))]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = [*cuts[1:].tolist(), len(block)]
    steps = [planes(np.diff(place[a:b], prepend=0)) for a, b in zip(cuts.tolist(), ends, strict=True)]
    counts = [planes(n[a:b]) for a, b in zip(cuts.tolist(), ends, strict=True)]
    return pa.record_batch([pa.array(block[cuts]), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], names=["answered", "steps", "n"])


def token_counts(
    df: DataFrame, path: str, text: str = "text", limit: int = 4096, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over_limit: str = "over_limit", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """df without its text, with the text's UTF-8 bytes, its tokens by the sentencepiece model at path, and whether these exceed the limit."""
    results = [n_bytes, n_tokens, over_limit]
    own, names = renamed(small_batches(df), [text], results)
    apart = Vocabulary(path).apart
    kinds = [own.schema[f"c{i}"] for i in range(len(names))]
    block_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("tokens", T.ArrayType(T.BinaryType()))])
    block_schema = block_schema.add("size", T.LongType()).add("places", T.BinaryType()).add("times", T.BinaryType())
    for f in kinds:
        block_schema = block_schema.add(f.name, f.dataType, True)

    def rows_of(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        texts = utf8(table["_text"].combine_chunks())
        tokens, counted = frequencies(texts, apart)
        rest = [table[f.name] for f in kinds]
        n = len(texts)
        yield from pa.table(
            [pa.array([block], pa.int64()), pa.array([tokens], pa.list_(pa.binary())), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *[pa.nulls(1, x.type) for x in rest]],
            names=block_schema.names,
        ).to_batches()
        yield from pa.table(
            [pa.array([block] * n, pa.int64()), pa.nulls(n, pa.list_(pa.binary())), pa.array([len(x) for x in texts], pa.int64()), pa.array([p for p, _ in counted], pa.binary()), pa.array([t for _, t in counted], pa.binary()), *rest],
            names=block_schema.names,
        ).to_batches(max_chunksize=2000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for part in pieces(batch, "_text", READ_BYTES):
                held.append(part)
                size, n = size + part.nbytes, n + len(part)
                if size >= block_bytes or n >= BLOCK_ROWS:
                    yield from rows_of(block, held)
                    block, held, size, n = block + 1, [], 0, 0
        if held:
            yield from rows_of(block, held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of sorted pre-tokens; what goes to one block is packed in one row."""
        model, last, n_last, held = library_model(path), None, 0, []
        for batch in batches:
            for at in range(0, len(batch), COUNTED):
                part = batch.slice(at, COUNTED)
                coded = part["token"].dictionary_encode()
                tokens = coded.dictionary.to_pylist()
                new = tokens[1:] if tokens[0] == last else tokens
                n = [n_last] * (len(tokens) - len(new)) + [len(x) for x in model.encode([x.decode("utf-8", "replace") for x in new], num_threads=1)]
                last, n_last = tokens[-1], n[-1]
                held.append(np.stack([part["block"].to_numpy(), part["pos"].to_numpy().astype(np.int64), np.array(n, np.int64)[coded.indices.to_numpy()]]))
            if sum(x.shape[1] for x in held) >= ANSWERS:
                yield packed(np.concatenate(held, axis=1))
                held = []
        if held:
            yield packed(np.concatenate(held, axis=1))

    def total(documents: pa.Table, counted: pa.Table) -> pa.Table:
        places = [np.cumsum(from_planes(x), dtype=np.int64) for x in counted["steps"].to_pylist()]
        pieces_of = np.zeros(1 + max((x[-1] for x in places), default=0), np.int64)
        for place, n in zip(places, counted["n"].to_pylist(), strict=True):
            pieces_of[place] = from_planes(n)
        steps, times = documents["places"].to_pylist(), documents["times"].to_pylist()
        sums = np.array([pieces_of[np.cumsum(from_planes(p), dtype=np.int64)] @ from_planes(t).astype(np.int64) for p, t in zip(steps, times, strict=True)], np.int64)
        return pa.table([*[documents[f.name] for f in kinds], documents["size"], pa.array(sums)], names=[*[f.name for f in kinds], "size", "sum"])

    blocks = stored(own.mapInArrow(read, block_schema), "token-blocks")
    # one row a block of each pre-token, rows of equal pre-tokens together
    seen = blocks.where("tokens is not null").select("block", F.posexplode("tokens").alias("pos", "token"))
    answers = seen.repartition("token").sortWithinPartitions("token").mapInArrow(count, "answered long, steps binary, n binary")
    documents = blocks.where("size is not null").drop("tokens")
    out_schema = T.StructType([*kinds, T.StructField("size", T.LongType()), T.StructField("sum", T.LongType())])
    summed = documents.groupBy("block").cogroup(answers.groupBy("answered")).applyInArrow(total, out_schema)
    return summed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("size").alias(n_bytes), F.col("sum").alias(n_tokens), (F.col("sum") > limit).alias(over_limit)
    )
