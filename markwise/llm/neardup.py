"""Near-duplicate documents: a chosen-path set similarity join over word shingles, and the components of its links.

Equal shingle sets collapse into a class first, so copies cost nothing further. Classes get MinHash coordinates. Each of
several independent trees branches the classes by one coordinate, its token of least hash, and nodes with more than
LEAF members by the next, DEPTH times at most. Nodes of LEAF members or fewer are compared exhaustively by sketches. A
larger node at full depth, whose members share DEPTH minwise tokens, is compared with its first member; of those that are then not in
the node's most common component, a block first and then all meet all members, block by block on both sides and on full sets. A pair of blocks
gives a spanning forest of its links. So nodes of any size are spread over tasks, and a node of near copies costs about BLOCK comparisons of sketches each. Other candidates are
confirmed on full shingle sets, in two rounds: first those with a node's first member, then those that join different components.

A pair of similarity s meets in a tree with probability s^DEPTH at least. The number of trees and the sketches' bound follow
from the threshold: each misses a pair at it with probability MISS at most, so recall is 1 - 2 * MISS or more. Equality of sets and
shingles is decided by 128 and 64 bits. Links and components stay distributed.

Defined results: a null or empty text has no set (n_shingles 0), links with nothing and is its own component; a text of
fewer words than a shingle is one shingle; a very long text's memory follows its words, 8 bytes each a few times over. Rows that repeat a
key or a text fall into one class if their sets are equal; a null key is larger than any other. Ties go to the smallest key. An
empty table gives an empty result. Extra columns, whatever their names, don't matter and don't come back. Keys are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, integer_key, mix64, pieces, small_batches, stored, utf8, window_hashes, word_hashes

DEPTH = 4
LEAF = 32
BLOCK = 256
#: So many full sets are compared with one at a time.
CHUNK = 64
SKETCH = 64
#: Text bytes that are hashed at a time.
PIECE_BYTES = 2 << 20
#: The probability that the trees miss a pair at the threshold, and that sketches do.
MISS = 1e-5
#: Shares of a root's nodes in pointer jumping.
SALTS = 16
#: Up to so many keys are broadcast to pick their texts; beyond, texts and keys are joined.
BROADCAST_KEYS = 1_000_000


def trees_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**DEPTH)) if similarity < 1 else 1


def least_agreeing(similarity: float) -> int:
    """How many of the sketches' bytes agree at least, but for MISS of the pairs of that similarity."""
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        if below > MISS:
            return k
    return SKETCH


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes(texts, lower=True)
    windows, at = window_hashes(words, offsets, k)
    cuts = np.searchsorted(at, offsets)
    out = []
    for i in range(len(texts)):
        n = offsets[i + 1] - offsets[i]
        if n >= k:
            out.append(np.unique(windows[cuts[i] : cuts[i + 1]]))
        elif n:
            whole = np.uint64(n)
            for w in words[offsets[i] : offsets[i + 1]]:
                whole = mix64(np.array([whole ^ w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minwise values of each non-empty set."""
    rng = np.random.default_rng(11)
    multiply = rng.integers(1, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), n), np.uint32)
    for i in range(n):
        v = (x ^ add[i]) * multiply[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, text: str, key: str, k: int, trees: int) -> DataFrame:
    """(key, n_shingles, fp, coords, sketch) of each row; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                sets = shingle_sets(utf8(part.column(1)), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                fp: list[bytes | None] = [None] * len(sets)
                coords: list[list[int] | None] = [None] * len(sets)
                sketch: list[bytes | None] = [None] * len(sets)
                if full:
                    m = min_hashes([sets[i] for i in full], max(SKETCH, trees * DEPTH))
                    for i, row in zip(full, m, strict=True):
                        fp[i], coords[i], sketch[i] = _fingerprint(sets[i]), row[: trees * DEPTH].view(np.int32), (row[:SKETCH] >> np.uint32(9)).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(coords, pa.list_(pa.int32())), pa.array(sketch, pa.binary())], ["key", "n_shingles", "fp", "coords", "sketch"])

    return df.select(integer_key(df, key).alias("key"), F.col(text).alias("_text")).mapInArrow(run, "key long, n_shingles long, fp binary, coords array<int>, sketch binary")


def tree_nodes(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(node, fp) of nodes to compare exhaustively, (node, n, first, fp) of those left at full depth, and the tables behind them."""
    paths = classes.select("fp", "coords", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    now = paths.select("fp", F.xxhash64("tree", F.get("coords", F.col("tree") * DEPTH)).alias("node"), F.slice("coords", F.col("tree") * DEPTH + 1, DEPTH).alias("path"))
    leaves, full, tables = None, None, []
    for depth in range(1, DEPTH + 1):
        counts = stored(now.groupBy("node").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where(F.col("n") > 1), "near-counts")
        here = now.join(counts, "node")
        small = here.where(F.col("n") <= LEAF).select("node", "fp")
        leaves = small if leaves is None else leaves.unionByName(small)
        tables.append(counts)
        if counts.where(F.col("n") > LEAF).isEmpty():
            break
        large = here.where(F.col("n") > LEAF)
        if depth == DEPTH:
            full = stored(large.select("node", "n", "first", "fp"), "near-full")
            tables.append(full)
        else:
            now = stored(large.select("fp", F.xxhash64("node", F.get("path", F.lit(depth))).alias("node"), "path"), "near-nodes")
            tables.append(now)
    if full is None:
        full = classes.sparkSession.createDataFrame([], "node long, n long, first binary, fp binary")
    return leaves, full, tables


def _sketches(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, SKETCH)


def leaf_pairs(leaves: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, round, salt) of the members of each leaf whose sizes and sketches allow the similarity; round 1: a is the first."""
    agree = least_agreeing(least)

    def pairs(rows: list[tuple]) -> Iterator[tuple[bytes, bytes, int]]:
        m = _sketches([r[3] for r in rows])
        n = np.array([r[2] for r in rows], np.float64)
        for i in range(len(rows) - 1):
            same = (m[i + 1 :] == m[i]).sum(1)
            fit = (same >= agree) & (np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i]) - 1e-9)
            for j in np.flatnonzero(fit) + i + 1:
                yield rows[i][1], rows[j][1], 1 if i == 0 else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != node:
                    if len(rows) > 1:
                        out += pairs(rows)
                    node, rows = r[0], []
                rows.append(r)
            yield _pairs_batch(out)
        if len(rows) > 1:
            yield _pairs_batch(list(pairs(rows)))

    members = leaves.join(classes.select("fp", "n_shingles", "sketch"), "fp").select("node", "fp", "n_shingles", "sketch")
    found = members.repartition("node").sortWithinPartitions("node", "fp").mapInArrow(run, "a binary, b binary, round int")
    return found.select("a", "b", "round", F.lit(0).cast("long").alias("salt"))


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32())], ["a", "b", "round"])


def first_pairs(full: DataFrame) -> DataFrame:
    """(a, b, round, salt): each member of a full-depth node with the first; the salt deals a large node over tasks."""
    share = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK))
    return full.where(F.col("fp") != F.col("first")).select(F.col("first").alias("a"), F.col("fp").alias("b"), F.lit(1).alias("round"), share.alias("salt"))


def apart(full: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, sampled: bool = False) -> DataFrame:
    """(a, b): links from members of full-depth nodes that are not in their node's most common component to other components.

    Blocks of about BLOCK of those members (sampled: one such block a node) meet blocks of all members; a pair of blocks gives a
    spanning forest of what it links, so fewer links than members. Sizes and sketches must allow the similarity before full sets are compared.
    """
    least, agree = percent / 100, least_agreeing(percent / 100)
    own = labels.select(F.col("node").alias("fp"), "root")
    rooted = stored(full.join(own, "fp", "left").select("node", "n", "fp", F.coalesce("root", "fp").alias("root")), "near-members")
    tally = rooted.groupBy("node", "root").agg(F.count("*").alias("c"), F.first("n").alias("n")).groupBy("node").agg(F.max(F.struct("c", "root")).alias("most"), F.first("n").alias("n"))
    nodes = stored(tally.select("node", F.col("most.root").alias("common"), (F.col("n") - F.col("most.c")).alias("n_apart")).where("n_apart > 0"), "near-counts")
    if nodes.isEmpty():
        discard(rooted, nodes)
        return classes.sparkSession.createDataFrame([], "a binary, b binary")
    spread = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(spread, ["node", "salt"]).withColumn("apart", F.col("root") != F.col("common"))
    known = asked.join(classes.select("fp", "n_shingles", "sketch"), "fp").join(sets, "fp")
    rows, queries = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_apart") / BLOCK)
    columns = ("fp", "root", "n_shingles", "sketch", "shingles")
    dealt = lambda df, one, other, block, every: df.select(F.col("node").alias("node"), F.pmod(F.xxhash64("fp"), one).alias(block), F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias(every), *[F.col(c).alias(c) for c in columns])
    asking = known.where("apart")
    if sampled:
        asking, queries = asking.where(F.pmod(F.xxhash64("fp", F.lit(1)), queries) == 0), F.lit(1).cast("long")
    left, right = dealt(asking, queries, rows, "q", "r"), dealt(known, rows, queries, "r", "q")

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes]] = []
        if queries.num_rows and rows.num_rows:
            q, r = (t["fp"].to_pylist() for t in (queries, rows))
            sketch = [_sketches(t["sketch"].to_pylist()) for t in (queries, rows)]
            sizes = [t["n_shingles"].to_numpy().astype(float) for t in (queries, rows)]
            names, at = np.unique(np.array([x.hex() for t in (queries, rows) for x in t["root"].to_pylist()]), return_inverse=True)
            here = np.arange(len(names))  # the component, in this pair of blocks, of each root
            sets = [[x.values.to_numpy() for x in t["shingles"]] for t in (queries, rows)]
            for i in range(len(q)):
                same = (sketch[1] == sketch[0][i]).sum(1)
                fit = (same >= agree) & (np.minimum(sizes[1], sizes[0][i]) >= least * np.maximum(sizes[1], sizes[0][i]) - 1e-9)
                fit &= here[at[len(q) :]] != here[at[i]]
                one = np.sort(sets[0][i])
                likely = np.flatnonzero(fit)
                likely = likely[np.argsort(-same[likely], kind="stable")]
                while len(likely):
                    some, likely = likely[:CHUNK], likely[CHUNK:]
                    lengths = np.array([len(sets[1][j]) for j in some])
                    others = np.concatenate([sets[1][j] for j in some])
                    hits = one[np.minimum(np.searchsorted(one, others), len(one) - 1)] == others
                    both = np.add.reduceat(hits.astype(np.int64), np.cumsum(lengths) - lengths)
                    for j in some[both * 100 >= (len(one) + lengths - both) * percent]:
                        if here[at[len(q) + j]] != here[at[i]]:
                            here[here == here[at[len(q) + j]]] = here[at[i]]
                            out.append((q[i], r[j]))
                    likely = likely[here[at[len(q) + likely]] != here[at[i]]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    found = stored(left.groupBy("node", "q", "r").cogroup(right.groupBy("node", "q", "r")).applyInArrow(meet, "a binary, b binary").distinct(), "near-apart")
    discard(rooted, nodes)
    return found


def full_sets(df: DataFrame, text: str, key: str, k: int, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the wanted (key, fp), computed again from their texts."""
    small = wanted.count() <= BROADCAST_KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                sets = shingle_sets(utf8(part.column(1)), k)
                keep = [i for i, (s, fp) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if _fingerprint(s) == fp]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["fp", "shingles"])

    own = df.select(integer_key(df, key).alias("key"), F.col(text).alias("_text"))
    side = wanted.select(F.col("key").alias("_k"), "fp")
    found = own.join(F.broadcast(side) if small else side, F.col("key").eqNullSafe(F.col("_k"))).select("fp", "_text")
    return found.mapInArrow(run, "fp binary, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets are similar enough. Pairs of a common a are dealt out by their salt."""
    b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    a = pairs.select("a", "salt").distinct().join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, ["a", "salt"]).where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, by label propagation with pointer jumping. A root's nodes are dealt over SALTS shares."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "near-edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("root")), "near-labels")
    state = lambda x: x.agg(F.bit_xor(F.xxhash64("node", "root"))).first()[0]
    seen = state(labels)
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        step = stored(labels.join(near, F.col("u") == F.col("node")).select("node", F.least("root", "near").alias("root")), "near-labels")
        tops = step.select("root").distinct().join(step.select(F.col("node").alias("root"), F.col("root").alias("top")), "root")
        tops = tops.select("root", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        jumped = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(tops, ["root", "salt"])
        now = stored(jumped.select("node", F.col("top").alias("root")), "near-labels")
        discard(labels, step)
        labels, before = now, seen
        seen = state(labels)
        if before == seen:
            discard(edges)
            return labels


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (the smallest key of the component) and kept (it is that key) of each row."""
    trees = trees_for(percent / 100)
    own = stored(signatures(small_batches(df), text, key, k, trees), "near-signatures")
    classes = stored(own.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("coords").alias("coords"), F.first("sketch").alias("sketch")), "near-classes")
    leaves, full, tables = tree_nodes(classes, trees)
    found = leaf_pairs(leaves, classes, percent / 100).unionByName(first_pairs(full))
    pairs = stored(found.groupBy("a", "b").agg(F.min("round").alias("round"), F.max("salt").alias("salt")), "near-pairs")
    discard(*[t for t in tables if t is not full])
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes.select("fp", "key"), "fp")
    wanted = stored(wanted, "near-wanted")
    sets = stored(full_sets(df, text, key, k, wanted).dropDuplicates(["fp"]), "near-sets")
    discard(wanted)
    links = stored(confirmed(pairs.where("round = 1"), sets, percent), "near-links")
    labels = components(links)
    at = lambda side: labels.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    rest = pairs.where("round = 2").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = rest.where(F.col("root_a").isNull() | F.col("root_b").isNull() | (F.col("root_a") != F.col("root_b"))).select("a", "b", "salt")
    more = stored(confirmed(rest, sets, percent), "near-links")
    discard(pairs)
    deep, hot = not full.isEmpty(), full.where(F.col("n") > BLOCK)
    if deep:
        found = apart(full, classes, labels, sets, percent, sampled=True)
        links = links.union(found)
        hot = None if hot.isEmpty() else stored(hot, "near-full")
        deep_sets = hot and stored(sets.join(hot.select("fp").distinct(), "fp", "left_semi"), "near-sets")
        discard(*[t for t in tables if t is full])
    discard(sets)
    if not more.isEmpty() or deep:
        discard(labels)
        labels = components(links.union(more))
    if deep and hot:  # smaller nodes' members have all been asked for
        found = apart(hot, classes, labels, deep_sets, percent)
        discard(hot, deep_sets)
        if not found.isEmpty():
            discard(labels)
            labels = components(links.union(more).union(found))
    least = labels.join(classes.select(F.col("fp").alias("node"), "key"), "node").groupBy("root").agg(F.min("key").alias("least"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ends = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"]).select(F.col("node").alias("fp"), "least")
    classed = stored(classes.select("fp", "key").join(ends, "fp", "left").select("fp", F.coalesce("least", "key").alias("component_id")), "near-ends")
    discard(classes, labels, more)
    alone = own.where(F.col("fp").isNull()).select("key", "n_shingles", F.col("key").alias("component_id"))
    result = own.where(F.col("fp").isNotNull()).select("key", "n_shingles", "fp").join(classed, "fp").select("key", "n_shingles", "component_id").union(alone)
    return result.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
