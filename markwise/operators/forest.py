"""Randomised k-d trees for the neighbours of a descriptor in each image, searched best bin first.

grow() makes a table with a row per image: the split planes of its trees, the leaves' members and the vectors. A plane cuts at the mean of a dimension
taken at random from the five of largest variance; the seed is a hash of the image and the tree, so a lost task's work comes out the same. A row is as
large as its image, whatever the database holds.

nearest_in_images() packs queries in blocks, dealt over shares. Every share meets every image (which is what comparing in pairs means) in a cogroup on (images, share), and
a block and an image are searched in arrays: a leaf's bound for a query is the sum of squared distances to the planes that part them; a query visits leaves of all
trees in order of their bounds, until it has met `checks` members (one that several trees give counts each time), and these alone are measured. Where leaves are many,
only the subtrees next to the visited leaves are kept, so that a task's memory doesn't grow with queries times leaves. Vectors keep their own precision.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from markwise.sources.tables import scratch

from .knn import CELLS, _exact, _first, _top

TREES = 5
CHECKS = 50
#: Members that a leaf holds at most, unless they are equal.
LEAF = 4
#: Fixed value: among how many dimensions of largest variance a plane's is taken.
WIDEST = 5
#: Queries of a block, blocks that meet an image in one task, and images of a task; images of more than LARGE members on average are a task's each.
#: Beyond TASKS tasks up to MORE times as many blocks meet in one, as every share of the queries is another copy of the forests.
QUERIES = 512
BLOCKS = 16
IMAGES = 16
LARGE = 1024
TASKS = 64
MORE = 4
#: Leaves per check up to which the bounds of all of them are taken.
DENSE = 64

FOREST = "image_id string, ids binary, vectors binary, nodes binary, cuts binary, leaves binary, members binary"
_FOUND = "qid long, image_id string, global_idx long, d2 double"


def tree(x: np.ndarray, chance: np.random.Generator, leaf: int = LEAF) -> tuple[list[list[int]], list[float], list[np.ndarray]]:
    """Nodes (dimension, child below the cut, child from the cut on; child c < 0 is leaf -1 - c), their cuts, and the leaves' members. Node 0 is the root."""
    nodes, cuts, leaves = [], [], []
    waiting: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while waiting:
        own, parent, side = waiting.pop()
        part = x[own]
        spread = part.var(axis=0)
        dim = int(chance.choice(np.argsort(-spread, kind="stable")[:WIDEST]))
        if spread[dim] == 0:
            dim = int(spread.argmax())
        cut = float(part[:, dim].mean())
        below = part[:, dim] < cut
        if below.all() or not below.any():  # the mean of equal numbers may be rounded away from them
            dim = int(np.ptp(part, axis=0).argmax())
            cut = float(part[:, dim].max())
            below = part[:, dim] < cut
        if len(own) <= leaf or not below.any():  # few, or all equal
            place = -1 - len(leaves)
            leaves.append(own)
        else:
            place = len(nodes)
            nodes.append([dim, 0, 0])
            cuts.append(cut)
            waiting += [(own[~below], place, 2), (own[below], place, 1)]
        if parent >= 0:
            nodes[parent][side] = place
    return nodes, cuts, leaves


def bounds(q: np.ndarray, nodes: np.ndarray, cuts: np.ndarray, n_leaves: int) -> np.ndarray:
    """(queries x leaves) sums of squared distances to the planes between a query and a leaf. A node stands after its parent."""
    out, at = np.zeros((len(q), n_leaves)), np.zeros((len(nodes), len(q)))
    for i, (dim, low, high) in enumerate(nodes):
        off = q[:, dim] - cuts[i]
        for child, far in ((low, off >= 0), (high, off < 0)):
            bound = at[i] + np.where(far, off * off, 0)
            if child < 0:
                out[:, -1 - child] = bound
            else:
                at[child] = bound
    return out


def grow(database: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> DataFrame:
    """A row of FOREST for each image of database(image_id, global_idx, d)."""
    kind = "<f4" if database.schema["d"].dataType.simpleString() == "array<float>" else "<f8"

    def plant(rows: pa.Table) -> pa.Table:
        name, ids = rows["image_id"][0].as_py(), rows["global_idx"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = rows["d"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order].astype(np.float64)
        all_nodes, all_cuts, starts, members, first = [], [], [], [], []
        for t in range(trees):
            nodes, cuts, leaves = tree(x, np.random.default_rng([seed, zlib.crc32(name.encode()), t]), leaf)
            first.append((len(nodes), len(leaves)))
            all_nodes += nodes
            all_cuts += cuts
            starts += [len(m) for m in leaves]
            members += leaves
        packed = [ids[order].astype("<i8"), x.astype(kind), np.array(first, "<i4").reshape(-1, 2), np.array(all_nodes, "<i4").reshape(-1, 3), np.array(all_cuts, "<f8"), np.array(starts, "<i4"), np.concatenate(members).astype("<i4")]
        head = np.array([trees], "<i4").tobytes() + packed[2].tobytes()
        values = [packed[0].tobytes(), packed[1].tobytes(), head + packed[3].tobytes(), packed[4].tobytes(), packed[5].tobytes(), packed[6].tobytes()]
        return pa.table([pa.array([name]), *[pa.array([v], pa.binary()) for v in values]], names=["image_id", "ids", "vectors", "nodes", "cuts", "leaves", "members"])

    wide = database.select("image_id", F.col("global_idx").cast("long"), F.col("d").cast("array<float>" if kind == "<f4" else "array<double>").alias("d"))
    return wide.groupBy("image_id").applyInArrow(plant, FOREST)


class _Image:
    """A row of FOREST as arrays. A child c < 0 is leaf -1 - c; nodes and leaves are numbered through all trees, and `begin` is a node's first leaf."""

    def __init__(self, row: dict, dim: int):
        self.name, self.ids = row["image_id"], np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], f"<f{len(row['vectors']) // max(1, len(self.ids) * dim)}").reshape(len(self.ids), -1)
        numbers = np.frombuffer(row["nodes"], "<i4")
        self.first = numbers[1 : 1 + 2 * numbers[0]].reshape(-1, 2)
        self.nodes, self.cuts = numbers[1 + 2 * numbers[0] :].reshape(-1, 3), np.frombuffer(row["cuts"], "<f8")
        self.sizes, self.members = np.frombuffer(row["leaves"], "<i4").astype(np.int64), np.frombuffer(row["members"], "<i4")
        n_nodes, n_leaves = self.first[:, 0], self.first[:, 1]
        node, leaf = np.cumsum(n_nodes) - n_nodes, np.cumsum(n_leaves) - n_leaves
        self.roots = np.where(n_nodes > 0, node, -1 - leaf)
        child = self.nodes[:, 1:]
        self.children = np.where(child < 0, child - np.repeat(leaf, n_nodes)[:, None], child + np.repeat(node, n_nodes)[:, None])
        low = self.children[:, 0]
        ends = np.flatnonzero(low < 0)  # a child below the cut that is no leaf stands right behind its parent
        self.begin = -1 - low[ends[np.searchsorted(ends, np.arange(len(low)))]] if len(ends) else low


def _visited_of_all(q: np.ndarray, image: _Image, checks: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, leaf) of the first `checks` leaves by bound and number at least, in this order for each query, from the bounds of all leaves."""
    each, at = [], 0
    for n_nodes, n_leaves in image.first:
        each.append(bounds(q, image.nodes[at : at + n_nodes], image.cuts[at : at + n_nodes], n_leaves))
        at += n_nodes
    queue = np.concatenate(each, axis=1)
    most = min(checks, queue.shape[1])  # a leaf holds a member at least, so no more leaves are visited
    i, leaf = np.nonzero(queue <= np.partition(queue, most - 1, axis=1)[:, most - 1 : most])
    order = np.lexsort((leaf, queue[i, leaf], i))
    return i[order], leaf[order]


def _visited(q: np.ndarray, image: _Image, checks: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The same leaves as far as `checks` members are met, best bin first.

    A query keeps the subtrees beside its paths, by (bound, first leaf), in `room` places; when these are full, the `checks` first ones stay, as each of them has a leaf to visit.
    From equal bounds the way leads to the child below the cut, so that leaves come in order of bound and number.
    """
    none, some = np.iinfo(np.int64).max, np.arange(len(q))
    bound, begin, child = np.full((len(q), room), np.inf), np.full((len(q), room), none), np.zeros((len(q), room), np.int64)
    trees = len(image.roots)
    bound[:, :trees], child[:, :trees] = 0, image.roots
    begin[:, :trees] = [-1 - c if c < 0 else image.begin[c] for c in image.roots]
    used, met = np.full(len(q), trees), np.zeros(len(q), np.int64)
    rows, leaves = [], []
    while len(some):
        least = np.where(begin[some] < none, bound[some], np.inf).min(1)
        place = np.where(bound[some] == least[:, None], begin[some], none).argmin(1)
        at = child[some, place]
        begin[some, place], bound[some, place] = none, np.inf
        way = np.flatnonzero(at >= 0)
        while len(way):
            node, row, own = at[way], some[way], least[way]
            if used[row].max() >= room:
                order = np.lexsort((begin, bound), axis=1)[:, : min(checks, room - 1)]
                for kept, empty in ((bound, np.inf), (begin, none), (child, 0)):
                    first = np.take_along_axis(kept, order, 1)
                    kept[:] = empty
                    kept[:, : order.shape[1]] = first
                used = (begin < none).sum(1)
            off = q[row, image.nodes[node, 0]] - image.cuts[node]
            far = own + np.where(off == off, off * off, 0)
            below = (off < 0) | (far == own)
            low, high = image.children[node, 0], image.children[node, 1]
            other = np.where(below, high, low)
            slot = used[row]
            bound[row, slot], child[row, slot] = far, other
            begin[row, slot] = np.where(other < 0, -1 - other, image.begin[np.maximum(other, 0)])
            used[row] += 1
            at[way] = np.where(below, low, high)
            way = way[at[way] >= 0]
        rows.append(some)
        leaves.append(-1 - at)
        met[some] += image.sizes[-1 - at]
        some = some[(met[some] < checks) & (begin[some] < none).any(1)]
    i, leaf = np.concatenate(rows), np.concatenate(leaves)
    order = np.argsort(i, kind="stable")
    return i[order], leaf[order]


def _search(q: np.ndarray, image: _Image, k: int, checks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, global index, squared distance) of the k nearest of the members that the queries visit."""
    ids, x, sizes = image.ids, image.x, image.sizes
    if checks >= sizes.sum():  # every leaf is visited
        return _top(q, x.astype(np.float64, copy=False), ids, k)
    few = len(sizes) <= DENSE * checks
    room = 4 * checks + 256 + len(image.roots)
    step = max(1, CELLS // (len(sizes) if few else room))
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0))]
    for at in range(0, len(q), step):
        part = q[at : at + step]
        i, leaf = _visited_of_all(part, image, checks) if few else _visited(part, image, checks, room)
        met = np.cumsum(sizes[leaf]) - sizes[leaf]
        near = met - met[np.searchsorted(i, i)] < checks
        i, leaf = i[near], leaf[near]
        i, begin, n = np.repeat(i, sizes[leaf]), np.cumsum(sizes) - sizes, sizes[leaf]
        j = image.members[np.repeat(begin[leaf] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs = np.unique(i * len(ids) + j)
        i, j = pairs // len(ids), pairs % len(ids)
        dist = _exact(part, x, i, j)
        keep = _first(i, dist, ids[j], k)
        out.append((i[keep] + at, ids[j[keep]], dist[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_in_images(queries: DataFrame, forests: DataFrame, k: int, checks: int = CHECKS) -> DataFrame:
    """Approximate: (qid, image_id, global_idx, d2, rank) of the k nearest in each image of the forests for each of queries(qid, d)."""
    spark, path = queries.sparkSession, scratch(queries.sparkSession, "forest")
    forests.write.parquet(path)
    forests = spark.read.schema(forests.schema).parquet(path)
    size = forests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)).alias("rows")).first()
    n_db = max(1, -(-size["n"] // IMAGES))
    part = F.xxhash64("image_id") if size["rows"] > size["n"] * LARGE else F.pmod(F.xxhash64("image_id"), F.lit(n_db))
    forests = forests.withColumn("part", part)
    parts = size["n"] if size["rows"] > size["n"] * LARGE else n_db
    asking = -(-queries.count() // (QUERIES * BLOCKS))
    n_q = max(1, -(-asking // MORE), min(asking, -(-TASKS // max(1, parts))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in np.unique(batch["share"].to_numpy()):
                own = batch.filter(pc.equal(batch["share"], pa.scalar(int(share), pa.int64())))
                for at in range(0, len(own), QUERIES):
                    part = own.slice(at, QUERIES)
                    x = part["d"].flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    yield pa.record_batch([pa.array([int(share)], pa.int64()), pa.array([part["qid"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["share", "qids", "q"])

    def search(blocks: pa.Table, images: pa.Table) -> pa.Table:
        out, asked = [], []
        for block in blocks.select(["qids", "q"]).to_pylist() if images.num_rows else []:
            qid = np.frombuffer(block["qids"], "<i8")
            asked.append((qid, np.frombuffer(block["q"], "<f8").reshape(len(qid), -1)))
        for at in range(images.num_rows if asked else 0):
            image = _Image(images.slice(at, 1).to_pylist()[0], asked[0][1].shape[1])
            for qid, x in asked:
                i, idx, d2 = _search(x, image, k, checks)
                out.append(pa.table([pa.array(qid[i], pa.int64()), pa.array([image.name] * len(i), pa.string()), pa.array(idx, pa.int64()), pa.array(d2, pa.float64())], names=["qid", "image_id", "global_idx", "d2"]))
        return pa.concat_tables(out) if out else pa.table({"qid": pa.array([], pa.int64()), "image_id": pa.array([], pa.string()), "global_idx": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})

    wide = queries.select(F.col("qid").cast("long"), F.col("d").cast("array<double>").alias("d"), F.pmod(F.xxhash64("qid"), F.lit(n_q)).alias("share"))
    blocks = wide.repartition(n_q, "share").mapInArrow(pack, "share long, qids binary, q binary")
    asked = blocks.join(F.broadcast(forests.select(F.col("part").alias("at")).distinct()))
    shares = forests.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    found = asked.groupBy("at", "share").cogroup(shares.groupBy("part", "share")).applyInArrow(search, _FOUND)
    own = W.Window.partitionBy("qid", "image_id").orderBy("d2", "global_idx")
    return found.withColumn("rank", F.row_number().over(own))
