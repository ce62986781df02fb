"""A stored index of product codes in cells: it is trained once, grows by batches, and is searched by joins on buckets.

train() fits k-means cells on a sample (operators.knn.cells) and, for each of `subspaces` parts of a vector, 256 code words of the
residuals to the cell's center, a Spark task per part. A descriptor is then a cell and `subspaces` bytes. The folder of an index holds

    centers     cell, center, and the cell's share of the training sample
    codebooks   part, code, and the code word
    codes       blocks of at most BLOCK_ROWS descriptors of one (cell, share): ids, codes, batch; bucketed and sorted by (cell, share)
    vectors     global_idx, image_id, local_idx, d, batch; bucketed by global_idx
    images      image_id, offset, n_desc, batch
    batches     batch, n: written last, and only rows of batches that stand here count, so that a batch that died halfway is nothing

add() codes new images with the stored cells and code words; written files stay as they are, and images known already are left out. Their
ids follow all earlier ones.

search() packs the queries of a task by the cells that they probe. These blocks meet the blocks of codes by an equi-join on (cell, share):
only queries are shuffled, as the codes lie in buckets; from TURN_QUERIES queries on they come in turns, and a copy of the codes goes to each turn. A pair
of blocks takes a matrix product of the queries' and the codes' residuals, and keeps k * refine candidates a query. The best of these over all cells are measured again on the whole vectors, a
join on their buckets, and ranked by (distance, index). A cell expected to hold more than SHARE_ROWS rows is dealt over shares, so that a
cell that holds a large part of the database is many tasks' work; no task holds more than a pair of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from markwise.functions.vectors import squared_l2

from .knn import BROADCAST_BYTES, CELLS, _bound, _first, _top, cells
from .matching import offsets

CODES = 256
#: Vectors that the code words are fitted on: as many a code word as code words.
TRAINING_ROWS = CODES * CODES
BLOCK_ROWS = 16_384
SHARE_ROWS = 262_144
#: Queries that a task packs together.
PACKED = 16_384
#: Queries beyond which a search is cut into turns, and how many queries a turn has.
TURN_QUERIES = 32_768
#: Bytes of codes or vectors that a bucket should hold.
BUCKET_BYTES = 64 << 20

_CODES = "cell int, share int, batch string, n int, ids binary, codes binary"
_VECTORS = "global_idx long, image_id string, local_idx long, d array<float>, batch string"
_FOUND = "qid long, global_idx long, rough float"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centers of the points, fewer if there are fewer distinct ones; a center without points moves to the point worst off."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centers = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near, far = _closest(points, centers)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, points[:, j], k) for j in range(points.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
        empty = np.flatnonzero(n == 0)
        centers[empty] = points[np.argsort(-far, kind="stable")[: len(empty)]]
    return centers


def _closest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each point, and how far it is, squared."""
    square, near, far = (centers * centers).sum(1), np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, CELLS // len(centers))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        dist = square - 2 * part @ centers.T
        near[at : at + step] = dist.argmin(1)
        far[at : at + step] = np.maximum(dist.min(1) + (part * part).sum(1), 0)
    return near, far


@dataclass(frozen=True)
class Model:
    """Centers (cells x numbers), code words (parts x codes x numbers) and each cell's share of the training sample."""

    centers: np.ndarray
    books: np.ndarray
    fraction: np.ndarray

    @property
    def code_bytes(self) -> int:
        return len(self.books)

    def shares(self, rows: int) -> np.ndarray:
        """Into how many shares each cell of an index of so many rows is dealt."""
        return np.maximum(1, np.ceil(self.fraction * rows / SHARE_ROWS)).astype(np.int64)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        return _closest(vectors, self.centers)[0]

    def encode(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (vectors - self.centers[cell]).reshape(len(vectors), len(self.books), -1)
        return np.stack([_closest(rest[:, s], book)[0] for s, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def rough(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances (queries x codes) of a cell's codes, looked up."""
        rest, words = self.rests(queries, cell), self.words(codes)
        return self.apart(rest, words, (words * words).sum(1))

    def rests(self, queries: np.ndarray, cell: int) -> np.ndarray:
        return queries.astype(np.float64) - self.centers[cell]

    def words(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1).astype(np.float64)

    def apart(self, rests: np.ndarray, words: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Squared distances, by a matrix product; rounded, so that equal codes are equally far."""
        out = (-2 * rests) @ words.T
        out += square
        out += (rests * rests).sum(1)[:, None]
        return out.astype(np.float32)


def train(database: DataFrame, subspaces: int = 16, n_cells: int | None = None, sample: int = 1_500_000, seed: int = 1) -> Model:
    """Cells and code words of database(global_idx, d)."""
    size = database.agg(F.count("*").alias("n"), F.min(F.size("d")).alias("a"), F.max(F.size("d")).alias("b")).first()
    if not size["n"] or size["a"] != size["b"] or size["a"] % subspaces:
        raise ValueError(f"codes of {subspaces} parts need descriptors of one length that {subspaces} divides, not {size['n']} of {size['a']} to {size['b']} numbers")
    found = cells(database, n_cells, sample, seed)
    centers = np.stack(found.clusterCenters()).astype(np.float32)
    if centers.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{len(centers)} cells are more than a broadcast of {BROADCAST_BYTES} bytes holds: fit fewer")
    sizes = np.array(found.summary.clusterSizes, np.float64)
    shared = database.sparkSession.sparkContext.broadcast(centers)
    part = min(1.0, TRAINING_ROWS / size["n"])
    some = database.where(F.pmod(F.xxhash64("global_idx"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else database
    width = size["a"] // subspaces

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["d"])
            rest = (x - shared.value[_closest(x, shared.value)[0]]).reshape(-1, width)
            parts = pa.array(np.tile(np.arange(subspaces, dtype=np.int32), len(x)))
            offsets = pa.array(np.arange(0, rest.size + 1, width, dtype=np.int32))
            yield pa.record_batch([parts, pa.ListArray.from_arrays(offsets, pa.array(rest.ravel()))], names=["part", "v"])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        points = _matrix(rows["v"])
        points = points[np.lexsort(points.T)]
        words = lloyd(points, CODES, seed=seed).astype(np.float32)
        return pa.table({"part": pa.array([key[0].as_py()] * len(words), pa.int32()), "code": pa.array(range(len(words)), pa.int32()), "word": pa.array(list(words), pa.list_(pa.float32()))})

    rows = some.select("d").mapInArrow(rests, "part int, v array<float>").groupBy("part").applyInArrow(fit, "part int, code int, word array<float>").collect()  # 256 rows a part
    return Model(centers, _books([(r["part"], r["code"], r["word"]) for r in rows], subspaces, width), sizes / sizes.sum())


def _books(rows: list[tuple[int, int, list[float]]], subspaces: int, width: int) -> np.ndarray:
    """Parts with fewer code words than others are filled up with words that nothing is nearest to."""
    out = np.full((subspaces, 1 + max(code for _, code, _ in rows), width), 1e9, np.float32)
    for part, code, word in rows:
        out[part, code] = word
    return out


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Opens what is there; create() makes a new one."""
        self.spark, self.path = spark, path.rstrip("/")
        centers = spark.read.parquet(f"{self.path}/centers").orderBy("cell").collect()  # 4 sqrt(N) rows
        books = spark.read.parquet(f"{self.path}/codebooks").collect()
        words = [(r["part"], r["code"], r["word"]) for r in books]
        self.model = Model(np.array([r["center"] for r in centers], np.float32), _books(words, 1 + max(w[0] for w in words), len(words[0][2])), np.array([r["fraction"] for r in centers]))
        self.buckets = centers[0]["buckets"]
        self.name = f"pq_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        for table, columns, by in (("codes", _CODES, "cell, share"), ("vectors", _VECTORS, "global_idx")):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'"
            )

    @classmethod
    def create(cls, database: DataFrame, path: str, buckets: int | None = None, **training) -> Index:
        """Trains on database(global_idx, d) and leaves an index without rows."""
        model = train(database, **training)
        spark, n = database.sparkSession, database.count()
        buckets = buckets or max(8, -(-n * 4 * model.centers.shape[1] // BUCKET_BYTES))
        cell_rows = [(i, c.tolist(), float(f), buckets) for i, (c, f) in enumerate(zip(model.centers, model.fraction, strict=True))]
        words = [(s, c, w.tolist()) for s, book in enumerate(model.books) for c, w in enumerate(book)]
        name = f"pq_{uuid.uuid5(uuid.NAMESPACE_URL, path.rstrip('/')).hex}"
        for table in ("codes", "vectors"):  # no file but those of buckets may lie in these folders
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{table}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        for table, rows, columns in (
            ("codebooks", words, "part int, code int, word array<float>"),
            ("images", [], "image_id string, offset long, n_desc long, batch string"),
            ("batches", [], "batch string, n long"),
            ("centers", cell_rows, "cell int, center array<float>, fraction double, buckets int"),
        ):
            spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{table}")
        return cls(spark, path)

    def _whole(self, df: DataFrame) -> DataFrame:
        """The rows of batches that were written to their end."""
        return df.where(F.col("batch").isin([r["batch"] for r in self.spark.read.parquet(f"{self.path}/batches").select("batch").collect()]))  # a row per add()

    def rows(self) -> int:
        return self.spark.read.parquet(f"{self.path}/batches").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def images(self) -> DataFrame:
        return self._whole(self.spark.read.parquet(f"{self.path}/images"))

    def vectors(self) -> DataFrame:
        return self._whole(self.spark.table(f"{self.name}_vectors"))

    def codes(self) -> DataFrame:
        return self._whole(self.spark.table(f"{self.name}_codes"))

    def bytes_per_descriptor(self) -> float:
        """Of ids and codes; whole vectors lie apart, and only candidates' are read."""
        return self.codes().agg(F.sum(F.octet_length("ids") + F.octet_length("codes")) / F.sum("n")).first()[0]

    def add(self, descriptors: DataFrame) -> int:
        """Adds the images of descriptors(image_id, local_idx, d) that the index hasn't; returns how many rows that were."""
        known = self.images()
        new = descriptors.join(known.select("image_id"), "image_id", "left_anti")
        batch, before = uuid.uuid4().hex, self.rows()
        places = offsets(new).select("image_id", (F.col("offset") + before).alias("offset"), "n_desc", F.lit(batch).alias("batch"))
        places.write.mode("append").parquet(f"{self.path}/images")
        places = self.spark.read.parquet(f"{self.path}/images").where(F.col("batch") == batch)
        n = places.agg(F.coalesce(F.sum("n_desc"), F.lit(0)).alias("n")).first()["n"]
        if not n:
            return 0
        placed = new.join(places.select("image_id", "offset"), "image_id").select((F.col("offset") + F.col("local_idx")).alias("global_idx"), "image_id", F.col("local_idx").cast("long"), F.col("d").cast("array<float>").alias("d"), F.lit(batch).alias("batch"))
        placed.repartition(self.buckets, "global_idx").sortWithinPartitions("global_idx").write.insertInto(f"{self.name}_vectors")
        own = self.spark.table(f"{self.name}_vectors").where(F.col("batch") == batch)
        model, shares = self.model, self.model.shares(before + n)
        shared = self.spark.sparkContext.broadcast((model, shares))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, shares = shared.value
            for part in batches:
                x, ids = _matrix(part["d"]), part["global_idx"].to_numpy()
                cell = model.cell(x)
                rows = [c.tobytes() for c in model.encode(x, cell)]
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array((ids % shares[cell]).astype(np.int32)), pa.array(ids), pa.array(rows, pa.binary())], names=["cell", "share", "global_idx", "code"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks of rows in order of (cell, share)."""
            for key, ids, codes in _groups(batches):
                for at in range(0, len(ids), BLOCK_ROWS):
                    some = slice(at, at + BLOCK_ROWS)
                    yield pa.record_batch(
                        [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([batch]), pa.array([len(ids[some])], pa.int32()), pa.array([np.array(ids[some], "<i8").tobytes()], pa.binary()), pa.array([b"".join(codes[some])], pa.binary())],
                        names=["cell", "share", "batch", "n", "ids", "codes"],
                    )

        coded = own.select("global_idx", "d").mapInArrow(code, "cell int, share int, global_idx long, code binary")
        sorted_ = coded.repartition(self.buckets, "cell", "share").sortWithinPartitions("cell", "share", "global_idx")
        sorted_.mapInArrow(pack, _CODES).write.insertInto(f"{self.name}_codes")
        self.spark.createDataFrame([(batch, n)], "batch string, n long").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return n

    def search(self, queries: DataFrame, k: int, probes: int = 16, refine: int = 8) -> DataFrame:
        """Approximate: (qid, global_idx, image_id, local_idx, d2, rank) of the k nearest for each of queries(qid, d), measured on whole vectors."""
        wanted, model = k * refine, self.model
        shared = self.spark.sparkContext.broadcast((model, model.shares(self.rows())))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for part in batches:
                held.append(part)
                n += len(part)
                if n >= PACKED:
                    yield asked(held)
                    held, n = [], 0
            if n:
                yield asked(held)

        def asked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            model, shares = shared.value
            table = pa.Table.from_batches(parts)
            x, qid = _matrix(table["d"]), table["qid"].to_numpy()
            centers = model.centers.astype(np.float64)
            row, cell, _ = _top(x.astype(np.float64), centers, np.arange(len(centers)), min(probes, len(centers)))
            order = np.argsort(cell, kind="stable")
            row, cell = row[order], cell[order]
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            rows = [(int(cell[a]), share, qid[row[a:b]].astype("<i8").tobytes(), x[row[a:b]].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True) for share in range(shares[cell[a]])]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cell", "share", "qids", "q"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, _ = shared.value
            for part in batches:
                for cell, qids, q, ids, codes in zip(*(part[c].to_pylist() for c in ("cell", "qids", "q", "ids", "codes")), strict=True):
                    qid, idx = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                    x, c = np.frombuffer(q, np.float32).reshape(len(qid), -1), np.frombuffer(codes, np.uint8).reshape(len(idx), -1)
                    step = max(1, min(256, CELLS // len(idx)))
                    words = model.words(c)
                    square = (words * words).sum(1)
                    for at in range(0, len(qid), step):
                        rough = model.apart(model.rests(x[at : at + step], cell), words, square)
                        i, j = np.nonzero(rough <= _bound(rough, min(wanted, len(idx)))[:, None])
                        keep = _first(i, rough[i, j], idx[j], wanted)
                        i, j = i[keep], j[keep]
                        yield pa.record_batch([pa.array(qid[at + i]), pa.array(idx[j]), pa.array(rough[i, j])], names=["qid", "global_idx", "rough"])

        q = queries.select(F.col("qid").cast("long"), F.col("d").cast("array<float>").alias("d"))
        if wanted >= self.rows():
            return self._measured_cells(q.mapInArrow(ask, "cell int, share int, qids binary, q binary"), k)
        asked_, codes = q.mapInArrow(ask, "cell int, share int, qids binary, q binary"), self.codes()
        turns = -(-q.count() // TURN_QUERIES)
        if turns > 1:  # many queries: each turn of them meets a copy of the codes, by cell, so that tasks grow in number and not in length
            by, tasks = ("cell", "share", "turn"), turns * len(model.centers)
            asked_ = asked_.withColumn("turn", F.pmod(F.xxhash64("qids"), F.lit(turns))).repartition(tasks, *by)
            codes = codes.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long")))).repartition(tasks, *by)
            blocks = asked_.join(codes.hint("merge"), list(by))
        else:
            blocks = asked_.join(codes.hint("merge"), ["cell", "share"])
        found = blocks.select("cell", "qids", "q", "ids", "codes").mapInArrow(look, _FOUND)
        best = W.Window.partitionBy("qid").orderBy("rough", "global_idx")
        short = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= wanted).select("qid", "global_idx")
        named = short.join(queries.select(F.col("qid").cast("long"), F.col("d").alias("_q")), "qid")
        measured = named.join(self.vectors().hint("merge"), "global_idx").select("qid", "global_idx", "image_id", "local_idx", squared_l2("_q", "d").alias("d2"))
        own = W.Window.partitionBy("qid").orderBy("d2", "global_idx")
        return measured.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


    def _measured_cells(self, asked: DataFrame, k: int) -> DataFrame:
        """search() where every member of a probed cell is a candidate: codes can leave none out, so a cell's queries and whole vectors meet in blocks.

        Only the k first of a pair of blocks leave it, instead of a row with two vectors for each candidate.
        """

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for cell, share, ids in zip(*(part[c].to_pylist() for c in ("cell", "share", "ids")), strict=True):
                    idx = np.frombuffer(ids, "<i8")
                    yield pa.record_batch([pa.array(np.full(len(idx), cell, np.int32)), pa.array(np.full(len(idx), share, np.int32)), pa.array(idx)], names=["cell", "share", "global_idx"])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if right.num_rows:
                d, ids = _matrix(right["d"]).astype(np.float64), right["global_idx"].to_numpy()
                for qids, q in zip(left["qids"].to_pylist(), left["q"].to_pylist(), strict=True):
                    qid = np.frombuffer(qids, "<i8")
                    i, idx, d2 = _top(np.frombuffer(q, np.float32).reshape(len(qid), -1).astype(np.float64), d, ids, k)
                    out.append((qid[i], idx, d2))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qid", "global_idx", "d2"])

        members = self.codes().select("cell", "share", "ids").mapInArrow(spread, "cell int, share int, global_idx long").join(self.vectors().select("global_idx", "d"), "global_idx")
        turns = F.lit(max(1, -(-self.rows() // (len(self.model.centers) * BLOCK_ROWS))))
        dealt = members.select(F.col("cell").alias("c"), F.col("share").alias("s"), F.pmod(F.xxhash64("global_idx"), turns).alias("turn"), "global_idx", "d")
        asked = asked.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns.cast("long") - 1)))
        found = asked.groupBy("cell", "share", "turn").cogroup(dealt.groupBy("c", "s", "turn")).applyInArrow(meet, "qid long, global_idx long, d2 double")
        own = W.Window.partitionBy("qid").orderBy("d2", "global_idx")
        first = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        return first.join(self.vectors().select("global_idx", "image_id", "local_idx"), "global_idx").select("qid", "global_idx", "image_id", "local_idx", "d2", "rank")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[int], list[bytes]]]:
    """Rows (cell, share, global_idx, code) in order of (cell, share), at most some blocks of one key at a time."""
    key, ids, codes = None, [], []
    for batch in batches:
        cell, share = batch["cell"].to_numpy(), batch["share"].to_numpy()
        idx, code = batch["global_idx"].to_pylist(), batch["code"].to_pylist()
        cuts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
            own = (int(cell[a]), int(share[a]))
            if own != key or len(ids) >= BLOCK_ROWS:
                if ids:
                    yield key, ids, codes
                key, ids, codes = own, [], []
            ids.extend(idx[a:b])
            codes.extend(code[a:b])
    if ids:
        yield key, ids, codes
