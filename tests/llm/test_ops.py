"""Each operator against a brute-force version or round trip, and on nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from markwise.llm import lines, matroska, mixing, neardup, pii, quality, sentencepiece, substrings, tokens, toxicity
from markwise.llm import queries as library
from markwise.llm.queries import END_ID, PIECE_BPE, WORD_BPE, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources or ["s"] * len(texts), strict=True)], SCHEMA).repartition(3)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " \n\t ", "one", "a b", "a b\n\nA B\n", "x" * 3000, "Ünïcödé  漢字 🙂 \x1c tail", "long " * 4000, "a b", "a b"]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", list(library.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    theirs = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    ours = entry.queries()[name](spark, sf).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in ours) == sorted(map(repr, theirs.fetchall()))


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 14)])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    query = next(f for n, f in entry.queries().items() if n.startswith(f"{name}_"))
    assert query(spark, str(tmp_path)).count() == 0


# Toxicity


def test_toxicity_learns_pairs(spark):
    """Neither word alone tells the label, both together do."""
    r = random.Random(1)
    rows = []
    for i in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        text = words(12, i) + ["insult"] * a + ["group"] * b
        r.shuffle(text)
        rows.append((i, " ".join(text), int(a and b)))
    d = docs(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(d, labels))
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got)
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.95


def test_scores_are_explicit_pair_sums():
    """Bias, linear weights and each pair's product of factors, one by one."""
    r = np.random.default_rng(3)
    kept = np.sort(r.choice(toxicity.BUCKETS, 50, replace=False))
    fm = toxicity.FactorizationMachine(kept, 0.3, r.normal(size=50), r.normal(size=(50, toxicity.FACTORS)))
    texts = [sorted(r.choice(50, n, replace=False).tolist()) for n in (0, 1, 2, 7, 20)]
    rows = np.array([i for i, x in enumerate(texts) for _ in x])
    got = fm.score(rows, np.array([t for x in texts for t in x]), len(texts))
    for i, x in enumerate(texts):
        z = 0.3 + sum(fm.linear[t] for t in x) + sum(float(fm.factors[a] @ fm.factors[b]) for k, a in enumerate(x) for b in x[:k])
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    d = docs(spark, [" ".join(words(50, i)) for i in range(60)] * 2, [*range(60)] * 2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert len(toxicity.train(d, labels).kept) >= 0
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    assert len(toxicity.train(d, labels).kept) == 0


def test_toxicity_on_odd_rows(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(d, none).collect()} == {1 / (1 + math.exp(30))}
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (99, 1), (4, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(d, labels))
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].score == got[1].score and got[4].score == got[9].score == got[10].score


def test_term_blocks_don_t_change_terms(monkeypatch):
    text = " ".join(words(5000, 3)).encode()
    whole = set(zip(*toxicity.term_buckets([b"a", text, b""]), strict=True))
    monkeypatch.setattr(toxicity, "_BLOCK", 1000)
    assert set(zip(*toxicity.term_buckets([b"a", text, b""]), strict=True)) == whole


# Mixing


def test_mixing_rates(spark):
    sources = ["hot"] * 3000 + ["b"] * 300 + [None] * 60
    d = docs(spark, [f"t{i}" for i in range(3360)], sources=sources)
    got = Counter(r.source for r in mixing.mix(d).collect())
    assert all(abs(got[s] - 1120) < 5 * 1120**0.5 * 4.5 for s in ("hot", "b", None))
    weights = spark.createDataFrame([("hot", 3.0), ("b", 1.0), ("none", 5.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix(d, weights, 4000).collect())
    assert abs(got["hot"] - 3000) < 300 and abs(got["b"] - 1000) < 300 and None not in got
    a, b = (sorted((r.doc_id, r.copy, r.mix_key) for r in mixing.mix(d, broadcast_sources=n).collect()) for n in (10, 0))
    assert a != [] and {x for x in a} >= {x for x in b if x[0] < 3300}


def test_poisson_counts(spark):
    """Counts follow the distribution; a rate above PART is drawn in parts."""
    d = docs(spark, [f"t{i}" for i in range(400)])
    n = [r.n for r in mixing.mix(d, budget=400 * 3.0).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()]
    assert abs(sum(n) / 400 - 3) < 0.4 and abs(np.var(n + [0] * (400 - len(n))) - 3) < 1
    one = docs(spark, ["t"])
    assert abs(mixing.mix(one, budget=1200.0).count() - 1200) < 200


def test_copies_of_a_hot_row(spark):
    """A rate of many parts: the copies come in parts, each with a number of its own."""
    d = docs(spark, ["t", "u"], sources=["a", "b"])
    rows = mixing.mix(d, budget=40_000.0).collect()
    per = Counter(r.text for r in rows)
    assert all(abs(n - 20_000) < 1000 for n in per.values()) and {(r.text, r.n_copies) for r in rows} == set(per.items())
    assert len({(r.text, r.copy) for r in rows}) == len(rows)


def test_mixing_with_clashing_columns(spark):
    d = docs(spark, [f"t{i}" for i in range(50)], sources=["a"] * 30 + ["b"] * 20)
    extra = ("_id", "_source", "_parts", "_cdf", "_n", "_share", "copy", "_weight")
    more = d
    for n in extra:
        more = more.withColumn(n, F.lit("x"))
    for size in (10, 0):
        plain, wide = ([(r.doc_id, r.copy, r.mix_key) for r in mixing.mix(x, broadcast_sources=size).collect()] for x in (d, more))
        assert plain == wide
    assert {r._id for r in mixing.mix(more).collect()} == {"x"}


def test_mixing_odd_rows(spark):
    d = docs(spark, ["a", None, "a", "b"], [1, None, 1, None])
    rows = mixing.mix(d, budget=40.0).collect()
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    per = Counter((r.doc_id, r.text) for r in rows)
    assert all(r.n_copies * (2 if r.doc_id == 1 else 1) == per[r.doc_id, r.text] for r in rows)


# Matroska


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1024, 6 * 1024, 6 * 1024 + 64, 25 * 1024 + 192, 300_000])
def test_matroska_roundtrip(size):
    payload = matroska.padded(random.Random(size).randbytes(size))
    data = matroska.mux(payload)
    m = matroska.demux(data)
    assert b"".join(data[p.start : p.start + p.size] for p in m.packets) == payload
    assert m.doc_type == "matroska" and m.tracks[1]["bits"] == 8 and m.duration == len(payload)
    assert [c for _, _, c in m.cues] == m.clusters
    assert [p.timestamp for p in m.packets] == np.cumsum([0, *(p.size for p in m.packets)])[:-1].tolist()


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_each_lacing_is_read(lacing):
    frames = [bytes([i]) * n for i, n in enumerate((300, 300, 300) if lacing == 2 else (300, 700, 5, 255, 90))]
    if lacing == 3:
        sizes = [len(f) for f in frames]
        flags, head = 0x06, bytes([len(frames) - 1]) + matroska._vint(sizes[0]) + b"".join(matroska._signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    else:
        flags, head = matroska._lace(frames, True)
    block = b"\x81\x00\x00" + bytes([flags]) + head + b"".join(frames)
    body = matroska._element(matroska.CLUSTER, matroska._uint(matroska.CLUSTER_TIMESTAMP, 7) + matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, block)))
    data = matroska._id(matroska.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body  # of unknown size
    m = matroska.demux(data)
    assert [data[p.start : p.start + p.size] for p in m.packets] == frames and {p.lacing for p in m.packets} == {lacing} and m.packets[0].timestamp == 7


def test_clusters_of_unknown_size():
    """As live streams write them: a cluster ends where the next one, or another element of the segment, begins."""
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = lambda t, x: matroska._id(matroska.CLUSTER) + unknown + matroska._uint(matroska.CLUSTER_TIMESTAMP, t) + matroska._element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + x)
    data = matroska._id(matroska.SEGMENT) + unknown + cluster(0, b"ab") + cluster(9, b"cde") + matroska._element(matroska.TAGS, b"") + cluster(20, b"f")
    m = matroska.demux(data)
    assert [(data[p.start : p.start + p.size], p.timestamp, p.cluster) for p in m.packets] == [(b"ab", 0, 0), (b"cde", 9, 1), (b"f", 20, 2)]


def test_blocks_are_numbered_through_the_file():
    per_cluster = matroska.LACED * matroska.BLOCKS
    packets = matroska.demux(matroska.mux(bytes(matroska.FRAME * (2 * per_cluster + 1)))).packets
    assert [(p.cluster, p.block) for p in packets] == [(i // per_cluster, i // matroska.LACED) for i in range(2 * per_cluster + 1)]


def test_durations():
    """A track's default, a block's own, and what samples of another width last."""
    frames = [b"abcd", b"efgh"]
    flags, head = matroska._lace(frames, True)
    block = b"\x81\x00\x00" + bytes([flags]) + head + b"".join(frames)
    audio = matroska._element(matroska.AUDIO, matroska._element(matroska.SAMPLING, matroska.struct.pack(">d", 1000.0)) + matroska._uint(matroska.CHANNELS, 2) + matroska._uint(matroska.BIT_DEPTH, 16))

    def read(track, more=b""):
        entry = matroska._uint(matroska.TRACK_NUMBER, 1) + matroska._uint(matroska.TRACK_TYPE, 2) + matroska._element(matroska.CODEC_ID, b"A_PCM/INT/LIT") + track
        group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, block) + more)
        body = matroska._element(matroska.TRACKS, matroska._element(matroska.TRACK_ENTRY, entry)) + matroska._element(matroska.CLUSTER, matroska._uint(matroska.CLUSTER_TIMESTAMP, 5) + group)
        return [(p.timestamp, p.duration_ns) for p in matroska.demux(matroska._element(matroska.SEGMENT, body)).packets]

    assert read(audio) == [(5, 1_000_000), (6, 1_000_000)]
    assert read(audio + matroska._uint(matroska.DEFAULT_DURATION, 20_000_000)) == [(5, 20_000_000), (25, 20_000_000)]
    assert read(b"", matroska._uint(matroska.BLOCK_DURATION, 60)) == [(5, 30_000_000), (35, 30_000_000)]
    assert read(b"") == [(5, 0), (5, 0)]


def test_damaged_matroska():
    with pytest.raises(ValueError):
        matroska.demux(matroska.mux(bytes(64))[:-3])


def test_media_digests(spark):
    got = by_id(matroska.media_digests(docs(spark, ODD)))
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[4][1:] == got[9][1:]
    files = spark.createDataFrame([(1, bytearray(matroska.mux(bytes(4096)))), (2, None)], "doc_id long, content binary")
    assert matroska.packet_table(files).count() == 4


# Lines


def test_lines_all_ways(spark):
    texts = ["Common line \nmine %d\n common LINE\t" % i for i in range(12)] + ["nine times"] * 9 + [None, "", "\n\n"]
    d = docs(spark, texts)
    for size in (1 << 25, 0):
        got = by_id(lines.drop_lines(d, broadcast_bytes=size))
        assert [got[i].text for i in range(12)] == [f"mine {i}" for i in range(12)] and got[0].n_dropped == 2 and got[0].n_lines == 3
        assert got[12].text == "nine times" and got[21].text is None and got[21].n_lines == 1 and got[23].text == "\n\n"
        first = by_id(lines.drop_lines(d, keep_first=True, broadcast_bytes=size))
        assert first[0].text.startswith("Common line") and first[0].n_dropped == 1 and first[5].n_dropped == 2


def test_lines_many_shards(spark):
    r = random.Random(2)
    texts = ["\n".join(f"line {r.randrange(3000)}" for _ in range(40)) for _ in range(500)]
    seen = Counter(k for t in texts for k in set(t.split("\n")))
    d = docs(spark, texts)
    got = by_id(lines.drop_lines(d))
    assert all(got[i].text == "\n".join(x for x in t.split("\n") if seen[x] < 10) for i, t in enumerate(texts))


@pytest.mark.parametrize("size", [1 << 25, 0])
def test_only_suspected_repeats_shuffle(spark, monkeypatch, size):
    """Rows sent for exact counts, whether the filter is broadcast or asked: the repeated lines and the filter's few errors."""
    monkeypatch.setattr(lines, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lines, "SHARD_BITS", 1 << 12)
    texts = ["\n".join([f"once {i} {j}" for j in range(40)] + [f"twice {i // 2}", "everywhere"]) for i in range(200)]
    d = docs(spark, texts)
    shards = -(-200 * 42 * lines.BITS_PER_LINE // lines.SHARD_BITS)
    filters = lines.twice_seen(d, "text", shards).cache()
    found = lines.suspects(d, "text", "doc_id", filters, shards, size > 0).groupBy("digest").sum("n_docs").collect()
    counts = Counter(r[1] for r in found)
    assert counts[200] == 1 and counts[2] == 100 and set(counts) == {1, 2, 200} and counts[1] < 0.05 * 8000


def test_chunks_in_another_order_count_all(spark, monkeypatch):
    """Where a chunk's rows aren't those that asked, all its lines are counted."""
    texts = [f"common\nmine {i}" for i in range(12)]
    monkeypatch.setattr(lines, "_check", lambda hashes: random.randbytes(16))
    assert {r.n_dropped for r in lines.drop_lines(docs(spark, texts), broadcast_bytes=0).collect()} == {1}


def test_lines_with_clashing_columns(spark):
    d = docs(spark, [f"common\nmine {i}" for i in range(12)])
    extra = ("_cut", "_row", "_key", "_text", "_doc", "digest", "chunk", "rows", "n_lines", "first")
    for n in extra:
        d = d.withColumn(n, d.doc_id + 1)
    for size in (1 << 25, 0):
        for r in lines.drop_lines(d, broadcast_bytes=size).collect():
            assert r.text == f"mine {r.doc_id}" and r.n_lines == 2 and all(r[n] == r.doc_id + 1 for n in extra if n != "n_lines")


# Tokens


def test_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = vocabulary(WORD_BPE)
    t = Tokenizer.from_file(path)
    texts = ODD + ["It's <|endoftext|> HERE <|STARTOFTEXT|>!", "é.é, É, don't. 12,5% ...end’. x…, ä'll", "Σ. ΑΣ, ΑΣ"] + [" ".join(words(50, i)) + ", W1. W2!" for i in range(60)]
    table = tokens.write_tokens(docs(spark, texts), path, END_ID)
    got = by_id(table.read())
    start = 0
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids + [END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(want), want), x
        start += len(want)
    with pytest.raises(ValueError):
        tokens.TokenFile(bytes(table.files.first().file), b"another")


def test_encoder_forgets_what_it_must(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary(WORD_BPE)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "STEMS", 10)
    e, t = tokens.WordEncoder(path, END_ID), Tokenizer.from_file(path)
    texts = [" ".join(words(30, i)) for i in range(20)]
    assert e.by_words and [np.frombuffer(e.encode([x.encode()])[0], "<u2").tolist() for x in texts] == [t.encode(x, add_special_tokens=False).ids + [END_ID] for x in texts]
    assert len(e.memo.hashes) < 60


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    e, t = tokens.WordEncoder(path, 5), Tokenizer.from_file(path)
    texts = ["two  spaces\nand a line", "", "x"]
    assert not e.by_words and [np.frombuffer(x, "<u2").tolist() for x in e.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids + [5] for x in texts]


def test_files_of_several_partitions(spark, monkeypatch):
    """Rows of one key, and of none, are dealt over partitions; starts follow each other."""
    monkeypatch.setattr(tokens, "PARTITION_BYTES", 500)
    texts = [" ".join(words(30, i)) for i in range(40)]
    table = tokens.write_tokens(docs(spark, texts, [None] * 15 + [7] * 15 + list(range(10, 20))), vocabulary(WORD_BPE), END_ID)
    rows = sorted(table.read().collect(), key=lambda r: r.start)
    assert table.files.select("part").distinct().count() > 5
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist() and [r.doc_id for r in rows] == [None] * 15 + [7] * 15 + list(range(10, 20))


def test_null_keys_come_first(spark):
    d = docs(spark, ["b", "a", "c"], [5, None, 5])
    got = sorted((r.start, r.doc_id) for r in tokens.token_digests(d, vocabulary(WORD_BPE), END_ID).collect())
    assert [i for _, i in got] == [None, 5, 5]


# Substrings


def removed_by_hand(texts, window):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_substrings(spark, chunk):
    passage = " ".join(words(40, 9))
    texts = ODD + [passage, "x " + passage + " y", "z " * 50, passage + " " + passage] + [" ".join(words(60, i, 3)) for i in range(20)] + [" ".join(words(200, i)) for i in range(20)]
    got = by_id(substrings.remove_repeats(docs(spark, texts), chunk_bytes=chunk))
    for i, (n, gone, kept) in enumerate(removed_by_hand(texts, 20)):
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (n, gone, kept)
        assert sum(s.stop - s.start for s in got[i].removed) == gone


def test_substrings_repeated_and_null_keys(spark):
    p = " ".join(words(25, 4))
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(docs(spark, [p, p, p], [7, None, 7])).collect())
    assert got == [("7", 25), ("7", 25), ("None", 0)]


@pytest.mark.parametrize("hot", [None, 50])
def test_substrings_hot_key(spark, hot):
    """Half of the rows have one key, or none: they fill several chunks, and each passage stays once."""
    passages = [" ".join(words(25, 100 + i, 5000)) for i in range(20)]
    texts = [passages[i % 20] for i in range(80)]
    d = docs(spark, texts, [hot] * 40 + list(range(40, 80)))
    chunks = 20 if hot is None else 30
    rows = substrings.remove_repeats(d, chunk_bytes=-(-sum(map(len, texts)) // chunks)).collect()
    assert sum(r.n_words - r.n_removed for r in rows) == 20 * 25
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    bounds = substrings.key_bounds(d, place, chunks)
    numbers = d.select("doc_id", substrings.chunk_number(place, F.xxhash64("text"), bounds).alias("c"))
    assert numbers.where(F.col("doc_id").eqNullSafe(F.lit(hot))).select("c").distinct().count() > 3
    assert numbers.groupBy(place.alias("k")).agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < 0").count() == 0


def test_substrings_with_clashing_columns(spark):
    p = " ".join(words(25, 4))
    d = docs(spark, [p, "x " + p])
    extra = ("_key", "_text", "_chunk", "_hash", "c0", "bucket", "n_words")
    for n in extra:
        d = d.withColumn(n, F.col("doc_id") * 10)
    got = by_id(substrings.remove_repeats(d))
    assert (got[0].text, got[1].text, got[1].n_words, got[1]._key, got[1].c0) == (p, "x", 26, 10, 10)


# Quality


def test_quality_by_hand(spark):
    texts = ODD + ["the cat sat\n" * 30, " ".join(words(80, 1)) + " the the", " ".join(f"the w{i}" for i in range(60)), "a b c a b c a b c " * 10, "### $$$ " * 40]
    got = by_id(quality.quality(docs(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j + k for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for k in range(3)}
        own = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(cover)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[len(ODD) + 2].kept


# PII

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, p in PLAIN.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) < 256 for x in m[0].split(".")) or k == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((k, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(["a", "B1", "@", ".", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "192.168.1.1", "255", "x.y", "0", "7", "é", "\n"]) for _ in range(r.randrange(30)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text,found", [
    ("mail jo [at] site [dot] org now", "jo [at] site [dot] org"), ("mail jo(at)site.org now", "jo(at)site.org"), ("mail jo at site dot org now", "jo at site dot org"),
    ("аnnа@site.org", "аnnа@site.org"), ("call plus 4 four one five 5 5 five 0 one two three x", "plus 4 four one five 5 5 five 0 one two three"), ("ip １９.1.2.3 x", "１９.1.2.3"),
])
def test_disguises(text, found):
    base, every = pii.all_spans(text)
    assert set(base) <= set(every)
    assert found in [text[s:e] for _, s, e in every]


@pytest.mark.parametrize("text,found", [("mail jo at site.org now", "jo at site.org"), ("mail john.doe at example.com now", "john.doe at example.com"), ("call +one 23 four 56 seven 89 zero 12 three now", "+one 23 four 56 seven 89 zero 12 three"), ("call +4 11 five 22 six 33 seven 44 now", "+4 11 five 22 six 33 seven 44")])
def test_a_single_disguise_is_enough(text, found):
    base, every = pii.all_spans(text)
    assert base == [] and [text[s:e] for _, s, e in every] == [found]


@pytest.mark.parametrize("text,kind,found", [
    ("card 4111 1111 1111 one one one one now", "card", "4111 1111 1111 one one one one"), ("card four one 11 1111 1111 1111 now", "card", "four one 11 1111 1111 1111"),
    ("call +1 415 five five five 0199 now", "phone", "+1 415 five five five 0199"), ("call plus 1 415 555 019 nine now", "phone", "plus 1 415 555 019 nine"),
    ("call +1 (415) five five five 0199 now", "phone", "+1 (415) five five five 0199"), ("ip 10.zero.zero.one now", "ip", "10.zero.zero.one"),
])
def test_partly_spelled(text, kind, found):
    _, every = pii.all_spans(text)
    assert found in [text[s:e] for k, s, e in every if k == kind]


@pytest.mark.parametrize("text,own,longer", [
    ("mail john [dot] smith@example.com now", "smith@example.com", "john [dot] smith@example.com"), ("mail jo@sub.site [dot] org now", "jo@sub.site", "jo@sub.site [dot] org"),
    ("call +1 (415) 555-019 nine now", "+1 (415) 555-019", "+1 (415) 555-019 nine"),
])
def test_a_longer_span_stands_beside_the_base_span(text, own, longer):
    base, every = pii.all_spans(text)
    assert [text[s:e] for _, s, e in base] == [own] and sorted(text[s:e] for _, s, e in every) == sorted([own, longer])


@pytest.mark.parametrize("text,is_ip", [("00000000000000000001.1.1.1", True), ("0.0.0.0", True), ("1.2.3.00000000000000000000256", False), ("0000000255.1.2.3", True), ("256.1.1.1", False), ("9" * 5000 + ".1.1.1", False)])
def test_leading_zeros(text, is_ip):
    assert [k for k, _, _ in pii.base_spans(text) if k == "ip"] == ["ip"] * is_ip


def test_a_covered_span_is_not_added():
    base, every = pii.all_spans("mail one.two.three.four@example.com, jo (at) site.org")
    assert [x for x in every if x[0] == "email" and x not in base] == [("email", 37, 53)]


def test_gate_lets_through_what_is_rewritten():
    r = random.Random(7)
    parts = [" at ", "(at)", "[ @ ]", " dot ", "<.>", "site.org", "jo", "a", "one", "Seven", "oh", "4", "55", " ", " ", ", ", "-", ".", "+", "plus "]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        found = [p.search(text) for p in (pii._DOT, pii._AT, pii._AT_WORD)] + [m for m in pii._SPELLED_RUN.finditer(text) if pii._SPELLED_ONE.search(m[0])]
        assert not any(found) or pii.suspect(text), text


def test_clean_text_has_no_spans():
    assert pii.all_spans("He was at home. One two three. The dot [at] most; см. там же 5 of 7") [1] == []


def test_pii_rows(spark):
    texts = ODD + ["a@b.co +1 (555) 010-0199, 10.0.0.1"]
    got = by_id(pii.find_pii(docs(spark, texts)))
    r = got[len(ODD)]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1) and r.spans == "email:0:6,ip:26:34,phone:7:24"
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "a@" * 50_000):
        pii.all_spans(text)


# Near duplicates


def components_by_hand(texts, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(n, seed, size=120):
    """Copies of one text with edits, some of edits."""
    r = random.Random(seed)
    out = [words(size, seed, 5000)]
    for _ in range(n - 1):
        w = list(r.choice(out[-3:]))
        for _ in range(r.randrange(1, 3)):
            w[r.randrange(size)] = f"n{r.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("leaf", [32, 4])
def test_near_duplicates(spark, monkeypatch, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    texts = ODD + [x for s in range(6) for x in family(12, s)] + [" ".join(words(100, 50 + i, 5000)) for i in range(30)] + ["A b", "same set same set same set"] * 2
    got = by_id(neardup.near_duplicates(docs(spark, texts), k=3, percent=85))
    want = components_by_hand(texts, 3, 85)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_hot_node(spark):
    """A family larger than a leaf at full depth."""
    base = words(300, 1, 5000)
    texts = [" ".join(base)] + [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 300, 2)]
    got = by_id(neardup.near_duplicates(docs(spark, texts)))
    assert {r.component_id for r in got.values()} == {0}


def components_by_shingles(texts, percent):
    """Links of 5-word shingle sets over all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both * 100 >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("sampled", [False, True])
def test_near_duplicates_links_grow_with_members(spark, monkeypatch, sampled):
    """Members of a node that are all alike, while none is linked yet: all are joined by fewer than members links a pair of blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    n = 300
    rows = [(7, n, bytes([0]), i.to_bytes(2, "big"), [*range(100), 1000 + i]) for i in range(n)]
    full = spark.createDataFrame([r[:4] for r in rows], "node long, n long, first binary, fp binary")
    sets = spark.createDataFrame([r[3:] for r in rows], "fp binary, shingles array<long>")
    classes = spark.createDataFrame([(r[3], 101, bytes(neardup.SKETCH)) for r in rows], "fp binary, n_shingles long, sketch binary")
    nobody = spark.createDataFrame([], "node binary, root binary")
    links = [(r.a, r.b) for r in neardup.apart(full, classes, nobody, sets, 85, *([True] if sampled else [])).collect()]
    assert len(links) < 25 * 2 * 100
    near = {r[3]: r[3] for r in rows}

    def top(x):
        while near[x] != x:
            x = near[x]
        return x

    for a, b in links:
        near[top(a)] = top(b)
    assert len({top(x) for x in near}) == 1


def test_near_duplicates_passage_in_many(spark, monkeypatch):
    """Nodes at full depth whose members share a passage but aren't near duplicates, with families among them."""
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    passage = words(150, 1, 5000)
    texts = [" ".join(passage + x.split()) for s in range(40) for x in family(3, 100 + s, 60)]
    got = by_id(neardup.near_duplicates(docs(spark, texts)))
    want = components_by_shingles(texts, 80)
    assert 20 < len(set(want)) < len(texts) and [got[i].component_id for i in range(len(texts))] == want


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.5])
def test_recall_of_candidates(similarity):
    """Trees and sketches miss a pair at the threshold as seldom as they say."""
    assert (1 - similarity**neardup.DEPTH) ** neardup.trees_for(similarity) <= neardup.MISS
    r = np.random.default_rng(5)
    agree = (r.random((200_000, neardup.SKETCH)) < similarity).sum(1)
    assert (agree < neardup.least_agreeing(similarity)).mean() <= 5e-5


def test_near_duplicates_on_documents(spark, sf):
    """All pairs of the small table's documents, by hand."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = by_id(neardup.near_duplicates(d))
    want = components_by_shingles([(t or "").translate(LOWER) for _, t in rows], 80)
    full = [i for i, (_, t) in enumerate(rows) if len((t or "").split()) >= 5]
    assert [got[rows[i][0]].component_id for i in full] == [rows[want[i]][0] for i in full] and len(set(want)) < len(rows)


def test_string_keys_are_refused(spark):
    d = docs(spark, ["a b"]).selectExpr("cast(doc_id as string) AS doc_id", "text")
    for call in (neardup.near_duplicates, lines.drop_lines, substrings.remove_repeats, lambda x: tokens.write_tokens(x, vocabulary(WORD_BPE), END_ID)):
        with pytest.raises(ValueError, match="integer"):
            call(d)


def test_near_duplicates_joined_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_KEYS", -1)
    texts = family(6, 3)
    got = by_id(neardup.near_duplicates(docs(spark, texts, [9, 8, 7, None, 5, 5]), k=3, percent=50))
    assert {r.component_id for r in got.values()} == {5}


def test_chains_end_in_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(40)], "a binary, b binary")
    assert {bytes(r.root) for r in neardup.components(edges).collect()} == {b"000"}


# SentencePiece


def cut(v, text):
    data, starts, _ = sentencepiece.words_of([text.encode()], v.apart)
    return [bytes(data[a:b]).decode() for a, b in zip(starts, starts[1:], strict=False)]


def test_lattice_paths(spark, monkeypatch):
    """Ids are each word's best path, also of words that go the task's own way; decoding gives the text."""
    path = vocabulary(PIECE_BPE)
    v = sentencepiece.Vocabulary(path)
    given = (v.pieces, v.byte_ids, v.longest, v.unknown)
    texts = ODD + ["  two  spaces\n\nnaïve, 漢字! 🙂 end...", "y" * 600 + " z", "a,b;c|d-e 'tis x_y"] + [" ".join(words(30, i)) for i in range(10)]
    for long in (sentencepiece.LONG, 4):
        monkeypatch.setattr(sentencepiece, "LONG", long)
        got = by_id(sentencepiece.decode(sentencepiece.encode(docs(spark, texts), path, check="same"), path))
        for i, t in enumerate(texts):
            split = cut(v, t or "")
            assert "".join(split) == (" " + t if t else "")
            assert list(got[i].piece_ids) == [p for w in split for p in sentencepiece.best_path(w, *given)]
            assert got[i].decoded == (t or "") and got[i].same


def test_space_pieces_in_the_text(spark):
    """U+2581 in a text is coded as a space, so such a text doesn't come back, and says so."""
    path = vocabulary(PIECE_BPE)
    got = by_id(sentencepiece.decode(sentencepiece.encode(docs(spark, ["a▁b", "▁", "c d"]), path, check="same"), path))
    assert [got[i].decoded for i in range(3)] == ["a b", " ", "c d"]
    assert [got[i].same for i in range(3)] == [False, False, True]


def test_several_blobs_and_chunks(spark, monkeypatch):
    path = vocabulary(PIECE_BPE)
    texts = [" ".join(words(200, i)) for i in range(60)] + [None, ""]
    whole = by_id(sentencepiece.encode(docs(spark, texts), path))
    monkeypatch.setattr(sentencepiece, "BLOB_BYTES", 2000)
    monkeypatch.setattr(sentencepiece, "CHUNK_BYTES", 9000)
    assert by_id(sentencepiece.encode(docs(spark, texts), path)) == whole


def test_piece_digests(spark):
    path = vocabulary(PIECE_BPE)
    texts = ODD + ["a▁b"]
    ids, got = by_id(sentencepiece.encode(docs(spark, texts), path)), by_id(sentencepiece.piece_digests(docs(spark, texts), path))
    for i, t in enumerate(texts):
        own = ids[i].piece_ids
        assert (got[i].n_pieces, got[i].ids_crc32, got[i].round_trip) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()), i < len(ODD))
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()


def test_best_path_is_best():
    """No segmentation costs less, over all of them; and words' paths together cost as much as a text's."""
    v = sentencepiece.Vocabulary(vocabulary(PIECE_BPE))
    given = (v.pieces, v.byte_ids, v.longest, v.unknown)
    cost = {i: c for i, c in v.pieces.values()}

    def every(w):
        if not w:
            yield 0
        for n in range(1, len(w) + 1):
            if w[:n] in v.pieces:
                for rest in every(w[n:]):
                    yield v.pieces[w[:n]][1] + rest

    for w in (" theory", " unhappiness", " reading", " a", "ing"):
        assert sum(cost[i] for i in sentencepiece.best_path(w, *given)) == min(every(w))
    text = "the quick, brown fox. it's 12 o'clock (now)\nand then 漢字 naïve"
    parts = [i for w in cut(v, text) for i in sentencepiece.best_path(w, *given)]
    total = lambda ids: sum(cost.get(i, v.unknown / 3) for i in ids)
    assert len(cut(v, text)) > 15 and abs(total(parts) - total(sentencepiece.best_path(" " + text, *given))) < 1e-6


def test_share_of_words_that_merging_codes_otherwise(sf):
    """The documented third: the given model's own ids against the lattice's, over the words of the small table."""
    import pyarrow.parquet as pq
    import sentencepiece as library

    path = vocabulary(PIECE_BPE)
    v, model = sentencepiece.Vocabulary(path), library.SentencePieceProcessor(model_file=path)
    given = (v.pieces, v.byte_ids, v.longest, v.unknown)
    found = sorted({w for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() for w in (t or "").split()})
    other = sum(model.encode(w) != sentencepiece.best_path(" " + w, *given) for w in found)
    assert 0.25 < other / len(found) < 0.45
