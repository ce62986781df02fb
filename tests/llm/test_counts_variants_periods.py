"""Token counts, spelling variants and periodic runs against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markwise.llm import common, counts, lines, matroska, mixing, neardup, periods, pii, quality, sentencepiece, substrings, tokens, toxicity, variants
from markwise.llm.queries import PIECE_BPE, vocabulary

from test_ops import ODD, docs

ODD_NAMES = ["a.b", "_text", "c0", "N_TOKENS", "RUNS", "block", "tokens", "size", "`q`"]


def with_odd_names(df):
    for i, name in enumerate(ODD_NAMES):
        df = df.withColumn(name, F.lit(i))
    return df


# Token counts


def library_counts(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    return [len(model.encode(t or "", num_threads=1)) for t in texts]


STRANGE = [*ODD, "a▁b ▁ c", "\n\n  two  spaces\t", "<s> </s> <unk> <0x41>", "漢" * 700 + "🙂" * 50, "don't-stop...e.g.,1234567", " ", "\x00nul", "word " * 5 + "\n" + "word\r\n" * 7]


@pytest.mark.parametrize("block_bytes", [1, 1 << 12, 1 << 24])
def test_counts_are_the_librarys(spark, block_bytes):
    df = with_odd_names(docs(spark, STRANGE, ids=[None, *range(1, len(STRANGE))]))
    got = counts.token_counts(df, vocabulary(PIECE_BPE), limit=100, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", *[c for c in ODD_NAMES if c != "N_TOKENS"], "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(None if i == 0 else i), len((t or "").encode()), n, n > 100) for i, (t, n) in enumerate(zip(STRANGE, library_counts(STRANGE), strict=True)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert {r["a.b"] for r in got.select("`a.b`").collect()} == {0}


def test_counts_of_documents_are_the_librarys(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(df.select("doc_id", "text"), vocabulary(PIECE_BPE)).collect()}
    assert got == dict(zip(texts, library_counts(texts.values()), strict=True))


def test_each_pre_token_is_counted_once(spark):
    df = docs(spark, [f"the cat sat {i} the" for i in range(200)])
    found = counts.token_counts(df, vocabulary(PIECE_BPE), block_bytes=256)
    assert found.count() == 200
    planes = np.array([0, 1, 255, 256, 1 << 31], np.int64)
    assert (counts.from_planes(counts.planes(planes)) == planes).all()


def test_dealt_join_has_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    want = sorted((r.id, r.k * 2) for r in rows.collect())
    for hot, cold in ((100_000, 1000), (3, 1), (1, 10**9)):
        got = common.dealt_join(rows, keyed, "k", "n", hot_keys=hot, cold_rows=cold)
        assert sorted((r.id, r.v) for r in got.collect()) == want
    assert common.dealt_join(rows.limit(0), keyed.limit(0), "k", "n").count() == 0


# Spelling variants


def brute_words(rows, typos=31, least=7):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % typos == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=10):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_of_small_alphabets(spark):
    r = np.random.default_rng(3)
    words = {"".join(r.choice(list("abé"), size=r.integers(0, 7))) for _ in range(500)}
    n = {w: int(10 ** r.integers(0, 5)) + int(r.integers(0, 3)) for w in words}
    table = spark.createDataFrame([*n.items(), (None, 7)], "word string, n long").repartition(3)
    assert rows_of(variants.variant_groups(table)) == brute_variants(n)
    assert rows_of(variants.variant_groups(table, ratio=2)) == brute_variants(n, 2)


def test_variants_in_chains_runs_and_ties(spark):
    chain = {"aaaaaaa" + "b" * i: 2 * 10**i for i in range(9)}
    ties = {"stone": 5, "stony": 5, "stone!": 1, "stoned": 500, "stones": 500, "stonez": 50}
    letters = {f"prefix{c}suffix": (1 if c != "q" else 10) for c in "abcdefghijklmnopqrstuvwxyz"}
    n = chain | ties | letters | {"": 3, "x": 40}
    assert rows_of(variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_variants(n)
    with pytest.raises(ValueError):
        variants.variant_groups(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_near_pairs_are_found_once_per_pair(spark):
    words = spark.createDataFrame([(w, 1) for w in ("aab", "ab", "aaab", "b", "bb", "abb")], "word string, n long")
    got = {r.word: r.n_near for r in variants.near_words(words).collect()}
    assert got == {"aab": 3, "ab": 4, "aaab": 1, "b": 2, "bb": 3, "abb": 3}


def test_counted_words(spark):
    texts = ["Wörterbuch wörterbuch WÖRTERBUCH", None, "", "mañanas ×÷×÷×÷× abcdefg abcdef", "ÿ" * 2000, "elephants " * 300, "Straßenbahn漢Straßenbahn", "elephants " * 300]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(i, f"typography{i % 3} elephant mountain{'x' * (i % 4)}") for i in range(400)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    for typos in (31, 3):
        got = {r.word: r.n for r in variants.count_words(df, typos=typos).collect()}
        assert got == dict(brute_words(rows, typos))
    assert {r.word: r.n for r in variants.count_words(df, least=1).collect()} == dict(brute_words(rows, 1 << 40, 1))
    found = variants.count_words(df, typos=31).where("n >= 2")
    assert rows_of(variants.variant_groups(found)) == brute_variants({w: n for w, n in brute_words(rows).items() if n >= 2})


# Periodic runs


def brute_runs(words, least=24, times=3):
    out, n = {}, len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, length, p) for (s, length), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_digest(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *top, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words():
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.integers(0, 300))
        words = r.integers(0, int(r.integers(1, 6)), n)
        for _ in range(int(r.integers(0, 4))):
            if n > 40:
                a, e = sorted(r.integers(0, n, 2))
                words[a:e] = np.resize(words[a : a + 1 + int(r.integers(0, 20))], e - a)
        assert [tuple(x) for x in periods.runs_of(words.astype(np.int64)).tolist()] == brute_runs(words.tolist())
        assert [tuple(x) for x in periods.runs_of(words.astype(np.int64), 5, 2).tolist()] == brute_runs(words.tolist(), 5, 2)


def test_runs_in_batches_of_the_grid(monkeypatch):
    words = np.concatenate([np.resize(np.arange(k), 4 * k + 30) for k in (1, 2, 7, 31, 64)] + [np.zeros(500, np.int64)])
    want = periods.runs_of(words)
    assert [tuple(x) for x in want.tolist()] == brute_runs(words.tolist())
    monkeypatch.setattr(periods, "GRID", 50)
    assert (periods.runs_of(words) == want).all()


def test_a_lying_hash_is_found_out(monkeypatch):
    words = np.concatenate([np.resize(np.arange(5), 60), np.arange(100, 160)])
    tried, true = [], periods.Prefixes.agree

    def lie(self, i, p, m):
        return np.ones(len(i), bool) if len(tried) == 1 else true(self, i, p, m)

    class Told(periods.Prefixes):
        def __init__(self, w, attempt=0):
            tried.append(attempt)
            super().__init__(w, attempt)

    Told.agree = lie
    monkeypatch.setattr(periods, "Prefixes", Told)
    assert [tuple(x) for x in periods.runs_of(words).tolist()] == brute_runs(words.tolist())
    assert tried == [0, 1]


def test_runs_of_odd_rows(spark):
    texts = [*ODD, "a b c " * 9, "x " * 23, "x " * 24, ("one two three four five six seven eight nine ten " * 3).strip(), "p q\n" * 20 + "r s t " * 20, "é b " * 30]
    texts += [" ".join(f"w{i * i % 37}" for i in range(k)) for k in range(0, 200, 7)]
    ids = [None, *range(1, len(texts))]
    df = with_odd_names(docs(spark, texts, ids=ids))
    want = sorted([brute_digest(i, t) for i, t in zip(ids, texts, strict=True)], key=str)
    assert sorted([tuple(r) for r in periods.run_digests(df.select("doc_id", "text")).collect()], key=str) == want
    out = periods.periodic_runs(df)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *[c for c in ODD_NAMES if c != "RUNS"], "runs", "collapsed"]
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[None].collapsed == "" and by_id[None].runs == []
    assert by_id[11].collapsed == "a b c" and [tuple(x) for x in by_id[11].runs] == [(0, 27, 3)]


def test_a_long_text_of_one_word(spark):
    df = docs(spark, ["na " * 200_000])
    row = periods.periodic_runs(df).first()
    assert row.collapsed == "na" and [tuple(x) for x in row.runs] == [(0, 200_000, 1)]


# Media files of other writers, addresses in prose


CLEAN = """Buy it at amazon.com. | Look at example.org for more. | You can find us at example.com. | Contact us at example.com today. | Read it at docs.site.org now.
Available at shop.example.co.uk. | The team at github.com agreed. | He works at example.com. | Sign up at example.com for free. | More at news.example.org.
The sale at store.example.com ended. | Prices start at example.com. | Meet me at cafe.example.com. | She laughed at xkcd.com. | Version 2.0 at example.com is out.
Get node.js at nodejs.org. | See example.com at archive.org. | Mail order at example.com. | E-mail us at example.com. | Email it at example.com, please.
Open 24/7 at example.com. | A talk at conf.example.org. | The 3rd release at example.org. | Download the file at files.example.net. | Check the FAQ at help.example.com.
The demo at try.example.io works. | I looked at wikipedia.org first. | We met at example.org. | Support is at example.com. | Watch live at tv.example.com.
Someone at example.com replied. | Join at example.org. | Register at example.org by May. | Our blog at blog.example.com. | Tickets at tickets.example.com.
Start at example.com and go on. | The shop at example.de is open. | Apply at jobs.example.com. | Donate at give.example.org. | Vote at polls.example.com.
The code at gitlab.com compiles. | Learn at school.example.edu. | Play at games.example.com. | Stop at example.org. | The page at example.net is old.
Anyone at example.org may know. | Search at find.example.com. | Listen at radio.example.fm. | Call in at example.com. | Users at forum.example.com said so.""".replace("\n", " | ").split(" | ")


def test_prose_with_domains_has_no_addresses():
    assert len(CLEAN) == 50
    for text in [*CLEAN, " ".join(CLEAN)]:
        assert pii.all_spans(text)[1] == [], text


@pytest.mark.parametrize("text,found", [
    ("write j𝗼hn@site.org now", "j𝗼hn@site.org"), ("mail jo​hn@si​te.org now", "jo​hn@si​te.org"), ("ask ann_lee at site.org now", "ann_lee at site.org"),
    ("call +1 (four one five) 555 0199 now", "+1 (four one five) 555 0199"), ("e-mail: jo at site.org now", "jo at site.org"), ("find jo at site dot org now", "jo at site dot org"),
])
def test_more_disguises(text, found):
    spans = [text[s:e] for _, s, e in pii.all_spans(text)[1]]
    assert found in spans, spans


def media(*children):
    return matroska._element(matroska.SEGMENT, b"".join(children))


CRC, VOID = b"\xbf\x84abcd", b"\xec\x83xyz"


def test_checksums_and_voids_in_every_element():
    u, el = matroska._uint, matroska._element
    odd = CRC + VOID
    block = b"\x81\x00\x00\x80ab"
    entry = u(matroska.TRACK_NUMBER, 1) + odd + u(matroska.TRACK_TYPE, 2) + el(matroska.CODEC_ID, b"A_PCM/INT/LIT") + el(matroska.AUDIO, odd)
    places = lambda track, at: el(matroska.CUE_POSITIONS, odd + u(matroska.CUE_TRACK, track) + u(matroska.CUE_CLUSTER, at))
    data = media(
        odd, el(matroska.INFO, odd + u(matroska.TIMESTAMP_SCALE, 1000)), el(matroska.TRACKS, odd + el(matroska.TRACK_ENTRY, entry)),
        el(matroska.CLUSTER, odd + u(matroska.CLUSTER_TIMESTAMP, 7) + el(matroska.SIMPLE_BLOCK, block) + el(matroska.BLOCK_GROUP, odd)),
        el(matroska.CUES, odd + el(matroska.CUE_POINT, odd + u(matroska.CUE_TIME, 7) + places(1, 30) + places(2, 31))),
    )
    m = matroska.demux(data)
    head = len(data) - len(data[data.index(odd):])
    assert m.cues == [(7, 1, head + 30), (7, 2, head + 31)]
    assert [(p.timestamp, p.size, p.keyframe) for p in m.packets] == [(7, 2, True)]
    assert m.tracks[1]["rate"] == matroska.DEFAULT_RATE and m.tracks[1]["channels"] == 1 and m.tracks[1]["bits"] == 0 and m.tick_ns == 1000


def test_reference_blocks_are_no_key_frames():
    u, el = matroska._uint, matroska._element
    group = lambda more: el(matroska.BLOCK_GROUP, el(matroska.BLOCK, b"\x81\x00\x00\x00ab") + more)
    simple = el(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x00ab")
    data = media(el(matroska.CLUSTER, u(matroska.CLUSTER_TIMESTAMP, 0) + group(b"") + group(u(matroska.REFERENCE_BLOCK, 1)) + simple))
    assert [p.keyframe for p in matroska.demux(data).packets] == [True, False, False]


# Names of columns


NAMES = ["a.b", "N_WORDS", "Kept", "_t", "c0", "_source", "SCORE", "n_Lines", "Copy", "Piece_Ids", "`q`.x", "text2"]
OPERATORS = {
    "with_scores": (lambda d: toxicity.with_scores(d, toxicity.fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))), ["score"]),
    "mix": (mixing.mix, ["copy", "n_copies", "mix_key"]),
    "drop_lines": (lambda d: lines.drop_lines(d, least_docs=2), ["n_lines", "n_dropped"]),
    "drop_lines_joined": (lambda d: lines.drop_lines(d, least_docs=2, broadcast_bytes=0), ["n_lines", "n_dropped"]),
    "remove_repeats": (lambda d: substrings.remove_repeats(d, window=2), ["n_words", "n_removed", "removed"]),
    "quality": (lambda d: quality.quality(d, keep=tuple(d.columns)), [*quality.MEASURES, "base_failed", "kept"]),
    "encode": (lambda d: sentencepiece.encode(d, vocabulary(PIECE_BPE), check="same"), ["piece_ids", "same"]),
    "token_counts": (lambda d: counts.token_counts(d, vocabulary(PIECE_BPE)), ["n_bytes", "n_tokens", "over_limit"]),
    "periodic_runs": (periods.periodic_runs, ["runs", "collapsed"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_names_of_columns_pass_through(spark, name):
    operator, results = OPERATORS[name]
    df = docs(spark, ["one two three\nfour", "one two three\nfive", None, ""])
    for i, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(i))
    out = operator(df)
    low = {c.lower() for c in results}
    gone = {"text"} if name in ("token_counts", "periodic_runs") else set()
    assert out.columns[-len(results):] == results or name == "quality"
    assert [c for c in out.columns if c not in results] == [c for c in df.columns if c.lower() not in low and c not in gone]
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    for r in out.collect():
        assert all(r[c] == i for i, c in enumerate(NAMES) if c.lower() not in low)


@pytest.mark.parametrize("name", ["key_only", "pii", "near", "media", "tokens"])
def test_odd_names_beside_key_and_text(spark, name):
    df = docs(spark, ["one two three four five six", "one two three four five six seven", None])
    for i, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(i))
    run = {
        "key_only": lambda: toxicity.toxicity(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")),
        "pii": lambda: pii.find_pii(df), "near": lambda: neardup.near_duplicates(df), "media": lambda: matroska.media_digests(df),
        "tokens": lambda: tokens.token_digests(df, vocabulary("word_bpe_49k.json"), 2),
    }
    assert run[name]().count() == 3


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_keep_any_names(spark, tmp_path, stage):
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = docs(spark, [" ".join(f"w{i}{j}" for j in range(12)) for i in range(6)])
    for i, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(i))
    out = dict(corpus_pipeline.STAGES)[stage](spark, df, str(tmp_path))
    want = [c for c in df.columns if stage != "sentencepiece" or c != "Piece_Ids"]
    assert out.columns[: len(want)] == want and all(r["a.b"] == 0 for r in out.collect())


# Pairs that no single term gives away


@pytest.mark.parametrize("rule", ["one of them", "both or neither"])
def test_toxicity_learns_what_only_pairs_tell(rule):
    """Neither word says anything alone: a linear model can't tell the label, so without its factors the machine can't."""
    r = random.Random(1)
    texts, y = [], []
    for _ in range(2400):
        a, b = r.random() < 0.5, r.random() < 0.5
        text = [f"w{r.randrange(400)}" for _ in range(12)] + ["insult"] * a + ["group"] * b
        r.shuffle(text)
        texts.append(" ".join(text).encode())
        y.append(float((a != b) == (rule == "one of them")))
    y, n = np.array(y), 1800
    rows, buckets = toxicity._distinct(*toxicity.term_buckets(texts), toxicity.BUCKETS)
    fm = toxicity.fit(rows[rows < n], buckets[rows < n], y[:n])
    at = fm.places()[buckets]
    right = lambda m: ((m.score(rows[at >= 0], at[at >= 0], len(y)) >= 0.5) == (y > 0))[n:].mean()
    assert right(fm) > 0.95
    assert right(toxicity.FactorizationMachine(fm.kept, fm.bias, fm.linear, np.zeros_like(fm.factors))) < 0.6
    # the best linear model of the same terms, by least squares
    x = np.zeros((len(y), len(fm.kept) + 1))
    x[rows[at >= 0], at[at >= 0]] = 1
    x[:, -1] = 1
    weights = np.linalg.lstsq(x[:n], y[:n], rcond=None)[0]
    assert ((x[n:] @ weights >= 0.5) == (y[n:] > 0)).mean() < 0.6


def test_no_key_is_not_held_out(spark):
    d = docs(spark, ["a", "b"], ids=[None, 1])
    got = toxicity.toxicity(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect()
    assert {(r.doc_id, r.held_out) for r in got} == {(None, False), (1, zlib.crc32(b"1") % 5 == 0)}
