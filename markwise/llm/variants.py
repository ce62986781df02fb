"""Spelling variants: words one edit apart, found by merging the light subtrees of an errata trie, and the word each is a variant of.

count_words() counts the words of texts; variant_groups() takes any table (word, n).

The trie of all words is a table of its nodes (prefix, children, heavy child: the one with most words below). Two words one edit
apart part at one node, and at most one of them goes on to the heavy child. So it is enough to move words that leave a node by a light
edge: with that character skipped, or replaced by the heavy one, or with the heavy one put before it, a word of the merged subtree coincides
with the other's terminal, an equi-join with the table of words; with the character replaced by a wildcard, the words of two light
subtrees coincide, a grouping. A word has at most log2(words) + 1 light edges, so the moved words are that many times the words, and each pair is
met once: at the node where it parts (of equal neighbouring characters only the last is skipped).

Skew: the first nodes are on every word's way. They are hot keys of the join of words with nodes, and `dealt_join` broadcasts those (at most
100,000). A wildcard group has a word per character of the alphabet at most. Numbers of near words and best ones are aggregated before they are shuffled.

Ties of n go to the smaller word in code-point order. A null text has no words, a null key counts as an empty one, repeated rows count again. Memory of a task follows one
text and FLUSH words. An empty table gives an empty result; columns other than text and key don't matter and don't come back.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, pieces, quote, renamed, small_batches, stored, utf8

#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
READ_BYTES = 1 << 20
WILD = "*"

#: Runs of ASCII letters (texts are lower-cased before) and of U+00C0 to U+00FF, in UTF-8.
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


def count_words(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, typos: int | None = None) -> DataFrame:
    """(word, n) of the maximal runs [A-Za-z\\u00C0-\\u00FF]+, A-Z in lower case, of at least `least` code points.

    typos: one in so many pairs of a row's key and a run, by the crc32 of `<key>:<run>`, loses one code point before it is counted.
    """
    own, _ = renamed(small_batches(df).select(quote(text).alias("text"), quote(key).alias("key")), ["text", "key"], [])

    def hand_on(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts.keys()), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "_text", READ_BYTES):
                for raw, name in zip(utf8(part["_text"]), part["_key"].to_pylist(), strict=True):
                    seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for run, n in Counter(_RUN.findall(raw.lower())).items():
                        length = len(run) - run.count(b"\xc3")
                        if length < least:
                            continue
                        if typos and (h := zlib.crc32(run, seed)) % typos == 0:
                            at, letters = h % length, run.decode()
                            if length == least:
                                continue
                            run = (letters[:at] + letters[at + 1 :]).encode()
                        counts[run] += n
                if len(counts) >= FLUSH:
                    yield hand_on(counts)
                    counts = Counter()
        yield hand_on(counts)

    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trie_steps(words: DataFrame) -> DataFrame:
    """(word, n, prefix, char, rest): each word's ways through its nodes; at its terminal char and rest are empty."""
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    return steps.select("word", "n", F.expr("substring(word, 1, i)").alias("prefix"), F.expr("substring(word, i + 1, 1)").alias("char"), F.expr("substring(word, i + 2)").alias("rest"))


def branching_nodes(steps: DataFrame) -> DataFrame:
    """(prefix, below, heavy) of the nodes with several children; a terminal is a child, though never the heavy one."""
    children = steps.groupBy("prefix", "char").agg(F.count("*").alias("c"))
    heavy = F.max(F.when(F.col("char") != "", F.struct("c", "char")))["char"]
    return children.groupBy("prefix").agg(F.sum("c").alias("below"), F.count("*").alias("kids"), heavy.alias("heavy")).where("kids > 1").drop("kids")


def moved_words(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(word, n, wild, key): the words of light subtrees, moved with one character skipped, replaced or put in."""
    light = dealt_join(steps, nodes, "prefix", "below").where("char <> heavy")
    inner = F.col("char") != ""
    found = lambda wild, *parts: F.struct(F.lit(wild).alias("wild"), F.concat("prefix", *parts).alias("key"))
    ways = F.array(
        F.when(inner & (F.substring("rest", 1, 1) != F.col("char")), found(False, "rest")),
        found(False, "heavy", "char", "rest"),
        F.when(inner, found(False, "heavy", "rest")),
        F.when(inner, found(True, F.lit(WILD), "rest")),
    )
    return light.select("word", "n", F.explode(F.array_compact(ways)).alias("way")).select("word", "n", "way.wild", "way.key")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are exactly one edit away, and (-n, word) of the one of largest n; words without any are left out."""
    steps = trie_steps(words)
    moved = stored(moved_words(steps, stored(branching_nodes(steps), "variant-nodes")), "variant-moved")
    about = lambda word, count, n, other: F.struct(F.col(word).alias("word"), count.cast("long").alias("count"), F.struct((-F.col(n)).alias("n"), F.col(other).alias("word")).alias("best"))
    terminals = moved.where("not wild").join(words.select(F.col("word").alias("key"), F.col("n").alias("n_key")), "key")
    pairs = terminals.select(F.explode(F.array(about("word", F.lit(1), "n_key", "key"), about("key", F.lit(1), "n", "word"))).alias("x")).select("x.*")
    groups = moved.where("wild").groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all")).where("size(all) > 1")
    members = groups.select("all", F.explode("all").alias("own"))
    best = F.when(F.col("own.word") == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    alike = members.select("own.word", (F.size("all") - 1).cast("long").alias("count"), best.alias("best"))
    return pairs.unionByName(alike).groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), n >= 1.

    form: the near word of largest n, if that is at least ratio * n; root: the last one that following forms leads to.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 may lead in circles")
    words = stored(words.select("word", "n").where("word is not null"), "variant-words")
    near = near_words(words).select("word", "n_near", (-F.col("best.n")).alias("n_best"), F.col("best.word").alias("best"))
    formed = F.col("n_best") >= F.col("n") * ratio
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("n_best")).alias("form_n")
    )
    found = stored(found, "variant-forms")
    bounds = found.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    hops, n = 0, bounds["a"] or 0
    while n and n * ratio <= bounds["b"]:  # no longer chain of forms is possible
        hops, n = hops + 1, n * ratio
    roots, reach = found.where("form is not null").select("word", F.col("form").alias("root")), 1
    while reach < hops:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots, reach = stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variant-roots"), 2 * reach
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB's SQL for op12 over documents: words with one character cut meet each other, and the uncut words.
VARIANTS_SQL = r"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, c),
w AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
x AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
s AS (SELECT p.word, count(*) AS n_near, arg_min({'form': other, 'n': b.n}, (-b.n, other)) AS best FROM p JOIN w b ON p.other = b.word GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.form END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN s ON w.word = s.word),
g AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM f JOIN g ON f.form = g.word)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN g ON f.word = g.word
"""
