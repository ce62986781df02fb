"""Quality rules: a threshold table compiled into Spark projections, evaluated without user functions.

Nulls: a null text counts as an empty one, which fails the base rule. Repeated rows and ties are judged row by row,
each alike. An empty table gives an empty result. Columns other than the text pass through only if named in `keep`.
Memory per task is that of one text's words, also of a very long text; nothing is shuffled. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plainly, quote

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Common function words of four languages.
STOP_WORDS = """
a an and are as at be by for from have he in is it of on or that the this to was were with
au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une
aber auf das dem den der die ein eine für ich ist mit nicht sich sie und von zu zum
al como con del el ella es la las lo los más no para pero por se su una y
""".split()


@dataclass(frozen=True)
class Rule:
    """kept needs low <= 100 * numerator / denominator <= high; a missing bound is no bound; integers, so no rounding."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The threshold table. Numerators and denominators name measures; all are whole numbers.
RULES = (
    Rule("length", "n_words", "one", 50 * 100, None),
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 1, None),
    Rule("repeated_lines", "n_dup_lines", "n_text_lines", None, 40),
    Rule("bullet_lines", "n_bullet_lines", "n_text_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_text_lines", None, 50),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_text_lines", "n_bullet_lines", "n_ellipsis_lines")
_RESULTS = {*MEASURES, "base_failed", "kept"}


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean column from the threshold table."""
    verdict = F.lit(True)
    for r in rules:
        top, below = F.col(r.numerator) * 100, F.lit(1) if r.denominator == "one" else F.col(r.denominator)
        if r.low is not None:
            verdict = verdict & (top >= below * r.low)
        if r.high is not None:
            verdict = verdict & (top <= below * r.high)
    return verdict


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the MEASURES of each row. Columns of a step are named under a prefix, so inputs can't clash with them."""
    words = F.filter(F.split(F.col("_t"), SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    step = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    step = step.select(*keep, "_t", words.alias("_w"), lines.alias("_l"))
    windows = F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    step = step.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_text_lines"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
        windows.alias("_h"),
    )
    rest = [c for c in step.columns if c != "_h"]
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alone = F.size(F.array_distinct("_h")) == F.size("_h")  # most texts repeat no window, so nothing needs sorting
    step = step.select(*rest, F.when(~alone, placed).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias("_s"))
    repeated = F.transform(
        "_s",
        lambda x, k: F.when((F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))), x["i"]),
    )
    step = step.select(*rest, F.sort_array(F.filter(repeated, lambda i: i.isNotNull())).alias("_r"))
    covered = F.aggregate(F.transform("_r", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_r", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return step.select(*rest, covered.cast("long").alias("n_repeat_words")).select(*keep, *MEASURES)


def quality(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, the MEASURES, base_failed and kept; what keep names like one of these, whatever the case, is overwritten."""
    plain, name, back = plainly(df.select(*[quote(c) for c in dict.fromkeys([*keep, text])]), [*MEASURES, "base_failed", "kept"])
    found = _quality(plain, name[text], tuple(name[c] for c in keep), rules)
    return back(found if text in keep else found.withColumn(name[text], F.lit(None))).select(*[quote(c) for c in keep if c.lower() not in _RESULTS], *MEASURES, "base_failed", "kept")


def _quality(df: DataFrame, text: str, keep: tuple[str, ...], rules: tuple[Rule, ...]) -> DataFrame:
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measures(df, text, keep).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB's SQL, over documents."""
    checks = []
    for r in rules:
        below = "1" if r.denominator == "one" else r.denominator
        checks += [f"{r.numerator} * 100 >= {below} * {r.low}"] * (r.low is not None) + [f"{r.numerator} * 100 <= {below} * {r.high}"] * (r.high is not None)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT row_id, doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda w: w <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS l FROM t),
x AS (SELECT row_id, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) > 2),
g AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS n FROM x),
c AS (SELECT row_id, count(DISTINCT i + d) AS n_repeat_words FROM (SELECT row_id, i, unnest([0, 1, 2]) AS d FROM g WHERE n > 1) GROUP BY row_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             len(l)::BIGINT AS n_text_lines, len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]')))::BIGINT AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$')))::BIGINT AS n_ellipsis_lines
      FROM s LEFT JOIN c USING (row_id)),
b AS (SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {' AND '.join(checks)}) AS kept FROM b
"""
