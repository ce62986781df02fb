"""PII: base detectors, and offset-preserving deobfuscation before a second detection.

Transducers normalise homoglyphs, spelled digits and at/dot disguises. Each keeps, for every character of its output,
the source characters it stands for; identifiers found in the normalised text map back to source spans.

Nulls: a null text counts as an empty one, without spans. Rows are judged one by one, so ties and repeated rows don't
matter; an empty table gives an empty result. Very long texts: every detector is linear in the text. Extra columns, whatever
their names, don't matter and don't come back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a later start in the same digits can't match if the first one doesn't
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """The leftmost, non-overlapping matches of local@domain, found from each @ so that runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def ips(text: str) -> Iterator[Span]:
    return (m.span() for m in _IP.finditer(text) if all(int(x.lstrip("0")[:4] or "0") <= 255 for x in m[0].split(".")))


def cards(text: str) -> Iterator[Span]:
    return (m.span() for m in _CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d))


def phones(text: str) -> Iterator[Span]:
    return (m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, *s) for k in KINDS for s in DETECTORS[k](text)]


# Letters that look like Latin ones, in the order of the second line.
_LOOKS = "аеорсухіѕјԁԛԝһАВЕКМНОРСТУХІЅЈαορνιτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "aeopcyxisjdqwhABEKMHOPCTYXISJaopvitkABEZHIKMNOPTYX"
#: Full-width forms and other scripts' digits follow by rule.
HOMOGLYPHS = {ord(a): b for a, b in zip(_LOOKS, _LATIN, strict=True)} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: str(unicodedata.digit(chr(c))) for lo in (0x660, 0x6F0, 0x966) for c in range(lo, lo + 10)}
#: Mathematical letters and digits too, by their compatibility forms.
HOMOGLYPHS |= {c: x for c in range(0x1D400, 0x1D800) if (x := unicodedata.normalize("NFKC", chr(c))).isascii()}
#: Two classes: one with characters of more than 16 bits among others would be searched item by item.
_GLYPH = re.compile("[" + re.escape("".join(chr(c) for c in HOMOGLYPHS if c < 1 << 16)) + "]")
_GLYPH_WIDE = re.compile("[\U0001d400-\U0001d7ff]")

# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAME = "|".join(SPELLED)
#: Digits in a row, in figures or spelled. The shortest identifier, an IP, has MIN_DIGITS; the detectors judge the rest.
_SPELLED_RUN = re.compile(rf"\b(?:{_NAME}|[0-9]+)(?:[\x20,.()-]{{1,3}}(?:{_NAME}|[0-9]+)\b)+", re.IGNORECASE)
MIN_DIGITS = 4
_SPELLED_ONE = re.compile(rf"\b(?:{_NAME})\b", re.IGNORECASE)
_PLUS = re.compile(r"\bplus[\x20]+(?=[0-9])", re.IGNORECASE)
_OPEN, _CLOSE = r"[\x20]?[\[({<][\x20]?", r"[\x20]?[\])}>][\x20]?"
_AT = re.compile(rf"{_OPEN}(?:at|@){_CLOSE}", re.IGNORECASE)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.){_CLOSE}|(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9])", re.IGNORECASE)
_AT_WORD = re.compile(r"(?<=[A-Za-z0-9])\x20at\x20(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.IGNORECASE)
#: Prose has " at " before a domain ("look at example.org"), so what stands before must look like a name: one with a dot, underscore or plus
#: between letters, or any word but these right behind "mail" or "e-mail"; or the domain's dot is disguised as well.
_NAMED = re.compile(
    r"(?:(?<![A-Za-z0-9._%+-])[A-Za-z][A-Za-z0-9]*(?:[._+][A-Za-z0-9]+)*[._+](?!(?:com|org|net|edu|gov|io|js|py|html?|php|md|txt|pdf)\Z)[A-Za-z][A-Za-z0-9]*"
    r"|\be?-?mail(?::|\x20is|\x20to)?\x20(?!(?:me|us|it|him|her|them|you|this|that|these|those|everyone|anyone|order|orders|server|list|lists|here|there)\Z)[A-Za-z0-9._%+-]+)\Z",
    re.IGNORECASE,
)
_DOMAIN_AHEAD = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Invisible characters inside a word.
_HIDDEN_ANY = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_HIDDEN = re.compile("(?<=[A-Za-z0-9@.])[\u00ad\u200b-\u200d\u2060\ufeff]+(?=[A-Za-z0-9@.])")
_BRACKETS = re.compile(r"[\[({<]\x20?(?:at|@|dot|\.)\x20?[\])}>]")
_BESIDE = re.compile(rf"\b(?:{_NAME})[\x20,.()-]{{1,3}}(?:(?:{_NAME})\b|[0-9])|[0-9][\x20,.()-]{{1,3}}(?:{_NAME})\b")


def suspect(text: str) -> bool:
    """Whether the text may hold what a transducer rewrites: a superset, by searches for plain strings before patterns."""
    low = text.lower()
    if " dot " in low or " at " in low and _AT_WORD.search(low):
        return True
    if any(x in low for x in "[({<") and _BRACKETS.search(low):
        return True
    if any(x in low for x in SPELLED) and _BESIDE.search(low):
        return True
    return not text.isascii() and bool(_HIDDEN_ANY.search(text))


class Normal:
    """A text after rewrites, with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        #: Where runs begin in the text and in the source; inside a copied run both advance together.
        self.at, self.source, self.copied = [0], [0], [True]
        self.length = len(text)

    def span(self, i: int) -> Span:
        k = bisect_right(self.at, i) - 1
        if self.copied[k]:
            s = self.source[k] + i - self.at[k]
            return s, s + 1
        return self.source[k], self.source[k + 1] if k + 1 < len(self.source) else self.length

    def rewrite(self, pattern: re.Pattern[str], put: Callable[[re.Match[str]], str], within: list[Span] | None = None, when: Callable[[re.Match[str]], bool] | None = None) -> None:
        """Replaces the matches (those for which `when` holds); the new characters of one match stand for all of its source characters."""
        parts: list[str] = []
        at, source, copied = [], [], []
        done, size = 0, 0

        def copy(stop: int) -> None:
            nonlocal done, size
            while done < stop:
                k = bisect_right(self.at, done) - 1
                end = min(stop, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                at.append(size)
                source.append(self.source[k] + (done - self.at[k]) * self.copied[k])
                copied.append(self.copied[k])
                parts.append(self.text[done:end])
                size += end - done
                done = end

        found = [m for lo, hi in within for m in pattern.finditer(self.text, lo, hi)] if within is not None else pattern.finditer(self.text)
        if when:
            found = [m for m in found if when(m)]
        for m in found:
            new = put(m)
            copy(m.start())
            if m.end() > m.start():
                at.append(size)
                source.append(self.span(m.start())[0])
                copied.append(False)
                parts.append(new)
                size += len(new)
                done = m.end()
                at.append(size)
                source.append(self.span(m.end() - 1)[1])
                copied.append(True)
        copy(len(self.text))
        keep = [i for i in range(len(at)) if i + 1 == len(at) or at[i + 1] > at[i]]
        self.at, self.source, self.copied = [at[i] for i in keep] or [0], [source[i] for i in keep] or [0], [copied[i] for i in keep] or [True]
        self.text = "".join(parts)


def _spelled(run: str) -> bool:
    """Whether some digit of the run is spelled, and the run has enough digits for an identifier."""
    n = len(_SPELLED_ONE.findall(run))
    return n > 0 and n + len(_digits(run)) >= MIN_DIGITS


def _is_address(text: Normal, at: re.Match[str]) -> bool:
    """Whether the word before " at " looks like a name, or the domain behind it has a dot that was disguised."""
    if _NAMED.search(at.string, max(0, at.start() - 80), at.start()):
        return True
    domain = _DOMAIN_AHEAD.match(at.string, at.end())
    return any(c == "." and text.span(i)[1] - text.span(i)[0] > 1 for i, c in enumerate(domain[0], domain.start()))


def normalise(text: str) -> Normal | None:
    """The rewritten text, or None if nothing in it looks disguised."""
    glyphs = not text.isascii() and (_GLYPH.search(text) or _GLYPH_WIDE.search(text))
    if not glyphs and not suspect(text):
        return None
    out = Normal(text.translate(HOMOGLYPHS) if glyphs else text)  # one character for one: offsets stay
    if not text.isascii() and _HIDDEN_ANY.search(text):
        out.rewrite(_HIDDEN, lambda m: "")
    out.rewrite(_DOT, lambda m: ".")
    out.rewrite(_AT, lambda m: "@")
    out.rewrite(_AT_WORD, lambda m: "@", when=lambda m: _is_address(out, m))
    if runs := [m.span() for m in _SPELLED_RUN.finditer(out.text) if _spelled(m[0])]:
        out.rewrite(_SPELLED_ONE, lambda m: SPELLED[m[0].lower()], runs)
        out.rewrite(_PLUS, lambda m: "+")
    return out if out.text != text else None


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those and what only the normalised text shows, unless one base span of the kind covers it."""
    base = base_spans(text)
    normal = normalise(text)
    if normal is None:
        return base, base
    added = []
    for k in KINDS:
        own = [(s, e) for kind, s, e in base if kind == k]
        for a, b in DETECTORS[k](normal.text):
            s, e = normal.span(a)[0], normal.span(b - 1)[1]
            i = bisect_right(own, (s, len(text))) - 1  # base spans of a kind don't overlap: only the last one that begins by s can cover it
            if not (i >= 0 and own[i][1] >= e) and text[s:e] != normal.text[a:b]:
                added.append((k, s, e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def find_pii(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, counts of base spans by kind, n_added, base_sha256, and all spans as kind:start:end in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                rows: list[list] = [[] for _ in range(7)]
                for x in part.column(1).to_pylist():
                    base, every = all_spans(x or "")
                    kinds = [k for k, _, _ in base]
                    for to, v in zip(rows, (*map(kinds.count, KINDS), len(every) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                        to.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in rows[:5]), *(pa.array(x, pa.string()) for x in rows[5:])], [key, "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    return small_batches(df).select(key, df[text].alias("_text")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}")


#: DuckDB's SQL for the counts of base spans.
PII_COUNTS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id,
        len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
        list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS card,
        list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, n_email::BIGINT AS n_email,
  len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) <= 3 THEN ('0' || ltrim(p, '0'))::INT ELSE 999 END)) <= 255))::BIGINT AS n_ip,
  len(list_filter(card, lambda d: len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(d)), lambda i:
    CASE WHEN i % 2 = 0 THEN d[len(d) - i]::INT ELSE d[len(d) - i]::INT * 2 - CASE WHEN d[len(d) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda d: len(d) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM m
"""
