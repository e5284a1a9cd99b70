"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much of their text are rejected.

A text is split at line feeds and every line with a word is judged by itself, by
the first rule that fails it: punctuation (shouted or symbol-ridden words, no
letter at all, a fragment without an end mark), navigation (separators standing
alone, lines of addresses, menu entries), boilerplate (legal and service
phrases, a line repeated from further up, one few words over and over). What is
left is the clean text; a document whose removed lines hold more than
MOST_LOST of its word characters is rejected. All counts come from one pass over
the whole text inside a task, and nothing is shuffled.

Cases: a null text counts as empty; a text without a word loses nothing by lines (the base
rule on few words rejects it in the query). Lines without a word are kept as they are
and never judged. Repeated rows are judged alike; equal lines of one text beyond the
first are boilerplate. Extra columns pass through, whatever their names, but
for the result columns, which replace those of the same name. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .textbytes import tidy

MOST_LOST = 0.3  # of a document's word characters
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
FRAGMENT_WORDS, FRAGMENT_CHARS = 5, 20
SHORT_LINE = 40  # words; phrases only speak for lines up to this length
MONOTONE_WORDS, MONOTONE_TIMES = 12, 3

# Marks that end a line, separators of menus, menu entries, phrases of notices.
END_MARKS = ".!?…:;\"')]»”’。！？؟।"
SEPARATORS = ["|", ">", "»", "›", "·", "•", "/", "::", "<", "«", "‹", "→", "←"]
MENU_ENTRIES = [
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back to top", "read more", "skip to content", "contact us", "about us", "share this",
    "accueil", "rechercher", "suivant", "lire la suite", "startseite", "anmelden", "suche", "weiter", "mehr lesen", "inicio", "buscar", "siguiente", "leer más",
]
PHRASES = [
    "all rights reserved", "licensed under", "is licensed", "released under the", "terms of use", "terms of service", "privacy policy", "use of cookies", "uses cookies", "accept cookies", "enable javascript",
    "subscribe to our", "sign up for our", "newsletter", "click here", "follow us on", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados", "lorem ipsum",
]

BLANK = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
NOT_FIRST = bytes(range(0x80, 0xC0))  # UTF-8 bytes that continue a character
ENDS = tuple(m.encode() for m in END_MARKS)
ALONE = frozenset(s.encode() for s in SEPARATORS)
ENTRIES = frozenset(m.encode() for m in MENU_ENTRIES)
PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
ADDRESS = (b"http://", b"https://", b"www.")

RESULTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, lost_chars long, clean_text string"


class Judged(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_punctuation: int
    n_navigation: int
    n_boilerplate: int
    lost_chars: int
    clean_text: str


def word_chars(data: bytes) -> int:
    """Characters other than blanks, from UTF-8 bytes."""
    return len(data.translate(None, BLANK + NOT_FIRST))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that stand twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + window - max(end, i)
            end = i + window
    return covered


def failed_rule(line: bytes, words: list[bytes], chars: int, again: bool) -> str | None:
    """The first rule that the line fails: punctuation, navigation, boilerplate; None if it stays."""
    n = len(words)
    shouts, symbols = line.count(b"!") + line.count(b"?"), sum(line.count(s) for s in (b"#", b"*", b"$", b"%", b"&"))
    if shouts >= 3 and 3 * shouts > n or symbols >= 3 and 5 * symbols > n or not LETTER.search(line):
        return "punctuation"
    lower = b" ".join(words).lower()
    if lower in ENTRIES:
        return "navigation"
    if n < FRAGMENT_WORDS and chars < FRAGMENT_CHARS and not lower.endswith(ENDS):
        return "punctuation"
    alone = sum(w in ALONE for w in words)
    if alone >= 2 and 5 * alone >= n or all(w.startswith(ADDRESS) for w in words):
        return "navigation"
    if again or n <= SHORT_LINE and PHRASE.search(lower) or n >= MONOTONE_WORDS and MONOTONE_TIMES * len(set(words)) < n:
        return "boilerplate"
    return None


def judge(data: bytes) -> Judged:
    """All counts of one text and what the line rules leave of it."""
    words = data.split()
    seen, kept, lost, again, n_lines = set(), [], 0, 0, 0
    fails = dict.fromkeys(("punctuation", "navigation", "boilerplate"), 0)
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        n_lines += 1
        repeat = line in seen
        again += repeat
        seen.add(line)
        chars = word_chars(line)
        rule = failed_rule(line, own, chars, repeat)
        if rule:
            fails[rule] += 1
            lost += chars
        else:
            kept.append(line)
    clean = b"\n".join(kept).decode("utf-8", "replace")
    return Judged(len(words), word_chars(data), len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words), n_lines, *fails.values(), lost, clean)


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """docs with the counts, clean_text and `stays`: whether the lines that went hold at most most_lost of the text."""
    names = [part.split()[0] for part in RESULTS.split(",")]
    rest = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out_schema = pa.schema([(n, pa.string() if n == "clean_text" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = batch.column("row").field("text").cast(pa.binary()).fill_null(b""), 0
            while at < len(batch):  # a long text goes out alone
                end, size = at, 0
                while end < len(batch) and (end == at or size + len(data[end].as_buffer()) <= 1 << 22):
                    size += len(data[end].as_buffer())
                    end += 1
                rows = [judge(data[i].as_py()) for i in range(at, end)]
                columns = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(out_schema)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, end - at), *columns], names=["row", *names])
                at = end

    judged = rest.mapInArrow(tidy(run), f"row {rest.schema['row'].dataType.simpleString()}, {RESULTS}")
    stays = F.col("lost_chars") <= F.lit(most_lost) * F.col("word_chars")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in (*names, "stays")), *names, stays.alias("stays"))


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def op11_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base verdict and line-first verdict; a null text counts as empty and fails."""
    judged = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars"]
    return judged.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & F.col("stays")).alias("kept"), *more, F.sha2("clean_text", 256).alias("clean_sha256"))


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


BLANKS = "[^\\x20\\x09-\\x0D]+"
OP11_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{BLANKS}') AS w FROM texts),
placed AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
followed AS (SELECT r, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) AS times FROM followed WHERE third IS NOT NULL),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY r),
pieces AS (SELECT r, string_split(text, chr(10)) AS ls FROM texts),
lines AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM pieces),
parts AS (
  SELECT r, i, line, regexp_extract_all(line, '{BLANKS}') AS w, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM lines),
measured AS (
  SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars,
         translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         length(regexp_replace(line, '[^!?]', '', 'gs')) AS shouts, length(regexp_replace(line, '[^#*$%&]', '', 'gs')) AS symbols,
         len(list_filter(w, lambda x: x IN ({_quoted(SEPARATORS)}))) AS alone
  FROM parts WHERE len(w) > 0),
judged AS (
  SELECT *, CASE
    WHEN shouts >= 3 AND 3 * shouts > n OR symbols >= 3 AND 5 * symbols > n OR NOT regexp_matches(line, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]') THEN 'p'
    WHEN low IN ({_quoted(MENU_ENTRIES)}) THEN 'n'
    WHEN n < {FRAGMENT_WORDS} AND chars < {FRAGMENT_CHARS} AND right(low, 1) NOT IN ({_quoted(list(END_MARKS))}) THEN 'p'
    WHEN alone >= 2 AND 5 * alone >= n OR len(list_filter(w, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, 'www.'))) = n THEN 'n'
    WHEN again OR n <= {SHORT_LINE} AND ({" OR ".join(f"contains(low, {_quoted([p])})" for p in PHRASES)}) OR n >= {MONOTONE_WORDS} AND {MONOTONE_TIMES} * len(list_distinct(w)) < n THEN 'b'
    END AS rule
  FROM measured),
sums AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup, count(*) FILTER (rule = 'p') AS n_p, count(*) FILTER (rule = 'n') AS n_n, count(*) FILTER (rule = 'b') AS n_b,
         coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost FROM judged GROUP BY r),
clean AS (
  SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM lines l LEFT JOIN judged j ON j.r = l.r AND j.i = l.i WHERE j.rule IS NULL GROUP BY l.r),
found AS (
  SELECT t.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'gs')) AS n_symbols,
         coalesce(s.n_dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_p, 0) AS n_punctuation, coalesce(s.n_n, 0) AS n_navigation,
         coalesce(s.n_b, 0) AS n_boilerplate, coalesce(s.lost, 0)::BIGINT AS lost_chars, sha256(coalesce(c.text, '')) AS clean_sha256
  FROM texts t JOIN words w USING (r) LEFT JOIN sums s USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN clean c USING (r)),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {MOST_LOST}::DOUBLE * word_chars AS kept,
       n_lines, n_punctuation, n_navigation, n_boilerplate, lost_chars, clean_sha256 FROM based
"""
