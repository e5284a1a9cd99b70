"""All terms of a vocabulary in one pass over a text: an Aho-Corasick automaton in flat arrays.

The automaton finds where a term's letters stand; whether a find counts (word borders,
stems, endings) is asked of the term's own pattern at that place only, so the cost of a text
hardly grows with the vocabulary. Texts are cut into pieces that overlap by the longest term and walk
through the automaton side by side, a position of all pieces at a time.
The arrays, (nodes x distinct characters) of 32 bits, go to every executor once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftline.functions.matching import PLACES, Term, Vocabulary, matched, stem
from siftline.functions.positions import norm_map
from siftline.functions.text import places, text_slices

PIECE = 512
LANES = 4096
MOST_CODE = 0x110000


def literal(term: Term) -> str:
    """What of a term must stand in the text letter by letter."""
    body = term.text.rstrip("*").strip()
    return body if body.isascii() else stem(body)[0]


class Automaton:
    """finds(texts) gives every place where one of the strings stands."""

    def __init__(self, strings: list[str]):
        self.longest = max((len(s) for s in strings), default=1)
        letters = sorted({ord(c) for s in strings for c in s})
        self.column = np.zeros(max(letters, default=0) + 2, np.int32)  # class of a code point; 0: in no string
        self.column[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, s in enumerate(strings):
            node = 0
            for c in s:
                code = int(self.column[ord(c)])
                if code not in children[node]:
                    children.append({})
                    ends.append([])
                    children[node][code] = len(children) - 1
                node = children[node][code]
            if s:
                ends[node].append(k)
        self.move = np.zeros((len(children), len(letters) + 1), np.int32)
        fail, self.found = np.zeros(len(children), np.int32), ends
        level = [0]
        while level:  # nodes in order of depth: a node's row is that of its failure node, but for its own children
            below = []
            for node in level:
                if node:
                    self.move[node] = self.move[fail[node]]
                    self.found[node] = ends[node] + self.found[fail[node]]
                for code, child in children[node].items():
                    fail[child] = self.move[node, code] if node else 0
                    below.append(child)
            for node in level:
                for code, child in children[node].items():
                    self.move[node, code] = child
            level = below
        self.hit = np.array([bool(f) for f in self.found])

    def finds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, string) of all places, by text and end."""
        step = PIECE - self.longest + 1 if PIECE >= 2 * self.longest else PIECE
        width = step + self.longest - 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        pieces = [(k, at) for k, c in enumerate(codes) for at in range(0, len(c), step)]
        for lo in range(0, len(pieces), LANES):
            own = pieces[lo : lo + LANES]
            column = np.zeros((len(own), width), np.int32)
            for row, (k, at) in enumerate(own):
                part = codes[k][at : at + width]
                column[row, : len(part)] = self.column[np.minimum(part, len(self.column) - 1)]
            column = np.ascontiguousarray(column.T)
            state, states = np.zeros(len(own), np.int32), np.empty((width, len(own)), np.int32)
            for j in range(width):
                state = self.move[state, column[j]]
                states[j] = state
            j, row = np.nonzero(self.hit[states])
            if len(j):
                text, start = (np.array(x) for x in zip(*own, strict=True))
                out.append(self.unfold(text[row], start[row], j, states[j, row], step))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        text, end, string = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((string, end, text))
        return text[order], end[order], string[order]

    def unfold(self, text: np.ndarray, start: np.ndarray, j: np.ndarray, state: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One row per string that ends at a place. A place in the overlap belongs to the piece that the string begins in."""
        n = np.array([len(self.found[s]) for s in state])
        string = np.array([k for s in state for k in self.found[s]], np.int64)
        text, start, j = np.repeat(text, n), np.repeat(start, n), np.repeat(j, n)
        begins = j + 1 - self.lengths[string]
        mine = (begins >= 0) & (begins < step)
        return text[mine], (start + j + 1)[mine], string[mine]

    @classmethod
    def of(cls, strings: list[str]) -> Automaton:
        made = cls(strings)
        made.lengths = np.array([len(s) for s in strings] or [0], np.int64)
        return made


class Matcher:
    """The spans of a vocabulary's terms in normalised texts, as Term.spans gives them one by one."""

    def __init__(self, terms: Iterable[Term]):
        self.terms = [t for t in terms if literal(t)]
        self.automaton = Automaton.of([literal(t) for t in self.terms])
        self.ascii = np.array([literal(t).isascii() and t.text.isascii() for t in self.terms], bool)
        self.open = np.array([t.text.endswith("*") for t in self.terms], bool)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (term, start, end), by term and start; terms are numbers in self.terms."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        text, end, k = self.automaton.finds(texts)
        if not len(text):
            return out
        start = end - self.automaton.lengths[k]
        plain = self.ascii[k]
        found = [self.bordered(texts, text[plain], start[plain], end[plain], k[plain])]
        rest = [(t, n, *m.span()) for t, s, n in zip(*(x[~plain].tolist() for x in (text, start, k)), strict=True) if (m := self.terms[n].compiled.match(texts[t], s))]
        found.append(tuple(np.array(x) for x in zip(*rest, strict=True)) if rest else tuple(np.zeros(0, np.int64) for _ in range(4)))
        every = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort((every[2], every[1], every[0]))
        for t, *hit in zip(*(x[order].tolist() for x in every), strict=True):
            out[t].append(tuple(hit))
        return [self.apart(own) for own in out]

    def bordered(self, texts: list[str], text: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
        """ASCII finds between borders of words; a term with a star goes on to the word's end."""
        code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
        word = (code >= 97) & (code <= 122) | (code >= 48) & (code <= 57)
        border = np.flatnonzero(~word)
        first = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])])[text]
        a, b = first + start, first + end
        b = np.where(self.open[k], border[np.searchsorted(border, b)], b)
        good = ~word[a - 1] & ~word[b]
        return text[good], k[good], start[good], (b - first)[good]

    def apart(self, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """ASCII terms never overlap themselves."""
        out: list[tuple[int, int, int]] = []
        for k, start, end in own:
            if not (out and out[-1][0] == k and start < out[-1][2] and self.ascii[k]):
                out.append((k, start, end))
        return out


HITS = "array<struct<term: int, start: int, stop: int>>"
HITS_TYPE = pa.list_(pa.struct([(name, pa.int32()) for name in ("term", "start", "stop")]))


def term_spans(spark: SparkSession, terms: Iterable[Term], text: Column, in_source: bool = False) -> Column:
    """Every hit (number of the term, start, stop) in a text's normal form, by term and start; with in_source as places in the text as it is."""
    shared = spark.sparkContext.broadcast(Matcher(terms))

    @F.arrow_udf(HITS)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for some in text_slices(texts):  # hits are flat numbers as soon as a slice is done
            if in_source:
                maps = [norm_map(t) for t in some]
                found = [[(k, *m.source(a, b)) for k, a, b in own] for m, own in zip(maps, shared.value.spans([m.text for m in maps]), strict=True)]
            else:
                found = shared.value.spans([matched(t) for t in some])
            off = np.r_[0, np.cumsum([len(own) for own in found])].astype(np.int32)
            flat = np.array([x for own in found for hit in own for x in hit], np.int32).reshape(-1, 3)
            hits = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], ["term", "start", "stop"])
            parts.append(pa.ListArray.from_arrays(off, hits))
        return pa.concat_arrays(parts) if parts else pa.array([], HITS_TYPE)

    return run(text)


def term_numbers(spark: SparkSession, terms: list[Term], text: Column) -> Column:
    """The numbers, in terms, of those that occur in a text."""
    shared = spark.sparkContext.broadcast((Matcher(terms), [k for k, t in enumerate(terms) if literal(t)]))

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        matcher, number = shared.value
        return pd.Series([sorted({number[k] for k, _, _ in own}) for own in matcher.spans([matched(t) for t in texts])])

    return run(text)


def named_places(spark: SparkSession, text: Column, groups: dict[str, list[str]], vocabulary: Vocabulary) -> Column:
    """The place groups that a text names: those of a table (see functions.text.places), then those of the vocabulary's place tiers, by the terms' groups."""
    terms = vocabulary.tier(*PLACES)
    names = F.array(*(F.lit((t.group or t.text).lower()) for t in terms)).cast("array<string>")
    hits = F.transform(term_spans(spark, terms, text), lambda h: F.get(names, h["term"]))
    return F.array_distinct(F.concat(places(text, groups, stem), F.coalesce(hits, F.array().cast("array<string>"))))
