"""Language-model scoring with a gated recurrent network, and the add-one unigram base beside it.

Tokens are words (A-Z lower-cased) and one end per document. The network reads the
VOCABULARY most frequent tokens by name and all others as one of RARE rare tokens, by a hash of their last two
bytes, so it can tell which endings are likely. Its output
is factored: a softmax over classes, then a softmax within the token's class. Every rare token is a class; a
word's share of it is its add-one share of that class's counts. So the model
is a proper distribution over all texts.

Counts cover all training rows: they are combined within tasks and added up by word.
Frequent words' counts go to every task (FREQUENT of them, a parameter); the other
words of each document are joined to the count table by word. The network is trained
by truncated backpropagation in numpy on all training rows, once each: a hash of doc_id
deals them to ROUNDS rounds, in a round every partition trains the round's network on its
share, and the changes are averaged by tokens, in steps of MERGED partitions, so the driver
sees parameters only. Training and scoring run many documents in lanes side by side; a
document's state is carried from window to window, so its log-likelihood is that of
the complete text.

Cases: null and empty texts have one token, their end; repeated rows (equal
doc_id and text) are scored alike and count as often as they occur in training; without training rows every
count is 0 and the network stays at its start; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, table, top_rows
from .textbytes import U64, Words, chunks, gathered, run_starts, tidy

VOCABULARY = 2047
CLASS_WORDS = 48
RARE = 48
HIDDEN = 16
FREQUENT = 65_536
ROUNDS = 3
RATE = 0.02
MERGED = 16
WINDOW = 16
LANES = 512
LEAST_UPDATES = 72  # of one chunk; fewer lanes where a chunk has too few tokens for that
CHUNK = 4 << 20
PIECE = 1 << 18  # bytes tokenised at once
AT_ONCE = 8192  # tokens scored together
CACHED = 1024  # of these, rows whose class shares are in memory at once
MOST_LOGIT = np.float32(80)
END = np.uint64(0xE0D0C0B0A0908071)
LN10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def tokens(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with each row's end, row borders, each token's group by its last two bytes), made in pieces of whole rows that stay in the processor's cache."""
    cut = np.unique(np.r_[0, np.searchsorted(off[:-1], np.arange(PIECE, len(flat), PIECE)), len(off) - 1]).tolist()
    parts = [_piece(flat[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pairwise(cut)] or [_piece(flat, off)]
    size = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], *(p[1][1:] + at for p, at in zip(parts, size, strict=False))]), np.concatenate([p[2] for p in parts])


def _piece(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(flat, off)
    border = words.first + np.arange(len(words.first))
    out, group = np.empty(int(border[-1]), np.uint64), np.zeros(int(border[-1]), np.uint8)
    at = np.arange(len(words.row)) + words.row
    out[at] = words.hash
    pair = words.flat[words.end - 1].astype(np.uint32) * np.uint32(31) + words.flat[np.maximum(words.end - 2, words.start)]
    group[at] = (pair * np.uint32(2_654_435_761) >> np.uint32(7)) % np.uint32(RARE)
    out[border[1:] - 1] = END
    return out, border, group


def token_counts(training: DataFrame) -> DataFrame:
    """(word, n, part): how often each token occurs and its group, tasks' own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, n, part = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(word, kind="stable")
            word, n, part = word[order], n[order], part[order]
            at = run_starts(word)
            return word[at], np.add.reduceat(n, at), part[at]

        def rows() -> Iterator[pa.RecordBatch]:
            word, n, part = merged()
            for at in range(0, len(word), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(word[at : at + 65536].view(np.int64)), pa.array(n[at : at + 65536]), pa.array(part[at : at + 65536].astype(np.int32))], ["word", "n", "part"])

        for b in batches:
            for _, flat, off in chunks(b.column(0)):
                h, _, group = tokens(flat, off)
                word, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((word, n.astype(np.int64), group[at]))
                size += len(word)
                if size > 3_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield from rows()
                        held, size = [], 0
        if held:
            yield from rows()

    counted = training.select("text").mapInArrow(tidy(run), "word long, n long, part int")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("part").alias("part"))


@dataclass
class Gru:
    """Gate inputs by token (z, r, candidate), recurrent weights, class and within-class outputs."""

    gates: np.ndarray  # (tokens, 3 * hidden)
    back: np.ndarray  # (hidden, 2 * hidden) for z and r
    back_n: np.ndarray  # (hidden, hidden)
    class_w: np.ndarray  # (hidden, classes)
    class_b: np.ndarray
    word_w: np.ndarray  # (classes, hidden, CLASS_WORDS)
    word_b: np.ndarray  # (classes, CLASS_WORDS); -inf-like where a class has fewer words

    @property
    def rare(self) -> int:
        """The first rare token; the others follow."""
        return len(self.gates) - RARE

    @property
    def rare_class(self) -> int:
        return len(self.class_b) - RARE

    @classmethod
    def start(cls, n_words: int, counts: np.ndarray, rare_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 5) -> Gru:
        """Small random weights; output biases start at the add-one unigram shares."""
        rng = np.random.default_rng(seed)
        classes = -(-n_words // CLASS_WORDS) if n_words else 0
        share = np.concatenate([counts.astype(float) + 1, np.zeros(classes * CLASS_WORDS - n_words)]).reshape(classes, CLASS_WORDS)
        total = np.concatenate([share.sum(axis=1), rare_counts + 1.0])
        with np.errstate(divide="ignore"):
            word_b = np.maximum(np.log(share / np.maximum(share.sum(axis=1, keepdims=True), 1)), -1e4)
        make = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        return cls(make(n_words + RARE, 3 * hidden), make(hidden, 2 * hidden), make(hidden, hidden), make(hidden, classes + RARE) * 0.1, np.log(total / total.sum()).astype(np.float32), make(classes, hidden, CLASS_WORDS) * 0.1, word_b.astype(np.float32))

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("gates", "back", "back_n", "class_w", "class_b", "word_w", "word_b")}

    def copy(self) -> Gru:
        return Gru(**{k: v.copy() for k, v in self.parts().items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts().values()])

    def moved(self, change: np.ndarray) -> Gru:
        """This network with a change of all parameters, in the order of flat()."""
        out, at = self.copy(), 0
        for v in out.parts().values():
            v += change[at : at + v.size].reshape(v.shape)
            at += v.size
        return out

    def turned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gate inputs and recurrent weights for step: lanes lie side by side, so that a gate is one run of memory, and z and r have the other sign."""
        k = len(self.back)
        gates = np.ascontiguousarray(self.gates.T)
        np.negative(gates[: 2 * k], out=gates[: 2 * k])
        return gates, np.ascontiguousarray(-self.back.T), np.ascontiguousarray(self.back_n.T)

    @staticmethod
    def step(h: np.ndarray, given: np.ndarray, back: np.ndarray, back_n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next state of (hidden, lanes), and z, r and the candidate; weights as turned, given as (3 * hidden, lanes). Gates beyond what a float holds are 0."""
        k = len(h)
        zr = back @ h
        zr += given[: 2 * k]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:k], zr[k:]
        n = back_n @ (r * h)
        n += given[2 * k :]
        np.tanh(n, out=n)
        out = h - n
        out *= z
        out += n
        return out, z, r, n

    def losses(self, h: np.ndarray, word: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(word | h) per row (for rare tokens, of their class only); with grads, also the gradient of -sum by h."""

        def shares(logit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """ln of the chosen column's share, and each row's total; logit becomes the shares times the total, less the total in that column, if there are grads."""
            rows = np.arange(len(own))
            if capped:
                np.minimum(logit, MOST_LOGIT, out=logit)
            chosen = logit[rows, own]
            np.exp(logit, out=logit)
            total = logit @ np.ones(logit.shape[1], logit.dtype)
            found = chosen - np.log(total)
            if grads is not None:
                if capped:  # totals may be too large for products with weights
                    logit /= total[:, None]
                    total[:] = 1
                logit[rows, own] -= total
            return found, total[:, None]

        # States lie between -1 and 1, so the weights bound the logits.
        bounds = [np.abs(self.class_w).sum(axis=0) + self.class_b, np.abs(self.word_w).sum(axis=1) + self.word_b]
        capped = any(x.size and not x.max() < MOST_LOGIT - 1 for x in bounds)
        k = h.shape[1]
        class_w, word_w = np.concatenate([self.class_w, self.class_b[None]]), np.concatenate([self.word_w, self.word_b[:, None]], axis=1)  # a bias is the weight of a last state, one
        group = np.where(word >= self.rare, self.rare_class + word - self.rare, word // CLASS_WORDS)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        word, group = word[order], group[order]
        own = np.ones((len(h), k + 1), h.dtype)
        own[:, :k] = h[order]
        found, dh = np.empty(len(h), h.dtype), None if grads is None else np.empty_like(h)
        change = np.zeros_like(class_w)
        for lo in range(0, len(h), CACHED):
            rows = slice(lo, lo + CACHED)
            p = own[rows] @ class_w
            found[rows], total = shares(p, group[rows])
            if grads is not None:
                change += (own[rows] / total).T @ p
                np.divide(p @ self.class_w.T, total, out=dh[rows])
        if grads is not None:
            grads["class_w"] += change[:k]
            grads["class_b"] += change[k]
        cut = np.searchsorted(group, np.arange(self.rare_class + 1)).tolist()
        named = cut[-1]
        if named:
            p = np.empty((named, CLASS_WORDS), h.dtype)
            there = [c for c in range(self.rare_class) if cut[c] < cut[c + 1]]
            for c in there:
                np.matmul(own[cut[c] : cut[c + 1]], word_w[c], out=p[cut[c] : cut[c + 1]])
            more, total = shares(p, word[:named] - group[:named] * CLASS_WORDS)
            found[:named] += more
            if grads is not None:
                share, back = own[:named] / total, np.empty((named, k), h.dtype)
                for c in there:
                    rows = slice(cut[c], cut[c + 1])
                    change = share[rows].T @ p[rows]
                    grads["word_w"][c] += change[:k]
                    grads["word_b"][c] += change[k]
                    np.matmul(p[rows], self.word_w[c].T, out=back[rows])
                back /= total
                dh[:named] += back
        out = np.empty_like(found)
        out[order] = found
        if dh is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def window_gradient(self, h0: np.ndarray, word: np.ndarray, live: np.ndarray, end: int) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients over one window (time, lanes), and the state after it. Gradients stop at its start."""
        steps, lanes = word.shape
        k = h0.shape[1]
        grads = {name: np.zeros_like(v) for name, v in self.parts().items()}
        gates, back, back_n = self.turned()
        states = np.empty((k, steps + 1, lanes), h0.dtype)
        states[:, 0] = h0.T
        goes_on = (word != end).astype(h0.dtype)
        given = gates.take(word, axis=1)
        kept = []
        with np.errstate(over="ignore"):
            for t in range(steps):
                h, z, r, n = self.step(states[:, t], given[:, t], back, back_n)
                kept.append((z, r, n))
                np.multiply(h, goes_on[t], out=states[:, t + 1])
        flat = states[:, :-1].reshape(k, -1)
        which = np.flatnonzero(live.ravel())
        loss, d = self.losses(flat.T[which], word.ravel()[which], grads)
        dh_out = np.zeros_like(flat)
        dh_out[:, which] = d.T
        dh_out = dh_out.reshape(k, steps, lanes)
        dgiven, reset = np.empty_like(given), np.empty_like(dh_out)
        ahead = np.zeros((k, lanes), h0.dtype)
        for t in range(steps - 1, -1, -1):
            z, r, n = kept[t]
            h, own = states[:, t], dgiven[:, t]
            ahead *= goes_on[t]
            g, z_off = ahead, 1 - z
            dn = np.multiply(g, z_off, out=own[2 * k :])
            dn -= n * n * dn
            drh = self.back_n @ dn
            dz = np.multiply(h - n, g, out=own[:k])
            z_off *= z
            dz *= z_off
            np.multiply(r, h, out=reset[:, t])
            dr = np.multiply(drh, reset[:, t], out=own[k : 2 * k])
            dr *= 1 - r
            drh *= r
            ahead = g * z
            ahead += drh
            ahead += self.back @ own[: 2 * k]
            ahead += dh_out[:, t]
        rows = dgiven.reshape(3 * k, -1)
        grads["back_n"] += reset.reshape(k, -1) @ rows[2 * k :].T
        grads["back"] += flat @ rows[: 2 * k].T
        names = word.ravel().astype(np.uint16)
        order = np.argsort(names, kind="stable")
        names = names[order]
        at = run_starts(names)
        grads["gates"][names[at]] += np.add.reduceat(rows.take(order, axis=1), at, axis=1).T
        return float(-loss.sum()), grads, states[:, -1].T.copy()


def lanes_of(border: np.ndarray, lanes: int) -> list[list[int]]:
    """Rows dealt to lanes, longest first to the shortest lane, so that lanes end together."""
    import heapq

    length = np.diff(border)
    heap = [(0, i) for i in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for row in np.argsort(-length, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        dealt[i].append(row)
        heapq.heappush(heap, (n + int(length[row]), i))
    return [x for x in dealt if x]


def lane_grid(word: np.ndarray, border: np.ndarray, dealt: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(time, lanes) positions into word, -1 where a lane has ended; and the same shape's liveness."""
    length = np.diff(border)
    deep = max(int(length[rows].sum()) for rows in dealt)
    grid = np.full((deep, len(dealt)), -1, np.int32)
    for i, rows in enumerate(dealt):
        at = np.concatenate([np.arange(border[r], border[r + 1]) for r in rows])
        grid[: len(at), i] = at
    return grid, grid >= 0


class Moments:
    """Running moments of gradients, kept from chunk to chunk."""

    def __init__(self, model: Gru):
        self.first = {k: np.zeros_like(v) for k, v in model.parts().items()}
        self.second = {k: np.zeros_like(v) for k, v in model.parts().items()}
        self.steps = 0


def train(model: Gru, word: np.ndarray, end: int, rate: float = RATE, lanes: int = LANES, moments: Moments | None = None, warm: int = 20) -> float:
    """One pass of truncated backpropagation with adaptive moments, which go on from chunk to chunk; returns the mean loss per token.

    The documents of a chunk, one after the other, are cut into lanes of equal length; a lane's
    state goes on from window to window and starts anew with each document.
    """
    if not len(word):
        return 0.0
    lanes = max(1, min(lanes, len(word) // (WINDOW * LEAST_UPDATES)))
    deep = -(-len(word) // lanes)
    grid = np.arange(deep)[:, None] + deep * np.arange(lanes)[None, :]
    live = grid < len(word)
    parts, moments = model.parts(), moments or Moments(model)
    h, told, step = np.zeros((grid.shape[1], model.back.shape[0]), np.float32), 0.0, {k: np.empty_like(v) for k, v in parts.items()}
    for at in range(0, len(grid), WINDOW):
        g, ok = grid[at : at + WINDOW], live[at : at + WINDOW]
        loss, grads, h = model.window_gradient(h, np.where(ok, word[np.minimum(g, len(word) - 1)], end), ok, end)
        told += loss
        moments.steps += 1
        n, count = moments.steps, max(1, int(ok.sum()))
        norm = math.sqrt(sum(float(np.vdot(v, v)) for v in grads.values())) / count
        scale = np.float32(min(1.0, 5 / max(norm, 1e-9)) / count)
        pace = np.float32(rate * min(1.0, n / warm) / (1 - 0.9**n))
        level = np.float32(1 / math.sqrt(1 - 0.99**n))
        for k, v in parts.items():
            d, first, second, move = grads[k], moments.first[k], moments.second[k], step[k]
            d *= scale
            first *= np.float32(0.9)
            np.multiply(d, np.float32(0.1), out=move)
            first += move
            second *= np.float32(0.99)
            d *= d
            d *= np.float32(0.01)
            second += d
            np.sqrt(second, out=move)
            move *= level
            move += np.float32(1e-7)
            np.divide(first, move, out=move)
            move *= pace
            v -= move
    return told / max(1, int(live.sum()))


def score_rows(model: Gru, word: np.ndarray, border: np.ndarray, end: int, lanes: int = LANES) -> np.ndarray:
    """ln-likelihood of each row, rare tokens by class only. State goes on from window to window."""
    rows = len(border) - 1
    out = np.zeros(len(word), np.float32)
    grid, live = lane_grid(word, border, lanes_of(border, max(1, min(lanes, rows))))
    gates, back, back_n = model.turned()
    h = np.zeros((len(back_n), grid.shape[1]), np.float32)
    lane, at = np.arange(grid.shape[1]), 0
    while at < len(grid):
        active = np.flatnonzero(live[at, lane])  # lanes end for good
        if len(active) < len(lane):
            lane, h = lane[active], h[:, active]
        until = at + max(WINDOW, AT_ONCE // len(lane))  # long windows where few lanes are left
        g, ok = grid[at:until, lane], live[at:until, lane]
        w = np.where(ok, word[g], end)
        states = np.empty((len(h), *g.shape), np.float32)
        given, goes_on = gates.take(w, axis=1), (w != end).astype(np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(g)):
                states[:, t] = h
                h = model.step(h, given[:, t], back, back_n)[0]
                h *= goes_on[t]
        which = np.flatnonzero(ok.ravel())
        out[g.ravel()[which]] = model.losses(states.reshape(len(h), -1).T[which], w.ravel()[which])[0]
        at = until
    return np.add.reduceat(out.astype(np.float64), border[:-1])


class Finder:
    """Places in sorted hashes by their leading bits: as np.searchsorted, but for a few steps within a bucket; beyond the last, the last."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = U64(64 - max(1, (4 * len(words)).bit_length()))
        self.first = np.searchsorted(words >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max())

    def places(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(self.first[h >> self.shift], len(self.words) - 1)
        left = np.flatnonzero(self.words[at] < h)
        for _ in range(self.most):
            left = left[at[left] < len(self.words) - 1]
            at[left] += 1
            left = left[self.words[at[left]] < h[left]]
            if not len(left):
                break
        return at


@dataclass
class Scorer:
    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    named: np.ndarray  # the network's token of each, or the first rare token where it has none
    model: Gru
    end: int
    rare_totals: np.ndarray  # of each rare class: its tokens and distinct words, and one

    @cached_property
    def finder(self) -> Finder:
        return Finder(self.words)

    def look_up(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into words or -1, network token) of each token."""
        rare, group = self.model.rare, group.astype(np.int64)
        if not len(self.words):
            return np.full(len(h), -1), rare + group
        at = self.finder.places(h)
        known = self.words[at] == h
        token = np.where(known, self.named[at], rare)
        return np.where(known, at, -1), np.where(token == rare, rare + group, token)


def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (change, n) row: the mean of rows' changes by n."""
    total, n = None, 0
    for b in batches:
        for change, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(change.as_buffer(), np.float32)
            n += k
            total = part.copy() if total is None else total + (part - total) * np.float32(k / n)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["change", "n"])


def fit(docs: DataFrame, scorer: Scorer, rounds: int = ROUNDS) -> Gru:
    """The scorer's network trained on all rows of docs (doc_id, text), each in one of the rounds."""
    spark = docs.sparkSession

    def one_round(k: int) -> np.ndarray | None:
        shared = spark.sparkContext.broadcast(scorer)  # FREQUENT words and the network: of fixed size
        rate = RATE * (1 - k / rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = shared.value
            model, n = s.model.copy(), 0
            moments = Moments(model)
            for b in gathered(batches, CHUNK):
                for _, flat, off in chunks(b.column(0), CHUNK):
                    h, _, group = tokens(flat, off)
                    train(model, s.look_up(h, group)[1], s.end, rate, moments=moments)
                    n += len(h)
            if n:
                change = (model.flat() - s.model.flat()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([change.tobytes()], pa.binary()), pa.array([n])], ["change", "n"])

        own = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k)
        changes = stage(own.select("text").mapInArrow(tidy(run), "change binary, n long"), "changes")
        left = changes.count()
        while left > 1:  # a tree: each task takes about MERGED changes
            left = -(-left // MERGED)
            changes = changes.repartition(left).mapInArrow(tidy(average), "change binary, n long")
        got = changes.first()
        shared.unpersist()
        return None if got is None else np.frombuffer(bytes(got["change"]), np.float32)

    for k in range(rounds):
        change = one_round(k)
        if change is not None:
            scorer = Scorer(scorer.words, scorer.counts, scorer.named, scorer.model.moved(change), scorer.end, scorer.rare_totals)
    return scorer.model


def learn(docs: DataFrame, counts: DataFrame) -> tuple[Scorer, int, int]:
    """The scorer and N, V."""
    parts = {r["part"]: (r["n"], r["v"]) for r in counts.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # RARE rows
    n, v = (sum(x[k] for x in parts.values()) for k in range(2))
    top = top_rows(counts, "n", FREQUENT, "word").toPandas().sort_values(["n", "word"], ascending=[False, True])
    word, c, part = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["part"].to_numpy(np.int64)
    if not (word == END).any():
        row = counts.filter(F.col("word") == int(END.astype(np.int64))).select("n").first()
        word, c, part = np.r_[word, END], np.r_[c, row["n"] if row else 0], np.r_[part, 0]
    size = min(len(word), VOCABULARY)
    if not (word[:size] == END).any():  # the end is always named
        last = int(np.flatnonzero(word == END)[0])
        order = np.r_[np.arange(size - 1), last, np.setdiff1d(np.arange(size - 1, len(word)), [last])]
        word, c, part = word[order], c[order], part[order]
    where = int(np.flatnonzero(word[:size] == END)[0])
    there = c[:size] > 0
    rare = np.array([sum(parts.get(g, (0, 0))) for g in range(RARE)], np.float64)
    rare -= np.bincount(part[:size], c[:size] + there, minlength=RARE)
    model = Gru.start(size, c[:size], rare)
    order = np.argsort(word)
    named = np.minimum(np.arange(len(word)), size)
    scorer = Scorer(word[order], c[order], named[order], model, where, rare + 1)
    scorer.model = fit(docs, scorer)
    return scorer, n, v


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, n_tokens, frequent, base_part, rare_part, model_ln) by the network and the frequent words; rare_part has the rare tokens' shares of their classes, less what their own counts add if they aren't frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # FREQUENT words and the network: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        logs, totals = np.log10(s.counts + 1.0), np.log10(s.rare_totals)
        for b in gathered(batches, 2 * CHUNK):
            for first, flat, off in chunks(b.column(1), 2 * CHUNK):
                h, border, group = tokens(flat, off)
                at, word = s.look_up(h, group)
                known = (at >= 0) & (s.counts[at] > 0)
                part = np.where(at >= 0, logs[at], 0)
                rare = word >= s.model.rare
                add = lambda x: np.add.reduceat(x.astype(np.float64), border[:-1])  # noqa: E731, B023
                arrays = [pa.array(np.diff(border)), pa.array(add(known).astype(np.int64)), pa.array(add(part)), pa.array(add(np.where(rare, part - totals[group], 0))), pa.array(score_rows(s.model, word, border, s.end))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(off) - 1), *arrays], ["doc_id", "n_tokens", "frequent", "base_part", "rare_part", "model_ln"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, frequent long, base_part double, rare_part double, model_ln double")


def other_words(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, word, times) of the words that aren't frequent; one row per document and word."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        finder = Finder(known) if len(known) else None
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, flat, off in chunks(b.column(1)):
                h, border, _ = tokens(flat, off)
                row = np.repeat(np.arange(len(border) - 1), np.diff(border))
                if len(known):
                    other = known[finder.places(h)] != h
                    h, row = h[other], row[other]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                if len(h):
                    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first + row[at]]), pa.array(h[at].view(np.int64)), pa.array(np.diff(np.r_[at, len(h)]).astype(np.int32))], ["doc_id", "word", "times"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, word long, times int")


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with the base and the model's log10 likelihood."""
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = stage(token_counts(training), "counts")
    scorer, n, v = learn(training.select("doc_id", "text"), counts)
    # A repeated row adds its words again, so sums are divided by the doc_id's rows.
    parts = other_words(docs, scorer.words).join(counts, "word").groupBy("doc_id").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    rows = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    parts = parts.join(rows, "doc_id").select("doc_id", (F.col("more") / F.col("rows")).alias("more"), (F.col("more_known") / F.col("rows")).cast("long").alias("more_known"))
    joined = scored(docs, scorer).join(parts, "doc_id", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return joined.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("frequent") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_part") + more - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("model_ln") / F.lit(LN10) + F.col("rare_part") + more).alias("score"),
    )


def op9_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
