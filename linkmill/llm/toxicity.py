"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks, trained on labelled sentences."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident
from .quality import is_held_out, labelled

#: The kernel: subsequences of three letters, each at most REACH letters after the one before, and DECAY for each letter they span.
REACH, DECAY = 3, 0.7
#: Letters of a piece: longer words are cut, and every two neighbouring pieces are looked at together.
PIECE = 20
#: Classes of letters: the border before a piece, a to z, and folded classes for all other letters.
CLASSES, BORDER = 48, 0
#: Landmarks; labelled rows that the fit gathers at most; pieces of clean rows in the first round and those added in each further one.
LANDMARKS, MAX_ROWS, PLAIN, HARD = 64, 4000, 8000, 4000
#: A toxic piece stands in this many toxic rows at least, and in this many times as many of them as of clean rows; two landmarks agree less than UNLIKE.
SEEN, TIMES, UNLIKE = 2, 20, 0.6
#: Landmarks of clean words that come nearest, and how much two of all landmarks may agree then.
CLEAN, CLOSE = 48, 0.9
#: Rounds of the fit, steps of the SVM in each, its ridge, and the value from which a piece counts as evidence besides the worst one.
ROUNDS, STEPS, RIDGE, HALF = 3, 500, 1e-4, 0.0
#: A missed toxic row counts as much as this many clean rows taken for toxic.
WEIGHT = 3.0
#: Characters that are worked on at a time.
BLOCK = 1 << 15


@cache
def classes() -> np.ndarray:
    """The class of each code point of the basic plane: 0 no letter, else 1 to CLASSES - 1; accents are folded."""
    out = np.zeros(1 << 16, np.int64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27 + i % (CLASSES - 27)
    return out


def letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a text's letters, the number of the piece and of the sentence that each is of, and its place in the text.

    A sentence ends at a line break, or at . ! ? before white space. Marks and digits are left out, so a
    marked word is whole again; single letters in a row are one piece. A piece begins with BORDER, a
    letter of its own: subsequences that hold it tell how words begin. Letters beyond the plane count as none.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return (np.zeros(0, np.int64),) * 4
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    after = np.r_[blank[1:], True]
    stop = (c == 10) | (((c == 46) | (c == 33) | (c == 63)) & after)
    kind = np.where(c > 0xFFFF, 0, classes()[np.minimum(c, 0xFFFF)])
    place = np.flatnonzero(kind)
    kind, at, word = kind[place], (np.cumsum(stop) - stop)[place], np.cumsum(blank)[place]
    if not len(kind):
        return kind, word, at, place
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    size = np.diff(np.r_[first, len(kind)])
    single = (size == 1) & np.r_[False, (size[:-1] == 1) & (at[first[1:]] == at[first[:-1]])]
    within = np.arange(len(kind)) - np.repeat(np.maximum.accumulate(np.where(single, 0, first)), size)
    begin = np.flatnonzero(within % PIECE == 0)
    border = lambda x, new: np.insert(x, begin, new)
    return border(kind, BORDER), border(np.cumsum(within % PIECE == 0) - 1, np.arange(len(begin))), border(at, at[begin]), border(place, place[begin])


def chains(kind: np.ndarray, gap: int):
    """The codes of the three letters of each subsequence of gap + 1 letters from first to last, by its last letter."""
    front, back = kind[:-gap] * CLASSES**2, kind[gap:]
    for second in range(max(1, gap - REACH), min(REACH, gap - 1) + 1):
        yield front + kind[gap - second : len(kind) - second] * CLASSES + back


GAPS = range(2, 2 * REACH + 1)


@cache
def scales(size: int) -> np.ndarray:
    """For pieces of 0 to `size` letters, the root of all their subsequences' squared weights."""
    n = np.arange(size + 1)
    return np.sqrt(sum(np.maximum(0, n - g) * (min(REACH, g - 1) - max(1, g - REACH) + 1) * DECAY ** (2 * g + 2) for g in GAPS))


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 16)
def phi(word: str) -> dict[int, float]:
    """A word's weights of its subsequences."""
    kind = letters(word)[0]
    out: dict[int, float] = {}
    for gap in GAPS:
        for codes in chains(kind, gap) if len(kind) > gap else ():
            for c in codes.tolist():
                out[c] = out.get(c, 0.0) + DECAY ** (gap + 1)
    return out


def dot(a: dict, b: dict) -> float:
    return sum(v * b[k] for k, v in a.items() if k in b)


def agree(a: dict, b: dict) -> float:
    """The normalised kernel of two words."""
    return dot(a, b) / math.sqrt(max(1e-12, dot(a, a) * dot(b, b)))


def in_pieces(kind: np.ndarray, word: np.ndarray, at: np.ndarray, weigh) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, then each two neighbouring pieces: the sum of weigh(codes) over their subsequences, scaled; and the pieces' first letters.

    The subsequences of two pieces of a sentence are those of each and those that cross from one to the other.
    """
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    size = np.diff(np.r_[first, len(kind)])
    own = over = None
    for gap in GAPS:
        if len(kind) <= gap:
            break
        sums = sum(weigh(codes) for codes in chains(kind, gap)) * DECAY ** (gap + 1)
        step = word[gap:] - word[:-gap]
        if own is None:
            own, over = (np.zeros((len(kind), *sums.shape[1:])) for _ in "ab")
        own[gap:][step == 0] += sums[step == 0]
        cross = (step == 1) & (at[gap:] == at[:-gap])
        over[gap:][cross] += sums[cross]
    if own is None:
        return np.zeros((0,)), first
    own, over = np.add.reduceat(own, first), np.add.reduceat(over, first)
    joined = own[:-1] + own[1:] + over[1:]
    joined[at[first[1:]] != at[first[:-1]]] = 0
    total = np.concatenate([own, joined])
    norm = np.maximum(scales(2 * PIECE + 2)[np.r_[size, size[:-1] + size[1:]]], 1e-6)
    return total / norm.reshape(-1, *[1] * (total.ndim - 1)), first


def parts(texts: list[str]):
    """The texts by number; a text of over BLOCK characters in parts that begin with the last word of the one before."""
    for i, t in enumerate(texts):
        start = 0
        while len(t) - start > BLOCK:
            end = t.rfind(" ", start + BLOCK // 2, start + BLOCK)
            end = start + BLOCK if end < 0 else end
            yield i, t[start:end]
            start = max(start + 1, t.rfind(" ", end - 3 * PIECE, end) + 1 or end)
        yield i, t[start:]


_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n")


class Sentences:
    """The sentences of labelled rows as bags of words: all distinct words, each sentence's words, and each row's sentences."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.of, sizes, rows = [], [], []
        for i, t in enumerate(texts):
            for s in _SENTENCE.split(t.lower()):
                if own := {w[j : j + PIECE] for w in _WORD.findall(s) for j in range(0, len(w), PIECE)}:
                    self.of += sorted(number.setdefault(w, len(number)) for w in sorted(own))  # a set's order differs from run to run
                    sizes.append(len(own))
                    rows.append(i)
        self.words, self.of, self.rows = list(number), np.array(self.of, np.int64), np.array(rows, np.int64)
        self.first = np.cumsum([0, *sizes])[:-1].astype(np.int64)

    def in_rows(self, keep: np.ndarray) -> np.ndarray:
        """In how many of the rows `keep` each word stands."""
        sizes = np.diff(np.r_[self.first, len(self.of)])
        row = np.repeat(self.rows, sizes)
        pairs = np.unique(row[keep[row]] * len(self.words) + self.of[keep[row]])
        return np.bincount(pairs % max(1, len(self.words)), minlength=len(self.words))

    def worst(self, value: np.ndarray) -> np.ndarray:
        """The word of the largest value in each sentence, the first among equals."""
        own = value[self.of]
        top = np.maximum.reduceat(own, self.first)
        hit = np.flatnonzero(own == np.repeat(top, np.diff(np.r_[self.first, len(own)])))
        sentence = np.searchsorted(self.first, hit, "right") - 1
        return self.of[hit[np.unique(sentence, return_index=True)[1]]]


class Model:
    """Scores a text by its worst pieces; the machine's weights of all landmarks are summed for each subsequence."""

    def __init__(self):
        self.marks: list[str] = []
        self.table = np.zeros(CLASSES**3, np.float32)
        self.bias, self.trust = -1.0, np.array([1.0, 0.0, 0.0, 0.0, -2.0])

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each whole text: the values of its worst piece and of its worst two neighbours joined, how far its pieces exceed HALF altogether, and that for a piece."""
        best, pair_best, more, n = np.full(len(texts), self.bias), np.full(len(texts), self.bias), np.zeros(len(texts)), np.zeros(len(texts))
        held, size = [], 0
        for part in [*parts(texts), None]:
            if held and (part is None or size + len(part[1]) > BLOCK):
                kind, word, at, place = letters("\n".join(s for _, s in held))
                value, first = in_pieces(kind, word, at, self.table.__getitem__) if len(kind) else (np.zeros(0), place)
                if len(value):
                    ends = np.cumsum([len(s.lower()) + 1 for _, s in held])
                    of = np.array([i for i, _ in held])[np.searchsorted(ends, place[first], "right")]
                    pair = at[first[1:]] == at[first[:-1]]
                    own, joined = value[: len(first)] + self.bias, value[len(first) :][pair] + self.bias
                    np.maximum.at(best, of, own)
                    np.maximum.at(pair_best, of[1:][pair], joined)
                    more += np.bincount(of, np.maximum(0, own - HALF), len(texts))
                    n += np.bincount(of, minlength=len(texts))
                held, size = [], 0
            if part is not None:
                held.append(part)
                size += len(part[1])
        return np.c_[best, pair_best, np.log1p(more), 100 * more / (n + 50)]

    def space(self, chosen: list[dict], words: list[str]) -> np.ndarray:
        """The words in the Nystroem space of the landmarks; a word without letters is at its origin."""
        norm = [math.sqrt(dot(m, m)) for m in chosen]
        codes = sorted({c for m in chosen for c in m})
        row = np.zeros(CLASSES**3, np.int32)
        row[codes] = np.arange(1, len(codes) + 1)
        weight = np.zeros((len(codes) + 1, len(chosen)), np.float32)
        for j, m in enumerate(chosen):
            for c, v in m.items():
                weight[row[c], j] = v / norm[j]
        e, u = np.linalg.eigh(np.array([[agree(a, b) for b in chosen] for a in chosen]))
        keep = e > 1e-3
        nystroem = (u[:, keep] / np.sqrt(e[keep])).astype(np.float32)
        self.maps = weight, nystroem, row
        x = np.zeros((len(words), nystroem.shape[1]), np.float32)
        known = np.array([i for i, w in enumerate(words) if any(ord(c) < 1 << 16 and classes()[ord(c)] for c in w)])
        for i in range(0, len(known), 2000):
            kind, word, at, _ = letters("\n".join(words[j] for j in known[i : i + 2000]))
            value, first = in_pieces(kind, word, at, lambda c: weight[row[c]])
            x[known[i : i + 2000]] = value[: len(first)] @ nystroem
        return x

    def fit(self, texts: list[str], y: list[int]) -> Model:
        """Multiple instances: of a toxic row the worst sentence is toxic, of a clean row all sentences are clean; a sentence is as bad as its worst word."""
        y = np.array(y, bool)
        if not y.any() or y.all():
            return self
        data = Sentences(texts)
        bad, good = data.in_rows(y), data.in_rows(~y)
        odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((~y).sum() + 1))
        seeds = [i for i in np.lexsort((np.array(data.words), -bad)) if bad[i] >= SEEN and bad[i] >= TIMES * good[i]] if data.words else []
        chosen: list[dict] = []
        for i in seeds:
            m = phi(data.words[i])
            if m and len(chosen) < LANDMARKS and all(agree(m, o) < UNLIKE for o in chosen):
                chosen.append(m)
                self.marks.append(data.words[i])
        if not chosen:
            return self
        x = self.space(chosen, data.words)
        plain = np.array(sorted(np.flatnonzero(good > 0), key=lambda i: zlib.crc32(data.words[i].encode()))[:PLAIN])
        toxic, v = y[data.rows], np.zeros(x.shape[1])
        value = np.where((bad >= SEEN) & (bad >= TIMES * good), odds, -np.inf)
        for turn in range(ROUNDS):
            # The machine so far, at first the words' odds, says which sentence of a toxic row is meant and which clean sentences come near.
            worst = data.worst(value)
            order = np.lexsort((-value[worst[toxic]], data.rows[toxic]))
            pos = worst[toxic][order[np.unique(data.rows[toxic][order], return_index=True)[1]]]
            pos = pos[value[pos] > (-np.inf if turn else 0)]
            near = np.unique(worst[~toxic])
            neg = np.concatenate([plain, near[np.argsort(-value[near], kind="stable")[:HARD]]])
            s = np.concatenate([x[pos], x[neg]]).astype(np.float64)
            t = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
            cost = np.r_[np.full(len(pos), 0.5 / max(1, len(pos))), np.full(len(plain), 0.5 / max(1, len(plain))), np.full(len(neg) - len(plain), 0.5 / max(1, len(neg) - len(plain)))]
            m, q = np.zeros_like(v), np.zeros_like(v)
            for step in range(1, STEPS + 1):  # squared hinge, Adam
                d = -2 * (cost * t * np.maximum(0, 1 - t * (s @ v + self.bias))) @ s + 2 * RIDGE * v
                m, q = 0.9 * m + 0.1 * d, 0.999 * q + 0.001 * d * d
                v = v - 0.05 * math.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(q) + 1e-8)
            value = x @ v
            if turn == 0:  # clean words that come near are landmarks too
                near = [phi(data.words[i]) for i in near[np.argsort(-value[near], kind="stable")[: 8 * CLEAN]]]
                before = len(chosen)
                for m in near:
                    if m and len(chosen) < before + CLEAN and all(agree(m, o) < CLOSE for o in chosen):
                        chosen.append(m)
                x = self.space(chosen, data.words)
                v = np.zeros(x.shape[1])
        weight, nystroem, row = self.maps
        self.table = np.r_[0.0, weight[1:] @ (nystroem @ v)].astype(np.float32)[row]
        del self.maps
        # All gathered rows set how much the evidence counts and where one half lies.
        x = np.c_[self.evidence(texts), np.ones(len(texts))]
        c, g, share = np.zeros(5), np.zeros(5), np.where(y, WEIGHT, 1.0)
        for _ in range(3000):  # logistic, Adagrad
            d = (share * (1 / (1 + np.exp(-np.clip(x @ c, -30, 30))) - y)) @ x / share.sum()
            g += d * d
            c -= 0.3 * d / (np.sqrt(g) + 1e-8)
        self.trust = c
        return self

    def scores(self, texts: list[str]) -> list[float]:
        x = self.evidence(texts) if self.marks else np.tile([self.bias, self.bias, 0.0, 0.0], (len(texts), 1))
        return (1 / (1 + np.exp(-np.clip(x @ self.trust[:4] + self.trust[4], -30, 30)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> Model:
    rows = labelled(docs, labels, "toxic", 5, ~is_held_out(5, 0), limit)
    return Model().fit([r.text for r in rows], [r.y for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    The machine learns from sentences: every sentence of a clean row is clean, of a toxic row the worst one is
    toxic, which the machine itself chooses anew in each round; a sentence is as bad as its worst word. A whole
    text is scored by its worst piece, its worst two neighbours joined (so that a split word is whole again), and how
    many pieces are like it. The kernel of every piece with every landmark is exact: its subsequences have
    bounded steps, so each letter ends nine of them, and the machine's value is a sum of one table's
    entries. Landmarks are words of toxic rows and the clean words that come nearest to them. The model has a
    fixed size and learns from at most MAX_ROWS labelled rows.

    Null or empty text has no sentence and the score of no resemblance, a low one; without labels of
    both kinds every score is that. Very long texts are worked on in blocks. Ties
    and repeated rows are scored alike; a null doc_id is not held out. Empty table: empty result.
    Other columns are not read.
    """
    state = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    name = uuid.uuid4().hex

    def run(batches):
        own = resident(("toxicity", name), lambda: state.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            s = [x for i in range(0, len(texts), 256) for x in own.scores(texts[i : i + 256])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(is_held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
