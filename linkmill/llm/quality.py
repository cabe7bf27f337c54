"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

#: Hashed words, factors, passes, and the most labelled rows that the fit gathers.
SLOTS, FACTORS, EPOCHS, MAX_ROWS = 1 << 15, 4, 6, 6000
#: Structure statistics follow the words' slots; each is cut into this many steps.
STEPS = 8
#: Most words whose slots a worker remembers.
REMEMBER = 100_000
_SENTENCE = re.compile(r"[.!?]+")


def structure(text: str, words: list[str], tf: Counter) -> list[float]:
    """Shares and sizes from 0 to 1 that describe a text's form; its length is the metadata."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text[:0])) if not text else len(re.findall(r"[^\W\d_]", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    digits = len(re.findall(r"\d", text))
    spaces = len(re.findall(r"\s", text))
    top = tf.most_common(1)[0][1] if tf else 0
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [letters / n, upper / max(1, letters), digits / n, 1 - (letters + digits + spaces) / n, len(tf) / m, top / m, same / m,
            min(1, len(text) / m / 20), len(set(lines)) / len(lines), min(1, len(_SENTENCE.findall(text)) / m), min(1, math.log1p(len(text)) / 12), min(1, math.log1p(m) / 10),
            text.count("|") / m, text.count("!") / m]


KINDS = 14
SIZE = SLOTS + KINDS * (STEPS + 1)


class Slots(dict):
    """The slot of each word, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        got = self[word] = zlib.crc32(word.encode()) % SLOTS
        return got


def features(text: str, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text; the words' part has length one."""
    words = text.split()
    tf = Counter(words)
    form = structure(text, words, tf)
    bag: dict[int, float] = {}
    for w, n in tf.items():
        s = slots[w]
        bag[s] = bag.get(s, 0) + n
    val = np.log1p(np.fromiter(bag.values(), np.float32, len(bag)))
    val /= max(1e-6, float(np.sqrt((val * val).sum())))
    idx = [SLOTS + k * (STEPS + 1) + min(STEPS, int(max(0.0, v) * STEPS * 0.999)) for k, v in enumerate(form)]
    return np.concatenate([np.fromiter(bag.keys(), np.int64, len(bag)), idx]), np.concatenate([val, np.full(KINDS, 0.5, np.float32)])


class Machine:
    """w0 + sum w x + half of (sum v x)^2 - sum v^2 x^2: the pairs' sum in linear time."""

    def __init__(self, seed: int = 7):
        self.slots = Slots()
        r = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(SIZE, np.float32), r.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)

    def raw(self, idx, val) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, text: str) -> float:
        z = self.raw(*features(text, self.slots))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, texts: list[str], y: list[int], seed: int = 7) -> Machine:
        """Adagrad on the logistic loss over mini-batches."""
        rows = [features(t, self.slots) for t in texts]
        y = np.array(y, np.float32)
        if not len(rows):
            return self
        gw, gv, g0 = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            turn = order.permutation(len(rows))
            for a in range(0, len(turn), 64):
                part = turn[a : a + 64]
                idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                n = np.array([len(rows[i][0]) for i in part])
                at = np.r_[0, np.cumsum(n)[:-1]]
                vx = self.v[idx] * val[:, None]
                s = np.add.reduceat(vx, at)
                z = self.w0 + np.add.reduceat(self.w[idx] * val, at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), at))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                each = np.repeat(g, n)[:, None] * val[:, None]
                slots, back = np.unique(idx, return_inverse=True)
                dw, dv = np.zeros(len(slots), np.float32), np.zeros((len(slots), FACTORS), np.float32)
                np.add.at(dw, back, each[:, 0])
                np.add.at(dv, back, each * (np.repeat(s, n, axis=0) - vx))
                dw += 1e-5 * self.w[slots]
                dv += 1e-4 * self.v[slots]
                gw[slots] += dw * dw
                gv[slots] += dv * dv
                g0 += float(g.sum()) ** 2
                self.w[slots] -= 0.1 * dw / np.sqrt(gw[slots])
                self.v[slots] -= 0.02 * dv / np.sqrt(gv[slots])
                self.w0 -= 0.1 * float(g.sum()) / math.sqrt(g0)
        return self


def loaded(w0, w, v) -> Machine:
    """A fitted machine in a Python worker."""
    m = Machine.__new__(Machine)
    m.w0, m.w, m.v, m.slots = w0, w, v, resident(("slots",), Slots)
    return m


def is_held_out(mod: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest


def labelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, keep, limit: int) -> list:
    """At most `limit` labelled rows outside the held-out fold, in the order of a hash of doc_id.

    Of rows that share a doc_id, and of its labels, the smallest text and label count, so that reruns agree.
    """
    learn = labels.filter(F.col(column).isNotNull()).filter(keep).select("doc_id", F.col(column).cast("int").alias("y"), F.xxhash64("doc_id").alias("o"))
    chosen = learn.groupBy("doc_id", "o").agg(F.min("y").alias("y")).orderBy("o", "doc_id").limit(limit)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "o", "y").agg(F.min("text").alias("text")).orderBy("o", "doc_id").select("text", "y").collect()


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> Machine:
    rows = labelled(docs, labels, "quality", 4, ~is_held_out(4, 2), limit)
    return Machine().fit([r.text for r in rows], [r.y for r in rows])


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row, from the whole text alone. Null text is empty."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def run(batches):
        m = loaded(*model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    The model has a fixed size (SLOTS words and the statistics' steps) and is fit on at most
    MAX_ROWS labelled rows. Without labels every score is 0.5. Null text is scored as the empty
    text; very long texts are read whole; repeated rows get one score each; a null doc_id is not
    held out; an empty table gives an empty result. Other columns are not read.
    """
    return score_documents(docs, fit(docs, labels)).select("doc_id", F.coalesce(is_held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows and columns of docs whose score reaches the threshold, scored in the same pass."""
    m = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((m.w0, m.w, m.v))

    at = docs.columns.index("text")

    def run(batches):
        m = loaded(*model.value)
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py() or "") >= threshold for t in b.column(at)]))

    return docs.mapInArrow(run, docs.schema)
