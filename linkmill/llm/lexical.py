"""Ranked lexical search by a hierarchical max tree over document ranges."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: A term: a run of these, in SQL.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes: A-Z lower-cased, all that ends a term made a blank.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Documents of an item's answer.
TOP = 50
#: Terms of all items of a block: they are broadcast, and each block reads the documents once.
TERMS = 1 << 14
#: Documents of a leaf, children of a node, and most documents and postings of a tree.
LEAF, FAN, DOCUMENTS, POSTINGS = 32, 8, 1 << 14, 1 << 21


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (each once) of the distinct items that have a term."""
    found = F.array_distinct(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), F.lit(0)))
    return items.select("item_id", "text").distinct().select("item_id", found.alias("terms")).filter(F.size("terms") > 0)


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all its terms), t and tf (numbers of the `terms` that it holds, and how often) of every document."""
    state = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def run(batches):
        number = state.value.get
        for b in batches:
            n, at, t, tf = [], [0], [], []
            for text in b.column(1).to_pylist():
                found = text.translate(BYTES).split(b" ")
                counts = Counter(map(number, found))
                counts.pop(None, None)
                n.append(len(found) - found.count(b""))
                t += counts.keys()
                tf += counts.values()
                at.append(len(t))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(t, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], ["doc_id", "n", "t", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, t array<int>, tf array<int>")


class Tree:
    """Some documents' postings of the items' terms, and for each term the maxima of its scores over ranges of documents.

    Documents are ordered by length, so that a range's scores are alike. A leaf is a range of LEAF documents; a node
    has the maxima of its FAN children.
    """

    def __init__(self, ids, n, at, terms, tf, weight, total, words):
        by_size = np.argsort(n, kind="stable")
        place = np.empty(len(n), np.int64)
        place[by_size] = np.arange(len(n))
        self.ids = [ids[i] for i in by_size]
        doc = place[np.repeat(np.arange(len(n)), np.diff(at))]
        order = np.argsort(doc, kind="stable")
        doc, terms, tf = doc[order], terms[order], tf[order].astype(np.int64)
        wide = 50 * int(n.max(initial=0)) * total < 1 << 63
        m = 50 + (50 * n * total // words if wide else np.array([50 * int(x) * total // words for x in n], np.int64))
        self.doc, self.score = doc, weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[by_size][doc]))
        self.own, self.term = np.unique(terms, return_inverse=True)
        leaves = -(-len(n) // LEAF)
        self.start = np.searchsorted(doc, np.arange(leaves + 1) * LEAF)
        key = self.term * leaves + doc // LEAF
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0]) if len(key) else np.zeros(0, np.int64)
        level = np.zeros((len(self.own), leaves), np.int64)
        if len(key):
            level.reshape(-1)[key[order][first]] = np.maximum.reduceat(self.score[order], first)
        self.levels = [level]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            low = np.pad(low, ((0, 0), (0, -low.shape[1] % FAN)))
            self.levels.append(low.reshape(len(self.own), low.shape[1] // FAN, FAN).max(2))

    def leaf(self, number: int, member: np.ndarray) -> np.ndarray:
        """The scores of a leaf's documents by the terms in `member`."""
        part = slice(self.start[number], self.start[number + 1])
        hit = member[self.term[part]]
        out = np.zeros(LEAF, np.int64)
        np.add.at(out, self.doc[part][hit] - number * LEAF, self.score[part][hit])
        return out

    def search(self, terms: np.ndarray, best: list, top: int) -> None:
        """Takes this tree's documents into `best`, a heap of at most `top` (score, -doc_id).

        The node of the highest bound, the sum of its terms' maxima, is opened next. Once `top` documents are
        known, no node below their lowest score is opened; one that equals it is, as it may hold a smaller doc_id.
        """
        rows = np.searchsorted(self.own, terms)
        rows = rows[(rows < len(self.own)) & (self.own[np.minimum(rows, len(self.own) - 1)] == terms)] if len(self.own) else rows[:0]
        if not len(rows):
            return
        member = np.zeros(len(self.own), bool)
        member[rows] = True
        root = len(self.levels) - 1
        agenda = [(-int(self.levels[root][rows].sum()), root, 0)]
        while agenda:
            bound, level, number = heapq.heappop(agenda)
            if bound == 0 or (len(best) == top and -bound < best[0][0]):
                return
            if level:
                below = self.levels[level - 1][rows, number * FAN : (number + 1) * FAN].sum(0)
                for i, b in enumerate(below.tolist()):
                    if b and (len(best) < top or b >= best[0][0]):
                        heapq.heappush(agenda, (-b, level - 1, number * FAN + i))
                continue
            scores = self.leaf(number, member)
            for i in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == top else 1)).tolist():
                doc = self.ids[number * LEAF + i]
                entry = (int(scores[i]), -math.inf if doc is None else -doc)
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def trees(batches, weight, total, words):
    """Trees of at most DOCUMENTS documents or about POSTINGS postings, from batches of postings."""
    for b in batches:
        at, terms, tf = (b.column(2).offsets.to_numpy().astype(np.int64), *(b.column(i).values.to_numpy() for i in (2, 3)))
        n, ids = b.column(1).to_numpy(), b.column(0).to_pylist()
        a = 0
        while a < len(ids):
            e = max(a + 1, min(len(ids), a + DOCUMENTS, int(np.searchsorted(at, at[a] + POSTINGS, "right")) - 1))
            part = slice(at[a], at[e])
            yield Tree(ids[a:e], n[a:e], at[a : e + 1] - at[a], terms[part], tf[part], weight, total, words)
            a = e


def answers(index: DataFrame, numbers: list[np.ndarray], weight: np.ndarray, total: int, words: int, top: int) -> DataFrame:
    """item (its place in `numbers`), doc_id, score: each task's best documents of each item."""
    state = index.sparkSession.sparkContext.broadcast((numbers, weight))

    def run(batches):
        numbers, weight = state.value
        best: list[list] = [[] for _ in numbers]
        for tree in trees(batches, weight, total, words):
            for terms, own in zip(numbers, best):
                tree.search(terms, own, top)
        rows = [(i, None if d == -math.inf else -d, s) for i, own in enumerate(best) for s, d in own]
        item, doc, score = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0.

    The items are dealt into blocks of about `block` terms; for each, one pass over all documents keeps the
    postings of its terms as a table. Every task builds trees over its documents, of bounded size,
    and searches them best first; what an item has found so far bounds the next trees. The tasks'
    answers are merged in two steps. Scores are whole numbers, so reruns agree.

    Null and empty texts have no terms and are not found; very long texts are counted whole. An
    item without terms, or without a document, gives no row; repeated items count once, items that
    share an item_id but not the text are items each. Each row of docs is a document, also where rows
    repeat a doc_id; a null doc_id comes last among equal scores. No documents or no items: no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as work:
        asked = work.keep(item_terms(items), "items")
        kind = dict(asked.dtypes)["item_id"]
        found = spark.createDataFrame([], f"item long, doc_id long, score long, item_id {kind}")
        size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
        blocks = max(1, -(-size // block))
        for k in range(blocks):
            own = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == k).orderBy("item_id", "terms").collect()  # about `block` terms
            if not own:
                continue
            terms = sorted({t for r in own for t in r.terms})
            number = {t: i for i, t in enumerate(terms)}
            index = work.keep(postings(docs, terms), f"postings-{k}")
            total, words = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(terms), np.int64)
            for r in index.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of the block
                df[r.t] = r.df
            weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
            got = answers(index, [np.array(sorted(number[t] for t in r.terms), np.int64) for r in own], weight, total, max(1, words), top)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item int, item_id {kind}")
            met = got.withColumn("__part", F.spark_partition_id() % 64).join(F.broadcast(names), "item").withColumn("item", F.lit(k).cast("long") * (1 << 32) + F.col("item"))
            found = found.unionByName(work.give(best_of(met, ["item", "__part"], top).select(found.columns), f"answers-{k}"))
            work.drop(f"postings-{k}")
    return best_of(found, ["item"], top).select("item_id", "rank", "doc_id", "score")


def best_of(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


_TERM = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, unnest(l) AS t FROM (SELECT doc_id, {_TERM} AS l FROM documents)),
c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY 1),
a AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
m AS (SELECT doc_id, 50 + (50 * n * nn) // l AS m FROM n, a),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM c GROUP BY 1), a),
q AS (SELECT DISTINCT item_id, unnest(l) AS t FROM (SELECT item_id, {_TERM} AS l FROM benchmark)),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN c USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
