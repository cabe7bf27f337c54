"""Vector code compression: product codes whose codebooks are searched through kd-trees."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salted_lookup

#: Parts of a vector, entries of a codebook, rounds, and the factor before components are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a kd-tree's leaf, and rows that are searched at a time.
LEAF, ROWS = 8, 8192
#: Largest whole component: beyond it a part's squared distances might leave 64 bits.
LARGEST = 1 << 28


@dataclass
class Node:
    """low, high: the box around the node's entries. A leaf has entries (ascending), an inner node two children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    axis: int = 0
    cut: int = 0
    children: tuple = ()


def kd_tree(book: np.ndarray, of: np.ndarray | None = None) -> Node:
    """book: entries x components, integers. Halved at the median of the widest component."""
    of = np.arange(len(book)) if of is None else of
    own = book[of]
    low, high = own.min(0, initial=LARGEST), own.max(0, initial=-LARGEST)
    if len(of) <= LEAF or not (high > low).any():
        return Node(low, high, of)
    axis = int((high - low).argmax())
    order = of[np.argsort(own[:, axis], kind="stable")]
    half = len(of) // 2
    return Node(low, high, None, axis, int(book[order[half], axis]), (kd_tree(book, np.sort(order[:half])), kd_tree(book, np.sort(order[half:]))))


def nearest(tree: Node, book: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; the lower index of equally near ones.

    Branch and bound for many rows at once: the rows that are on a node's side go there first, and
    to the other child if its box is not farther than what they have. A box that is equally far is
    opened too, for it may hold an equally near entry of a lower index.
    """
    far = np.iinfo(np.int64).max
    best, at = np.full(len(rows), far), np.full(len(rows), len(book))

    def visit(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        x = rows[who]
        out = np.maximum(0, np.maximum(node.low - x, x - node.high))
        open_ = (out * out).sum(1) <= best[who]
        who, x = who[open_], x[open_]
        if not len(who):
            return
        if node.entries is not None:
            gap = x[:, None, :] - book[node.entries]
            d = (gap * gap).sum(2)
            k = d.argmin(1)  # the first among equals: entries ascend
            d, k = d[np.arange(len(who)), k], node.entries[k]
            closer = (d < best[who]) | ((d == best[who]) & (k < at[who]))
            best[who[closer]], at[who[closer]] = d[closer], k[closer]
            return
        left = x[:, node.axis] < node.cut
        for side, first, then in ((left, 0, 1), (~left, 1, 0)):
            visit(node.children[first], who[side])
            visit(node.children[then], who[side])

    visit(tree, np.arange(len(rows)))
    return at, best


def whole(docs: DataFrame) -> DataFrame:
    """vec_id, label and v, the floored components, of the rows that stay."""
    v = F.col("embedding")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return docs.select("vec_id", "label", v.cast("array<double>").alias("embedding")).filter(good).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"))


def check_sizes(rows: DataFrame, parts: int) -> int:
    """The components of a part; an error for vectors that cannot be cut equally or whose squares leave 64 bits."""
    seen = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(F.expr("aggregate(v, 0L, (a, x) -> greatest(a, abs(x)))")).alias("top")).first()
    if seen.most is None:
        return 0
    if seen.least != seen.most or seen.most % parts:
        raise ValueError(f"vectors of {seen.least} to {seen.most} components cannot be cut into {parts} equal parts")
    if seen.top > LARGEST:
        raise ValueError(f"a component of {seen.top / SCALE} is too large for squared distances in 64 bits")
    return seen.most // parts


def matrix(column, parts: int, width: int) -> np.ndarray:
    """parts x rows x width of a list column."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width).transpose(1, 0, 2))


def assigned(column, books: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances, rows x parts."""
    found = [nearest(t, b, m) for t, b, m in zip(trees, books, matrix(column, *books.shape[::2]))]
    return np.stack([a for a, _ in found], 1), np.stack([d for _, d in found], 1)


def shipped(rows: DataFrame, books: np.ndarray):
    """The codebooks and a kd-tree of each, broadcast: their size is fixed by parts, entries and a part's components."""
    return rows.sparkSession.sparkContext.broadcast((books, [kd_tree(b) for b in books]))


def sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, s: how many parts each entry is nearest to, and their sums by component.

    A task adds up its own rows first, so it sends one row for each entry that it met.
    """
    state = shipped(rows, books)
    parts, entries, width = books.shape

    def run(batches):
        books, trees = state.value
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                column = b.column(0).slice(i, ROWS)
                at, _ = assigned(column, books, trees)
                for p, m in enumerate(matrix(column, parts, width)):
                    n[p] += np.bincount(at[:, p], minlength=entries)
                    np.add.at(s[p], at[:, p], m)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(s[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    got = rows.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    return got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)])


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries that no part is nearest to stay."""
    out = books.copy()
    for r in sums(rows, books).collect():  # at most parts x entries rows
        out[r.part, r.entry] = [x // r.n for x in r[3:]]
    return out


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """Each part of the vectors of the smallest vec_ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each row."""
    state = shipped(rows, books)

    def run(batches):
        books, trees = state.value
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                at, d = assigned(part.column(2), books, trees)
                hexed = [bytes(r).hex() for r in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hexed, pa.string()), pa.array(d.sum(1))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, label_error for every vector that stays, and the codebooks (part x entry x component).

    Components are floored after the factor SCALE, so all sums and distances are whole numbers and
    reruns agree. Each round ships a kd-tree for each part's codebook, finds every part's nearest entry by
    branch and bound, and sums the parts of each entry where they lie; only the sums move. A code is two
    hex digits for each part.

    Vectors that are null, or hold nulls or components that are not finite, are left out. A null
    vec_id comes last in the order that starts the codebooks; rows that repeat a vec_id each count,
    ordered by their vectors. Null labels are one label. Equally near entries: the lower index. Fewer
    vectors than entries: so many entries. Empty vectors have code zero; vectors of unequal sizes, of sizes
    that parts do not divide, or with components beyond LARGEST / SCALE are an error. No vector: no
    rows. Other columns are not read.
    """
    rows = whole(vectors)
    width = check_sizes(rows, parts)
    books = first_books(rows, parts, entries, width)
    for _ in range(rounds):
        books = updated(rows, books)
    # A third of all rows may have one label: errors are added up where they lie, and the sums are looked up by parts of a label.
    done = materialise(codes(rows, books).withColumn("__label", F.struct(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("l"), F.col("label").isNull().alias("none"))), "vector-codes")
    total = done.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return salted_lookup(done, total, "__label", "vec_id").drop("__label"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


#: DuckDB: the same codes by comparing every part with every entry.
_NEAREST = """{name} AS (SELECT vec_id, label, p, c, k, d FROM (
  SELECT x.vec_id, x.label, x.p, x.c, b.k, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
    row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY d, b.k) AS o FROM x JOIN {books} b ON x.p = b.p) WHERE o = 1)"""
_UPDATE = """{name} AS (SELECT b.p, b.k, coalesce(list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) FILTER (s IS NOT NULL), any_value(b.c)) AS c
  FROM {books} b LEFT JOIN (SELECT p, k, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, k, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM {near}) GROUP BY 1, 2, 3) u ON b.p = u.p AND b.k = u.k GROUP BY b.p, b.k)"""
ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS c FROM kept, (SELECT unnest(range({PARTS})) AS p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT p, k, c FROM x JOIN f USING (vec_id)),
""" + ",\n".join(_NEAREST.format(name=f"n{i}", books=f"b{i}") + ",\n" + _UPDATE.format(name=f"b{i + 1}", books=f"b{i}", near=f"n{i}") for i in range(ROUNDS)) + f""",
{_NEAREST.format(name='z', books=f'b{ROUNDS}')},
r AS (SELECT vec_id, label, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM b{ROUNDS}) AS codebooks_sha256
FROM r
"""
