"""Line and passage dedup by winnowing over hashes of lines and of words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Lines of a run, words of a line that is a run by itself, words of a passage, words of a passage's fingerprint.
RUN, FEW, PASSAGE, GRAM = 2, 3, 50, 10
#: Low bits of a place that hold its first word; the hash of its text leads it.
_LOW = (1 << 31) - 1
#: Words of smaller hashes are selected, about one in ten.
ANCHOR = (1 << 64) // 10 - (1 << 63)
_BLANKS = "\\t\\n\\u000B\\u000C\\r "


def bound(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` for `value`, worked out once. A captured array would be worked out for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def line_hashes(text: Column) -> Column:
    """The hashes of each line's words. Tabs and the like become spaces, so that splitting needs no pattern."""
    odd = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])
    plain = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    return F.transform(F.split(F.coalesce(plain, F.lit("")), "\n"), lambda line: F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def selected(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """id, x, h, n, starts, anchors: word hashes, their number, the first words of lines and n behind them, the selected words.

    Every window of words that a run of `gram` words may begin in, of a passage of `size`, selects the first word there
    whose hash is below ANCHOR. A window without one selects its first word.
    """
    reach = size - gram + 1
    lines = docs.select(F.col("doc_id").alias("id"), F.expr("hash(text)").alias("x"), F.filter(line_hashes(F.col("text")), lambda h: F.size(h) > 0).alias("lines"))
    begins = F.flatten(F.transform("lines", lambda h: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), F.size(h) - 1))))
    words = lines.select("id", "x", F.flatten("lines").alias("h"), F.array_compact(F.transform(begins, lambda b, i: F.when(b, i))).alias("starts"))
    marks = F.when(F.size("h") >= size, F.array_compact(F.transform("h", lambda v, i: F.when(v < ANCHOR, i))))
    words = words.select("id", "x", "h", F.size("h").alias("n"), F.concat("starts", F.array(F.size("h"))).alias("starts"), marks.alias("marks"))

    def with_gap(a, j):
        before, last = F.coalesce(F.get("marks", j - 1), F.lit(-1)), F.least(a - reach, F.col("n") - size)
        return F.when(last > before, F.concat(F.sequence(before + 1, last), F.array(a))).otherwise(F.array(a))

    gaps = F.flatten(F.transform(F.concat("marks", F.array(F.col("n") + size)), with_gap))
    return words.select("id", "x", "h", "n", "starts", F.coalesce(gaps, F.array().cast("array<int>")).alias("anchors"))


def fingerprints(docs: DataFrame, run: int, few: int, size: int, gram: int) -> DataFrame:
    """id, x, start, span, f, k of all runs of lines and all blocks of passages: one scan, one row for each.

    x: a hash of the text; with id and the first word's place it orders places. A line of `few` words is a run. Of
    `run` lines with a shorter one among them, winnowing takes the smallest line of each window; its row is the
    window's. Passages that select one word follow one another; they are a block. f is the hash of the selected run
    of words, the guaranteed fingerprint; k that of all words of the row.
    span: of lines the words, negative; of blocks words * 256 + passages beyond the first.
    """
    part = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.alias("of"))
    rows = selected(docs, size, gram)
    rows = rows.select("id", "x", "h", "n", F.inline(F.array(part(0, F.concat(F.array(F.lit(-1)), "anchors")), part(1, F.col("starts")), part(2, F.col("starts")))))
    rows = rows.select("*", F.posexplode("of").alias("j", "at"))
    passage, line = F.col("kind") == 0, lambda j: F.get("of", F.col("j") + j + 1) - F.get("of", F.col("j") + j)
    rows = rows.select("*", F.get("of", F.col("j") + F.when(F.col("kind") == 2, run).otherwise(1)).alias("to"))
    short = reduce(lambda x, y: x | y, [line(j) < few for j in range(run)])
    kept = F.when(passage, F.least("to", F.col("n") - size) > F.col("at")).when(F.col("kind") == 1, F.col("to") - F.col("at") >= few).otherwise(short)
    # A block's passages begin behind the word before the selected one, a line at its first word.
    sizes = [F.when(F.col("kind") == 2, line(j)).alias(f"line{j}") for j in range(run - 1)]
    start, words = F.when(passage, F.col("at") + 1).otherwise(F.col("at")), F.when(passage, F.least("to", F.col("n") - size) - F.col("at") - 1 + size).otherwise(F.col("to") - F.col("at"))
    rows = rows.filter(F.col("to").isNotNull() & kept).select("id", "x", "h", "kind", "to", start.alias("start"), words.alias("words"), *sizes)
    sort = ["kind", *[f"line{j}" for j in range(run - 1)]]
    span = F.when(passage, F.col("words").cast("long") * 256 + F.col("words") - size).otherwise(-F.col("words"))
    f = F.xxhash64(*sort, F.slice("h", F.when(passage, F.col("to")).otherwise(F.col("start")) + 1, F.when(passage, F.lit(gram)).otherwise(F.col("words"))))
    return rows.select("id", "x", "start", span.alias("span"), f.alias("f"), F.xxhash64(F.lit(1), *sort, F.slice("h", F.col("start") + 1, F.col("words"))).alias("k"))


def _start(at: str = "at") -> str:
    return f"cast({at} & {_LOW}L as int)"


def _apart(size: int) -> str:
    """SQL: a passage that overlaps its own first place is no second place."""
    return f"not (id <=> first.id and shiftrightunsigned(at, 32) = shiftrightunsigned(first.at, 32) and at < first.at + {size})"


def later_blocks(rows: DataFrame, size: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Two tables: later places (id, at, words), and the blocks (id, at, more) left to look at passage by passage.

    Most fingerprints stand once: they are counted first, by hash, and only rows of the others go on.
    Of these, every key's first place is found by partial minima and its other places meet it. A key has one
    row on the side that a join builds on, so a key of very many rows can be split. A block whose
    fingerprint also stands in another block may share some passages with it: only the first
    place of each distinct block has to be looked at again.
    """
    place = F.struct("id", "at")
    often = work.keep(rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f"), "line-often")
    rows = work.keep(rows.join(often.hint("shuffle_hash"), "f", "left_semi").select("id", F.expr("shiftleft(cast(x as bigint), 32) | start").alias("at"), "span", "f", "k"), "line-rows")
    work.drop("line-prints", "line-often")
    groups = work.keep(rows.groupBy("f", "k").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("span").alias("span")), "line-groups")
    met = rows.join(groups.filter("n > 1").select("f", "k", "first").hint("shuffle_hash"), ["f", "k"]).filter(place > F.col("first"))
    met = work.keep(met.select("id", "at", "span", F.expr(f"span < 0 or ({_apart(size)})").alias("apart")), "line-later")
    blocks = groups.filter("span > 0")
    shared = blocks.groupBy("f").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    open_ = blocks.join(shared.hint("shuffle_hash"), "f", "left_semi").select("first.id", "first.at", F.expr("cast(span & 255 as int)").alias("more"))
    own = met.filter("not apart").select("id", "at", F.expr("cast(span & 255 as int)").alias("more"))
    words = F.expr("cast(if(span < 0, -span, shiftright(span, 8)) as int)").alias("words")
    return met.filter("apart").select("id", "at", words), open_.unionByName(own)


def later_passages(docs: DataFrame, blocks: DataFrame, size: int, work: Scratch) -> DataFrame:
    """id, at, words of the single passages of `blocks` that stand at an earlier place too."""
    marks = blocks.groupBy("id", F.expr("cast(shiftright(at, 32) as int)").alias("x")).agg(F.collect_list(F.struct(F.expr(_start()).alias("start"), "more")).alias("bs"))
    texts = docs.select("doc_id", "text", F.expr("hash(text)").alias("tx"))
    met = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tx") == F.col("x")))

    found = met.select("id", "x", F.flatten(line_hashes(F.col("text"))).alias("h"), F.flatten(F.transform("bs", lambda b: F.sequence(b.start, b.start + b.more))).alias("s"))
    passage = F.slice("h", F.col("s") + 1, F.lit(size))
    found = found.select("id", "x", "h", F.explode("s").alias("s")).select("id", "x", "s", F.xxhash64(passage).alias("f"), F.xxhash64(F.lit(1), passage).alias("k"))
    held = work.keep(found.select("id", F.expr("shiftleft(cast(x as bigint), 32) | s").alias("at"), "f", "k"), "passages")
    often = work.keep(held.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f"), "passages-often")
    held = work.keep(held.join(often.hint("shuffle_hash"), "f", "left_semi"), "passages-rows")
    work.drop("passages", "passages-often")
    place = F.struct("id", "at")
    # Repeated rows give a passage twice at one place: none is later than itself.
    first = held.groupBy("f", "k").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    met = held.join(first.hint("shuffle_hash"), ["f", "k"]).filter(place > F.col("first")).filter(_apart(size))
    return met.select("id", "at", F.lit(size).alias("words"))


def repeated_ranges(docs: DataFrame, run: int = RUN, few: int = FEW, size: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """id, x, gone, n_removed: the ranges (b, e) of words that stand at an earlier place too, disjoint and in order."""
    with Scratch(docs.sparkSession) as work:
        rows = work.keep(fingerprints(docs, run, few, size, gram), "line-prints")
        later, blocks = later_blocks(rows, size, work)
        later = work.keep(later.select("id", "at", "words"), "line-ranges")
        blocks = work.keep(blocks, "line-blocks")
        work.drop("line-rows", "line-groups", "line-later")
        every = later.unionByName(work.keep(later_passages(docs, blocks, size, work), "passage-ranges"))
        work.drop("passages-rows", "line-blocks")
        ends = every.select("id", F.expr("cast(shiftright(at, 32) as int)").alias("x"), F.expr(_start()).alias("b"), F.expr(f"{_start()} + words").alias("e"))
        one = Window.partitionBy("id", "x").orderBy("b", "e")
        new = ends.withColumn("new", F.coalesce(F.col("b") > F.max("e").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
        islands = new.withColumn("i", F.sum("new").over(one)).groupBy("id", "x", "i").agg(F.min("b").alias("b"), F.max("e").alias("e"))
        out = islands.groupBy("id", "x").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("gone"), F.sum(F.col("e") - F.col("b")).alias("n_removed"))
        return work.give(out, "ranges")


def line_dedup(docs: DataFrame, run: int = RUN, few: int = FEW, size: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """All rows and columns of docs, text without its later repeated runs, and n_removed (its deleted words).

    Words are compared without the blanks between them, so line ends (LF or CRLF) and indentation
    do not matter. Deleted is each later place (by doc_id, then position) of a line of `few` words,
    of `run` lines in a row, and of `size` words in a row wherever lines break; its first place
    stays. Overlapping places are one run. Blanks before a deleted word go too; a run that begins
    with a line leaves the break before it to what follows.

    Winnowing selects a word in every passage and a line in every run, so each repeated one is
    found. Keys are two 64-bit hashes of all words. A key that very many places share is
    aggregated, never paired. All steps are linear in a document's words and lines.

    Null text stays null; a null doc_id comes before all others. Repeated rows with one doc_id and
    text are one place, none is later, all are cut alike. A text without words stays as it is. Empty
    table: empty result. A column of docs named n_removed is replaced; others pass through.
    """
    cols = [c for c in docs.columns if c != "n_removed"]
    ranges = repeated_ranges(docs, run, few, size, gram)
    # The columns of docs go as one, so that none can clash with the ranges'. Texts need no sort: a document has one row of ranges.
    held = docs.select(F.struct(*cols).alias("d"), F.col("doc_id").alias("did"), F.expr("hash(text)").alias("k"))
    met = held.join(ranges.hint("shuffle_hash"), F.col("did").eqNullSafe(F.col("id")) & (F.col("k") == F.col("x")), "left")
    body = f"trim(TRAILING '{_BLANKS}' FROM d.text)"
    lead = lambda p: f"regexp_extract({p}, '^[\\\\x20\\\\x09-\\\\x0D]*', 0)"
    before = "get(w, get(g, j - 1).b)"
    first = f"if(get(g, j - 1).b = 0 or contains({lead(before)}, '\\n'), concat({lead(before)}, trim(LEADING '{_BLANKS}' FROM get(w, get(g, j - 1).e))), get(w, get(g, j - 1).e))"
    upto = "if(j = size(g), size(w), get(g, j).b)"
    part = f"if(j = 0, array_join(slice(w, 1, {upto}), ''), if({upto} <= get(g, j - 1).e, '', concat({first}, array_join(slice(w, get(g, j - 1).e + 2, {upto} - get(g, j - 1).e - 1), ''))))"
    words = f"regexp_extract_all({body}, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    whole = bound(words, "w", bound("gone", "g", f"if(size(g) = 1 and get(g, 0).b = 0 and get(g, 0).e = size(w), '', concat(array_join(transform(sequence(0, size(g)), j -> {part}), ''), substr(d.text, length({body}) + 1)))"))
    return met.select(*[F.when(F.col("gone").isNotNull(), F.expr(whole)).otherwise(F.col("d.text")).alias("text") if c == "text" else F.col("d")[c].alias(c) for c in cols],
                      F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))


_B = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""
WITH p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ \\t-\\r]*[^ \\t-\\r]+') AS l FROM documents)),
w AS (SELECT doc_id, i, piece, ltrim(piece, {_B}) AS word, left(piece, len(piece) - len(ltrim(piece, {_B}))) AS blanks FROM p),
v AS (SELECT *, sum((i = 1 OR contains(blanks, chr(10)))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS line, i = 1 OR contains(blanks, chr(10)) AS begins FROM w),
l AS (SELECT doc_id, line, min(i) AS b, max(i) AS e, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM v GROUP BY 1, 2),
t AS (SELECT *, lead(s) OVER o AS s2, lead(e) OVER o AS e2, lead(n) OVER o AS n2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
one AS (SELECT doc_id, b, e, row_number() OVER (PARTITION BY s ORDER BY doc_id, b) AS k FROM t WHERE n >= {FEW}),
two AS (SELECT doc_id, b, e2 AS e, row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, b) AS k FROM t WHERE s2 IS NOT NULL),
a AS (SELECT doc_id, list(word ORDER BY i) AS ws FROM w GROUP BY 1 HAVING count(*) >= {PASSAGE}),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {PASSAGE - 1}), ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {PASSAGE - 2})) AS i FROM a)),
f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0, row_number() OVER o AS k FROM g WINDOW o AS (PARTITION BY s ORDER BY doc_id, i)),
gone AS (SELECT doc_id, b, e FROM one WHERE k > 1 UNION ALL SELECT doc_id, b, e FROM two WHERE k > 1
  UNION ALL SELECT doc_id, i, i + {PASSAGE - 1} FROM f WHERE k > 1 AND (doc_id <> d0 OR i >= i0 + {PASSAGE})),
c AS (SELECT doc_id, b, max(e) AS e FROM gone GROUP BY 1, 2),
m AS (SELECT v.*, coalesce(max(c.e) OVER (PARTITION BY v.doc_id ORDER BY v.i) >= v.i, false) AS cut FROM v LEFT JOIN c ON v.doc_id = c.doc_id AND v.i = c.b),
n AS (SELECT *, coalesce(max(CASE WHEN NOT cut THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM m),
r AS (SELECT n.doc_id, n.i, CASE WHEN n.prev = n.i - 1 OR NOT h.begins THEN n.piece ELSE h.blanks || n.word END AS piece FROM n JOIN v h ON h.doc_id = n.doc_id AND h.i = n.prev + 1 WHERE NOT n.cut),
x AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS s FROM r GROUP BY 1),
z AS (SELECT doc_id, count(*) AS n_removed FROM m WHERE cut GROUP BY 1)
SELECT d.doc_id, CASE WHEN z.doc_id IS NULL THEN d.text WHEN x.s IS NULL THEN '' ELSE x.s || right(d.text, len(d.text) - len(rtrim(d.text, {_B}))) END AS text,
  coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""
