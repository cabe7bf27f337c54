"""Ranked search, sentence pieces and vector codes against brute force."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from linkmill.llm import lexical, sentence_pieces, vector_codes

DOCS = "doc_id long, text string, lang string, n string, t string, tf string, rank string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, "x", "y", "z", "r") for i, t in rows], DOCS).repartition(parts)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_search(rows, items, top):
    """Every document against every item."""
    tfs = [(d, Counter(terms(t))) for d, t in rows]
    size = [sum(c.values()) for _, c in tfs]
    n, words = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), s in zip(tfs, size):
            m = 50 + 50 * s * n // max(1, words)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def searched(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block", [lexical.TERMS, 9])
def test_search_against_brute_force(spark, block):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "THE", "the", "漢字"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 30, 200])))) for i in range(300)]
    rows += [(1000 + i, "same, Words the-w1 w2") for i in range(90)]  # equal scores, and more of them than are asked for
    rows += [(500, ""), (501, None), (502, " .,! "), (None, "w1 w2 the"), (7, rows[7][1]), (503, "w3 " * 20000)]
    items = [(0, "w1 W2 w2 the"), (1, "same words"), (2, ""), (3, None), (4, "nowhere"), (5, " ".join(vocabulary)), (6, "É-漢字"), (None, "w5"), (7, "the same w9")]
    got = lexical.search(docs(spark, rows), spark.createDataFrame(items * 2, "item_id long, text string"), 50, block)
    assert searched(got) == slow_search(rows, items, 50)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_with_small_trees(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randrange(1, 9)))) for i in range(500)]
    packed = lexical.postings(docs(spark, rows, 1), list("abcdefgh")).toPandas()
    total, words, df = len(rows), int(packed.n.sum()), Counter(t for ts in packed.t for t in ts)
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df[i] + 1))) for i in range(8)])
    best: list = []
    for a in range(0, 500, 70):
        p = packed[a : a + 70]
        at = np.r_[0, np.cumsum([len(x) for x in p.t])]
        tree = lexical.Tree(p.doc_id.tolist(), p.n.to_numpy(), at, np.concatenate(list(p.t)), np.concatenate(list(p.tf)), weight, total, words)
        for level, below in zip(tree.levels[1:], tree.levels):
            assert level.max() == below.max() and (level[:, 0] >= below[:, : lexical.FAN].max(1)).all()
        tree.search(np.array([0, 3, 5]), best, 20)
    want = slow_search(rows, [(0, "a d f")], 20)
    assert sorted((s, -d) for s, d in best) == sorted((s, d) for _, _, d, s in want)


def test_search_opens_only_ranges_that_can_be_among_the_best():
    n, rare = 32 * 64, 70
    ids, sizes = list(range(n)), np.full(n, 10)
    t, tf = np.zeros(n, np.int64), np.ones(n, np.int64)
    tf[rare] = 9
    tree = lexical.Tree(ids, sizes, np.arange(n + 1), t, tf, np.array([1000]), n, 10 * n)
    opened, leaf = [], tree.leaf
    tree.leaf = lambda number, member: opened.append(number) or leaf(number, member)
    best: list = []
    tree.search(np.array([0]), best, 1)
    assert best[0][1] == -rare and opened == [rare // lexical.LEAF]


def test_search_without_documents_or_items(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs(spark, []), items).collect() == []
    assert lexical.search(docs(spark, [(1, "a")]), items.filter("false")).collect() == []
    assert lexical.search(docs(spark, [(1, None), (2, "")]), items).collect() == []


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    r = random.Random(11)
    letters = ["a", "the", "th", "er", " ", "  ", "\n", "\t", "▁", "é", "é", "漢", "😀", "\x00", "½", "ﬁ", "　", " ", "Q", "7", "</s>", "<0x41>", "<unk>", "ß", "​", "ing", "�", "।"]
    return [None, "", " ", "   ", "▁", "▁a", " a ", "a  b", "<s> a </s>", "x" * 3000, "é" * 700, "aab" * 20000, "ab " * 9000, "😀" * 300] + ["".join(r.choices(letters, k=r.randrange(1, 40))) for _ in range(1500)]


def test_sentence_pieces_against_the_library(spark):
    m, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), odd_texts()
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3])]
    want = sorted(((i, m.encode(t or "", add_eos=True)) for i, t in rows), key=repr)
    whole = sentence_pieces.encode_documents(docs(spark, rows), MODEL).collect()
    assert sorted(((r.doc_id, r.ids) for r in whole), key=repr) == want
    assert sorted(((r.doc_id, r.decoded, r.n_tokens) for r in whole), key=repr) == sorted(((i, m.decode(x), len(x)) for i, x in want), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sentence_pieces.encoding_digests(docs(spark, rows), MODEL).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len(x), sha(" ".join(map(str, x))), sha(m.decode(x))) for i, x in want), key=repr)
    assert sentence_pieces.encoding_digests(docs(spark, []), MODEL).count() == 0


def test_sentence_pieces_forget_without_effect_and_decode_any_ids():
    m, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), [t for t in odd_texts() if t is not None]
    small, large = sentence_pieces.Encoder(MODEL, 50), sentence_pieces.Encoder(MODEL)
    assert [x for t in texts for x in small.encode([t])] == large.encode(texts) and len(small.done) < 200
    assert not any(len(w) > sentence_pieces.LONG for w in large.done)
    r = random.Random(2)
    for _ in range(300):  # also bytes that are no text
        ids = [300] + [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(131, 259), 1, 2]) for _ in range(r.randrange(12))]
        assert large.decode(" ".join(map(str, ids))).decode() == m.decode(ids), ids


def test_a_wrong_agenda_is_found():
    enc = sentence_pieces.Encoder(MODEL)
    enc.agenda.run = lambda words: [[300] for _ in words]
    with pytest.raises(ValueError, match="other ids"):
        enc.encode(["thing"])


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, v string"


def slow_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine: dict = {}
            for _, v, _ in kept:
                mine.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(book)]
    found = [(i, lab, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, lab in kept]
    errors = Counter()
    for _, lab, n in found:
        errors[lab] += sum(d for d, _ in n)
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), errors[lab]) for i, lab, n in found), key=repr), hashlib.sha256(flat.encode()).hexdigest()


def coded(spark, rows, **k):
    df, books = vector_codes.vector_codes(spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows], VECTORS).repartition(4), **k)
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error").collect()), key=repr), vector_codes.digest(books)


@pytest.mark.parametrize("grain", [3, 200])  # few values: many equally near entries
def test_codes_against_brute_force(spark, grain):
    r = random.Random(grain)
    rows = [(i, [r.randrange(-grain, grain) / 256 + 0.001 for _ in range(12)], r.choice([None, 1, 1, 1, 2])) for i in range(400)]
    rows += [(900, None, 1), (901, [0.1] * 11 + [None], 1), (902, [math.nan] * 12, 2), (903, [math.inf] + [0.0] * 11, 2), (None, [0.5] * 12, None), (3, rows[3][1], 2), (4, rows[5][1], 1)]
    r.shuffle(rows)
    assert coded(spark, rows, parts=4, entries=20, rounds=2) == slow_codes(rows, 4, 20, 2)


def test_codes_of_few_vectors(spark):
    rows = [(5, [0.25] * 16, None), (2, [-0.25] * 16, 1)]
    got = coded(spark, rows)
    assert got == slow_codes(rows, 16, 64, 2) and [c for _, c, _, _ in got[0]] == ["00" * 16, "01" * 16]
    assert coded(spark, [])[0] == [] and coded(spark, [(1, None, 1)])[0] == []
    assert coded(spark, [(1, [], 1)])[0] == [(1, "00" * 16, 0, 0)]


@pytest.mark.parametrize("bad", [[(1, [0.0] * 15, 1)], [(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [1e12] * 16, 1)]])
def test_codes_refuse_what_cannot_be_cut(spark, bad):
    with pytest.raises(ValueError):
        coded(spark, bad)


def test_nearest_keeps_the_lower_index_and_skips_far_boxes():
    r = np.random.default_rng(1)
    for width, top in ((1, 4), (2, 3), (4, 2), (4, 1000)):
        book, rows = r.integers(-top, top, (64, width)), r.integers(-top, top, (3000, width))
        at, d = vector_codes.nearest(vector_codes.kd_tree(book), book, rows)
        every = ((rows[:, None] - book[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
