import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from linkmill.llm import licences, line_dedup, media, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, n_lines string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def words(n, r, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def test_licence_scan_against_brute_force(spark):
    r = random.Random(3)
    texts = ["", None, "mit", "x under the MIT license. y under The mit, License", "Apache License, Version 2.0 and CC BY-NC 4.0; cc by  nc", "under the mit and license", "é under the mit licensé under-the-mit-license",
             "All rights reserved.", "permission is hereby granted, free of charge, to any other person obtaining a copy of this software and the associated documentation files"]
    pool = "under the mit license apache version 2 cc by nc x".split()
    texts += [" ".join(r.choice(pool) for _ in range(300)) for _ in range(20)]
    got = {x.doc_id: x for x in licences.licence_scan(docs(spark, texts)).collect()}
    base = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(p, k) for k, b in base.items() for p in range(len(w)) if w[p : p + len(b.split())] == b.split()]
        x = got[i]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(at), ",".join(sorted({k for _, k in at})))
        assert (x.first_word, x.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert got[7].labels == "all-rights-reserved" and "mit" in got[8].labels and got[8].n_base == 0
    assert licences.licence_scan(docs(spark, [])).count() == 0


def slow_labels(text):
    """labels and score by the definition: votes of equal word triples, diagonals merged where they are close."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(), 0.0
    for base, group in ((True, licences.BASE), (False, licences.NOTICES)):
        for label, phrases in group.items():
            for p in (x.split() for x in phrases):
                grams, votes = len(p) - 2, {}
                for i in range(len(w) - 2):
                    for j in range(grams):
                        if w[i : i + 3] == p[j : j + 3]:
                            votes.setdefault(i - j, set()).add(j)
                spans, last = [], None
                for d in sorted(votes):
                    if base or last is None or d - last > licences.NEAR:
                        spans.append(set())
                    spans[-1] |= votes[d]
                    last = d
                best = max((len(s) / grams for s in spans), default=0.0)
                score = max(score, best)
                if best >= (1 if base else licences.COVER):
                    labels.add(label)
    return ",".join(sorted(labels)), score


def test_labels_and_score_against_brute_force(spark):
    r = random.Random(17)
    phrases = [p for g in (licences.BASE, licences.NOTICES) for ps in g.values() for p in ps]
    texts = [None, "", "all rights"]
    for _ in range(150):
        out = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(phrases).split()
            for _ in range(r.randrange(4)):  # words put in, left out or changed
                i = r.randrange(len(w))
                w = r.choice([w[:i] + ["extra"] + w[i:], w[:i] + w[i + 1 :] or w, w[:i] + ["other"] + w[i + 1 :]])
            out += r.choices(["the", "license", "x"], k=r.randrange(5)) + w
        texts.append(r.choice([" ", ", ", "\n"]).join(out).title())
    got = {x.doc_id: x for x in licences.licence_scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        labels, score = slow_labels(t)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-12, t
    twice = docs(spark, ["all rights reserved"]).union(docs(spark, ["all rights reserved"]))
    assert licences.licence_scan(twice).count() == 1


def slow_fingerprint(text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_dedup_against_brute_force(spark):
    r = random.Random(5)
    texts = ["", None, "  \n", "one", "One", "two words", "a b c", "A  b\tc"]
    for _ in range(30):
        t = words(200, r).split()
        texts.append(" ".join(t))
        for _ in range(r.randrange(6)):
            c = list(t)
            c[r.randrange(len(c))] = "other"
            texts.append(" ".join(c))
    fps = [slow_fingerprint(t) for t in texts]
    got = {x.doc_id: x for x in simhash.near_dedup(docs(spark, texts)).collect()}
    want = slow_components(fps)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert simhash.near_dedup(docs(spark, [])).count() == 0
    odd = docs(spark, ["a b c d"]).union(docs(spark, ["a b c d"])).union(spark.createDataFrame([(None, "a b c d", *[None] * 6), (None, "quite another one", *[None] * 6)], SCHEMA))
    rows = simhash.near_dedup(odd).collect()
    assert len(rows) == 4 and sorted(str(x.component_id) for x in rows) == ["0", "0", "0", "None"]


def test_links_of_crowded_buckets(spark):
    r = random.Random(7)
    fps = set()
    for _ in range(3):
        c = r.getrandbits(64)
        for _ in range(300):
            f = c
            for _ in range(r.randrange(7)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {x.node: x.root for x in simhash.components(simhash.links(df)).collect()}
    want = slow_components(fps)
    groups = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, []).append(f)
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


BLANKS = " \t\n\r\x0b\x0c"


def slow_dedup(texts, run=2, few=3, size=50):
    """text and deleted words by the definition: all lines, runs of lines and passages in order."""
    pieces, seen, gone, units = [re.findall(r"[ \t-\r]*[^ \t-\r]+", t or "") for t in texts], {}, [set() for _ in texts], []
    blanks = lambda x: x[: len(x) - len(x.lstrip(BLANKS))]
    for d, p in enumerate(pieces):
        w = [x.strip(BLANKS) for x in p]
        at = [i for i, x in enumerate(p) if i == 0 or "\n" in blanks(x)]
        lines = list(zip(at, [*at[1:], len(w)]))
        for j, (b, e) in enumerate(lines):
            if e - b >= few:
                units.append(((1, *w[b:e]), d, b, e))
            if j + run <= len(lines):
                units.append(((2, *(tuple(w[x:y]) for x, y in lines[j : j + run])), d, b, lines[j + run - 1][1]))
        units += [((3, *w[i : i + size]), d, i, i + size) for i in range(len(w) - size + 1)]
    for k, d, b, e in units:
        d0, b0 = seen.setdefault(k, (d, b))
        if (d0, b0) != (d, b) and not (k[0] == 3 and d0 == d and b < b0 + size):
            gone[d] |= set(range(b, e))
    out = []
    for t, p, g in zip(texts, pieces, gone):
        text, last = "", -1
        for i, x in enumerate(p):
            if i in g:
                continue
            if last < i - 1 and (last < 0 or "\n" in blanks(p[last + 1])):
                x = blanks(p[last + 1]) + x.lstrip(BLANKS)
            text, last = text + x, i
        out.append((t if not g else text + t[len("".join(p)) :] if text else "", len(g)))
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(11)
    known = [words(n, r) for n in (50, 51, 70, 130)]
    texts = ["", None, "\n\n", "a", "a", "a " * 240, " \n" + known[0], words(20, r) + "\t" + known[0].replace(" ", "\n ", 3) + "\n \nend. \n", known[1][: known[1].rindex(" ")],
             "x y z\r\nq\r\n", "x y z\nq", "  x y\tz  \n\n  b c\n", "only this line\r\n", "only  this line",
             "first of all\nfluff and puff", "fluff and puff\nfoot of\x0cstuff", "foot of stuff\nfff", "\x0b first of all\x0c\n ffs", f"off {known[2]} of fluff"]
    for _ in range(80):
        parts = [p for _ in range(r.randrange(1, 5)) for p in (words(r.randrange(30), r), r.choice(known))]
        texts.append(r.choice([" ", "\n", "  \n"]).join(parts)[r.randrange(40) :])
    texts += ["\n".join(r.choice(["a", "b c", "c d e", "d", "", "  e ", f"u{r.random()} 1 2"]) for _ in range(r.randrange(14))) for _ in range(60)]
    df = docs(spark, texts)
    got = line_dedup.line_dedup(df)
    assert got.columns == [*df.columns, "n_removed"]
    got = {x.doc_id: x for x in got.collect()}
    for i, (text, n) in enumerate(slow_dedup(texts)):
        assert (got[i].text if i != 1 else "", got[i].n_removed) == (text or "", n), (i, texts[i])
    assert got[1].text is None


def test_line_dedup_of_repeated_rows_null_ids_and_no_rows(spark):
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    twice = line_dedup.line_dedup(docs(spark, ["p q r\ns"]).union(docs(spark, ["p q r\ns"]))).collect()
    assert [x.n_removed for x in twice] == [0, 0]
    rows = [(None, "some line here", "7"), (3, "some line here\nx", "8"), (3, "and some more words", "9")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_removed string"))
    assert sorted((x.text, x.n_removed) for x in got.collect()) == [("and some more words", 0), ("some line here", 0), ("x", 3)]
    assert got.columns == ["doc_id", "text", "n_removed"]


def test_line_dedup_of_very_long_texts(spark, tmp_path):
    long = "\r\n".join(f"line number {i}" for i in range(200_000))
    spark.createDataFrame([(i, t) for i, t in enumerate([long, long, "a" + " " * 300_000 + "b", "x y z\n" * 100_000])], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = {x.doc_id: (len(x.text), x.n_removed) for x in line_dedup.line_dedup(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == {0: (len(long), 0), 1: (0, 600_000), 2: (300_002, 0), 3: (6, 299_997)}


def test_pipeline_deletes_single_lines_and_passages_inside_lines(spark):
    import corpus_pipeline as p

    r = random.Random(13)
    passage = words(50, r)
    texts = ["one line that repeats\nother text here", "some more\none line that repeats\nand more words", f"first {passage} ends", f"then {passage} goes on"]
    got = {x.doc_id: x.text for x in p.lines(spark, docs(spark, texts), "").collect()}
    assert got == {0: texts[0], 1: "some more\nand more words", 2: texts[2], 3: "then goes on"}


def test_media_round_trip(spark):
    texts = ["", None, "a", "x" * 192, "x" * 193, "é" * 500, "same", "same", "y" * 100_000]
    got = {x.doc_id: x for x in media.media_columns(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (x.media_bytes, x.media_sha256) == (len(media.encode(p)), hashlib.sha256(media.encode(p)).hexdigest()) and media.decode(media.encode(p)) == p
        assert (x.width, x.height) == (192, len(p) // 192)
    assert got[6].feature == got[7].feature and media.media_columns(docs(spark, [])).count() == 0


def test_machine_pairs_identity():
    m = quality.Machine()
    idx, val = quality.features("One two two. THREE!! four | five\nsix", quality.Slots())
    m.w[:] = 0.1
    pairs = sum(float(m.v[idx[a]] @ m.v[idx[b]]) * val[a] * val[b] for a in range(len(idx)) for b in range(a))
    assert abs(m.raw(idx, val) - (m.w0 + 0.1 * val.sum() + pairs)) < 1e-5


def test_kernel_of_pieces_against_brute_force():
    """The table's sums are the kernel of each word, and of each two neighbours, with every landmark."""
    from itertools import combinations

    def slow(x):
        out = {}
        for c in combinations(range(len(x)), 3):
            if all(b - a <= toxicity.REACH for a, b in zip(c, c[1:])):
                out[tuple(x[i] for i in c)] = out.get(tuple(x[i] for i in c), 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    def squares(n):
        return sum(toxicity.DECAY ** (2 * (c - a + 1)) for a, b, c in combinations(range(n), 3) if b - a <= toxicity.REACH and c - b <= toxicity.REACH)

    words = ["idiot", "an", "id", "iot", "idxiot", "aabbaabb", "x", "lunch"]
    for mark in ("idiot", "abab", "lunch"):
        table = np.zeros(toxicity.CLASSES**3)
        for c, v in toxicity.phi(mark).items():
            table[c] = v
        kind, word, at, _ = toxicity.letters(" ".join(words))
        got, first = toxicity.in_pieces(kind, word, at, table.__getitem__)
        assert len(first) == len(words)
        for k, x in zip(got, [f"^{a}" for a in words] + [f"^{a}^{b}" for a, b in zip(words, words[1:])]):
            want = sum(v * slow(f"^{mark}").get(u, 0) for u, v in slow(x).items())
            assert abs(k - (want / squares(len(x)) ** 0.5 if len(x) > 2 else 0)) < 1e-4, (x, mark)


def test_letters_and_parts():
    kind, word, at, _ = toxicity.letters("I d.i o-t 12!\nÉ ab")
    assert "".join("^" if k == toxicity.BORDER else chr(96 + k) for k in kind) == "^i^di^ot^e^ab"
    assert word.tolist() == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4]
    assert at.tolist() == [0] * 8 + [at[8]] * 5 and at[8] > 0
    assert "".join("^" if k == toxicity.BORDER else chr(96 + k) for k in toxicity.letters("an i d i o t")[0]) == "^an^idiot"
    long = " ".join(f"w{i}" for i in range(30_000))
    cut = [s for _, s in toxicity.parts([long])]
    assert len(cut) > 2 and all(len(s) <= toxicity.BLOCK for s in cut)
    assert all(b.split(" ")[0] in a.split(" ")[-20:] for a, b in zip(cut, cut[1:])) and set(" ".join(cut).split()) == set(long.split())


@pytest.fixture(scope="module")
def held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return df, labels


def test_quality_held_out(spark, held_out_rows):
    df, labels = held_out_rows
    rows = quality.quality(df, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in rows)
    for y in (0, 1):  # both kinds, so that a constant answer fails
        mine = [x for x in rows if x.quality == y]
        assert sum(x.predicted == y for x in mine) / len(mine) >= 0.9


def test_toxicity_held_out(spark, held_out_rows):
    df, labels = held_out_rows
    got = toxicity.toxicity(df, labels).join(labels, "doc_id").join(df.select("doc_id", "text"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(x.doc_id).encode()) % 5 == 0 for x in got)
    bad, fine = [x for x in got if x.toxic == 1], [x for x in got if x.toxic == 0]
    assert sum(x.predicted for x in bad) / len(bad) >= 0.88 and sum(x.predicted for x in fine) / len(fine) <= 0.02
    insulting = [x for x in bad if re.search("idiot|moron|stupid|trash", x.text.lower())]
    assert len(insulting) > 30 and all(x.predicted for x in insulting)


def test_classifiers_of_odd_rows(spark, held_out_rows):
    labels = spark.createDataFrame([(0, 1, 1), (3, 0, 0), (3, 0, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    odd = docs(spark, ["", None, "x" * 50_000, "a b c"])
    odd = odd.union(odd.filter("doc_id = 3")).union(spark.createDataFrame([(None, "of no id", *[None] * 6)], SCHEMA))
    for f in (quality.quality, toxicity.toxicity):
        for few in (labels, labels.limit(0)):
            rows = f(odd, few).collect()
            assert len(rows) == 6 and len({x.score for x in rows if x.doc_id == 3}) == 1 and [x.held_out for x in rows if x.doc_id is None] == [False]
        assert f(odd.limit(0), labels).count() == 0


def test_sentences_of_labelled_rows():
    data = toxicity.Sentences(["Ab cd. Ab ef!\ngh", "", "cd 12 cd", "..."])
    assert data.words == ["ab", "cd", "ef", "gh"] and data.rows.tolist() == [0, 0, 0, 2]
    assert data.in_rows(np.array([True, True, False, True])).tolist() == [1, 1, 1, 1] and data.in_rows(np.array([False, False, True, False])).tolist() == [0, 1, 0, 0]
    value = np.array([0.0, 1.0, 2.0, -5.0])
    assert [data.words[i] for i in data.worst(value)] == ["cd", "ef", "gh", "cd"]


def test_split_and_marked_insults_are_toxic():
    bad = ["you idiot here", "what a stupid loser", "moron and idiot", "stupid moron", "idiot loser"] * 6
    fine = ["the quick brown fox went home", "some plain words about weather today", "reading about editions and patios"] * 12
    m = toxicity.Model().fit(bad + fine, [1] * len(bad) + [0] * len(fine))
    low = max(m.scores([*fine, "", "12 34", "a"]))
    for t in ("a i.d.i.o.t spoke", "such an idxiot", "st*upid thing", "i d i o t", "an id iot", "an idi ot", "an i-d iot", "st upid"):
        assert m.scores([t])[0] > low, t
    long = "plain words " * 40_000
    assert m.scores([long + "st upid " + long])[0] > max(low, m.scores([long])[0])
    assert m.scores(["fine text", "an idiot"]) == [m.scores(["fine text"])[0], m.scores(["an idiot"])[0]]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet")
    docs_ = source
    assert len(p.STAGES) == 5
    for n, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs_, d)
        if n < 4:
            assert out.columns == source.columns
            docs_ = out.cache()
            assert 0 < docs_.count() <= 2 * source.count()
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns) and out.count() == docs_.count()
    for _, stage in p.STAGES:
        assert stage(spark, source.limit(0), d).count() == 0


def test_pipeline_stages_of_odd_rows(spark):
    import corpus_pipeline as p

    d, stages = "/root/testdata/sf0.001", dict(p.STAGES)
    good = spark.read.parquet(f"{d}/documents.parquet").filter("n_chars > 2000").first().text
    rows = [(1, good), (1, good), (2, good), (None, good), (None, good), (None, None), (7, None), (8, ""), (9, " \n "), (10, "w " * 60_000), (11, good[::-1])]
    odd = spark.createDataFrame([(i, t, None, s, 0, "x", "y", "z", "k", 1) for (i, t), s in zip(rows, ["a", "a", "a", None, None, "b", "b", "b", None, "a", "b"])],
                                "doc_id long, text string, lang string, source string, n_chars long, fp string, times string, id string, __k string, copy int").repartition(3)
    for name, stage in p.STAGES[:4]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns and out.count() >= 0, name
    one = stages["SimHash near-dedup"](spark, odd, d).collect()
    assert sorted(x.doc_id for x in one if x.text == good) == [1] and sum(not (x.text or "").strip() for x in one) == 1 and len(one) == 4
    mixed = stages["mixing sources to target weights"](spark, odd, d).collect()
    assert all((x.text or "").strip() for x in mixed) and max(sum(y == x for y in mixed) for x in mixed) <= 4
    two = spark.createDataFrame([(1, "a b c", "s"), (1, "d " * 500, "s"), (2, "e " * 30, "t")], "doc_id long, text string, source string")
    taken = {x.text_hash: x.taken for x in __import__("linkmill.llm.mixing", fromlist=["mix"]).mix(two, with_hash=True).collect()}
    assert len(taken) == 3  # rows that share a doc_id keep their own counts


def test_pipeline_runs_over_a_small_table(spark, tmp_path):
    import shutil

    import corpus_pipeline as p

    d = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", d)
    out = p.run(spark, d).toPandas()
    source = spark.read.parquet(f"{d}/documents.parquet")
    assert list(out.columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < len(out) <= 2 * source.count()
    assert set(out.doc_id) <= {x.doc_id for x in source.select("doc_id").collect()} and out.n_tokens.min() > 0


def test_worker_keeps_one_state_and_restores_collection():
    import gc

    from linkmill.llm import bpe, common

    made = []
    assert common.resident(("a",), lambda: made.append("a") or 1) == 1
    assert common.resident(("a",), lambda: made.append("again") or 2) == 1
    assert common.resident(("b",), lambda: 3) == 3
    assert made == ["a"] and list(common._resident) == [("b",)]
    with bpe.worker(dict):
        assert not gc.isenabled()
    assert gc.isenabled()


def test_encoder_that_forgets_gives_the_same_ids():
    import public_tokenizers

    from linkmill.llm import bpe

    path, texts = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), [f"word{i} and  more\n{i % 7} é{i}" for i in range(1500)]
    assert bpe.Encoder(path, public_tokenizers.PATTERN, 5).encode(texts) == bpe.Encoder(path, public_tokenizers.PATTERN).encode(texts)
