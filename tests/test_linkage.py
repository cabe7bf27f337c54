import math
import random
import re

import pytest
from pyspark.sql import functions as F

from linkmill.functions import kernels, text
from linkmill.operators import blocking, decide, pairfeatures, tokenstats, windows
from linkmill.sources import tables


def value(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


NAMES = {"Boulangerie  Dupré S.R.L.": "boulangerie dupre s r l", "<EMPTY> Kiosk": "kiosk", "": "", "   ": "", "Rope&Sail Co": "rope and sail co", "ＮＯＲＤ　７": "nord 7", "Straße №3 – Øre": "strasse no3 ore", "Œuvre “Łódź”": "oeuvre lodz"}


@pytest.mark.parametrize("raw", NAMES)
def test_norm_name(spark, raw):
    assert value(spark, text.norm_name, raw) == NAMES[raw]


def test_norm_addr_and_romanisation(spark):
    assert value(spark, text.norm_addr, "Unit 4, N/A, 77 Quay Lane, nil, <ZIP>, 90210") == "unit 4 77 quay lane 90210"
    assert value(spark, text.norm_addr, " NONE ") == ""
    got = value(spark, text.norm_name, "Кафе Мир")
    assert got and got.isascii()
    assert value(spark, text.has_non_latin, "Мир") and not value(spark, text.has_non_latin, "ñandú")


def test_no_text_is_sent_to_python(spark):
    rows = spark.createDataFrame([("plain",), ("Кафе",), (None,), ("élan",)], "c string")
    assert [r.v for r in rows.select(text.latin(F.col("c")).alias("v")).collect()] == ["plain", "kafe", None, "elan"]
    for f in (text.latin, text.norm_name, text.norm_addr, text.raw_tokens):
        assert "Python" not in rows.select(f(F.col("c")).alias("v"))._jdf.queryExecution().executedPlan().toString()


def test_kernels():
    assert kernels.ratio("", "") == 100 and kernels.partial_ratio("", "a") == 0 and kernels.token_set("", "") == 0
    assert kernels.token_set("quay mill", "mill quay old") == 100 and kernels.token_sort("mill quay", "quay mill") == 100
    assert kernels.partial_ratio("mill", "windmills") == 100
    assert round(kernels.jaro_winkler("martha", "marhta"), 4) == 0.9611
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert kernels.lcs(a, b) == t[-1][-1]


TOKS = "array<struct<p:int,tok:string,idf:double,known:boolean,q:double,last:double,first:double>>"
POOL = ["harbour", "harbor", "hbr", "works", "work", "of", "12", "120", "0", "314", "3140", "x", "mill", "mills", "ml", "the"]


def toks(r, words):
    return [(i, w, r.choice([0.0, 0.5, 1.25, 3.0]), r.random() < 0.5, r.choice([-1.0, 0.25, 0.75]), r.choice([0.0, 0.5]), r.choice([0.0, 1.0])) for i, w in enumerate(words)]


def pairs_of_tokens(spark):
    r = random.Random(21)
    rows = [([], [], 0), ([], toks(r, ["x"]), 1), (toks(r, ["x"]), [], 2), ([(0, "zero", 0.0, False, -1.0, 0.0, 0.0)], toks(r, ["mill"]), 3)]
    rows += [(toks(r, r.choices(POOL, k=r.randrange(6))), toks(r, r.choices(POOL, k=r.randrange(6))), i) for i in range(4, 160)]
    return rows, spark.createDataFrame(rows, f"r {TOKS}, s {TOKS}, i int").repartition(4)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def like(a, b, least):
    return min(len(a), len(b)) >= least and 4 * distance(a, b) <= max(len(a), len(b))


def short_for(a, b):
    return re.fullmatch("[a-z]{2,}", a) is not None and len(a) < len(b) and re.match(a[0] + "".join(f".*{c}" for c in a[1:]), b) is not None


def slow_cover(left, right, short):
    names = [t[1] for t in right]
    grade = [1 if t[1] in names else 0.8 if any(like(t[1], u, 4) or short and (short_for(t[1], u) or short_for(u, t[1])) for u in names) else 0 for t in left]
    mass, missed = sum(t[2] for t in left), [t[2] for t, g in zip(left, grade) if not g]
    share = lambda f: sum(t[2] * g for t, g in zip(left, grade) if f(g)) / mass if mass else None
    return share(lambda g: True), share(lambda g: g == 1), max(missed, default=0.0), len(missed)


def near(got, want):
    return got is want is None or got is not None and want is not None and abs(got - want) < 1e-9


def test_coverage_against_brute_force(spark):
    rows, df = pairs_of_tokens(spark)
    for short in (False, True):
        cols = pairfeatures.covers(pairfeatures.graded(F.col("r"), F.col("s"), short), list("abcd"))
        for x in df.select("i", *[c.alias(k) for k, c in cols.items()]).collect():
            want = slow_cover(rows[x.i][0], rows[x.i][1], short)
            assert all(map(near, (x.a, x.b, x.c, x.d), want)), (rows[x.i], want, x)
    # Without any idf the shares are unknown, but the uncovered token counts.
    got = df.filter("i = 3").select(*[c.alias(k) for k, c in pairfeatures.covers(pairfeatures.graded(F.col("r"), F.col("s")), list("abcd")).items()]).first()
    assert tuple(got) == (None, None, 0.0, 1.0)


def relation(a, b):
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return 0 if a == b else 2 if len(a) == len(b) else 1 if long.startswith(short) or long.endswith(short) else 3


def test_numbers_against_brute_force(spark):
    rows, df = pairs_of_tokens(spark)
    only = lambda c: F.filter(F.col(c), lambda t: t["tok"].rlike("^[0-9]+$"))
    cols = pairfeatures.number_columns(F.transform(only("r"), lambda t: t["tok"]), F.transform(only("s"), lambda t: t["tok"])) | pairfeatures.rare_columns(only("r"), only("s"))
    for x in df.select("i", *[c.alias(k) for k, c in cols.items()]).collect():
        r, s = ([t for t in side if t[1].isdigit()] for side in rows[x.i][:2])
        if not r or not s:
            assert all(v is None for k, v in x.asDict().items() if k != "i")
            continue
        a, b = [t[1] for t in r], [t[1] for t in s]
        best = [min(relation(p, q) for q in b) for p in a]
        gaps = [abs(int(p) - int(q)) for p in a for q in b if len(p) == len(q) and p != q]
        top = max(s, key=lambda t: (t[2], -t[0]))[1]
        off = [abs(int(p) - int(top)) for p in a if len(p) == len(top)]
        gap = abs(int(a[0]) - int(b[0]))
        want = {"dz_rex": best.count(0) / len(a), "dz_rnear": best.count(2) / len(a), "dz_sex": sum(q in a for q in b) / len(b), "hn_rel": relation(a[0], b[0]), "hn_logdiff": math.log1p(gap), "hn_reldiff": gap / max(int(a[0]), int(b[0]), 1),
                "dz_minnear_log": math.log1p(min(gaps)) if gaps else None, "dz_nearonly": float(2 in best and 0 not in best), "nz_idfcov_r": sum(t[2] for t in r if t[1] in b) / max(1e-9, sum(t[2] for t in r)),
                "nz_rare_rel": min(relation(p, top) for p in a), "nz_rare_logdiff": math.log1p(min(off)) if off else None}
        assert all(near(x[k], v) for k, v in want.items()), (a, b, want, x)


def test_edit_operations_against_brute_force(spark):
    rows, df = pairs_of_tokens(spark)
    cols = pairfeatures.edit_columns(F.col("r"), F.col("s"), F.col("got"))
    met = df.withColumn("got", pairfeatures.aligned_tokens(F.col("r"), F.col("s")))
    for x in met.select("i", *[c.alias(k) for k, c in cols.items()]).collect():
        r, s, _ = rows[x.i]
        if not r or not s:
            assert x.o_nins is None and x.o_del_qmax is None
            continue
        stands: dict[int, int] = {}
        for same in (lambda a, b: a == b, lambda a, b: like(a, b, 3), lambda a, b: short_for(a, b) or short_for(b, a)):
            for i, a in enumerate(r):
                open_ = [j for j, b in enumerate(s) if j not in stands.values() and same(a[1], b[1])]
                if i not in stands and open_:
                    stands[i] = open_[0]
        ins, gone = [i for i in range(len(r)) if i not in stands], [j for j in range(len(s)) if j not in stands.values()]
        path = [stands[i] for i in sorted(stands)]
        want = {"o_nins": len(ins), "o_ndel": len(gone), "o_ins_at_end": float(len(r) - 1 in ins), "o_del_s1last": float(len(s) - 1 in gone), "o_ins_frac": len(ins) / len(r), "o_order_swap": sum(a > b for a, b in zip(path, path[1:])),
                "o_ins_novel": sum(not r[i][3] for i in ins), "o_ins_qmax": max((r[i][4] for i in ins), default=None), "o_del_qmin": min((s[j][4] for j in gone), default=None), "o_del_firstmax": max((s[j][6] for j in gone), default=None)}
        assert all(near(x[k], v) for k, v in want.items()), (r, s, want, x)


def test_gap_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(37), float(r.randrange(11))) for i in range(1234)]
    gap, rank, n = windows.gap_to_best_other(F.col("v"), "k", "i")
    got = spark.createDataFrame(rows, "i long, k long, v double").repartition(7).select("i", gap.alias("g"), rank.alias("r"), n.alias("n")).collect()
    by = {i: (k, v) for i, k, v in rows}
    for x in got:
        k, v = by[x.i]
        others = [w for j, kk, w in rows if kk == k and j != x.i]
        assert x.g == v - max(others) and x.n == len(others) + 1
        assert x.r == sum((-w, j) < (-v, x.i) for j, kk, w in rows if kk == k)


def test_decisions(spark):
    p = spark.createDataFrame([(41, 7, 0.31), (41, 9, 0.88), (42, 9, 0.97), (43, 7, 0.44), (44, 8, 0.12)], "ri long, si long, p double")
    assert decide.best_per_record(p).count() == 4
    assert {r.si for r in decide.apply_decision(p, {"rule": "hybrid", "p_min": 0.2, "gate": 0.66}).collect()} == {9}
    ties = spark.createDataFrame([(5, s, 0.55) for s in (61, 60, 77)] + [(6, s, 0.21) for s in (99, 12)], "ri long, si long, p double")
    assert {(r.ri, r.si) for r in decide.best_per_record(ties.repartition(3)).collect()} == {(5, 60), (6, 12)}
    for rule in ({"rule": "threshold", "t": 0.5}, {"rule": "expected"}, {"rule": "hybrid", "p_min": 0.3, "gate": 0.5}):
        assert decide.apply_decision(p.limit(0), rule).count() == 0
    with pytest.raises(ValueError):
        decide.apply_decision(p, {"rule": "none"})


def test_empty_record_and_lone_master(spark):
    s = spark.createDataFrame([(1, "no", "fjord ferries", "4 pier"), (2, "no", "kelp farm", "88 bay road"), (3, "is", "geyser", "6 vik")], "id long, country string, name string, addr string")
    r = spark.createDataFrame([(10, "no", "", ""), (11, "no", "fjord ferry", "4 pier"), (12, "is", "geyser ltd", ""), (13, "fo", "q", "z")], s.schema)
    got = {(x.ri, x.si): x for x in blocking.block(s, r).collect()}
    assert {(10, 1), (10, 2), (11, 1), (12, 3)} <= set(got) and not any(k[0] == 13 for k in got)
    assert got[11, 1].rank_both == 0


def test_token_votes(spark):
    rows = [(i, "Mir Bakery", "Мир Bakery") for i in range(3)] + [(9, "Kelp", "Kelp")]
    df = spark.createDataFrame(rows, "entity long, s1_name string, rec_name string")
    assert [(r.tok, r.latin) for r in tokenstats.token_votes(df).collect()] == [("Мир", "mir")]
    assert tokenstats.token_votes(df.withColumn("entity", F.lit(1))).count() == 0


def test_sources(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "a.tsv").write_text(head + 'k1\t"Old ""Tom"" Gin"\t<EMPTY>\tNorway\nk2\tnil\tNA\tIceland\nk3\t""\t""\tPeru\n')
    got = {r.entity_id: r for r in tables.read_source(spark, str(tmp_path / "a.tsv")).collect()}
    assert got["k1"].business_name == 'Old "Tom" Gin' and got["k2"].business_name == "nil" and got["k3"].business_name == ""
    (tmp_path / "b.tsv").write_text(head + "k9\tp\tq\tPeru\n" * 2)
    with pytest.raises(ValueError):
        tables.read_source(spark, str(tmp_path / "b.tsv"))
    (tmp_path / "g.tsv").write_text('source1_entity_id\tmatched_entity_ids\nm7\tv4, v5\nm8\t\n')
    assert {r.s1: r.ids for r in tables.read_ground_truth(spark, str(tmp_path / "g.tsv")).collect()} == {"m7": ["v4", "v5"], "m8": []}


def test_step_refuses_stale(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda: spark.range(3)
    assert tables.step(spark, path, make, "m1").count() == tables.step(spark, path, make, "m1").count() == 3
    with pytest.raises(tables.StaleArtifact):
        tables.step(spark, path, make, "m2")
    spark.range(5).write.parquet(f"{tmp_path}/bare")
    with pytest.raises(tables.StaleArtifact):
        tables.step(spark, f"{tmp_path}/bare", make, "m1")
    assert spark.read.parquet(f"{tmp_path}/bare").count() == 5
    a = spark.createDataFrame([(1, 1, 5)], "ri long, si long, x long")
    assert tables.aligned(a, a.withColumnRenamed("x", "y")).count() == 1
    with pytest.raises(ValueError):
        tables.aligned(a, a.withColumn("ri", F.lit(2)))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_sweep_report_and_hard_pairs(spark):
    from linkmill.operators import decide

    s1 = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id long, country string")
    best = spark.createDataFrame([(10, 1, 0.9), (11, 1, 0.6), (12, 2, 0.4)], "ri long, si long, p double")
    truth = spark.createDataFrame([(10, 1)], "ri long, si long")
    got = {(r.t, r.country): (r.n, r.f05) for r in decide.threshold_sweep(s1, best, truth, [0.3, 0.5, 0.95]).collect()}
    half = round(1.25 * 0.5 / (0.25 * 0.5 + 1), 6)
    assert got[0.3, "A"] == (2, round(half / 2, 6)) and got[0.5, "A"] == (2, round((half + 1) / 2, 6)) and got[0.95, "A"] == (2, 0.5)
    assert got[0.3, "B"] == (1, 1.0) and got[0.5, None] == (3, round((half + 2) / 3, 6))
    assert decide.best_threshold(decide.threshold_sweep(s1, best, truth, [0.3, 0.5, 0.95])).first().t == 0.5
    for conf_t in (0.3, 0.5, 0.95):  # the sweep agrees with the measure at one threshold
        one = {r.country: r.f05 for r in decide.macro_f05(decide.confusion(s1, decide.assign_threshold(best, conf_t), truth)).collect()}
        assert one == {c: f for (t, c), (_, f) in got.items() if t == conf_t}
    assert {tuple(r) for r in decide.country_report(s1, best).collect()} == {("A", 2, 3, 1.5, 0.0), ("B", 1, 0, 0.0, 1.0)}
    other = spark.createDataFrame([(10, 1, 0.0), (11, 1, 0.7)], "ri long, si long, p double")
    pairs = spark.createDataFrame([(10, 1, 0.001), (11, 1, 0.001), (12, 2, 0.001)], "ri long, si long, p double")
    assert {tuple(r) for r in decide.hard_pairs(pairs, other).collect()} == {(11, 1, 0.001, 0.7), (12, 2, 0.001, 1.0)}
    none = best.limit(0)
    assert {r.f05 for r in decide.threshold_sweep(s1, none, truth.limit(0), [0.5]).collect()} == {1.0}


def test_gbt_queries_learn_from_all_features_with_the_defaults(spark, monkeypatch):
    from linkmill.operators import matcher
    from linkmill.plans import catalogue, linkage

    seen = []
    monkeypatch.setattr(matcher, "fit_folds", lambda f, *a, **b: seen.append((f, a, b)) or [])
    monkeypatch.setattr(matcher, "out_of_fold", lambda f, m: f)
    monkeypatch.setattr(matcher, "predict", lambda f, m: f)
    monkeypatch.setattr(linkage, "written", lambda f, name: f)
    d = "/root/testdata/sf0.001"
    want = set(matcher.feature_columns(linkage.features(*catalogue.entities(spark, d))))
    for name in ("gbt_oof", "gbt_predict"):
        got = catalogue.QUERIES[name](spark, d)
        assert set(matcher.feature_columns(got)) == want and {"n_tset", "a_cov_s", "hn_rel", "o_nins", "cos_both"} <= want
    assert [x[1:] for x in seen] == [((), {})] * 2


def test_saved_models_rules_and_maps(spark, tmp_path):
    from linkmill.operators import matcher
    from linkmill.plans import linkage

    r = random.Random(2)
    rows = [(i, i // 3, int(i % 3 == 0), (i % 3 == 0) * 1.0 + r.random() / 4, r.random()) for i in range(240)]
    f = spark.createDataFrame(rows, "ri long, si long, y int, good double, noise double")
    models = matcher.fit_folds(f, 2, rounds=2, depth=2)
    weight = {x.feature: x.weight for x in matcher.importance(models, f).collect()}
    assert set(weight) == {"good", "noise"} and weight["good"] > weight["noise"]
    mapping = spark.createDataFrame([("Мир", "mir", 4)], "tok string, latin string, n long")
    linkage.save(spark, f"{tmp_path}/m", models, {"rule": "hybrid", "p_min": 0.1, "gate": 0.6}, mapping)
    again, rule, tokens = linkage.load(spark, f"{tmp_path}/m")
    assert rule == {"rule": "hybrid", "p_min": 0.1, "gate": 0.6} and tokens.collect() == mapping.collect()
    same = lambda m: {(x.ri, x.si): x.p for x in matcher.predict(f, m).collect()}
    assert same(again) == same(models)
    import shutil

    for folds, columns in ((3, None), (1, None)):
        with pytest.raises(tables.StaleArtifact):
            matcher.load_models(f"{tmp_path}/m/models", folds, columns)
    matcher.save_models(models, f"{tmp_path}/n", ["good", "noise"])
    with pytest.raises(tables.StaleArtifact):
        matcher.load_models(f"{tmp_path}/n", 2, ["good"])
    shutil.rmtree(f"{tmp_path}/n/fold-1")
    with pytest.raises(tables.StaleArtifact):
        matcher.load_models(f"{tmp_path}/n", 2)


def test_best_rule_of_both_sweeps(spark):
    t = spark.createDataFrame([(0.5, None, 0.7), (0.6, None, 0.8), (0.7, None, 0.8)], "t double, country string, f05 double")
    h = lambda f: spark.createDataFrame([(0.02, 0.5, 0.1), (0.3, 0.9, f), (0.3, 0.8, f)], "p_min double, gate double, f05 double")
    assert decide.best_rule(t, h(0.8)) == {"rule": "threshold", "t": 0.6}
    assert decide.best_rule(t, h(0.9)) == {"rule": "hybrid", "p_min": 0.3, "gate": 0.8}


def test_id_lists_and_truth_are_written_and_read(spark, tmp_path):
    s1 = spark.createDataFrame([(2, "m8"), (0, "m7"), (1, "m9")], "position long, s1 string")
    lists = spark.createDataFrame([("m7", ["v2", "v1", "v2"]), ("m8", [])], "s1 string, ids array<string>")
    tables.write_id_lists(s1, lists, f"{tmp_path}/out")
    rows = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert rows == ['m7\tv2,v1', "m9\t", "m8\t"] or [x.replace('"', "") for x in rows] == ["m7\tv2,v1", "m9\t", "m8\t"]
    (tmp_path / "g.tsv").write_text("source1_entity_id\tmatched_entity_ids\nm7\tv2, v1\nm9\t\n")
    got = tables.truth_pairs(tables.read_ground_truth(spark, f"{tmp_path}/g.tsv")).collect()
    assert sorted(map(tuple, got)) == [("m7", "v1"), ("m7", "v2")]


def test_top_pairs_with_many_twins_and_single_grams(spark):
    """Ties of more masters than k go to the smallest ids, also where only a frequent gram is shared."""
    s = spark.createDataFrame([(i, "c", "mill house" if i % 2 else "quay", "") for i in range(100)], "id long, country string, name string, addr string")
    r = spark.createDataFrame([(1000, "c", "mill", ""), (1001, "c", "quay", ""), (1002, "c", "", ""), (1003, "d", "mill", "")], s.schema)
    got = {}
    for x in blocking.top_pairs(s, r, "both").collect():
        got.setdefault(x.ri, []).append((x.rank, x.si))
    assert [i for _, i in sorted(got[1000])] == list(range(1, 20, 2)) and [i for _, i in sorted(got[1001])] == list(range(0, 20, 2))
    assert len(got[1002]) == 10 and 1003 not in got


def test_one_file_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Records with quoted line breaks, tabs and quotes, cut anywhere by the splits."""
    r = random.Random(12)
    pieces = ["x", "word ", "\n", "\n\n", "\t", '"', "é", "\r\n", ",", "ends\\n"]
    rows = [(f"k{i}", "".join(r.choices(pieces, k=r.randrange(12))), r.choice(["", "plain", '5" pipe', "a\nb"]), r.choice(["no", "is"])) for i in range(700)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in "\n\r\t") or v[:1] == '"' or r.random() < 0.2 else v
    text_ = "\t".join(tables.COLUMNS) + "\n" + "".join("\t".join(map(quoted, row)) + "\n" for row in rows)
    (tmp_path / "s.tsv").write_text(text_, newline="")
    want = sorted(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert tables._lines(spark, str(tmp_path / "s.tsv")).rdd.getNumPartitions() > 20
        got = sorted(tuple(x) for x in tables.read_source(spark, str(tmp_path / "s.tsv")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert sorted(tuple(x) for x in tables.read_source(spark, str(tmp_path / "s.tsv")).collect()) == want


@pytest.mark.parametrize("line, inside, after", [("a\tb", False, False), ('a\t"b', False, True), ('b"\tc', True, False), ('b""', True, True), ('5" x\ty', False, False), ('"a""b"\t"', False, True), ('""', False, False), ('"', True, False), ('"x"y"\tz', False, False)])
def test_quoted_after(line, inside, after):
    assert tables.quoted_after(line, inside) is after


def test_group_ranks_in_many_ranges(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1.5, float(r.randrange(60)), r.random()])) for i in range(2000)] + [(9999, "alone", 3.0), (9998, "none", None)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(6)
    got = {x.i: x.q for x in windows.quantile_rank(df, "g", "v", "q").collect()}
    assert len(got) == len(rows)
    by = {}
    for _, g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    for i, g, v in rows:
        own = by.get(g, [])
        want = None if v is None else (sum(x < v for x in own) + (own.count(v) - 1) / 2) / max(1, len(own) - 1)
        assert near(got[i], want), (g, v)
    plan = windows.quantile_rank(df, "g", "v", "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "__range" in plan


def test_mapped_names_with_a_large_mapping(spark):
    mapping = spark.range(300_000).select(F.concat(F.lit("т"), "id").alias("tok"), F.concat(F.lit("t"), "id").alias("latin")).unionByName(spark.createDataFrame([("Мир", "mir")], "tok string, latin string"))
    names = spark.createDataFrame([(1, "Мир т299999, Кафе Bar"), (2, "plain Bar"), (3, "Кафе"), (4, ""), (5, None), (6, "т7 т7")], "id long, name string")
    got = {x.id: (x.name, x.map_cov) for x in tokenstats.mapped_names(names, mapping).collect()}
    assert got == {1: ("mir t299999 Кафе Bar", 2 / 3), 3: ("Кафе", 0.0), 6: ("t7 t7", 1.0)}


def test_normalise_joins_the_map_and_refuses_a_second(spark):
    from linkmill.plans import linkage

    source = spark.createDataFrame([("1", "Мир Bakery", "1 quay", "no"), ("2", "Kelp", "2 quay", "no"), ("3", None, None, "no")], "entity_id string, business_name string, business_address string, country string")
    mapping = spark.createDataFrame([("Мир", "mir", 4)], "tok string, latin string, n long")
    once = linkage.normalise(source, mapping)
    got = {x.id: (x.name, x.name_nonlatin, x.name_mapped, x.map_cov) for x in once.collect()}
    assert got == {"1": ("mir bakery", True, True, 1.0), "2": ("kelp", False, False, None), "3": ("", False, False, None)}
    again = source.join(once.select(F.col("id").alias("entity_id"), "name_mapped"), "entity_id")
    with pytest.raises(ValueError):
        linkage.normalise(again, mapping)


def test_logits_are_ranked_among_pairs_that_have_one(spark):
    pairs = spark.createDataFrame([(1, s) for s in range(4)] + [(2, 0)], "ri long, si long")
    z = spark.createDataFrame([(1, 1, -25.0), (1, 3, 2.0), (2, 0, 0.5), (7, 7, 1.0)], "ri long, si long, z double")
    got = {(x.ri, x.si): (x.ce_rank, x.ce_gap) for x in windows.logit_features(pairs, z).collect()}
    assert got == {(1, 0): (None, None), (1, 2): (None, None), (1, 1): (1, -27.0), (1, 3): (0, 27.0), (2, 0): (0, 20.5)}
