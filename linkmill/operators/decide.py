"""Assignment of records to at most one master, and the F0.5 measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmill.functions.text import strip_zeros, tokens


def best_per_record(pairs: DataFrame) -> DataFrame:
    """ri, si, p, p2: each record's best master (ties: lowest si) and the runner-up's p, else 0."""
    w = Window.partitionBy("ri").orderBy(F.desc("p"), "si")
    return pairs.select("ri", "si", "p", F.lead("p", 1, 0.0).over(w).alias("p2"), F.row_number().over(w).alias("__o")).filter("__o = 1").drop("__o")


def assign_threshold(best: DataFrame, t: float) -> DataFrame:
    return best.filter(F.col("p") >= t)


def mass(pairs: DataFrame) -> DataFrame:
    """si, n_hat, log_p0, p0: expected number of matches and the chance of none, over all pairs; p0 is 0 where many pairs make it too small for a double, its logarithm is not."""
    sums = pairs.groupBy("si").agg(F.sum("p").alias("n_hat"), F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-7)))).alias("log_p0"))
    return sums.withColumn("p0", F.exp("log_p0"))


def assign_expected_f(pairs: DataFrame, best: DataFrame, p_min: float = 0.02, mass_scale: float = 1.0, use_empty: bool = True) -> DataFrame:
    """The masters' top sets that maximise expected F0.5; with use_empty, none where that scores better."""
    w = Window.partitionBy("si").orderBy(F.desc("p"), "ri")
    b = best.filter(F.col("p") >= p_min).join(mass(pairs), "si")
    b = b.withColumn("m", F.row_number().over(w).cast("long")).withColumn("cs", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = b.withColumn("ef", 1.25 * F.col("cs") / (F.col("m") + 0.25 * F.greatest(mass_scale * F.col("n_hat"), F.col("cs"))))
    own = Window.partitionBy("si")
    b = b.withColumn("top", F.max("ef").over(own))
    b = b.withColumn("star", F.min(F.when(F.col("ef") >= F.col("top") - 1e-12, F.col("m"))).over(own))
    if use_empty:
        b = b.filter("p0 < top")
    return b.filter("m <= star").select("ri", "si", "p", "p2")


def assign_hybrid(pairs: DataFrame, best: DataFrame, p_min: float, gate: float, mass_scale: float = 1.0) -> DataFrame:
    a = assign_expected_f(pairs, best, p_min, mass_scale, use_empty=False)
    return a.withColumn("__top", F.max("p").over(Window.partitionBy("si"))).filter(F.col("__top") >= gate).drop("__top")


def apply_decision(pairs: DataFrame, rule: dict) -> DataFrame:
    """rule: {"rule": "threshold", "t"}, {"rule": "expected", ...} or {"rule": "hybrid", "p_min", "gate"}."""
    best, rest = best_per_record(pairs), {k: v for k, v in rule.items() if k != "rule"}
    match rule["rule"]:
        case "threshold":
            return assign_threshold(best, rest["t"])
        case "expected":
            return assign_expected_f(pairs, best, **rest)
        case "hybrid":
            return assign_hybrid(pairs, best, **rest)
    raise ValueError(f"unknown rule {rule['rule']!r}")


def number_set(c: Column) -> Column:
    return F.array_distinct(F.transform(tokens(c), strip_zeros))


def gate_side(digits: Column, name: Column) -> Column:
    """What house_number_gate takes from one side of a pair, so that it is worked out once for each entity."""
    t = tokens(name)
    return F.struct(number_set(digits).alias("numbers"), F.array_contains(t, "and").alias("has_and"), F.array_contains(t, "et").alias("has_et"))


def gate_of_sides(r: Column, s: Column, unseen: float, t_eq: float, t_ne: float, t_and: float = 1.0) -> Column:
    """The threshold of a pair from both gate_sides."""
    a, b = r["numbers"], s["numbers"]
    share = F.arrays_overlap(a, b)
    extra = (r["has_and"] & ~s["has_and"]) | (r["has_et"] & s["has_and"] & ~r["has_and"])
    base = F.when(share, t_eq).when((F.size(a) > 0) & (F.size(b) > 0), t_ne).otherwise(unseen)
    return F.when(extra & share, F.least(base, F.lit(t_and))).otherwise(base)


def house_number_gate(rec_digits: Column, s1_digits: Column, rec_name: Column, s1_name: Column, unseen: float, t_eq: float, t_ne: float, t_and: float = 1.0) -> Column:
    """The threshold of a pair, by its house numbers and an inserted "and"."""
    return gate_of_sides(gate_side(rec_digits, rec_name), gate_side(s1_digits, s1_name), unseen, t_eq, t_ne, t_and)


def logit_blend(ps: list[Column], ws: list[float]) -> Column:
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    z = sum((w * F.log(clip(p) / (1 - clip(p))) for p, w in zip(ps, ws)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def f05(n_pred: Column, n_true: Column, tp: Column) -> Column:
    p, r = tp / n_pred, tp / n_true
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def confusion(s1: DataFrame, assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """si, country, n_pred, n_true, tp for every master. truth: ri, si."""
    hit = assigned.select("ri", "si").join(truth, ["ri", "si"]).groupBy("si").agg(F.count(F.lit(1)).alias("tp"))
    a, t = assigned.groupBy("si").agg(F.count(F.lit(1)).alias("n_pred")), truth.groupBy("si").agg(F.count(F.lit(1)).alias("n_true"))
    out = s1.select(F.col("id").alias("si"), "country")
    for d in (a, t, hit):
        out = out.join(d, "si", "left")
    return out.na.fill(0, ["n_pred", "n_true", "tp"])


def _means() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("f05"), F.round(F.avg(F.when(F.col("n_true") == 0, F.col("f"))), 6).alias("f05_singleton"),
            F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f"))), 6).alias("f05_matched")]


def macro_f05(conf: DataFrame) -> DataFrame:
    """country (NULL: all), n, f05, f05_singleton, f05_matched in one pass."""
    f = f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))
    return conf.withColumn("f", f).groupingSets([[F.col("country")], []], F.col("country")).agg(*_means())


def threshold_sweep(s1: DataFrame, best: DataFrame, truth: DataFrame, thresholds) -> DataFrame:
    """t, country (NULL: all) and the F0.5 means at each threshold; best and truth are read once.

    A best pair stands once for each threshold it reaches, partly summed before it is shuffled.
    """
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    hits = best.select("ri", "si", "p").join(truth.select("ri", "si", F.lit(1).alias("hit")), ["ri", "si"], "left")
    got = hits.select("si", "hit", F.explode(F.filter(ts, lambda t: F.col("p") >= t)).alias("t")).groupBy("si", "t").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    own = s1.select(F.col("id").alias("si"), "country").join(truth.groupBy("si").agg(F.count(F.lit(1)).alias("n_true")), "si", "left")
    conf = own.withColumn("t", F.explode(ts)).join(got, ["si", "t"], "left").na.fill(0, ["n_pred", "n_true", "tp"])
    f = f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))
    return conf.withColumn("f", f).groupingSets([[F.col("t"), F.col("country")], [F.col("t")]], F.col("t"), F.col("country")).agg(*_means())


def best_threshold(sweep: DataFrame) -> DataFrame:
    """t, f05: the threshold of the largest F0.5 over all countries, the lowest one among equals. One row."""
    return sweep.filter("country is null").agg(F.max_by(F.struct("t", "f05"), F.struct("f05", -F.col("t"))).alias("b")).select("b.*")


def hybrid_sweep(s1: DataFrame, pairs: DataFrame, truth: DataFrame, p_mins, gates) -> DataFrame:
    """p_min, gate, f05 over all masters of each hybrid rule; the pairs are ranked once for each p_min, the gates in one pass."""
    best, gs = best_per_record(pairs), F.array(*[F.lit(float(g)) for g in gates])
    kept = None
    for p_min in p_mins:  # a short fixed list of parameters
        a = assign_expected_f(pairs, best, p_min, use_empty=False).select("ri", "si", F.lit(float(p_min)).alias("p_min"), F.max("p").over(Window.partitionBy("si")).alias("lead"))
        kept = a if kept is None else kept.unionByName(a)
    hits = kept.join(truth.select("ri", "si", F.lit(1).alias("hit")), ["ri", "si"], "left")
    got = hits.select("si", "p_min", "hit", F.explode(F.filter(gs, lambda g: F.col("lead") >= g)).alias("gate")).groupBy("si", "p_min", "gate").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    own = s1.select(F.col("id").alias("si")).join(truth.groupBy("si").agg(F.count(F.lit(1)).alias("n_true")), "si", "left")
    cells = own.withColumn("p_min", F.explode(F.array(*[F.lit(float(p)) for p in p_mins]))).withColumn("gate", F.explode(gs))
    conf = cells.join(got, ["si", "p_min", "gate"], "left").na.fill(0, ["n_pred", "n_true", "tp"])
    return conf.groupBy("p_min", "gate").agg(F.round(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))), 6).alias("f05"))


def best_hybrid(sweep: DataFrame) -> DataFrame:
    """p_min, gate, f05 of the largest F0.5; the smallest parameters among equals. One row."""
    return sweep.agg(F.max_by(F.struct("p_min", "gate", "f05"), F.struct("f05", -F.col("p_min"), -F.col("gate"))).alias("b")).select("b.*")


def best_rule(thresholds: DataFrame, hybrids: DataFrame) -> dict:
    """The rule, as apply_decision takes it, of the largest F0.5 of both sweeps; a threshold wins a tie. Two rows reach the driver."""
    t, h = best_threshold(thresholds).first(), best_hybrid(hybrids).first()
    if h.f05 is not None and (t.f05 is None or h.f05 > t.f05):
        return {"rule": "hybrid", "p_min": h.p_min, "gate": h.gate}
    return {"rule": "threshold", "t": t.t}


def weighted_f05(conf: DataFrame, weights: DataFrame) -> DataFrame:
    """f05: the countries' means weighed anew. weights: country, w. One row."""
    own = conf.groupBy("country").agg(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))).alias("f"))
    return own.join(weights, "country").agg(F.round(F.sum(F.col("w") * F.col("f")) / F.sum("w"), 6).alias("f05"))


def country_report(s1: DataFrame, assigned: DataFrame) -> DataFrame:
    """country, masters, matches, per_master, empty (share of masters without a match)."""
    n = assigned.groupBy("si").agg(F.count(F.lit(1)).alias("k"))
    return s1.select(F.col("id").alias("si"), "country").join(n, "si", "left").na.fill(0, ["k"]).groupBy("country").agg(
        F.count(F.lit(1)).alias("masters"), F.sum("k").alias("matches"), F.round(F.avg("k"), 6).alias("per_master"), F.round(F.avg((F.col("k") == 0).cast("int")), 6).alias("empty"))


def hard_pairs(pairs: DataFrame, other: DataFrame, least: float = 0.003) -> DataFrame:
    """The pairs that either model gives `least` or more, with p_other: the second model's p, 1 where it has none."""
    met = pairs.join(other.select("ri", "si", F.col("p").alias("p_other")), ["ri", "si"], "left")
    return met.withColumn("p_other", F.coalesce("p_other", F.lit(1.0))).filter((F.col("p") >= least) | (F.col("p_other") >= least))


def id_lists(s1: DataFrame, assigned: DataFrame) -> DataFrame:
    """si, ids: one row for every master, its records in order, joined by commas; empty without any."""
    lists = assigned.groupBy("si").agg(F.sort_array(F.collect_set("ri")).alias("l"))
    return s1.select(F.col("id").alias("si")).join(lists, "si", "left").select("si", F.coalesce(F.array_join(F.col("l").cast("array<string>"), ","), F.lit("")).alias("ids"))
