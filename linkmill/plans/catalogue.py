"""Queries over the driver's tables with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.functions import kernels, text
from linkmill.operators import blocking, decide, matcher, pairfeatures, tokenstats, views, windows
from linkmill.plans import linkage

QUERIES: dict = {}
ORACLES: dict = {}
MASTERS = ("Brand#1", "Brand#2")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Masters and records, all rows of part: id, country, name, addr, from whole columns."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("country"), "p_brand",
        text.norm_name(F.col("p_name")).alias("name"), text.norm_addr(F.concat_ws(", ", "p_brand", "p_size")).alias("addr"))
    master = F.col("p_brand").isin(*MASTERS)
    return p.filter(master).drop("p_brand"), p.filter(~master).drop("p_brand")


def candidates(spark, sf_dir) -> DataFrame:
    return blocking.block(*entities(spark, sf_dir))


def with_p(pairs: DataFrame) -> DataFrame:
    """A closed form in place of a trained score."""
    return pairs.select("ri", "si", F.round(1 / (1 + F.exp(-(6 * F.col("cos_both") + 4 * F.col("cos_name") - 5))), 6).alias("p"))


def scores(spark, sf_dir) -> DataFrame:
    return with_p(candidates(spark, sf_dir))


NORM = "trim(regexp_replace(replace(strip_accents(replace(lower(regexp_replace({x}, '<[A-Za-z_]+>', ' ', 'g')), 'ß', 'ss')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
ADDR = NORM.format(x="array_to_string(list_filter(string_split(p_brand || ', ' || p_size, ','), lambda p: lower(trim(p)) NOT IN ('null', 'none', 'n/a', 'na', 'nil', '-')), ',')")
ENT = f"ent AS (SELECT p_partkey AS id, p_type AS country, p_brand IN ('Brand#1', 'Brand#2') AS m, {NORM.format(x='p_name')} AS name, {ADDR} AS addr FROM part)"


def block_sql(b: str, t: str) -> str:
    """CTEs {b}_pairs (all) and {b}_top of one blocker, without any trick."""
    return f"""{b}_w AS (SELECT country, id, m, unnest(string_split({t}, ' ')) AS w FROM ent),
{b}_g AS (SELECT country, id, m, substr(' ' || w || ' ', i, 3) AS gram, count(*) AS tf FROM (SELECT country, id, m, w, unnest(range(1, len(w) + 1)) AS i FROM {b}_w WHERE w <> '') GROUP BY ALL),
{b}_n AS (SELECT country, count(*) AS n FROM ent WHERE m GROUP BY 1),
{b}_d AS (SELECT country, gram, count(*) AS df, max(count(*)) OVER (PARTITION BY country) AS top FROM {b}_g WHERE m GROUP BY country, gram),
{b}_v AS (SELECT country, gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM {b}_d JOIN {b}_n USING (country) WHERE df >= 2 OR top < 2),
{b}_r AS (SELECT country, id, m, gram, (1 + ln(tf)) * idf AS w FROM {b}_g JOIN {b}_v USING (country, gram)),
{b}_u AS (SELECT country, id, m, gram, w / sqrt(sum(w * w) OVER (PARTITION BY country, id)) AS w FROM {b}_r),
{b}_pairs AS (SELECT q.country, q.id AS ri, s.id AS si, round(sum(q.w * s.w), 6) AS cos FROM {b}_u q JOIN {b}_u s ON q.country = s.country AND q.gram = s.gram AND NOT q.m AND s.m GROUP BY ALL),
{b}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ri ORDER BY cos DESC, si) - 1 AS rank FROM {b}_pairs WHERE cos > 0) WHERE rank < 10)"""


BOTH, NAME = block_sql("b", "name || ' | ' || addr"), block_sql("n", "name")
CANDS = f"""{ENT}, {BOTH}, {NAME},
cands AS (SELECT country, ri, si, coalesce(bp.cos, 0) AS cos_both, coalesce(np.cos, 0) AS cos_name, coalesce(rank_both, 10) AS rank_both, coalesce(rank_name, 10) AS rank_name
  FROM (SELECT country, ri, si, rank AS rank_both FROM b_top) FULL JOIN (SELECT country, ri, si, rank AS rank_name FROM n_top) USING (country, ri, si)
  LEFT JOIN b_pairs bp USING (country, ri, si) LEFT JOIN n_pairs np USING (country, ri, si))"""
SCORES = f"{CANDS}, pr AS (SELECT ri, si, round(1 / (1 + exp(-(6 * cos_both + 4 * cos_name - 5))), 6) AS p FROM cands)"
BEST = "best AS (SELECT ri, si, p, p2 FROM (SELECT ri, si, p, coalesce(lead(p) OVER w, 0) AS p2, row_number() OVER w AS o FROM pr WINDOW w AS (PARTITION BY ri ORDER BY p DESC, si)) WHERE o = 1)"
EXPECT = """mass AS (SELECT si, sum(p) AS n_hat, exp(sum(ln(1 - least(p, 1 - 1e-7)))) AS p0 FROM pr GROUP BY si),
e1 AS (SELECT best.*, n_hat, p0, row_number() OVER w AS m, sum(p) OVER w AS cs FROM best JOIN mass USING (si) WHERE p >= {p_min} WINDOW w AS (PARTITION BY si ORDER BY p DESC, ri ROWS UNBOUNDED PRECEDING)),
e2 AS (SELECT *, 1.25 * cs / (m + 0.25 * greatest(n_hat, cs)) AS ef FROM e1), e3 AS (SELECT *, max(ef) OVER (PARTITION BY si) AS top FROM e2),
e4 AS (SELECT *, min(m) FILTER (WHERE ef >= top - 1e-12) OVER (PARTITION BY si) AS star FROM e3)"""
TRUTH = "truth AS (SELECT r.p_partkey AS ri, min(s.p_partkey) AS si FROM part r JOIN part s ON r.p_name = s.p_name AND r.p_type = s.p_type WHERE r.p_brand NOT IN ('Brand#1', 'Brand#2') AND s.p_brand IN ('Brand#1', 'Brand#2') GROUP BY 1)"


def truth(spark, sf_dir) -> DataFrame:
    """ri, si: a record's master has the same name and type; the smallest key of several."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    s = p.filter(F.col("p_brand").isin(*MASTERS)).groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("si"))
    return p.filter(~F.col("p_brand").isin(*MASTERS)).join(s, ["p_name", "p_type"]).select(F.col("p_partkey").alias("ri"), "si")


# --- text

@query(f"WITH {ENT} SELECT id, country, m AS is_master, name, addr, array_to_string(regexp_extract_all(addr, '[0-9]+'), ' ') AS addr_digits, len(list_filter(string_split(name, ' '), lambda t: t <> '')) AS n_tok, len(list_filter(string_split(addr, ' '), lambda t: t <> '')) AS a_tok FROM ent")
def norm_entities(spark, d):
    s, r = entities(spark, d)
    e = s.withColumn("is_master", F.lit(True)).unionByName(r.withColumn("is_master", F.lit(False)))
    return pairfeatures.with_columns(e).select("id", "country", "is_master", "name", "addr", "addr_digits", "n_tok", "a_tok")


@query(f"SELECT doc_id, {NORM.format(x='text')} AS name, len(list_filter(string_split({NORM.format(x='text')}, ' '), lambda t: t <> '')) AS n_tok FROM documents")
def norm_documents(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.norm_name(F.col("text")).alias("name"))
    return t.withColumn("n_tok", text.token_count(F.col("name")))


@query(f"SELECT c_custkey, {NORM.format(x='c_name')} AS name, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, coalesce(nullif(ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0'), ''), '0') AS number, regexp_matches(c_name, '[^\\x00-\\x{{024F}}]') AS non_latin FROM customer")
def norm_customers(spark, d):
    c = table(spark, d, "customer").withColumn("name", text.norm_name(F.col("c_name"))).withColumn("digits", text.digits(F.col("name")))
    return c.select("c_custkey", "name", "digits", text.strip_zeros(F.col("digits")).alias("number"), text.has_non_latin(F.col("c_name")).alias("non_latin"))


@query("SELECT p_partkey, p_name, translate(lower(replace(p_name, 'e', '3')), '01345789', 'oleastbg') AS folded FROM part")
def ocr_fold(spark, d):
    t = F.transform(F.split(F.lower(F.replace("p_name", F.lit("e"), F.lit("3"))), " "), text.ocr_token)
    return table(spark, d, "part").select("p_partkey", "p_name", F.array_join(t, " ").alias("folded"))


@query("""SELECT DISTINCT a, b, CASE WHEN a = b THEN 0 WHEN len(a) = len(b) THEN 2 WHEN starts_with(x, y) OR ends_with(x, y) THEN 1 ELSE 3 END AS rel FROM (
  SELECT *, CASE WHEN len(a) > len(b) THEN a ELSE b END AS x, CASE WHEN len(a) > len(b) THEN b ELSE a END AS y FROM (SELECT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b FROM lineitem))""")
def number_relations(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b")).distinct()
    return p.select("a", "b", text.number_relation(F.col("a"), F.col("b")).alias("rel"))


WORDS = "words AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS t FROM part)"


@query(f"WITH {WORDS} SELECT a.t AS a, b.t AS b, levenshtein(a.t, b.t) AS lev, least(len(a.t), len(b.t)) >= 4 AND levenshtein(a.t, b.t) <= 0.25 * greatest(len(a.t), len(b.t)) AS fuzzy, len(a.t) < len(b.t) AND regexp_matches(b.t, '^' || array_to_string(string_split(a.t, ''), '.*')) AS abbrev FROM words a JOIN words b ON a.t[1] = b.t[1]")
def token_pairs(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("t")).distinct().withColumn("f", F.substring("t", 1, 1))
    p = w.select("f", F.col("t").alias("a")).join(w.select("f", F.col("t").alias("b")), "f")
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", F.levenshtein(a, b).cast("long").alias("lev"), text.tokens_match(a, b).alias("fuzzy"), text.is_abbreviation(a, b).alias("abbrev"))


@query("SELECT c_custkey, ((c_custkey * 2654435761) % 4294967296) % 5 AS fold, (c_custkey * 40503) % 1000 < 50 AS held FROM customer")
def hash_folds(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.fold_of(F.col("c_custkey"), 5).alias("fold"), text.es_holdout(F.col("c_custkey"), 0.05).alias("held"))


# --- statistics

@query(f"WITH {ENT} SELECT id, country, name, count(*) OVER (PARTITION BY country, name) AS twins FROM ent WHERE m")
def name_twins(spark, d):
    return tokenstats.name_twins(entities(spark, d)[0]).select("id", "country", "name", "twins")


IDF = f"""WITH {ENT}, n AS (SELECT country, count(*) AS n FROM ent WHERE m GROUP BY 1),
t AS (SELECT DISTINCT country, id, unnest(list_transform(string_split(name, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]') THEN translate(t, '01345789', 'oleastbg') ELSE t END)) AS tok FROM ent WHERE m)
SELECT country, tok, count(*) AS df, round(%s, 6) AS idf, count(*) >= greatest(0.02 * any_value(n), 50) OR len(tok) = 1 AS frequent FROM t JOIN n USING (country) WHERE tok <> '' GROUP BY country, tok"""


@query(IDF % "ln(any_value(n) / count(*))")
def token_idf(spark, d):
    return tokenstats.token_idf(entities(spark, d)[0])


@query(IDF % "least(ln(any_value(n) / count(*)), ln(1e5))")
def capped_idf(spark, d):
    return tokenstats.token_idf(entities(spark, d)[0], cap=1e5)


@query(f"""WITH {ENT}, t AS (SELECT country, id, list_filter(string_split(name, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$')) AS l FROM ent WHERE m),
o AS (SELECT country, id, tok, max((tok = l[len(l)])::INT) AS l, max((tok = l[1])::INT) AS f FROM (SELECT country, id, l, unnest(l) AS tok FROM t) GROUP BY ALL),
s AS (SELECT country, tok, count(*) AS df, avg(l) AS last, avg(f) AS first FROM o GROUP BY 1, 2)
SELECT country, tok, df, round((rank() OVER (PARTITION BY country ORDER BY df) - 1) / greatest(count(*) OVER (PARTITION BY country) - 1, 1), 6) AS q, round(last, 6) AS last, round(first, 6) AS first FROM s""")
def token_positions(spark, d):
    return tokenstats.token_positions(entities(spark, d)[0])


@query("""WITH p AS (SELECT p_partkey % 50 AS entity, string_split(lower(p_name), ' ') AS a, string_split(p_brand || ' ' || p_type, ' ') AS b FROM part),
v AS (SELECT entity, unnest(a) AS latin, unnest(b) AS tok FROM p WHERE len(a) = len(b)), n AS (SELECT tok, latin, count(*) AS n, count(DISTINCT entity) AS e FROM v GROUP BY 1, 2)
SELECT tok, latin, n FROM (SELECT *, sum(n) OVER (PARTITION BY tok) AS s FROM n) WHERE n >= 3 AND n / s >= 0.1 AND e >= 3""")
def token_map_votes(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("entity"), F.col("p_name").alias("s1_name"), F.concat_ws(" ", "p_brand", F.replace("p_type", F.lit("/"), F.lit("_"))).alias("rec_name"))
    return tokenstats.token_votes(p, purity=0.1, foreign=lambda c: F.lit(True))


MAPPED = """p AS (SELECT p_partkey AS id, string_split(p_brand || ' ' || p_type || ' ' || p_name, ' ') AS l FROM part), r AS (SELECT id, unnest(l) AS tok, generate_subscripts(l, 1) AS place FROM p),
m AS (SELECT lower(w) AS latin, w AS tok FROM (SELECT DISTINCT p_brand AS w FROM part WHERE p_partkey % 2 = 0))"""


@query(f"WITH {MAPPED} SELECT id, string_agg(coalesce(latin, r.tok), ' ' ORDER BY place) AS name, round(count(latin) / count(*), 6) AS map_cov FROM r LEFT JOIN m ON r.tok = m.tok GROUP BY 1")
def token_map_applied(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("name"))
    mapping = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("tok"), F.lower("p_brand").alias("latin")).distinct()
    return tokenstats.mapped_names(names, mapping, foreign=lambda c: F.lit(True)).withColumn("map_cov", F.round("map_cov", 6))


#: Latin letters of the tables' names and the Cyrillic and Greek ones that are spelled by them.
FOREIGN = (("abvgdeziyklmnoprstuf", "абвгдезийклмнопрстуф"), ("abgdeziklmnxoprstu", "αβγδεζικλμνξοπρστυ"))
WIDE = "".join(chr(0xFF01 + i) for i in range(94))
ASCII = "".join(map(chr, range(0x21, 0x7F)))


def foreign_sql(x: str) -> str:
    return f"translate({x}, '{FOREIGN[0][0]}', '{FOREIGN[0][1]}')"


@query("SELECT p_partkey, lower(p_name) AS cyrillic, lower(p_name) AS greek, lower(p_name) AS wide, true AS foreign FROM part")
def romanised_names(spark, d):
    """Names written in Cyrillic, Greek and full-width letters come back in Latin ones."""
    p = table(spark, d, "part").select("p_partkey", *[F.translate(F.lower("p_name"), *pair).alias(k) for k, pair in zip(("cyrillic", "greek", "wide"), (*FOREIGN, (ASCII, WIDE)))])
    return p.select("p_partkey", *[text.norm_name(F.col(c)).alias(c) for c in ("cyrillic", "greek", "wide")], (text.has_non_latin(F.col("cyrillic")) & text.has_non_latin(F.col("greek"))).alias("foreign"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_type || ' ' || p_name || '/' || p_brand, '[ /]'), lambda t: t <> ''), '|') AS toks, len(list_filter(regexp_split_to_array(p_type || ' ' || p_name || '/' || p_brand, '[ /]'), lambda t: t <> '')) AS n FROM part")
def raw_name_tokens(spark, d):
    """Full-width names, slash and blank in their full-width forms as well, in parts of their compatibility form."""
    p = table(spark, d, "part").select("p_partkey", F.translate(F.concat_ws(" ", "p_type", F.concat_ws("/", "p_name", "p_brand")), ASCII + " ", WIDE + "\u3000").alias("w"))
    t = p.select("p_partkey", text.raw_tokens(F.col("w")).alias("t"))
    return t.select("p_partkey", F.array_join("t", "|").alias("toks"), F.size("t").cast("long").alias("n"))


# Every second word's first two letters in Cyrillic stand for it: words of one beginning share their votes.
VOTES = f"""p AS (SELECT p_partkey AS entity, list_filter(string_split({NORM.format(x='p_name')}, ' '), lambda t: t <> '') AS a FROM part),
w AS (SELECT entity, unnest(a) AS latin, generate_subscripts(a, 1) AS place FROM p),
v AS (SELECT entity, latin, {foreign_sql('left(latin, 2)')} AS tok FROM w WHERE place % 2 = 0),
n AS (SELECT tok, latin, count(*) AS n, count(DISTINCT entity) AS e FROM v WHERE regexp_matches(tok, '[\\p{{Cyrillic}}]') GROUP BY 1, 2),
votes AS (SELECT tok, latin, n FROM (SELECT *, sum(n) OVER (PARTITION BY tok) AS s FROM n) WHERE n >= 3 AND n / s >= 0.6 AND e >= 3)"""


def foreign_pairs(spark, d) -> DataFrame:
    """entity, s1_name, rec_name."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("s1_name"))
    words = F.transform(F.split(F.lower("s1_name"), " "), lambda w, i: F.when(i % 2 == 1, F.translate(F.substring(w, 1, 2), *FOREIGN[0])).otherwise(w))
    return p.withColumn("rec_name", F.array_join(words, " "))


@query(f"WITH {VOTES} SELECT tok, latin, n FROM votes")
def foreign_token_votes(spark, d):
    return tokenstats.token_votes(foreign_pairs(spark, d))


@query(f"""WITH {VOTES}, r AS (SELECT entity AS id, place, CASE WHEN place % 2 = 0 THEN {foreign_sql('left(latin, 2)')} ELSE latin END AS tok FROM w)
SELECT id, string_agg(coalesce(latin, r.tok), ' ' ORDER BY place) AS name, round(count(latin) / count(*) FILTER (WHERE regexp_matches(r.tok, '[\\p{{Cyrillic}}]')), 6) AS map_cov
FROM r LEFT JOIN votes ON r.tok = votes.tok GROUP BY 1 HAVING count(*) FILTER (WHERE regexp_matches(r.tok, '[\\p{{Cyrillic}}]')) > 0""")
def foreign_names_mapped(spark, d):
    """The learned map applied to the foreign names that it was learned from."""
    p = foreign_pairs(spark, d)
    got = tokenstats.mapped_names(p.select(F.col("entity").alias("id"), F.col("rec_name").alias("name")), tokenstats.token_votes(p))
    return got.withColumn("map_cov", F.round("map_cov", 6))


# --- blocking

@query(f"WITH {ENT}, {NAME} SELECT ri, si, cos, rank FROM n_top")
def block_name_top10(spark, d):
    return blocking.top_pairs(*entities(spark, d), "name").select("ri", "si", "cos", "rank")


@query(f"WITH {ENT}, {BOTH} SELECT ri, si, cos, rank FROM b_top")
def block_both_top10(spark, d):
    return blocking.top_pairs(*entities(spark, d), "both").select("ri", "si", "cos", "rank")


@query(f"WITH {CANDS} SELECT * FROM cands")
def block_union(spark, d):
    return candidates(spark, d)


@query(f"WITH {CANDS}, {TRUTH}, found AS (SELECT count(*) AS hits FROM cands JOIN truth USING (ri, si)) SELECT (SELECT count(*) FROM cands) AS pairs, (SELECT count(DISTINCT ri) FROM cands) AS records, hits, (SELECT count(*) FROM truth) AS positives FROM found")
def block_stats(spark, d):
    c, t = candidates(spark, d), truth(spark, d)
    a = c.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("ri").alias("records"))
    return a.crossJoin(c.join(t, ["ri", "si"]).agg(F.count(F.lit(1)).alias("hits"))).crossJoin(t.agg(F.count(F.lit(1)).alias("positives")))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS l FROM v),
c AS (SELECT q.id AS qi, v.id AS vi, round(list_dot_product(q.e, v.e) / (q.l * v.l), 6) AS cos FROM n q JOIN n v ON q.id % 50 = 0 AND q.id <> v.id)
SELECT qi, vi, cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, vi) - 1 AS rank FROM c) WHERE rank < 10""")
def dense_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return blocking.dense_top_k(v, v.filter("id % 50 = 0"), 10)


# --- features

@query("""WITH w AS (SELECT event_id, user_id, value, row_number() OVER o - 1 AS rank, first_value(value) OVER f AS v1, nth_value(value, 2) OVER f AS v2, count(*) OVER (PARTITION BY user_id) AS n FROM events
  WINDOW o AS (PARTITION BY user_id ORDER BY value DESC, event_id), f AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(value - CASE WHEN rank = 0 THEN v2 ELSE v1 END, 6) AS gap, rank, n FROM w""")
def context_gap(spark, d):
    gap, rank, n = windows.gap_to_best_other(F.col("value"), "user_id", "event_id")
    return table(spark, d, "events").select("event_id", F.round(gap, 6).alias("gap"), rank.alias("rank"), n.alias("n"))


def gap_sql(c: str, key: str, tie: str) -> str:
    return f"round({c} - CASE WHEN row_number() OVER ({key}_{c}) = 1 THEN nth_value({c}, 2) OVER ({key}_{c} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE first_value({c}) OVER ({key}_{c}) END, 6)"


@query(f"""WITH {CANDS} SELECT ri, si, {gap_sql('cos_both', 'ri', 'si')} AS rg_cos_both, row_number() OVER (ri_cos_both) - 1 AS rr_cos_both, count(*) OVER (PARTITION BY ri) AS r_ncand,
{gap_sql('cos_both', 'si', 'ri')} AS sg_cos_both, row_number() OVER (si_cos_both) - 1 AS sr_cos_both, count(*) OVER (PARTITION BY si) AS s_ncand FROM cands
WINDOW ri_cos_both AS (PARTITION BY ri ORDER BY cos_both DESC, si), si_cos_both AS (PARTITION BY si ORDER BY cos_both DESC, ri)""")
def context_pairs(spark, d):
    c = windows.add_context(candidates(spark, d).select("ri", "si", "cos_both"))
    return c.withColumn("rg_cos_both", F.round("rg_cos_both", 6)).withColumn("sg_cos_both", F.round("sg_cos_both", 6)).drop("cos_both")


@query("SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) - 1 + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2) / greatest(count(*) OVER (PARTITION BY event_type) - 1, 1), 6) AS q FROM events")
def qnorm(spark, d):
    return windows.quantile_rank(table(spark, d, "events"), "event_type", "value", "q").select("event_id", F.round("q", 6).alias("q"))


@query("SELECT c_custkey, s_suppkey, round(jaro_winkler_similarity(c_name, s_name), 6) AS jw FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def jaro_winkler(spark, d):
    side = lambda name, p, key: table(spark, d, name).select(F.col(key).cast("long").alias("id"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_name").alias("text"))
    p = blocking.text_pairs(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), "nation", kernels.jaro_winkler_table, lambda v: F.round(v, 6))
    c, s = table(spark, d, "customer").schema["c_custkey"].dataType, table(spark, d, "supplier").schema["s_suppkey"].dataType
    return p.select(F.col("li").cast(c).alias("c_custkey"), F.col("ri").cast(s).alias("s_suppkey"), F.col("value").alias("jw"))


@query()
def string_features(spark, d):
    return pairfeatures.string_features(candidates(spark, d), *entities(spark, d))


@query()
def token_features(spark, d):
    s, r = entities(spark, d)
    return pairfeatures.token_features(candidates(spark, d), s, r)


@query()
def capped_token_features(spark, d):
    s, r = entities(spark, d)
    return pairfeatures.token_features(candidates(spark, d), s, r, cap=1e5)


@query(f"WITH {CANDS}, {TRUTH} SELECT c.ri, c.si, (t.si IS NOT NULL)::INT AS y FROM cands c LEFT JOIN truth t ON c.ri = t.ri AND c.si = t.si")
def label_join(spark, d):
    t = truth(spark, d).withColumn("y", F.lit(1))
    return candidates(spark, d).join(t, ["ri", "si"], "left").select("ri", "si", F.coalesce("y", F.lit(0)).alias("y"))


# --- joins and sets

@query(f"WITH {TRUTH} SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND p_partkey NOT IN (SELECT ri FROM truth)")
def anti_unmatched(spark, d):
    r = entities(spark, d)[1].select("id")
    return r.join(truth(spark, d), F.col("id") == F.col("ri"), "left_anti").select(F.col("id").alias("p_partkey"))


@query(f"WITH {TRUTH} SELECT si, string_agg(ri, ',' ORDER BY ri) AS ids, count(*) AS n FROM truth GROUP BY si")
def truth_lists(spark, d):
    return truth(spark, d).groupBy("si").agg(F.array_join(F.sort_array(F.collect_list("ri")).cast("array<string>"), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def seen_partition(spark, d):
    seen = table(spark, d, "customer").join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return table(spark, d, "orders").join(seen, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


# --- decisions

@query(f"WITH {SCORES}, {BEST} SELECT * FROM best")
def best_per_record(spark, d):
    return decide.best_per_record(scores(spark, d))


@query(f"WITH {SCORES}, {BEST} SELECT * FROM best WHERE p >= 0.8")
def assign_threshold(spark, d):
    return decide.apply_decision(scores(spark, d), {"rule": "threshold", "t": 0.8})


@query(f"WITH {SCORES}, {BEST}, {EXPECT.format(p_min=0.02)} SELECT ri, si, p, p2 FROM e4 WHERE m <= star AND p0 < top")
def expected_f05(spark, d):
    return decide.apply_decision(scores(spark, d), {"rule": "expected"})


@query(f"WITH {SCORES}, {BEST}, {EXPECT.format(p_min=0.3)}, a AS (SELECT ri, si, p, p2, max(p) OVER (PARTITION BY si) AS t FROM e4 WHERE m <= star) SELECT ri, si, p, p2 FROM a WHERE t >= 0.75")
def hybrid_gate(spark, d):
    return decide.apply_decision(scores(spark, d), {"rule": "hybrid", "p_min": 0.3, "gate": 0.75})


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.6 * ln(a / (1 - a)) + 0.4 * ln(b / (1 - b))))), 6) AS p FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_discount, 1e-6), 1 - 1e-6) AS a, least(greatest(l_tax, 1e-6), 1 - 1e-6) AS b FROM lineitem)")
def logit_blend(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(decide.logit_blend([F.col("l_discount"), F.col("l_tax")], [0.6, 0.4]), 6).alias("p"))


GATE = "CASE WHEN sh THEN 0.65 WHEN len(a) > 0 AND len(b) > 0 THEN 0.95 ELSE 0.8 END"


@query(f"""WITH x AS (SELECT c_custkey, s_suppkey, list_distinct(regexp_extract_all((c_custkey % 7)::VARCHAR || ' ' || (c_custkey % 3)::VARCHAR, '[0-9]+')) AS a, CASE WHEN s_suppkey % 4 = 0 THEN [] ELSE [(s_suppkey % 7)::VARCHAR] END AS b, c_custkey % 2 = 0 AS e FROM customer JOIN supplier ON c_nationkey = s_nationkey),
y AS (SELECT *, list_has_any(a, b) AS sh FROM x) SELECT c_custkey, s_suppkey, CASE WHEN e AND sh THEN least({GATE}, 0.5) ELSE {GATE} END::DOUBLE AS thr FROM y""")
def house_number_gate(spark, d):
    r = decide.gate_side(F.concat_ws(" ", F.concat(F.lit("0"), (F.col("c_custkey") % 7).cast("string")), (F.col("c_custkey") % 3).cast("string")), F.when(F.col("c_custkey") % 2 == 0, "a and b").otherwise("a b"))
    s = decide.gate_side(F.when(F.col("s_suppkey") % 4 == 0, "").otherwise((F.col("s_suppkey") % 7).cast("string")), F.lit("a b"))
    side = lambda name, p, key, own: table(spark, d, name).select(F.col(key).alias("id"), F.col(f"{p}_nationkey").alias("nation"), own.alias(p))
    p = blocking.all_pairs(side("customer", "c", "c_custkey", r), side("supplier", "s", "s_suppkey", s), "nation")
    return p.select(F.col("li").alias("c_custkey"), F.col("ri").alias("s_suppkey"), decide.gate_of_sides(F.col("c"), F.col("s"), 0.8, 0.65, 0.95, 0.5).alias("thr"))


@query(f"WITH {SCORES}, {BEST} SELECT id AS si, coalesce(string_agg(ri, ',' ORDER BY ri), '') AS ids FROM ent LEFT JOIN (SELECT * FROM best WHERE p >= 0.8) b ON ent.id = b.si WHERE m GROUP BY id")
def id_lists(spark, d):
    s, r = entities(spark, d)
    return decide.id_lists(s, decide.assign_threshold(decide.best_per_record(with_p(blocking.block(s, r))), 0.8))


CONF = f"""{SCORES}, {BEST}, {TRUTH}, a AS (SELECT * FROM best WHERE p >= 0.8),
conf AS (SELECT id AS si, country, (SELECT count(*) FROM a WHERE a.si = id) AS n_pred, (SELECT count(*) FROM truth t WHERE t.si = id) AS n_true, (SELECT count(*) FROM a JOIN truth t ON a.ri = t.ri AND a.si = t.si WHERE a.si = id) AS tp FROM ent WHERE m)"""


def _confusion(spark, d):
    s, r = entities(spark, d)
    return decide.confusion(s, decide.assign_threshold(decide.best_per_record(with_p(blocking.block(s, r))), 0.8), truth(spark, d))


@query(f"WITH {CONF} SELECT * FROM conf")
def confusion_counts(spark, d):
    return _confusion(spark, d)


@query(f"""WITH {CONF}, f AS (SELECT country, n_true, CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f FROM conf)
SELECT country, count(*) AS n, round(avg(f), 6) AS f05, round(avg(f) FILTER (WHERE n_true = 0), 6) AS f05_singleton, round(avg(f) FILTER (WHERE n_true > 0), 6) AS f05_matched FROM f GROUP BY GROUPING SETS ((country), ())""")
def macro_f05(spark, d):
    return decide.macro_f05(_confusion(spark, d))


@query(f"WITH {SCORES}, {BEST} SELECT t / 100 AS t, count(*) AS assigned, count(DISTINCT si) AS masters FROM best, (SELECT unnest(range(30, 100, 5)) AS t) WHERE p >= t / 100 GROUP BY t")
def rule_grid(spark, d):
    best = decide.best_per_record(scores(spark, d))
    grid = F.explode(F.filter(F.transform(F.sequence(F.lit(30), F.lit(95), F.lit(5)), lambda t: t / 100), lambda t: F.col("p") >= t))
    return best.select("si", grid.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("assigned"), F.countDistinct("si").alias("masters"))


F_AT = f"""{SCORES}, {BEST}, {TRUTH}, conf AS (SELECT ts.t, e.id AS si, e.country, (SELECT count(*) FROM truth x WHERE x.si = e.id) AS n_true, coalesce(g.n_pred, 0) AS n_pred, coalesce(g.tp, 0) AS tp
  FROM ent e CROSS JOIN (SELECT unnest(range(30, 100, 5)) / 100 AS t) ts
  LEFT JOIN (SELECT best.si, u.t, count(*) AS n_pred, count(truth.ri) AS tp FROM best LEFT JOIN truth ON best.ri = truth.ri AND best.si = truth.si, (SELECT unnest(range(30, 100, 5)) / 100 AS t) u WHERE best.p >= u.t GROUP BY 1, 2) g ON g.si = e.id AND g.t = ts.t WHERE e.m),
f AS (SELECT t, country, n_true, CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f FROM conf)"""
THRESHOLDS = [t / 100 for t in range(30, 100, 5)]


def _sweep(spark, d):
    s, r = entities(spark, d)
    return decide.threshold_sweep(s, decide.best_per_record(with_p(blocking.block(s, r))), truth(spark, d), THRESHOLDS)


@query(f"WITH {F_AT} SELECT t, country, count(*) AS n, round(avg(f), 6) AS f05, round(avg(f) FILTER (WHERE n_true = 0), 6) AS f05_singleton, round(avg(f) FILTER (WHERE n_true > 0), 6) AS f05_matched FROM f GROUP BY GROUPING SETS ((t, country), (t))")
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query(f"WITH {F_AT} SELECT t, round(avg(f), 6) AS f05 FROM f GROUP BY t ORDER BY f05 DESC, t LIMIT 1")
def best_threshold(spark, d):
    return decide.best_threshold(_sweep(spark, d))


@query(f"WITH {SCORES}, {BEST}, k AS (SELECT country, (SELECT count(*) FROM best b WHERE b.p >= 0.8 AND b.si = ent.id) AS k FROM ent WHERE m) SELECT country, count(*) AS masters, sum(k)::BIGINT AS matches, round(avg(k), 6) AS per_master, round(avg((k = 0)::INT), 6) AS empty FROM k GROUP BY 1")
def country_report(spark, d):
    s, r = entities(spark, d)
    return decide.country_report(s, decide.assign_threshold(decide.best_per_record(with_p(blocking.block(s, r))), 0.8))


@query(f"WITH {SCORES} SELECT si, round(sum(p), 6) AS n_hat, round(sum(ln(1 - least(p, 1 - 1e-7))), 4) AS log_p0 FROM pr GROUP BY si")
def expected_mass(spark, d):
    return decide.mass(scores(spark, d)).select("si", F.round("n_hat", 6).alias("n_hat"), F.round("log_p0", 4).alias("log_p0"))


@query(f"WITH {SCORES}, lo AS (SELECT ri, si, round(p * p, 6) AS p_other FROM pr WHERE p < 0.5) SELECT ri, si, p, coalesce(p_other, 1) AS p_other FROM pr LEFT JOIN lo USING (ri, si) WHERE p >= 0.1 OR coalesce(p_other, 1) >= 0.1")
def hard_pairs(spark, d):
    p = scores(spark, d)
    return decide.hard_pairs(p, p.filter("p < 0.5").select("ri", "si", F.round(F.col("p") * F.col("p"), 6).alias("p")), 0.1)


@query(f"WITH {SCORES}, {BEST}, {TRUTH}, b AS (SELECT ri, si, p FROM best WHERE p >= 0.5) SELECT ri, si, p FROM b UNION ALL SELECT ri + 10000000, si, p FROM b WHERE ri NOT IN (SELECT ri FROM truth) AND (ri * 2654435761) % 4294967296 % 1000000 < 900000")
def clone_density(spark, d):
    return views.clones(decide.best_per_record(scores(spark, d)), truth(spark, d).select("ri"), 0.9, 10_000_000)


P_MINS, GATES = (0.3, 0.5), (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
F_OF = "CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"
HYBRIDS = f"""{SCORES}, {BEST}, {TRUTH}, mass AS (SELECT si, sum(p) AS n_hat FROM pr GROUP BY si),
e1 AS (SELECT best.*, x.p_min, n_hat, row_number() OVER w AS m, sum(p) OVER w AS cs FROM best JOIN mass USING (si), (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE]) AS p_min) x WHERE p >= x.p_min WINDOW w AS (PARTITION BY x.p_min, si ORDER BY p DESC, ri ROWS UNBOUNDED PRECEDING)),
e2 AS (SELECT *, 1.25 * cs / (m + 0.25 * greatest(n_hat, cs)) AS ef FROM e1), e3 AS (SELECT *, max(ef) OVER (PARTITION BY p_min, si) AS top FROM e2),
e4 AS (SELECT *, min(m) FILTER (WHERE ef >= top - 1e-12) OVER (PARTITION BY p_min, si) AS star FROM e3),
kept AS (SELECT e4.ri, e4.si, p_min, max(p) OVER (PARTITION BY p_min, e4.si) AS lead, t.si IS NOT NULL AS hit FROM e4 LEFT JOIN truth t ON t.ri = e4.ri AND t.si = e4.si WHERE m <= star),
counts AS (SELECT p_min, gate, si, count(*) AS n_pred, count(*) FILTER (WHERE hit) AS tp FROM kept, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GATES)}]) AS gate) WHERE lead >= gate GROUP BY 1, 2, 3),
grid AS (SELECT p_min, gate FROM (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE]) AS p_min), (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GATES)}]) AS gate)),
cells AS (SELECT g.p_min, g.gate, e.id AS si, (SELECT count(*) FROM truth x WHERE x.si = e.id) AS n_true, coalesce(c.n_pred, 0) AS n_pred, coalesce(c.tp, 0) AS tp FROM ent e CROSS JOIN grid g LEFT JOIN counts c ON c.si = e.id AND c.p_min = g.p_min AND c.gate = g.gate WHERE e.m),
hybrids AS (SELECT p_min, gate, round(avg({F_OF}), 6) AS f05 FROM cells GROUP BY 1, 2)"""


def _hybrids(spark, d):
    s, r = entities(spark, d)
    return decide.hybrid_sweep(s, with_p(blocking.block(s, r)), truth(spark, d), P_MINS, GATES)


@query(f"WITH {HYBRIDS} SELECT * FROM hybrids")
def hybrid_grid(spark, d):
    return _hybrids(spark, d)


@query(f"WITH {HYBRIDS} SELECT p_min, gate, f05 FROM hybrids ORDER BY f05 DESC, p_min, gate LIMIT 1")
def best_hybrid(spark, d):
    return decide.best_hybrid(_hybrids(spark, d))


@query(f"""WITH {CONF}, c AS (SELECT country, avg({F_OF}) AS f05 FROM conf GROUP BY 1), n AS (SELECT country, count(*)::DOUBLE AS w FROM ent WHERE NOT m GROUP BY 1)
SELECT round(sum(w * f05) / sum(w), 6) AS f05 FROM c JOIN n USING (country)""")
def weighted_f05(spark, d):
    n = entities(spark, d)[1].groupBy("country").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return decide.weighted_f05(_confusion(spark, d), n)


LOGITS = f"{CANDS}, z AS (SELECT ri, si, round(8 * cos_name - 3, 6) AS z FROM cands WHERE cos_name > 0.2)"


@query(f"""WITH {LOGITS}, g AS (SELECT ri, si, z, row_number() OVER w AS o, nth_value(z, 2) OVER u AS second, first_value(z) OVER u AS first FROM z
WINDOW w AS (PARTITION BY ri ORDER BY z DESC, si), u AS (PARTITION BY ri ORDER BY z DESC, si ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT c.ri, c.si, round(1 / (1 + exp(-z)), 6) AS ce_p, round(z - coalesce(CASE WHEN o = 1 THEN second ELSE first END, -20), 6) AS ce_gap, o - 1 AS ce_rank FROM cands c LEFT JOIN g ON c.ri = g.ri AND c.si = g.si""")
def logit_features(spark, d):
    c = candidates(spark, d)
    z = c.filter("cos_name > 0.2").select("ri", "si", F.round(8 * F.col("cos_name") - 3, 6).alias("z"))
    return windows.logit_features(c.select("ri", "si"), z).select("ri", "si", F.round("ce_p", 6).alias("ce_p"), F.round("ce_gap", 6).alias("ce_gap"), "ce_rank")


# --- learning

def _features(spark, d):
    """ri, si, y and every feature that the linkage builds for the classifier, written to the shared folder."""
    s, r = entities(spark, d)
    f = linkage.features(s, r).join(truth(spark, d).withColumn("y", F.lit(1)), ["ri", "si"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return linkage.written(f, "pair-features").drop("country")


@query()
def gbt_oof(spark, d):
    f = _features(spark, d)
    return matcher.out_of_fold(f, matcher.fit_folds(f))


@query()
def gbt_predict(spark, d):
    f = _features(spark, d)
    return matcher.predict(f, matcher.fit_folds(f))


@query()
def boosted_scores(spark, d):
    """ri, si, y, p out of fold: second-order trees over the blocked pairs' cosines, ranks and context; a higher cosine never lowers p."""
    f = windows.add_context(candidates(spark, d).drop("country")).join(truth(spark, d).withColumn("y", F.lit(1)), ["ri", "si"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    f = linkage.written(f, "boosted")
    return matcher.out_of_fold(f, matcher.fit_boosted(f, 2, rounds=6, depth=4, step=0.3, monotone={"cos_both": 1, "cos_name": 1}))


# --- views and routing

@query("""WITH w AS (SELECT event_id, user_id, value, row_number() OVER o - 1 AS rank, first_value(value) OVER f AS v1, nth_value(value, 2) OVER f AS v2 FROM events WHERE event_type IN ('view', 'click')
  WINDOW o AS (PARTITION BY user_id ORDER BY value DESC, event_id), f AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT e.event_id, round(w.value - coalesce(CASE WHEN rank = 0 THEN v2 ELSE v1 END, -20), 6) AS gap, rank FROM events e LEFT JOIN w USING (event_id)""")
def context_subset(spark, d):
    e = table(spark, d, "events")
    gap, rank, _ = windows.gap_to_best_other(F.col("value"), "user_id", "event_id", -20.0)
    some = e.filter("event_type in ('view', 'click')").select("event_id", F.round(gap, 6).alias("gap"), rank.alias("rank"))
    return e.select("event_id").join(some, "event_id", "left")


@query("SELECT v.view, count(*) AS n, count(*) FILTER (WHERE lang <> v.view) AS train FROM documents, (SELECT DISTINCT lang AS view FROM documents) v GROUP BY 1")
def loco_split(spark, d):
    p = table(spark, d, "documents").select(F.col("lang").alias("country"))
    return views.view_sizes(p)


@query("SELECT l_orderkey AS ri, l_partkey AS si, count(*) AS n FROM lineitem WHERE (l_partkey * 2246822519) % 4294967296 % 1000000 >= 190000 GROUP BY 1, 2")
def drop_view(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("ri"), F.col("l_partkey").cast("long").alias("si"))
    return views.drop_masters(p).groupBy("ri", "si").agg(F.count(F.lit(1)).alias("n"))


ROUTED = "CASE WHEN list_has_any(list_transform(regexp_extract_all(r.addr, '[0-9]+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')), list_transform(regexp_extract_all(s.addr, '[0-9]+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0'))) THEN 0.65 ELSE 0.95 END"


@query(f"""WITH {SCORES}, {BEST}, seen AS (SELECT DISTINCT country FROM ent WHERE m AND id % 2 = 0) SELECT ri, si, p FROM best JOIN ent r ON r.id = ri JOIN ent s ON s.id = si
WHERE p >= CASE WHEN r.country IN (SELECT country FROM seen) THEN 0.75 ELSE {ROUTED} END""")
def seen_unseen_route(spark, d):
    """Countries are seen if a master of an even key is in them; others go by house numbers, which every address here has."""
    s, r = entities(spark, d)
    pairs = blocking.block(s, r)
    p = pairs.select("country", "ri", "si").join(with_p(pairs), ["ri", "si"])
    p = p.join(r.select(F.col("id").alias("ri"), F.col("name").alias("rn"), F.col("addr").alias("ra")), "ri").join(s.select(F.col("id").alias("si"), F.col("name").alias("sn"), F.col("addr").alias("sa")), "si")
    gate = decide.house_number_gate(text.digits(F.col("ra")), text.digits(F.col("sa")), F.col("rn"), F.col("sn"), 0.95, 0.65, 0.95)
    return views.route(p.select("country", "ri", "si", "p"), p, s.filter("id % 2 = 0").select("country").distinct(), 0.75, gate)
