"""The queries of the library by name, and their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import edit, jaro, ngrams, ratios
from kindred.functions.namespace import fuzzy
from kindred.functions.normalize import normalize_string
from kindred.operators import batch
from kindred.operators.dedupe import dedupe, dedupe_snm, find_pairs, match_pairs
from kindred.operators.index import EditIndex, NgramIndex
from kindred.operators.join import fuzzy_join, match_records
from kindred.operators.metrics import confusion_matrix
from kindred.operators.schema import MatchSchema, SchemaIndex
from kindred.plans import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What strings are compared with where one is given.
ASKED = "green gadget"
NAMES_SQL = "SELECT p_name AS t, min(p_partkey) AS id FROM part GROUP BY p_name"
PAIRS_SQL = "(SELECT a.t AS a, b.t AS b FROM (SELECT DISTINCT p_name AS t FROM part) a, (SELECT DISTINCT p_name AS t FROM part) b)"


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names, with their first part."""
    return read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).withColumnRenamed("p_name", "t")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = names(spark, sf_dir).select(F.col("t").alias("a"))
    return a.crossJoin(a.withColumnRenamed("a", "b"))


def over_pairs(name: str, oracle: dict[str, str] | None, **columns: Callable[[Column, Column], Column]) -> None:
    """A query that compares all pairs of distinct part names by some functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        return name_pairs(spark, sf_dir).select("a", "b", *[f(a, b).alias(c) for c, f in columns.items()])

    QUERIES[name] = run
    if oracle:
        ORACLE[name] = f"SELECT a, b, {', '.join(f'{x} AS {c}' for c, x in oracle.items())} FROM {PAIRS_SQL}"


def rounded(f: Callable) -> Callable:
    return lambda a, b: F.round(f(a, b), 6)


def long(f: Callable) -> Callable:
    return lambda a, b: f(a, b).cast("long")


def accent(c: Column) -> Column:
    return F.replace(c, F.lit("e"), F.lit("é"))


R = "round({}, 6)".format
over_pairs("lev_distance", {"d": "levenshtein(a, b)"}, d=long(edit.levenshtein))
over_pairs(
    "lev_bounded",
    {"within": "CASE WHEN levenshtein(a, b) <= 5 THEN levenshtein(a, b) END", "capped": "least(levenshtein(a, b), 6)"},
    within=long(lambda a, b: edit.levenshtein_bounded(a, b, 5)),
    capped=long(lambda a, b: edit.levenshtein(a, b, 5)),
)
over_pairs("lev_similarity", {"s": R(S.lev_sim("a", "b"))}, s=rounded(edit.levenshtein_similarity))
over_pairs(
    "lev_bytes",
    {"d": "levenshtein(replace(a, 'e', 'é'), b)", "within": "CASE WHEN levenshtein(replace(a, 'e', 'é'), b) <= 7 THEN levenshtein(replace(a, 'e', 'é'), b) END"},
    d=long(lambda a, b: edit.levenshtein_bytes(accent(a), b)),
    within=long(lambda a, b: edit.levenshtein_bytes_bounded(accent(a), b, 7)),
)
over_pairs(
    "lev_grapheme",
    {"d": "levenshtein(a, b)", "s": R(S.lev_sim("a", "b"))},
    d=long(lambda a, b: edit.levenshtein_grapheme(F.replace(a, F.lit("e"), F.lit("é")), F.replace(b, F.lit("e"), F.lit("é")))),
    s=rounded(lambda a, b: edit.levenshtein_similarity_grapheme(F.replace(a, F.lit("e"), F.lit("é")), F.replace(b, F.lit("e"), F.lit("é")))),
)
over_pairs(
    "dl_distance",
    {"d": "damerau_levenshtein(a, b)", "within": "CASE WHEN damerau_levenshtein(a, b) <= 5 THEN damerau_levenshtein(a, b) END"},
    d=long(edit.damerau_levenshtein),
    within=long(lambda a, b: edit.damerau_levenshtein_bounded(a, b, 5)),
)
over_pairs("dl_similarity", {"s": R("1.0::DOUBLE - damerau_levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))")}, s=rounded(edit.damerau_levenshtein_similarity))
over_pairs("osa", None, d=long(edit.optimal_string_alignment), s=rounded(edit.optimal_string_alignment_similarity))
over_pairs("jaro", {"s": R(S.jaro("a", "b"))}, s=rounded(jaro.jaro_similarity))
over_pairs("jaro_winkler", {"s": R(S.jaro_winkler("a", "b"))}, s=rounded(jaro.jaro_winkler_similarity))
over_pairs("jaro_grapheme", None, j=rounded(jaro.jaro_similarity_grapheme), w=rounded(jaro.jaro_winkler_similarity_grapheme))
over_pairs("ngram_dice", {"d2": R(S.dice("a", "b", 2)), "d3": R(S.dice("a", "b", 3))}, d2=rounded(ngrams.bigram_similarity), d3=rounded(ngrams.trigram_similarity))
over_pairs("ngram_jaccard", {"s": R(S.jaccard("a", "b", 3))}, s=rounded(ngrams.ngram_jaccard))
over_pairs("ngram_profile", {"s": R(S.profile("a", "b", 3))}, s=rounded(ngrams.ngram_profile_similarity))
over_pairs("cosine_chars", {"s": R(f"CASE WHEN a = b THEN 1.0::DOUBLE ELSE {S.cosine(S.letters('a'), S.letters('b'))} END")}, s=rounded(ngrams.cosine_similarity_chars))
over_pairs("cosine_words", {"s": R(S.cosine(S.words("lower(a)"), S.words("lower(b)")))}, s=rounded(ngrams.cosine_similarity_words))
over_pairs("cosine_ngrams", {"s": R(S.cosine(S.grams("a", 3), S.grams("b", 3)))}, s=rounded(ngrams.cosine_similarity_ngrams))
over_pairs("ratio_partial", {"r": R(S.lev_sim("a", "b")), "p": R(S.partial_ratio("a", "b"))}, r=rounded(ratios.ratio), p=rounded(ratios.partial_ratio))
over_pairs("token_sort", {"s": R(S.token_sort("a", "b"))}, s=rounded(ratios.token_sort_ratio))
over_pairs("token_set", {"s": R(S.token_set("a", "b"))}, s=rounded(ratios.token_set_ratio))
over_pairs("wratio", {"s": R(S.wratio("a", "b"))}, s=rounded(ratios.wratio))
over_pairs("qratio", {"q": R(S.lev_sim("a", "b")), "w": R(S.wratio("a", "b"))}, q=rounded(ratios.qratio), w=rounded(ratios.qwratio))
over_pairs("lcs_len", None, n=long(ngrams.lcs_length), s=rounded(ngrams.lcs_similarity), m=rounded(ngrams.lcs_similarity_max), t=ngrams.lcs_string)
over_pairs(
    "common_substring",
    {"n": "list_max(list_transform(range(0, length(a) * length(a)), lambda k: CASE WHEN k // length(a) + k % length(a) < length(a) AND contains(b, substr(a, k // length(a) + 1, k % length(a) + 1)) THEN k % length(a) + 1 ELSE 0 END))"},
    n=long(ngrams.longest_common_substring_length),
)
over_pairs("distances", {"d": "levenshtein(a, b)", "t": "damerau_levenshtein(a, b)"}, d=lambda a, b: fuzzy(a).distance(b).cast("long"), t=lambda a, b: fuzzy(a).distance(b, "damerau_levenshtein").cast("long"))
over_pairs("is_similar", {"y": f"{S.jaro_winkler('a', 'b')} >= 0.8::DOUBLE", "l": f"{S.lev_sim('a', 'b')} >= 0.5::DOUBLE"}, y=lambda a, b: fuzzy(a).is_similar(b), l=lambda a, b: fuzzy(a).is_similar(b, 0.5, "levenshtein"))


@query("hamming_padded", "SELECT c_custkey, hamming(c_name, 'Customer#000000042') AS d, round(1.0::DOUBLE - hamming(c_name, 'Customer#000000042')::DOUBLE / 18, 6) AS s, length(c_name) + 2 - 18 + hamming(c_name, 'Customer#000000042') AS p FROM customer")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("c_name"), F.lit("Customer#000000042")
    return read(spark, sf_dir, "customer").select("c_custkey", edit.hamming(a, b).cast("long").alias("d"), F.round(edit.hamming_similarity(a, b), 6).alias("s"), edit.hamming_distance_padded(F.concat(a, F.lit("xy")), b).cast("long").alias("p"))


@query("extract_ngrams", f"SELECT t, array_to_string({S.grams('t', 3)}, '|') AS padded, array_to_string({S.grams('t', 2, False)}, '|') AS plain FROM ({NAMES_SQL})")
def extract_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("t", F.array_join(ngrams.extract_ngrams(F.col("t")), "|").alias("padded"), F.array_join(ngrams.extract_ngrams(F.col("t"), 2, False), "|").alias("plain"))


TFIDF_SQL = f"""
WITH docs AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_type), ' '), lambda w: w <> '') AS w FROM part),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM docs) GROUP BY word),
n AS (SELECT count(*) AS n FROM docs),
side AS (SELECT id, 0 AS side, w FROM docs UNION ALL SELECT id, 1, string_split('{{asked}}', ' ') FROM docs),
tf AS (SELECT id, side, word, count(*)::DOUBLE / any_value(m) AS tf FROM (SELECT id, side, len(w) AS m, unnest(w) AS word FROM side) GROUP BY id, side, word),
x AS (SELECT id, side, tf.word, tf * CASE WHEN df IS NULL THEN 1.0::DOUBLE ELSE ln((n + 1)::DOUBLE / (df + 1)) + 1 END AS x FROM tf LEFT JOIN df USING (word), n),
p AS (SELECT id, word, sum(x) FILTER (side = 0) AS xa, sum(x) FILTER (side = 1) AS xb FROM x GROUP BY id, word)
SELECT id AS p_partkey, round(least(1.0::DOUBLE, coalesce(sum(xa * xb), 0) / (sqrt(sum(xa * xa)) * sqrt(sum(xb * xb)))), 6) AS score FROM p GROUP BY id
""".replace("{asked}", "small brass steel")


@query("tfidf", TFIDF_SQL)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type").withColumn("asked", F.lit("small brass steel"))
    scored = ngrams.TfIdfCosine(part, "p_type").similarity(part, "p_partkey", "p_type", "asked")
    return scored.select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "normalize_modes",
    "SELECT p_partkey, lower(p_brand) AS lowercase, p_type AS nfkd, translate(p_brand, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '') AS no_punctuation, replace(p_type, ' ', '') AS no_space, replace(translate(lower(p_brand || ' ' || p_type), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), ' ', '') AS strict FROM part",
)
def normalize_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, kind = F.col("p_brand"), F.col("p_type")
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        normalize_string(brand, "lowercase").alias("lowercase"),
        normalize_string(kind, "nfkd").alias("nfkd"),
        normalize_string(brand, "remove_punctuation").alias("no_punctuation"),
        normalize_string(kind, "remove_whitespace").alias("no_space"),
        normalize_string(F.concat_ws(" ", brand, kind), "strict").alias("strict"),
    )


def asked_sql(score: str, limit: int, order: str = "s DESC, id") -> str:
    return f"SELECT id, t AS text, round(s, 6) AS score FROM (SELECT id, t, {score} AS s FROM ({NAMES_SQL})) ORDER BY {order} LIMIT {limit}"


@query("batch_similarity", f"SELECT id, t AS text, round({S.jaro_winkler('t', chr(39) + ASKED + chr(39))}, 6) AS score FROM ({NAMES_SQL})")
def batch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.similarity(names(spark, sf_dir), ASKED, text="t", id_col="id").withColumn("score", F.round("score", 6))


@query("best_matches_topk", asked_sql(S.jaro_winkler("t", f"'{ASKED}'"), 5))
def best_matches_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.best_matches(names(spark, sf_dir), ASKED, limit=5, text="t", id_col="id").withColumn("score", F.round("score", 6))


@query("extract_topk", asked_sql(S.wratio(f"'{ASKED}'", "t"), 10))
def extract_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.extract(ASKED, names(spark, sf_dir), text="t", id_col="id").withColumn("score", F.round("score", 6))


@query("extract_one", asked_sql(S.wratio(f"'{ASKED}'", "t"), 1, "s DESC, id DESC"))
def extract_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.extract_one(ASKED, names(spark, sf_dir), text="t", id_col="id").withColumn("score", F.round("score", 6))


COMPARED = {"jaro": S.jaro, "jaro_winkler": S.jaro_winkler, "levenshtein": S.lev_sim, "trigram": lambda a, b: S.dice(a, b, 3)}


@query(
    "compare_algorithms",
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS algorithm, id, t AS text, {f('t', chr(39) + ASKED + chr(39))} AS s FROM ({NAMES_SQL})" for n, f in COMPARED.items())
    + "), r AS (SELECT *, avg(s) OVER (PARTITION BY algorithm) AS m, row_number() OVER (PARTITION BY algorithm ORDER BY s DESC, id) AS rank FROM s) SELECT algorithm, round(m, 6) AS mean_score, rank, id, text, round(s, 6) AS score FROM r WHERE rank <= 3",
)
def compare_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch.compare_algorithms(names(spark, sf_dir), ASKED, list(COMPARED), text="t", id_col="id")
    return out.select("algorithm", F.round("mean_score", 6).alias("mean_score"), F.col("rank").cast("long").alias("rank"), "id", "text", F.round("score", 6).alias("score"))


@query("similarity_matrix", f"SELECT r_regionkey::BIGINT AS query_id, n_nationkey::BIGINT AS choice_id, round({S.lev_sim('r_name', 'n_name')}, 6) AS score FROM region, nation")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("text")), read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text"))
    return batch.similarity_matrix(q, c, query_id="r_regionkey", choice_id="n_nationkey").withColumn("score", F.round("score", 6))


@query("series_similarity", f"SELECT p_partkey, round({S.lev_sim('p_name', 'p_type')}, 6) AS score FROM part")
def series_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pairwise(read(spark, sf_dir, "part"), "p_name", "p_type", "levenshtein").select("p_partkey", F.round("score", 6).alias("score"))


@query("series_match", f"SELECT s_suppkey AS query_idx, s_name AS query, c_custkey AS target_idx, c_name AS target, round({S.lev_sim('s_name', 'c_name')}, 6) AS score FROM supplier, customer WHERE {S.lev_sim('s_name', 'c_name')} >= 0.6::DOUBLE")
def series_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("text")), read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text"))
    return batch.series_match(q, t, "levenshtein", 0.6, query_id="s_suppkey", target_id="c_custkey").withColumn("score", F.round("score", 6))


BEST_SQL = f"""
WITH q AS (SELECT p_partkey AS id, {S.typo('p_partkey', 'p_name')} AS q FROM part), c AS ({NAMES_SQL}), v AS (SELECT DISTINCT q FROM q),
s AS (SELECT q, t, id, {S.jaro_winkler('q', 't')} AS s FROM v, c
  WHERE len(list_intersect(list_distinct({S.grams('lower(q)', 3, False)}), list_distinct({S.grams('lower(t)', 3, False)}))) >= greatest(1, ceil(0.2::DOUBLE * len(list_distinct({S.grams('lower(q)', 3, False)}))))),
b AS (SELECT q, t, s FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) = 1)
SELECT q.id AS query_idx, q.q AS query, b.t AS "match", round(b.s, 6) AS score FROM q LEFT JOIN b ON b.q = q.q
"""


@query("series_best_match", BEST_SQL)
def series_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch.series_best_match(mutated(spark, sf_dir), names(spark, sf_dir), query_id="p_partkey", target_id="id", text="t")
    return out.withColumn("score", F.round("score", 6))


@query(
    "best_match_score",
    f"SELECT n_nationkey, r_name AS best, round(s, 6) AS score FROM (SELECT n_nationkey, r_name, {S.jaro_winkler('n_name', 'r_name')} AS s, row_number() OVER (PARTITION BY n_nationkey ORDER BY {S.jaro_winkler('n_name', 'r_name')} DESC, r_regionkey) AS k FROM nation, (SELECT r_regionkey, r_name FROM region)) WHERE k = 1",
)
def best_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = [r.r_name for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return read(spark, sf_dir, "nation").select("n_nationkey", fuzzy("n_name").best_match_score(choices).alias("m")).select("n_nationkey", F.col("m.match").alias("best"), F.round("m.score", 6).alias("score"))


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(S.typo("p_partkey", "p_name")).alias("t"), "p_type")


def join_sql(score: str, least: float, how: str) -> str:
    return f"""
WITH q AS (SELECT p_partkey, {S.typo('p_partkey', 'p_name')} AS t FROM part), c AS ({NAMES_SQL}), v AS (SELECT DISTINCT t FROM q),
s AS (SELECT v.t AS q, c.t AS t, id, {score.replace('$a', 'v.t').replace('$b', 'c.t')} AS s FROM v, c WHERE {S.share_gram('v.t', 'c.t')}),
b AS (SELECT q, t, id, s FROM s WHERE s >= {least}::DOUBLE QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) = 1)
SELECT p_partkey, q.t AS t, b.t AS t_right, b.id AS id, round(coalesce(b.s, 0), 6) AS fuzzy_score FROM q {how} JOIN b ON b.q = q.t
"""


def joined(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    left = mutated(spark, sf_dir).select("p_partkey", "t")
    return fuzzy_join(left, names(spark, sf_dir), on="t", left_id="p_partkey", right_id="id", **options).withColumn("fuzzy_score", F.round("fuzzy_score", 6))


@query("fuzzy_join_inner", join_sql(S.lev_sim("$a", "$b"), 0.8, ""))
def fuzzy_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir, algorithm="levenshtein", min_similarity=0.8)


@query("fuzzy_join_left", join_sql(S.jaro_winkler("$a", "$b"), 0.97, "LEFT"))
def fuzzy_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir, min_similarity=0.97, how="left")


MULTI_SQL = f"""
WITH q AS (SELECT p_partkey, {S.typo('p_partkey', 'p_name')} AS t, p_type AS k FROM part), c AS (SELECT p_name AS t, p_type AS k, min(p_partkey) AS id FROM part GROUP BY ALL), v AS (SELECT DISTINCT t, k FROM q),
n AS (SELECT v.t AS t, c.t AS ct, {S.lev_sim('v.t', 'c.t')} AS s FROM (SELECT DISTINCT t FROM v) v, (SELECT DISTINCT t FROM c) c WHERE {S.share_gram('v.t', 'c.t')}),
y AS (SELECT v.k AS k, c.k AS ck, {S.jaro_winkler('v.k', 'c.k')} AS s FROM (SELECT DISTINCT k FROM v) v, (SELECT DISTINCT k FROM c) c WHERE {S.share_gram('v.k', 'c.k')}),
p AS (SELECT v.t AS t, v.k AS k, c.id AS id, 2.0::DOUBLE AS w, n.s AS s FROM v JOIN n ON n.t = v.t JOIN c ON c.t = n.ct
  UNION ALL SELECT v.t, v.k, c.id, 1.0::DOUBLE, y.s FROM v JOIN y ON y.k = v.k JOIN c ON c.k = y.ck),
s AS (SELECT t, k, id, sum(w * s) / sum(w) AS s FROM p GROUP BY ALL),
b AS (SELECT t, k, id, s FROM s WHERE s >= 0.9::DOUBLE QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY round(s, 9) DESC, id) = 1)
SELECT q.p_partkey, b.id, round(b.s, 6) AS fuzzy_score FROM q JOIN b ON b.t = q.t AND b.k = q.k
"""


@query("fuzzy_join_multi", MULTI_SQL)
def fuzzy_join_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("kind")).agg(F.min("p_partkey").alias("id"))
    on = [("t", "name", {"algorithm": "levenshtein", "weight": 2.0}), ("p_type", "kind", {"algorithm": "jaro_winkler"})]
    return fuzzy_join(mutated(spark, sf_dir), right, on=on, min_similarity=0.9, left_id="p_partkey", right_id="id").select("p_partkey", "id", F.round("fuzzy_score", 6).alias("fuzzy_score"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url")


def url_edges(score: str, least: float) -> str:
    """CTE e(u, v, s): similar pages that share a bigram."""
    return f"e AS (SELECT a.page_id AS u, b.page_id AS v, a.url AS ua, b.url AS ub, {score} AS s FROM pages a JOIN pages b ON a.page_id < b.page_id WHERE {score} >= {least}::DOUBLE AND {S.share_gram('a.url', 'b.url')})"


@query("match_pairs", f"WITH {url_edges(S.lev_sim('a.url', 'b.url'), 0.85)} SELECT u AS idx_a, v AS idx_b, round(s, 6) AS score, ua AS url_a, ub AS url_b FROM e")
def match_pairs_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_pairs(urls(spark, sf_dir), ["url"], "levenshtein", 0.85, id_col="page_id").withColumn("score", F.round("score", 6))


@query(
    "match_records",
    f"WITH q AS (SELECT p_partkey, {S.typo('p_partkey', 'p_name')} AS t FROM part), c AS ({NAMES_SQL}), v AS (SELECT DISTINCT t FROM q), s AS (SELECT v.t AS q, c.t AS t, id, {S.dice('v.t', 'c.t', 3)} AS s FROM v, c WHERE {S.share_gram('v.t', 'c.t')}), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) = 1) SELECT p_partkey AS query_idx, id AS target_idx, round(s, 6) AS score, q.t AS t_query, b.t AS t_target FROM q JOIN b ON b.q = q.t",
)
def match_records_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(mutated(spark, sf_dir), names(spark, sf_dir), ["t"], "ngram", query_id="p_partkey", target_id="id").withColumn("score", F.round("score", 6))


def snm_edges(table: str, key: str, row: str, score: str, least: float, window: int, block: str | None = None) -> str:
    """CTE e(u, v, s): similar rows up to ``window`` places apart in the order of ``key``, inside blocks if given."""
    part = f"PARTITION BY {block}" if block else ""
    same = f" AND a.{block} = b.{block}" if block else ""
    return f"o AS (SELECT *, row_number() OVER ({part} ORDER BY {key}, {row}) AS n FROM {table}), e AS (SELECT least(a.{row}, b.{row}) AS u, greatest(a.{row}, b.{row}) AS v, {score} AS s FROM o a JOIN o b ON b.n > a.n AND b.n <= a.n + {window}{same} WHERE {score} >= {least}::DOUBLE)"


@query("find_pairs_snm", f"WITH {snm_edges('pages', 'lower(url)', 'page_id', S.jaro_winkler('lower(a.url)', 'lower(b.url)'), 0.9, 9)} SELECT u AS idx_a, v AS idx_b, round(s, 6) AS score, a.url AS url_a, b.url AS url_b FROM e JOIN pages a ON a.page_id = u JOIN pages b ON b.page_id = v")
def find_pairs_snm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pairs(urls(spark, sf_dir), ["url"], min_similarity=0.9, id_col="page_id").withColumn("score", F.round("score", 6))


def groups_sql(edges: str, table: str, row: str) -> str:
    nodes = f"(SELECT {row} AS id FROM {table})"
    return f"WITH RECURSIVE {edges}, {S.clusters(nodes, 'e')}, g AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS gid FROM (SELECT DISTINCT root FROM cluster WHERE members > 1)) SELECT id AS {row}, gid AS _group_id, id = root AS _is_canonical FROM cluster LEFT JOIN g USING (root)"


@query("dedupe_full", groups_sql(url_edges(S.lev_sim("a.url", "b.url"), 0.85), "pages", "page_id"))
def dedupe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(urls(spark, sf_dir), ["url"], "levenshtein", 0.85, id_col="page_id").drop("url")


@query("dedupe_snm", groups_sql(snm_edges("pages", "lower(url)", "page_id", S.lev_sim("lower(a.url)", "lower(b.url)"), 0.85, 9), "pages", "page_id"))
def dedupe_snm_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_snm(urls(spark, sf_dir), ["url"], "levenshtein", 0.85, id_col="page_id").drop("url")


@query("dedupe_blocked", groups_sql(snm_edges("customer", "lower(c_name)", "c_custkey", S.lev_sim("lower(a.c_name)", "lower(b.c_name)"), 0.95, 9, "c_nationkey"), "customer", "c_custkey"))
def dedupe_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_snm(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_name"], "levenshtein", 0.95, blocking_key="c_nationkey", id_col="c_custkey").select("c_custkey", "_group_id", "_is_canonical")


@query("find_duplicates", f"WITH RECURSIVE r AS (SELECT DISTINCT url AS t FROM pages), e AS (SELECT a.page_id AS u, b.page_id AS v FROM pages a JOIN pages b ON a.page_id < b.page_id WHERE {S.lev_sim('lower(a.url)', 'lower(b.url)')} >= 0.85::DOUBLE), {S.clusters('(SELECT page_id AS id FROM pages)', 'e')}, g AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS gid FROM cluster WHERE members > 1 GROUP BY root) SELECT id, url AS text, gid AS group_id, n AS group_size FROM cluster JOIN pages ON page_id = id LEFT JOIN g USING (root)")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.find_duplicates(urls(spark, sf_dir), "levenshtein", method="brute_force", text="url", id_col="page_id")


def asked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a search: every row whose id is divisible by 20."""
    return urls(spark, sf_dir).where(F.col("page_id") % 20 == 0)


@query("edit_range_search", "SELECT q.page_id AS query_id, i.id, i.url AS text, levenshtein(q.url, i.url) AS distance FROM pages q JOIN (SELECT url, min(page_id) AS id FROM pages GROUP BY url) i ON levenshtein(q.url, i.url) <= 12 WHERE q.page_id % 20 = 0")
def edit_range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = EditIndex(urls(spark, sf_dir), text="url", id_col="page_id")
    return index.search(asked_urls(spark, sf_dir), max_distance=12, text="url", query_id="page_id").select("query_id", "id", "text", F.col("distance").cast("long").alias("distance"))


@query("edit_nearest", "SELECT q.page_id AS query_id, i.id, levenshtein(q.url, i.url) AS distance FROM pages q JOIN (SELECT url, min(page_id) AS id FROM pages GROUP BY url) i ON true WHERE q.page_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.page_id ORDER BY levenshtein(q.url, i.url), i.id) <= 3")
def edit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = EditIndex(urls(spark, sf_dir), text="url", id_col="page_id")
    return index.find_nearest(asked_urls(spark, sf_dir), 3, text="url", query_id="page_id").select("query_id", "id", F.col("distance").cast("long").alias("distance"))


GRAM_CTE = f"""g AS (SELECT page_id, url, list_distinct({S.grams('lower(url)', 3, False)}) AS g FROM pages),
x AS (SELECT page_id, len(g) AS n, unnest(g) AS gram FROM g), c AS (SELECT q.page_id AS query_id, i.page_id AS id, count(*) AS shared, any_value(q.n) AS n FROM x q JOIN x i USING (gram) WHERE q.page_id % 20 = 0 GROUP BY ALL)"""
GRAM_CTE = GRAM_CTE.replace("GROUP BY ALL", "GROUP BY q.page_id, i.page_id")


@query("ngram_candidates", f"WITH {GRAM_CTE} SELECT query_id, id, shared FROM c WHERE shared >= ceil(0.2::DOUBLE * n)")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramIndex(urls(spark, sf_dir), text="url", id_col="page_id").get_candidates(asked_urls(spark, sf_dir), "url", "page_id")


@query("ngram_search", f"WITH {GRAM_CTE}, s AS (SELECT query_id, id, i.url AS text, {S.jaro_winkler('lower(q.url)', 'lower(i.url)')} AS s FROM c JOIN pages q ON q.page_id = query_id JOIN pages i ON i.page_id = id WHERE shared >= ceil(0.2::DOUBLE * n)) SELECT query_id, id, text, round(s, 6) AS score FROM s WHERE s >= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5")
def ngram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = NgramIndex(urls(spark, sf_dir), text="url", id_col="page_id").search(asked_urls(spark, sf_dir), min_similarity=0.8, limit=5, text="url", query_id="page_id")
    return hits.select("query_id", "id", "text", F.round("score", 6).alias("score"))


def schema_sql(scoring: str) -> str:
    rule = "CASE WHEN max(s) - min(s) < 1e-10 THEN sum(w * s) / sum(w) ELSE (sum(w * s) - min(s) * sum(w)) / (max(s) - min(s)) / sum(w) END" if scoring == "minmax_scaling" else "sum(w * s) / sum(w)"
    return f"""
WITH r AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS brand FROM part), q AS (SELECT id, name, kind FROM r WHERE id % 20 = 0),
n AS (SELECT a.t AS a, b.t AS b, {S.jaro_winkler('a.t', 'b.t')} AS s FROM (SELECT DISTINCT name AS t FROM r) a, (SELECT DISTINCT name AS t FROM r) b WHERE {S.share_gram('a.t', 'b.t')}),
k AS (SELECT a.t AS a, b.t AS b, {S.lev_sim('a.t', 'b.t')} AS s FROM (SELECT DISTINCT kind AS t FROM r) a, (SELECT DISTINCT kind AS t FROM r) b WHERE {S.share_gram('a.t', 'b.t')}),
p AS (SELECT q.id AS query_id, r.id, 3.0::DOUBLE AS w, s FROM q JOIN n ON n.a = q.name JOIN r ON r.name = n.b UNION ALL SELECT q.id, r.id, 1.0::DOUBLE, s FROM q JOIN k ON k.a = q.kind JOIN r ON r.kind = k.b),
s AS (SELECT query_id, id, {rule} AS s FROM p GROUP BY query_id, id)
SELECT query_id, id, round(s, 6) AS score FROM s WHERE round(s, 9) >= 0.9::DOUBLE QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 3
"""


def schema_search(spark: SparkSession, sf_dir: str, scoring: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    schema = MatchSchema.builder().add_field("name", "short_text", algorithm="jaro_winkler", weight=3.0).add_field("kind", "short_text", algorithm="levenshtein").add_field("brand", "short_text").with_scoring(scoring).build()
    index = SchemaIndex(schema, part.withColumnRenamed("p_partkey", "rid").select("name", "kind", "brand", F.col("rid").alias("data")).withColumn("id", F.col("data")), id_col="id", data="data")
    queries = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), "name", "kind")
    # the last bits of a mean depend on the order of its sum
    hits = index.search(queries, 0.9, 3, query_id="query_id", digits=9)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


@query("schema_search_weighted", schema_sql("weighted_average"))
def schema_search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_search(spark, sf_dir, "weighted_average")


@query("schema_search_minmax", schema_sql("minmax_scaling"))
def schema_search_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_search(spark, sf_dir, "minmax_scaling")


TOKENS = "list_distinct(list_filter(list_transform(string_split({}, ' '), lambda t: lower(trim(t))), lambda t: t <> ''))".format


@query(
    "token_set_search",
    f"WITH t AS (SELECT DISTINCT p_type AS t FROM part), v AS (SELECT a.t AS a, b.t AS b, len(list_intersect({TOKENS('a.t')}, {TOKENS('b.t')}))::DOUBLE / len(list_distinct(list_concat({TOKENS('a.t')}, {TOKENS('b.t')}))) AS s FROM t a, t b WHERE list_has_any({TOKENS('a.t')}, {TOKENS('b.t')})) SELECT q.p_partkey AS query_id, i.p_partkey AS id, round(s, 6) AS score FROM part q JOIN v ON v.a = q.p_type JOIN part i ON i.p_type = v.b WHERE q.p_partkey % 20 = 0 AND s >= 0.5::DOUBLE",
)
def token_set_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("tags"))
    index = SchemaIndex(MatchSchema.builder().add_field("tags", "token_set", separator=" ").build(), part, id_col="id")
    queries = part.where("id % 20 = 0").select(F.col("id").alias("query_id"), "tags")
    return index.search(queries, 0.5, query_id="query_id").select("query_id", "id", F.round("score", 6).alias("score"))


METRICS_SQL = f"""
WITH {url_edges(S.lev_sim('a.url', 'b.url'), 0.8)},
t AS (SELECT a.page_id AS u, b.page_id AS v FROM pages a JOIN pages b ON a.page_id < b.page_id AND regexp_extract(a.url, '//([^/]*)', 1) = regexp_extract(b.url, '//([^/]*)', 1)),
m AS (SELECT count(*) FILTER (e.u IS NOT NULL AND t.u IS NOT NULL) AS tp, count(*) FILTER (t.u IS NULL) AS fp, count(*) FILTER (e.u IS NULL) AS fn FROM e FULL JOIN t ON e.u = t.u AND e.v = t.v)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f_score FROM m
"""


@query("pair_metrics", METRICS_SQL)
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_pairs(urls(spark, sf_dir), ["url"], "levenshtein", 0.8, id_col="page_id").select("idx_a", "idx_b")
    host = urls(spark, sf_dir).withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    other = host.select(F.col("page_id").alias("b"), F.col("host").alias("h"))
    true = host.join(other, (F.col("host") == F.col("h")) & (F.col("page_id") < F.col("b"))).select("page_id", "b")
    m = confusion_matrix(true, found)
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_score")])
