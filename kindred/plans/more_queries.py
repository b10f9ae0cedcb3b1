"""More queries of the library: functions, duplicates, indexes and schemas beyond the headline ones, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import edit, jaro, ngrams, phonetic
from kindred.functions.namespace import fuzzy
from kindred.functions.normalize import normalize_pair, normalize_string
from kindred.operators import batch
from kindred.operators.dedupe import dedupe, dedupe_snm
from kindred.operators.index import EditIndex, FuzzyIndex, HybridIndex, NgramIndex, ShardedEditIndex, ShardedNgramIndex, ThreadSafeEditIndex, ThreadSafeNgramIndex
from kindred.operators.join import fuzzy_join
from kindred.operators.schema import MatchSchema, SchemaIndex
from kindred.plans import sql as S
from kindred.plans.queries import GRAM_CTE, NAMES_SQL, ORACLE, PAIRS_SQL, R, TOKENS, accent, asked_urls, groups_sql, long, mutated, names, over_pairs, query, read, rounded, snm_edges, url_edges, urls
from kindred.plans.scratch import fresh

# --- functions over all pairs of part names
over_pairs("lev_bytes_similarity", {"s": R("greatest(0.0::DOUBLE, 1.0::DOUBLE - levenshtein(replace(a, 'e', 'é'), b)::DOUBLE / greatest(length(a), length(b)))")}, s=rounded(lambda a, b: edit.levenshtein_bytes_similarity(accent(a), b)))
over_pairs("dl_checked", {"d": "damerau_levenshtein(a, b)"}, d=long(edit.damerau_levenshtein_checked))
over_pairs("jaro_distances", {"j": R(f"1.0::DOUBLE - {S.jaro('a', 'b')}"), "w": R(f"1.0::DOUBLE - {S.jaro_winkler('a', 'b')}")}, j=rounded(jaro.jaro_distance), w=rounded(jaro.jaro_winkler_distance))
LONGEST = "list_max(list_transform(range(0, length(a) * length(a)), lambda k: CASE WHEN k // length(a) + k % length(a) < length(a) AND contains(b, substr(a, k // length(a) + 1, k % length(a) + 1)) THEN 1000 * (k % length(a) + 1) + 999 - (k // length(a) + k % length(a) + 1) ELSE 999 END))"
over_pairs("common_substring_text", {"t": f"substr(a, 1000 - {LONGEST} % 1000 - {LONGEST} // 1000, {LONGEST} // 1000)"}, t=ngrams.longest_common_substring)
over_pairs(
    "normalized_pairs",
    {"x": "replace(a, ' ', '')", "y": "replace(b, ' ', '')", "d": "levenshtein(a, b)", "j": R(S.jaro("a", "b")), "c": "damerau_levenshtein(replace(a, ' ', ''), replace(b, ' ', ''))"},
    x=lambda a, b: normalize_pair(F.upper(a), F.concat(b, F.lit("!?")), "strict")[0],
    y=lambda a, b: normalize_pair(F.upper(a), F.concat(b, F.lit("!?")), "strict")[1],
    d=long(lambda a, b: edit.levenshtein(F.upper(a), b, normalize="lowercase")),
    j=rounded(lambda a, b: jaro.jaro_similarity(a, F.upper(b), "lowercase")),
    c=long(lambda a, b: edit.damerau_levenshtein(a, b, normalize="remove_whitespace")),
)
over_pairs(
    "fuzzy_similarity",
    {"w": R(S.jaro_winkler("a", "b")), "l": R(S.lev_sim("a", "b")), "i": R(S.jaro("a", "b")), "g": R(S.dice("a", "b", 2))},
    w=rounded(lambda a, b: fuzzy(a).similarity(b)),
    l=rounded(lambda a, b: fuzzy(a).similarity(b, "levenshtein")),
    i=rounded(lambda a, b: fuzzy(F.upper(a)).similarity(b, "jaro", case_insensitive=True)),
    g=rounded(lambda a, b: fuzzy(a).similarity(b, "ngram", 2)),
)
over_pairs("soundex_pairs", {"s": R(S.soundex_similarity(S.soundex("a"), S.soundex("b"))), "y": f"{S.soundex('a')} = {S.soundex('b')}"}, s=rounded(phonetic.soundex_similarity), y=phonetic.soundex_match)

PAIR_TABLE = f"{PAIRS_SQL} AS p"
ORACLE["lcs_len"] = f"WITH RECURSIVE {S.lcs(PAIR_TABLE)} SELECT a, b, n, t, round(2.0::DOUBLE * n / (length(a) + length(b)), 6) AS s, round(n::DOUBLE / greatest(length(a), length(b)), 6) AS m FROM l"
ORACLE["osa"] = f"WITH RECURSIVE {S.osa(PAIR_TABLE)} SELECT a, b, d, round(1.0::DOUBLE - d::DOUBLE / greatest(length(a), length(b)), 6) AS s FROM l"
PREFIX = " + ".join(f"(CASE WHEN a[1:{k}] = b[1:{k}] THEN 1 ELSE 0 END)" for k in range(1, 5))
ORACLE["jaro_grapheme"] = f"WITH RECURSIVE {S.jaro_halves(PAIR_TABLE)} SELECT a, b, round(j, 6) AS j, round(CASE WHEN j = 0 THEN 0 ELSE j + ({PREFIX}) * 0.1::DOUBLE * (1 - j) END, 6) AS w FROM l"
over_pairs("fuzzy_distances", None, h=lambda a, b: fuzzy(a).distance(b, "hamming").cast("long"), l=lambda a, b: fuzzy(a).distance(b, "lcs").cast("long"), o=lambda a, b: fuzzy(a).distance(b, "osa").cast("long"))
ORACLE["fuzzy_distances"] = f"WITH RECURSIVE {S.lcs(PAIR_TABLE)}, {S.osa(PAIR_TABLE).replace('cell(', 'cells(').replace('FROM cell ', 'FROM cells ').replace('), l AS', '), r AS')} SELECT a, b, CASE WHEN length(a) = length(b) THEN hamming(a, b) END AS h, greatest(length(a), length(b)) - n AS l, d AS o FROM l JOIN r USING (a, b)"


# --- phonetics
@query("phonetic_codes", f"WITH RECURSIVE {S.metaphone('(' + NAMES_SQL + ')')} SELECT t, {S.soundex('t')} AS soundex, code AS metaphone FROM meta")
def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("t", phonetic.soundex(F.col("t")).alias("soundex"), phonetic.metaphone(F.col("t")).alias("metaphone"))


over_pairs("phonetic_similarity", None, m=rounded(phonetic.metaphone_similarity), n=phonetic.metaphone_match)
ORACLE["phonetic_similarity"] = f"WITH RECURSIVE {S.metaphone('(' + NAMES_SQL + ')')} SELECT x.t AS a, y.t AS b, round({S.jaro_winkler('x.code', 'y.code')}, 6) AS m, x.code = y.code AS n FROM meta x, meta y"

#: Primary and alternate codes of all words that occur in part names, by the published rules.
DOUBLE_CODES = {
    "blue": ("PL", ""), "cold": ("KLT", ""), "hot": ("HT", ""), "large": ("LRJ", "LRK"), "new": ("N", "NF"), "old": ("ALT", ""), "red": ("RT", ""), "small": ("SML", "XML"),
    "anvil": ("ANFL", ""), "bolt": ("PLT", ""), "gear": ("JR", "KR"), "gizmo": ("JSM", "KSM"), "plate": ("PLT", ""), "ring": ("RNK", ""), "rod": ("RT", ""), "widget": ("AJT", "FJT"),
}
WORDS_SQL = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part"
CODES_SQL = f"SELECT t, p, q FROM (VALUES {', '.join(f'{(t, *c)}' for t, c in DOUBLE_CODES.items())}) c(t, p, q) JOIN ({WORDS_SQL}) USING (t)"


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select(F.explode(F.split("t", " ")).alias("t")).distinct()


@query("double_metaphone_codes", f"SELECT t, p AS \"primary\", q AS alternate FROM ({CODES_SQL})")
def double_metaphone_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_words(spark, sf_dir).select("t", phonetic.double_metaphone(F.col("t")).alias("d")).select("t", "d.primary", "d.alternate")


def best_code(pairs: list[tuple[str, str]]) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN {x} <> '' AND {y} <> '' THEN {S.jaro_winkler(x, y)} ELSE 0 END" for x, y in pairs) + ")"


CODE_PAIRS = [("x.p", "y.p"), ("x.p", "y.q"), ("x.q", "y.p"), ("x.q", "y.q")]


@query("double_metaphone_pairs", f"WITH c AS ({CODES_SQL}) SELECT x.t AS a, y.t AS b, round({best_code(CODE_PAIRS)}, 6) AS s, {' OR '.join(f'{p} = {q} AND {p} <> chr(0) AND length({p}) > 0' for p, q in CODE_PAIRS)} AS m FROM c x, c y")
def double_metaphone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = name_words(spark, sf_dir).select(F.col("t").alias("a"))
    x, y = F.col("a"), F.col("b")
    return a.crossJoin(a.withColumnRenamed("a", "b")).select("a", "b", F.round(phonetic.double_metaphone_similarity(x, y), 6).alias("s"), phonetic.double_metaphone_match(x, y).alias("m"))


@query("fuzzy_phonetic", f"WITH RECURSIVE {S.metaphone('(' + NAMES_SQL + ')')} SELECT t, {S.soundex('t')} AS s, {S.soundex('t')} AS p, code AS m, substr(code, 1, 2) AS short, lower(t) AS l, replace(t, ' ', '') AS w FROM meta")
def fuzzy_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fuzzy("t")
    return names(spark, sf_dir).select("t", t.soundex().alias("s"), t.phonetic().alias("p"), t.phonetic("metaphone").alias("m"), t.metaphone(2).alias("short"), fuzzy(F.upper("t")).normalize().alias("l"), t.normalize("strict").alias("w"))


#: Strings beyond ASCII, for what part names can't show.
MARKED = "concat(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN 'Ünïcode' WHEN 1 THEN 'ﬁle' WHEN 2 THEN 'été' ELSE '①' END)"


@query(
    "normalize_unicode",
    "SELECT p_partkey, concat(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN 'Ünïcode' WHEN 1 THEN 'file' WHEN 2 THEN 'été' ELSE '1' END) AS d, concat(replace(p_name, ' ', ''), CASE p_partkey % 4 WHEN 0 THEN 'ünïcode' WHEN 1 THEN 'file' WHEN 2 THEN 'été' ELSE '1' END) AS s, "
    "CASE p_partkey % 4 WHEN 2 THEN 1.0::DOUBLE END AS q FROM part",
)
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.functions import ratios

    t = F.expr(MARKED)
    same = F.when(F.col("p_partkey") % 4 == 2, ratios.qwratio(t, F.replace(t, F.lit("é"), F.lit("é"))))
    return read(spark, sf_dir, "part").select("p_partkey", normalize_string(t, "nfkd").alias("d"), normalize_string(t, "strict").alias("s"), F.round(same, 6).alias("q"))


# --- duplicates
def numbered_groups(edges: str, table: str, row: str, text: str) -> str:
    """Groups from the largest, of rows that the CTE e(u, v) ties."""
    return f"WITH RECURSIVE {edges}, {S.clusters(f'(SELECT {row} AS id FROM {table})', 'e')}, g AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS gid FROM cluster WHERE members > 1 GROUP BY root) SELECT id, {text} AS text, gid AS group_id, n AS group_size FROM cluster JOIN {table} ON {row} = id LEFT JOIN g USING (root)"


NAMES_TABLE = f"({NAMES_SQL}) x"


@query("deduplicate", numbered_groups(f"n AS (SELECT t, id AS nid FROM {NAMES_TABLE}), e AS (SELECT a.nid AS u, b.nid AS v FROM n a JOIN n b ON a.nid < b.nid WHERE {S.jaro_winkler('a.t', 'b.t')} >= 0.93::DOUBLE)", "n", "nid", "t"))
def deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.deduplicate(names(spark, sf_dir), min_similarity=0.93, text="t", id_col="id")


def near_urls(window: int, least: float = 0.85) -> str:
    return snm_edges("pages", "lower(url)", "page_id", S.lev_sim("lower(a.url)", "lower(b.url)"), least, window)


@query("find_duplicates_snm", numbered_groups(near_urls(10), "pages", "page_id", "url"))
def find_duplicates_snm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.find_duplicates(urls(spark, sf_dir), "levenshtein", method="snm", window_size=10, text="url", id_col="page_id")


#: As the method is chosen: all pairs below 2000 strings, else sorted neighbours.
AUTO = f"o AS (SELECT *, row_number() OVER (ORDER BY lower(url), page_id) AS n FROM pages), e AS (SELECT least(a.page_id, b.page_id) AS u, greatest(a.page_id, b.page_id) AS v FROM o a JOIN o b ON b.n > a.n AND ((SELECT count(*) FROM pages) < 2000 OR b.n <= a.n + 50) WHERE {S.lev_sim('lower(a.url)', 'lower(b.url)')} >= 0.9::DOUBLE)"


@query("find_duplicates_auto", numbered_groups(AUTO, "pages", "page_id", "url"))
def find_duplicates_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.find_duplicates(urls(spark, sf_dir), "levenshtein", 0.9, text="url", id_col="page_id")


@query("find_duplicate_pairs", f"WITH {near_urls(7, 0.8)} SELECT u AS id_a, v AS id_b, round(s, 6) AS score FROM e")
def find_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.find_duplicate_pairs(urls(spark, sf_dir), "levenshtein", 0.8, 8, text="url", id_col="page_id").withColumn("score", F.round("score", 6))


@query(
    "series_dedupe",
    f"WITH f AS ({numbered_groups(AUTO, 'pages', 'page_id', 'url')}) SELECT id, text AS value, coalesce(group_id, (SELECT count(DISTINCT group_id) FROM f) + row_number() OVER (PARTITION BY group_id IS NULL ORDER BY id) - 1) AS group_id, group_id IS NULL OR id = min(id) OVER (PARTITION BY group_id) AS is_canonical FROM f",
)
def series_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.series_dedupe(urls(spark, sf_dir), "levenshtein", 0.9, text="url", id_col="page_id")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))


HOST_TABLE = "(SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages) h"
WEIGHTED = f"(2 * {S.jaro_winkler('a.host', 'b.host')} + {S.lev_sim('a.url', 'b.url')}) / 3"


@query("dedupe_snm_weighted", groups_sql(snm_edges(HOST_TABLE, "host || ' ' || url", "page_id", WEIGHTED, 0.93, 5), "pages", "page_id"))
def dedupe_snm_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_snm(hosts(spark, sf_dir), ["host", "url"], min_similarity=0.93, window_size=5, weights={"host": 2.0}, algorithms={"url": "levenshtein"}, id_col="page_id")
    return out.select("page_id", "_group_id", "_is_canonical")


@query("dedupe_snm_customers", groups_sql(snm_edges("customer", "lower(c_name)", "c_custkey", S.lev_sim("lower(a.c_name)", "lower(b.c_name)"), 0.95, 9), "customer", "c_custkey"))
def dedupe_snm_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_snm(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"], "levenshtein", 0.95, id_col="c_custkey").drop("c_name")


def kept_sql(order: str) -> str:
    return groups_sql(url_edges(S.lev_sim("a.url", "b.url"), 0.85), "pages", "page_id").replace("id = root AS _is_canonical", f"gid IS NULL OR id = first(id) OVER (PARTITION BY root ORDER BY {order}) AS _is_canonical")


@query("dedupe_keep_last", kept_sql("id DESC"))
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(urls(spark, sf_dir), ["url"], "levenshtein", 0.85, keep="last", id_col="page_id").drop("url")


@query("dedupe_keep_most_complete", kept_sql("CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 0 ELSE 1 END + CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END DESC, id"))
def dedupe_keep_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("page_id") % 3 == 1, F.lit(" ")).when(F.col("page_id") % 3 == 2, F.lit("x"))
    df = urls(spark, sf_dir).withColumn("more", more).withColumn("other", F.when(F.col("page_id") % 5 != 0, F.col("page_id")))
    return dedupe(df, ["url"], "levenshtein", 0.85, keep="most_complete", id_col="page_id").select("page_id", "_group_id", "_is_canonical")


# --- joins
def near_names(least: float) -> str:
    """CTEs q (mutated names), c (names) and s (similar distinct ones)."""
    return f"q AS (SELECT p_partkey, {S.typo('p_partkey', 'p_name')} AS t FROM part), c AS ({NAMES_SQL}), v AS (SELECT DISTINCT t FROM q), s AS (SELECT v.t AS q, c.t AS t, id, {S.lev_sim('v.t', 'c.t')} AS s FROM v, c WHERE {S.share_gram('v.t', 'c.t')} AND {S.lev_sim('v.t', 'c.t')} >= {least}::DOUBLE)"


@query("fuzzy_join_semi", f"WITH {near_names(0.9)} SELECT p_partkey, t FROM q WHERE t IN (SELECT q FROM s)")
def fuzzy_join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_join(mutated(spark, sf_dir).select("p_partkey", "t"), names(spark, sf_dir), on="t", algorithm="levenshtein", min_similarity=0.9, how="semi")


@query("fuzzy_join_anti", f"WITH {near_names(0.9)} SELECT p_partkey, t FROM q WHERE t NOT IN (SELECT q FROM s)")
def fuzzy_join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_join(mutated(spark, sf_dir).select("p_partkey", "t"), names(spark, sf_dir), on="t", algorithm="levenshtein", min_similarity=0.9, how="anti")


@query("fuzzy_join_top_k", f"WITH {near_names(0.6)}, k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 3) SELECT p_partkey, k.id, round(k.s, 6) AS fuzzy_score FROM q JOIN k ON k.q = q.t")
def fuzzy_join_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_join(mutated(spark, sf_dir).select("p_partkey", "t"), names(spark, sf_dir), on="t", algorithm="levenshtein", min_similarity=0.6, left_id="p_partkey", right_id="id", top_k=3)
    return out.select("p_partkey", "id", F.round("fuzzy_score", 6).alias("fuzzy_score"))


# --- indexes
ITEMS_SQL = "SELECT url, min(page_id) AS id FROM pages GROUP BY url"
WITHIN_SQL = f"SELECT q.page_id AS query_id, i.id, levenshtein(q.url, i.url) AS distance FROM pages q JOIN ({ITEMS_SQL}) i ON levenshtein(q.url, i.url) <= 10 WHERE q.page_id % 20 = 0"


def within(index: EditIndex, spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index.search(asked_urls(spark, sf_dir), max_distance=10, text="url", query_id="page_id")
    return hits.select("query_id", "id", F.col("distance").cast("long").alias("distance"))


@query("edit_similarity_search", f"SELECT q.page_id AS query_id, i.id, levenshtein(q.url, i.url) AS distance, round({S.lev_sim('q.url', 'i.url')}, 6) AS score FROM pages q JOIN ({ITEMS_SQL}) i ON levenshtein(q.url, i.url) <= ceil((1.0::DOUBLE - 0.8::DOUBLE) * length(q.url)) WHERE q.page_id % 20 = 0")
def edit_similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = EditIndex(urls(spark, sf_dir), text="url", id_col="page_id").search(asked_urls(spark, sf_dir), min_similarity=0.8, text="url", query_id="page_id")
    return hits.select("query_id", "id", F.col("distance").cast("long").alias("distance"), F.round("score", 6).alias("score"))


@query(
    "index_maintenance",
    f"WITH i AS ({ITEMS_SQL}), k AS (SELECT * FROM i WHERE id % 7 <> 3 AND id <> 8 AND url <> (SELECT url FROM pages WHERE page_id = 5) UNION ALL SELECT 'more ' || r_name, 1000000 + r_regionkey FROM region) SELECT row_number() OVER (ORDER BY id) - 1 AS id, url AS text, (SELECT count(*) FROM k) AS active FROM k",
)
def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = urls(spark, sf_dir).where("page_id % 7 = 3").select("page_id")
    fifth = urls(spark, sf_dir).where("page_id = 5").first().url
    more = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1_000_000).alias("id"), F.concat(F.lit("more "), "r_name").alias("text"))
    index = EditIndex(urls(spark, sf_dir), text="url", id_col="page_id").remove(gone).remove([8]).remove_text(fifth).add_all(more, id_col="id").compact()
    return index.get_items().select("id", "text", F.lit(index.active_count()).cast("long").alias("active"))


@query("index_contains", "SELECT DISTINCT p_partkey, t FROM (SELECT p_partkey, " + S.typo("p_partkey", "p_name") + " AS t FROM part) WHERE t IN (SELECT p_name FROM part)")
def index_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EditIndex(names(spark, sf_dir), text="t", id_col="id").contains(mutated(spark, sf_dir).select("p_partkey", "t"), "t").select("p_partkey", "t")


@query("edit_index_saved", WITHIN_SQL)
def edit_index_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "edit")
    EditIndex(urls(spark, sf_dir), text="url", id_col="page_id").save(at)
    return within(EditIndex.load(spark, at), spark, sf_dir)


@query("sharded_edit_search", WITHIN_SQL)
def sharded_edit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(ShardedEditIndex(urls(spark, sf_dir), 5, text="url", id_col="page_id"), spark, sf_dir)


@query("threadsafe_edit_search", WITHIN_SQL)
def threadsafe_edit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(ThreadSafeEditIndex(urls(spark, sf_dir), text="url", id_col="page_id"), spark, sf_dir)


def best_hits(score: str, least: float, shared: str, limit: int, cte: str = GRAM_CTE) -> str:
    return f"WITH {cte}, s AS (SELECT query_id, id, {score} AS s FROM c JOIN pages q ON q.page_id = query_id JOIN pages i ON i.page_id = id WHERE shared >= {shared}) SELECT query_id, id, round(s, 6) AS score FROM s WHERE s >= {least}::DOUBLE QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= {limit}"


LOWER_LEV, LOWER_WINKLER, SHARED = S.lev_sim("lower(q.url)", "lower(i.url)"), S.jaro_winkler("lower(q.url)", "lower(i.url)"), "ceil(0.2::DOUBLE * n)"


def hits_of(index, spark: SparkSession, sf_dir: str, algorithm: str, least: float, limit: int) -> DataFrame:
    hits = index.search(asked_urls(spark, sf_dir), algorithm, least, limit, text="url", query_id="page_id")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


@query("ngram_index_saved", best_hits(LOWER_LEV, 0.7, SHARED, 4))
def ngram_index_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "ngram")
    NgramIndex(urls(spark, sf_dir), text="url", id_col="page_id").compress().save(at)
    return hits_of(NgramIndex.load(spark, at).decompress(), spark, sf_dir, "levenshtein", 0.7, 4)


@query("hybrid_search", best_hits(LOWER_LEV, 0.7, SHARED, 4))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(HybridIndex(urls(spark, sf_dir), text="url", id_col="page_id"), spark, sf_dir, "levenshtein", 0.7, 4)


@query("sharded_ngram_search", best_hits(LOWER_LEV, 0.7, SHARED, 4))
def sharded_ngram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(ShardedNgramIndex(urls(spark, sf_dir), 5, text="url", id_col="page_id"), spark, sf_dir, "levenshtein", 0.7, 4)


@query("threadsafe_ngram_search", best_hits(LOWER_WINKLER, 0.9, "1", 3, GRAM_CTE.replace("lower(url)", "url").replace("lower(url", "url")))
def threadsafe_ngram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(ThreadSafeNgramIndex(urls(spark, sf_dir), min_similarity=0.9, text="url", id_col="page_id"), spark, sf_dir, "jaro_winkler", 0.0, 3)


@query("ngram_nearest", best_hits(LOWER_WINKLER, 0.0, SHARED, 2))
def ngram_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = NgramIndex(urls(spark, sf_dir), text="url", id_col="page_id").find_nearest(asked_urls(spark, sf_dir), 2, text="url", query_id="page_id")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


@query("fuzzy_index_ngram", best_hits(LOWER_WINKLER, 0.85, SHARED, 3))
def fuzzy_index_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(FuzzyIndex.from_dataframe(urls(spark, sf_dir), "url", id_col="page_id"), spark, sf_dir, "jaro_winkler", 0.85, 3)


RADIUS = "least(50, greatest(2, floor((1.0::DOUBLE - 0.75::DOUBLE) * greatest((SELECT max(length(url)) FROM pages), 3 * length(q.url)))))"


@query("fuzzy_index_edit", f"SELECT q.page_id AS query_id, i.id, round({S.lev_sim('q.url', 'i.url')}, 6) AS score FROM pages q JOIN ({ITEMS_SQL}) i ON {S.lev_sim('q.url', 'i.url')} >= 0.75::DOUBLE AND levenshtein(q.url, i.url) <= {RADIUS} WHERE q.page_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.page_id ORDER BY {S.lev_sim('q.url', 'i.url')} DESC, i.id) <= 4")
def fuzzy_index_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "fuzzy")
    FuzzyIndex.from_series(urls(spark, sf_dir), "url", "bktree", id_col="page_id").save(at)
    return hits_of(FuzzyIndex.load(spark, at), spark, sf_dir, "levenshtein", 0.75, 4)


@query("index_statistics", f"WITH g AS (SELECT page_id, unnest(list_distinct({S.grams('lower(url)', 3, False)})) AS gram FROM pages) SELECT count(DISTINCT gram) AS grams, count(*) AS postings, (SELECT count(*) FROM pages) AS items FROM g")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ShardedNgramIndex(urls(spark, sf_dir), 4, text="url", id_col="page_id")
    return index.compression_stats().crossJoin(index.shard_distribution().agg(F.sum("items").alias("items")))


# --- schemas
PARTS = "SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS brand FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))


def single_sql(key: str, asked: str, score: str, least: float, gate: int) -> str:
    """Search by one field: distinct values are compared, rows joined. ``$a`` and ``$b`` are the compared values."""
    s = score.replace("$a", "x.t").replace("$b", "y.t")
    return f"WITH r AS ({PARTS}), q AS (SELECT id, {asked} AS t FROM r WHERE id % 20 = 0), i AS (SELECT id, {key} AS t FROM r), v AS (SELECT x.t AS a, y.t AS b, {s} AS s FROM (SELECT DISTINCT t FROM q) x, (SELECT DISTINCT t FROM i) y WHERE {S.share_gram('x.t', 'y.t', gate)} AND {s} >= {least}::DOUBLE) SELECT q.id AS query_id, i.id, round(s, 6) AS score FROM q JOIN v ON v.a = q.t JOIN i ON i.t = v.b"


def searched(index: SchemaIndex, queries: DataFrame, least: float) -> DataFrame:
    return index.search(queries, least, query_id="query_id").select("query_id", "id", F.round("score", 6).alias("score"))


@query("schema_search_normalized", single_sql("lower(replace(name, ' ', ''))", "lower(replace(name, ' ', ''))", S.lev_sim("$a", "$b"), 0.7, 2))
def schema_search_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", "name")
    schema = MatchSchema.builder().add_field("name", "short_text", algorithm="levenshtein", normalize="strict", max_length=100).build()
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.upper("name"), F.lit(" !")).alias("name"))
    return searched(SchemaIndex(schema, rows, id_col="id"), asked, 0.7)


@query("schema_search_lowercase", single_sql("lower(kind)", "lower(kind)", S.jaro_winkler("$a", "$b"), 0.8, 2))
def schema_search_lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", "kind")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.lower("kind").alias("kind"))
    return searched(SchemaIndex(MatchSchema.builder().add_field("kind", normalize="lowercase").build(), rows, id_col="id"), asked, 0.8)


LONG = "name || ' of ' || kind || ' by ' || brand"


@query("schema_search_long_text", single_sql(LONG, LONG, S.dice("$a", "$b", 2), 0.75, 2))
def schema_search_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", F.concat_ws(" of ", "name", F.concat_ws(" by ", "kind", "brand")).alias("body"))
    schema = MatchSchema.builder().add_field("body", "long_text", chunk_size=1000).build()
    return searched(SchemaIndex(schema, rows, id_col="id"), rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 0.75)


@query("schema_search_exact", f"WITH r AS ({PARTS}) SELECT q.id AS query_id, r.id, 1.0::DOUBLE AS score FROM r q JOIN r ON r.brand = q.brand WHERE q.id % 20 = 0")
def schema_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", "brand")
    schema = MatchSchema.builder().add_field("brand", "short_text", algorithm="exact_match").build()
    return searched(SchemaIndex(schema, rows, id_col="id"), rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 0.5)


@query("schema_get", f"SELECT id, name, tags, (SELECT count(*) FROM part) + 5 AS records FROM (SELECT id, name, kind AS tags FROM ({PARTS}) UNION ALL SELECT 1000000 + r_regionkey, r_name, NULL FROM region) WHERE id IN (3, 1000002)")
def schema_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = MatchSchema.builder().add_field("name", normalize="strict").add_field("tags", "token_set").build()
    index = SchemaIndex(schema, parts(spark, sf_dir).select("id", "name", F.col("kind").alias("tags")), id_col="id")
    index = index.add(read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1_000_000).cast("long").alias("id"), F.col("r_name").alias("name")), id_col="id")
    return index.get(3).unionByName(index.get(1_000_002)).select("id", "name", "tags", F.lit(len(index)).cast("long").alias("records"))


TAGS = "kind || ' ' || name"


@query(
    "token_set_rare",
    f"WITH r AS (SELECT id, {TAGS} AS t FROM ({PARTS})), d AS (SELECT DISTINCT t FROM r), v AS (SELECT a.t AS a, b.t AS b, len(list_intersect({TOKENS('a.t')}, {TOKENS('b.t')}))::DOUBLE / len(list_distinct(list_concat({TOKENS('a.t')}, {TOKENS('b.t')}))) AS s FROM d a, d b) SELECT q.id AS query_id, i.id, round(s, 6) AS score FROM r q JOIN v ON v.a = q.t JOIN r i ON i.t = v.b WHERE q.id % 20 = 0 AND s >= 0.5::DOUBLE",
)
def token_set_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", F.concat_ws(" ", "kind", "name").alias("tags"))
    index = SchemaIndex(MatchSchema.builder().add_field("tags", "token_set", separator=" ").build(), rows, id_col="id")
    return searched(index, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 0.5)
