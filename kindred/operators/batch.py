"""Operators over lists of strings, here one-column tables: scores, top-k, matrices, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.errors import ValidationError, check_positive, check_similarity
from kindred.functions.normalize import normalize_string
from kindred.functions.ratios import wratio
from kindred.functions.registry import lengths_allow, scorer
from kindred.operators._arguments import Algo
from kindred.operators.cluster import connected_components
from kindred.plans.near import matches, short, similar_to_itself
from kindred.plans.scratch import numbered, spool, with_row_ids
from kindred.plans.similarity_join import Field, all_cores, score_within, value_scores

#: Fixed value: up to so many strings every pair is compared, beyond it sorted neighbours are.
BRUTE_FORCE = 2000


def strings_of(df: DataFrame, text: str, id_col: str | None) -> DataFrame:
    return with_row_ids(df, "id", id_col).select("id", F.col(text).alias("text"))


def similarity(strings: DataFrame, query: str, algorithm: Algo = "jaro_winkler", text: str = "text", id_col: str | None = None) -> DataFrame:
    """``id, text, score`` of every string."""
    return strings_of(strings, text, id_col).withColumn("score", scorer(algorithm)(F.col("text"), F.lit(query)))


batch_similarity = similarity


def top(scored: DataFrame, limit: int, least: float) -> DataFrame:
    return scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(limit)


def best_matches(strings: DataFrame, query: str, algorithm: Algo = "jaro_winkler", limit: int = 5, min_similarity: float = 0.0, text: str = "text", id_col: str | None = None) -> DataFrame:
    """The ``limit`` best; of equal scores the smaller id comes first."""
    t = check_similarity(min_similarity)
    rows, cheap = strings_of(strings, text, id_col), lengths_allow(algorithm, t, F.col("text"), F.lit(query)) if t > 0 else None
    rows = rows if cheap is None else rows.where(cheap)
    return top(rows.withColumn("score", scorer(algorithm)(F.col("text"), F.lit(query))), check_positive(limit, "limit"), t)


def pairwise(pairs: DataFrame, left: str = "left", right: str = "right", algorithm: Algo = "jaro_winkler", into: str = "score", ngram_size: int = 3) -> DataFrame:
    """``pairs`` with the similarity of two columns, by any algorithm. Null gives null."""
    return pairs.withColumn(into, scorer(algorithm, ngram_size)(F.col(left), F.col(right)))


series_similarity = pairwise


def similarity_matrix(queries: DataFrame, choices: DataFrame, algorithm: Algo = "levenshtein", text: str = "text", query_id: str | None = None, choice_id: str | None = None) -> DataFrame:
    """``query_id, choice_id, score`` of all combinations: the result itself has that many rows."""
    q = strings_of(queries, text, query_id).select(F.col("id").alias("query_id"), F.col("text").alias("q"))
    c = strings_of(choices, text, choice_id).select(F.col("id").alias("choice_id"), F.col("text").alias("c"))
    return q.crossJoin(c).select("query_id", "choice_id", scorer(algorithm)(F.col("q"), F.col("c")).alias("score"))


cdist = distance_matrix = similarity_matrix


def extract(query: str, choices: DataFrame, limit: int = 10, min_similarity: float = 0.0, text: str = "text", id_col: str | None = None) -> DataFrame:
    """The best by weighted ratio."""
    scored = strings_of(choices, text, id_col).withColumn("score", wratio(F.lit(query), F.col("text")))
    return top(scored, check_positive(limit, "limit"), check_similarity(min_similarity))


def extract_one(query: str, choices: DataFrame, min_similarity: float = 0.0, text: str = "text", id_col: str | None = None) -> DataFrame:
    """One row or none; of equal scores the last."""
    scored = strings_of(choices, text, id_col).withColumn("score", wratio(F.lit(query), F.col("text")))
    best = scored.where(F.col("score") >= check_similarity(min_similarity)).agg(F.max(F.struct("score", "id", "text")).alias("b"))
    return best.where("b is not null").select("b.id", "b.text", "b.score")


def compare_algorithms(strings: DataFrame, query: str, algorithms: Sequence[Algo] = ("levenshtein", "jaro", "jaro_winkler", "ngram", "lcs", "cosine"), limit: int = 3, text: str = "text", id_col: str | None = None) -> DataFrame:
    """``algorithm, mean_score, rank, id, text, score``: the best ``limit`` strings by each algorithm; best mean first."""
    rows = strings_of(strings, text, id_col)
    each = F.explode(F.array(*[F.struct(F.lit(str(getattr(a, "value", a))).alias("algorithm"), scorer(a)(F.col("text"), F.lit(query)).alias("score")) for a in algorithms])).alias("x")
    scored = rows.select("id", "text", each).select("id", "text", "x.algorithm", "x.score")
    means = scored.groupBy("algorithm").agg(F.avg("score").alias("mean_score"))
    # a limit for each algorithm before the window: it ranks few rows
    best = None
    for a in algorithms:
        one = top(scored.where(F.col("algorithm") == str(getattr(a, "value", a))), check_positive(limit, "limit"), -1.0)
        best = one if best is None else best.unionByName(one)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("algorithm").orderBy(F.col("score").desc(), "id")))
    return ranked.join(means, "algorithm").select("algorithm", "mean_score", "rank", "id", "text", "score").orderBy(F.col("mean_score").desc(), "algorithm", "rank")


def normalized(rows: DataFrame, normalize: str | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.withColumn("key", text if normalize is None else normalize_string(text, normalize))


def find_duplicate_pairs(strings: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.85, window_size: int = 50, normalize: str | None = "lowercase", text: str = "text", id_col: str | None = None) -> DataFrame:
    """``id_a < id_b, score`` of similar strings within ``window_size - 1`` places in sorted order."""
    from kindred.plans.neighbours import neighbour_pairs

    t, w = check_similarity(min_similarity), check_positive(window_size, "window_size")
    rows = normalized(strings_of(strings, text, id_col), normalize)
    if w == 1:
        return strings.sparkSession.createDataFrame([], "id_a long, id_b long, score double")
    pairs = neighbour_pairs(rows, ["key", "id"], w - 1, ["id", "key"])
    scored = pairs.withColumn("score", scorer(algorithm)(F.col("a.key"), F.col("b.key"))).where(F.col("score") >= t)
    return scored.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), "score")


def duplicate_edges(rows: DataFrame, algorithm: Algo, t: float, method: str, window: int) -> DataFrame:
    from kindred.plans.neighbours import neighbour_pairs

    # equal strings are compared once; the rows of each are tied to its first
    keys = spool(rows.groupBy("key").agg(F.min("id").alias("id")), "keys")
    copies = rows.join(keys.withColumnRenamed("id", "first"), "key").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    if method == "auto":
        method = "brute_force" if rows.count() < BRUTE_FORCE else "snm"
    if method == "brute_force":
        field = Field("key", "key", algorithm)
        if field.name == "levenshtein" and t > 0 and short((keys, "key")):
            return similar_to_itself(keys.select("id", F.col("key").alias("t")), keys.count(), t, 0, forest=True).unionByName(copies)
        a, b = keys.select(F.col("key").alias("lv"), F.col("id").alias("u")), keys.select(F.col("key").alias("rv"), F.col("id").alias("v"))
        close, score = F.col("u") < F.col("v"), score_within(field, t)
        cheap = lengths_allow(algorithm, t, F.col("lv"), F.col("rv"))
        close = close if cheap is None else close & cheap
        close = close & (score >= t) if field.name == "levenshtein" else close
        return all_cores(a).join(all_cores(b), close).where(score >= t).select("u", "v").unionByName(copies)
    # here copies fill places of the window, so all rows are compared
    pairs = neighbour_pairs(rows, ["key", "id"], window, ["id", "key"])
    scored = pairs.where(scorer(algorithm)(F.col("a.key"), F.col("b.key")) >= t)
    return scored.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))


def find_duplicates(strings: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.85, normalize: str | None = "lowercase", method: str = "auto", window_size: int = 50, text: str = "text", id_col: str | None = None) -> DataFrame:
    """``id, text, group_id, group_size``: groups numbered from the largest; a null group for strings without duplicates.

    method: brute_force compares all pairs of distinct strings, snm each with the next ``window_size`` in sorted order,
    auto takes the former below 2000 strings. The number of superfluous rows is ``total_duplicates`` of the result.
    """
    if method not in ("auto", "brute_force", "snm"):
        raise ValidationError(f"method is auto, brute_force or snm, not {method!r}")
    rows = spool(normalized(strings_of(strings, text, id_col), normalize), "strings")
    edges = duplicate_edges(rows, algorithm, check_similarity(min_similarity), method, check_positive(window_size, "window_size"))
    comps = spool(connected_components(edges), "components")
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("group_size")).withColumn("_desc", -F.col("group_size"))
    groups = numbered(sizes, ["_desc", "component"], "group_id").drop("_desc")
    return rows.select("id", "text").join(comps.withColumnRenamed("node", "id"), "id", "left").join(groups, "component", "left").select("id", "text", "group_id", "group_size")


def total_duplicates(groups: DataFrame) -> int:
    """Rows that could go: each group's size less one."""
    return groups.where("group_id is not null").agg((F.count(F.lit(1)) - F.countDistinct("group_id"))).first()[0]


def deduplicate(strings: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.8, normalize: str | None = None, text: str = "text", id_col: str | None = None) -> DataFrame:
    return find_duplicates(strings, algorithm, min_similarity, normalize, text=text, id_col=id_col)


def series_dedupe(strings: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.85, normalize: str | None = "lowercase", text: str = "text", id_col: str | None = None) -> DataFrame:
    """``id, value, group_id, is_canonical``: all rows have a group, those without duplicates one of their own, after the others."""
    found = spool(find_duplicates(strings, algorithm, min_similarity, normalize, text=text, id_col=id_col), "found")
    groups = found.where("group_id is not null").agg(F.countDistinct("group_id")).first()[0]
    first = found.where("group_id is not null").groupBy("group_id").agg(F.min("id").alias("kept"))
    alone = numbered(found.where("group_id is null").select("id"), ["id"], "nth").withColumn("own", F.col("nth") + groups).drop("nth")
    joined = found.join(first, "group_id", "left").join(alone, "id", "left")
    return joined.select("id", F.coalesce("text", F.lit("")).alias("value"), F.coalesce("group_id", "own").alias("group_id"), (F.col("kept").isNull() | (F.col("kept") == F.col("id"))).alias("is_canonical"))


def series_match(queries: DataFrame, targets: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.0, text: str = "text", query_id: str | None = None, target_id: str | None = None) -> DataFrame:
    """``query_idx, query, target_idx, target, score`` of all combinations that reach ``min_similarity``; nulls are skipped.

    There is no gate: Levenshtein similarities are found by blocks that all meet, others by a nested loop over distinct
    strings whose lengths are checked first.
    """
    t = check_similarity(min_similarity)
    q = spool(strings_of(queries, text, query_id).where("text is not null").select(F.col("id").alias("query_idx"), F.col("text").alias("query")), "queries")
    r = spool(strings_of(targets, text, target_id).where("text is not null").select(F.col("id").alias("target_idx"), F.col("text").alias("target")), "targets")
    field = Field("query", "target", algorithm)
    if field.name == "levenshtein" and t > 0 and short((q, "query"), (r, "target")):
        items, asks = r.select(F.col("target_idx").alias("id"), F.col("target").alias("t")), q.select(F.col("query_idx").alias("id"), F.col("query").alias("t"))
        found = matches(items, asks, r.count(), q.count(), t)
        return found.select(F.col("query_id").alias("query_idx"), "query", F.col("id").alias("target_idx"), F.col("text").alias("target"), "score")
    a, b = q.select(F.col("query").alias("lv")).distinct(), r.select(F.col("target").alias("rv")).distinct()
    scored = value_scores(a, b, field, t, gated=False).select(F.col("lv").alias("query"), F.col("rv").alias("target"), F.col("s").alias("score"))
    return q.join(scored, "query").join(r, "target").select("query_idx", "query", "target_idx", "target", "score")


def series_best_match(queries: DataFrame, targets: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.0, normalize: str | None = None, text: str = "text", query_id: str | None = None, target_id: str | None = None) -> DataFrame:
    """``query_idx, query, match, score``: the best target that shares a fifth of the query's trigrams; null if none does."""
    from kindred.operators.index import NgramIndex

    q = strings_of(queries, text, query_id)
    hits = NgramIndex(strings_of(targets, text, target_id).where("text is not null"), id_col="id").search(q.where("text is not null"), algorithm, min_similarity, limit=1, normalize=normalize, query_id="id")
    best = hits.select(F.col("query_id").alias("id"), F.col("text").alias("match"), "score")
    return q.join(best, "id", "left").select(F.col("id").alias("query_idx"), F.col("text").alias("query"), "match", "score")
