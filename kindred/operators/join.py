"""Fuzzy joins: the best partner of each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.errors import ValidationError, check_columns, check_positive, check_similarity
from kindred.functions.registry import Algorithm, resolve
from kindred.operators._arguments import Algo, fields_of, key_rows
from kindred.plans.scratch import with_row_ids
from kindred.plans.similarity_join import Field, best_of, pair_scores


def join_fields(on, left_on, right_on, algorithm: Algo) -> list[Field]:
    """``on``: a column, columns, or (left, right) or (left, right, {algorithm, weight}) for each pair of columns."""
    if on is None:
        if left_on is None or right_on is None:
            raise ValidationError("give on, or left_on and right_on")
        lefts, rights = ([x] if isinstance(x, str) else list(x) for x in (left_on, right_on))
        if len(lefts) != len(rights):
            raise ValidationError("left_on and right_on have as many columns")
        on = list(zip(lefts, rights))
    out = []
    for x in [on] if isinstance(on, str) else on:
        x = (x, x) if isinstance(x, str) else tuple(x)
        options = x[2] if len(x) > 2 else {}
        if unknown := set(options) - {"algorithm", "weight"}:
            raise ValidationError(f"unknown join options {sorted(unknown)}")
        a, w = options.get("algorithm", algorithm), float(options.get("weight", 1.0))
        if isinstance(a, (str, Algorithm)):
            resolve(a)
        if w < 0:
            raise ValidationError("weights aren't negative")
        out.append(Field(x[0], x[1], a, w))
    return out


def fuzzy_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence | None = None,
    left_on: str | Sequence[str] | None = None,
    right_on: str | Sequence[str] | None = None,
    algorithm: Algo = "jaro_winkler",
    min_similarity: float = 0.8,
    how: str = "inner",
    left_id: str | None = None,
    right_id: str | None = None,
    top_k: int = 1,
    gating: bool = True,
) -> DataFrame:
    """Each left row with its best right row (``top_k`` of them) and ``fuzzy_score``.

    how: inner, left (rows without partner keep nulls and a score of 0), semi or anti. Left rows with a null key
    have no partner. Of equal scores the right row with the smaller id wins (``right_id``, else its position).
    Right columns whose names the left has end in ``_right``. ``gating=False`` also compares values that share no
    bigram, by a nested loop: for small tables only.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValidationError(f"how is inner, left, semi or anti, not {how!r}")
    t, k = check_similarity(min_similarity), check_positive(top_k, "top_k")
    fields = join_fields(on, left_on, right_on, algorithm)
    lk, rk = list(dict.fromkeys(f.left for f in fields)), list(dict.fromkeys(f.right for f in fields))
    check_columns(left, lk)
    check_columns(right, rk)
    if how in ("semi", "anti"):
        keyed = left.select(*lk).where(" and ".join(f"`{c}` is not null" for c in lk)).distinct()
        keyed, b = with_row_ids(keyed, "_lid"), with_row_ids(right.select(*rk).distinct(), "_rid")
        pairs = pair_scores(key_rows(keyed, lk, "_lid", "lid"), key_rows(b, rk, "_rid", "rid"), fields, t, gated=gating)
        met = keyed.join(pairs.select(F.col("lid").alias("_lid")).distinct(), "_lid", "left_semi").drop("_lid")
        return left.join(met, lk, f"left_{how}")
    a, b = with_row_ids(left, "_lid", left_id), with_row_ids(right, "_rid", right_id)
    present = a.where(" and ".join(f"`{c}` is not null" for c in lk))
    left_keys, right_keys = key_rows(present, lk, "_lid", "lid"), key_rows(b, rk, "_rid", "rid")
    pairs = pair_scores(left_keys, right_keys, fields, t, gated=gating)
    best = best_of(pairs, "lid", "rid", 1 if k == 1 else k)
    if k > 1:
        # equal right rows beyond the first of their kind also are partners
        same = b.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rk], "_rid")
        every = best.join(right_keys, "rid").join(same, rk).select("lid", F.col("_rid").alias("rid"), "score")
        best = best_of(every, "lid", "rid", k)
    texts = [F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(lk)]
    of_row = present.select("_lid", *texts).join(left_keys.select("lid", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(lk)]), [f"_k{i}" for i in range(len(lk))]).select("_lid", "lid")
    matched = of_row.join(best, "lid").select("_lid", F.col("rid").alias("_rid"), F.col("score").alias("fuzzy_score"))
    renamed = b.select("_rid", *[F.col(c).alias(f"{c}_right" if c in left.columns else c) for c in right.columns])
    partners = matched.join(renamed, "_rid").drop("_rid")
    out = a.join(partners, "_lid", "inner" if how == "inner" else "left")
    names = [*left.columns, *[c for c in renamed.columns if c != "_rid"]]
    return out.select(*names, F.coalesce("fuzzy_score", F.lit(0.0)).alias("fuzzy_score"))


def match_records(
    queries: DataFrame,
    targets: DataFrame,
    columns: Sequence[str],
    algorithm: Algo = "jaro_winkler",
    min_similarity: float = 0.0,
    weights: dict[str, float] | None = None,
    algorithms: dict[str, Algo] | None = None,
    limit: int = 1,
    min_field_similarity: float = 0.0,
    query_id: str | None = None,
    target_id: str | None = None,
) -> DataFrame:
    """``query_idx, target_idx, score`` and the compared columns of both, for the ``limit`` best targets of each query that has any."""
    columns = check_columns(queries, list(columns))
    check_columns(targets, columns)
    fields = fields_of(columns, algorithm, weights, algorithms)
    t, m, k = check_similarity(min_similarity), check_similarity(min_field_similarity, "min_field_similarity"), check_positive(limit, "limit")
    q, r = as_rows(queries, columns, "lid", query_id), as_rows(targets, columns, "rid", target_id)
    best = best_of(pair_scores(q, r, fields, t, m), "lid", "rid", k)
    left = q.select("lid", *[F.col(c).alias(f"{c}_query") for c in columns])
    right = r.select("rid", *[F.col(c).alias(f"{c}_target") for c in columns])
    out = best.join(left, "lid").join(right, "rid")
    return out.select(F.col("lid").alias("query_idx"), F.col("rid").alias("target_idx"), "score", *[f"{c}_query" for c in columns], *[f"{c}_target" for c in columns])


def as_rows(df: DataFrame, columns: list[str], into: str, id_col: str | None) -> DataFrame:
    from kindred.operators._arguments import as_text

    return as_text(with_row_ids(df, into, id_col).select(into, *columns), columns)
