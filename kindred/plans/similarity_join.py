"""Candidate pairs for similarity joins: which pairs of values are worth scoring.

Two values are candidates when they share a bigram (case-sensitive, unpadded); this gate is part of the operators'
meaning, not only a shortcut. It is an equi-join over distinct values, so repeated values cost nothing. Where the
algorithm and threshold allow, fewer grams are joined without losing a pair:

* Levenshtein at least t: k = (1 - t) * longer length edits destroy at most q * k of a string's q-grams, so among
  its q * k + 1 rarest there is one that survives (prefix filter). Strings with no more grams than that keep all.
* Token sets with a Jaccard similarity of t: one of the n - t * n + 1 rarest of a set's n tokens is shared.
* Lengths alone rule out pairs for the Levenshtein, Jaro, LCS and Hamming families.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.ngrams import extract_ngrams
from kindred.functions.registry import Algorithm, Scorer, lengths_allow, resolve, scorer


#: Up to so many distinct values on both sides are compared outright.
FEW, FEW_BYTES = 5000, 4 << 20


@dataclass(frozen=True)
class Field:
    """A pair of columns that are compared, how, and with what weight."""

    left: str
    right: str
    algorithm: str | Algorithm | Scorer = "jaro_winkler"
    weight: float = 1.0
    ngram_size: int = 3
    #: length of the grams that candidates share; 0: words split by ``separator``
    gate: int = 2
    separator: str = ","

    def grams(self, value: Column) -> Column:
        if self.gate == 0:
            return tokens(value, self.separator)
        return F.array_distinct(extract_ngrams(value, self.gate, False))

    def score(self, a: Column, b: Column) -> Column:
        if self.gate == 0:
            x, y = tokens(a, self.separator), tokens(b, self.separator)
            both = F.size(F.array_intersect(x, y))
            union = F.size(x) + F.size(y) - both
            return F.when(union == 0, F.lit(1.0)).otherwise(both / union)
        return scorer(self.algorithm, self.ngram_size)(a, b)

    @property
    def name(self) -> str | None:
        named = isinstance(self.algorithm, (str, Algorithm))
        return resolve(self.algorithm) if named and self.gate else None


def tokens(value: Column, separator: str) -> Column:
    """Distinct parts, trimmed and lower-cased, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(value, "\\Q" + separator + "\\E"), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def distinct_values(df: DataFrame, column: str, into: str) -> DataFrame:
    return df.select(F.col(column).alias(into)).where(F.col(into).isNotNull()).distinct()


def by_grams(left: DataFrame, right: DataFrame, field: Field) -> DataFrame:
    """``lv, rv``: distinct values that share a gram."""
    x = left.select("lv", F.explode(field.grams(F.col("lv"))).alias("gram"))
    y = right.select("rv", F.explode(field.grams(F.col("rv"))).alias("gram"))
    return x.join(y, "gram").select("lv", "rv").distinct()


def by_prefixes(left: DataFrame, right: DataFrame, field: Field, least: float) -> DataFrame:
    """As ``by_grams``, but for Levenshtein similarities of at least ``least`` only."""
    q = field.gate

    def occurrences(df: DataFrame, v: str) -> DataFrame:
        grams = df.select(v, F.posexplode(extract_ngrams(F.col(v), q, False)).alias("at", "g"))
        nth = F.row_number().over(Window.partitionBy(v, "g").orderBy("at"))
        return grams.withColumn("gram", F.struct("g", nth.alias("nth"))).select(v, "gram", F.length(v).alias("n"))

    x, y = occurrences(left, "lv"), occurrences(right, "rv")
    # how common a gram is, on both sides together, orders the grams: rarest first
    common = x.select("gram").unionAll(y.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(df: DataFrame, v: str) -> DataFrame:
        # the longest partner has n / least characters, so this many edits at most
        k = F.floor((1 - least) * F.floor(F.col("n") / least + 1e-9) + 1e-9)
        ranked = df.join(common, "gram").withColumn("rank", F.row_number().over(Window.partitionBy(v).orderBy("df", "gram")))
        grams = F.greatest(F.col("n") - (q - 1), F.lit(0))
        return ranked.withColumn("short", grams <= q * k).withColumn("head", F.col("rank") <= q * k + 1)

    a, b = prefixes(x, "lv"), prefixes(y, "rv")
    heads = a.where("head and not short").select("lv", "gram").join(b.where("head and not short").select("rv", "gram"), "gram")
    # a short string may keep any of its grams only: it meets all grams of the other side
    left_short = a.where("short").select("lv", F.col("gram.g").alias("g")).distinct().join(b.select("rv", F.col("gram.g").alias("g")).distinct(), "g")
    right_short = b.where("short").select("rv", F.col("gram.g").alias("g")).distinct().join(a.select("lv", F.col("gram.g").alias("g")).distinct(), "g")
    return heads.select("lv", "rv").unionByName(left_short.select("lv", "rv")).unionByName(right_short.select("lv", "rv")).distinct()


def by_rare_tokens(left: DataFrame, right: DataFrame, field: Field, least: float) -> DataFrame:
    """As ``by_grams``, but for Jaccard similarities of the tokens of at least ``least`` only.

    Sets of n tokens share ``least * n`` of them, so one of the ``n - least * n + 1`` rarest of each side is shared.
    """
    x = left.select("lv", F.explode(field.grams(F.col("lv"))).alias("gram"))
    y = right.select("rv", F.explode(field.grams(F.col("rv"))).alias("gram"))
    common = x.select("gram").unionAll(y.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def heads(df: DataFrame, v: str) -> DataFrame:
        each = Window.partitionBy(v)
        ranked = df.join(common, "gram").withColumn("rank", F.row_number().over(each.orderBy("df", "gram"))).withColumn("n", F.count(F.lit(1)).over(each))
        return ranked.where(F.col("rank") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select(v, "gram")

    return heads(x, "lv").join(heads(y, "rv"), "gram").select("lv", "rv").distinct()


def few(values: DataFrame, column: str) -> bool:
    """Whether there are at most FEW values of at most FEW_BYTES; stops counting beyond that."""
    n, size = values.limit(FEW + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return n <= FEW and (size or 0) <= FEW_BYTES


def all_cores(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores: a side of a nested loop, which a small table would leave in one task. Either may be the one that is broadcast."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def score_within(field: Field, least: float) -> Column:
    """The score of ``lv`` and ``rv``; Levenshtein stops at the distance that ``least`` allows, and is then null."""
    if field.name == "levenshtein" and least > 0:
        longest = F.greatest(F.length("lv"), F.length("rv"))
        d = F.expr(f"levenshtein(lv, rv, cast(floor((1 - {least!r}D) * greatest(length(lv), length(rv)) + 1e-9D) as int))")
        return F.when(longest == 0, F.lit(1.0)).when(d >= 0, 1.0 - d / longest)
    return field.score(F.col("lv"), F.col("rv"))


def value_scores(left: DataFrame, right: DataFrame, field: Field, least: float, gated: bool = True) -> DataFrame:
    """``lv, rv, s`` of distinct candidate values with a similarity of at least ``least``.

    Few values on both sides are compared by a nested loop, the right side in memory; the result is the same.
    """
    cheap = lengths_allow(field.algorithm, least, F.col("lv"), F.col("rv")) if field.gate and least > 0 else None
    close = F.lit(True) if cheap is None else cheap
    # a bounded Levenshtein distance is cheaper than what comes after it, other scores aren't
    first = score_within(field, least) >= least if field.name == "levenshtein" and least > 0 else F.lit(True)
    if not gated:
        pairs = all_cores(left).join(all_cores(right), close & first)
    elif few(left, "lv") and few(right, "rv"):
        x, y = left.withColumn("lg", field.grams(F.col("lv"))), right.withColumn("rg", field.grams(F.col("rv")))
        # the size has just been checked
        pairs = all_cores(x).join(F.broadcast(y), close & first & F.arrays_overlap("lg", "rg")).select("lv", "rv")
    elif field.name == "levenshtein" and least >= 0.5:
        pairs = by_prefixes(left, right, field, least).where(close)
    elif field.gate == 0 and least > 0:
        pairs = by_rare_tokens(left, right, field, least)
    else:
        pairs = by_grams(left, right, field).where(close)
    scored = pairs.withColumn("s", score_within(field, least))
    return scored.where(F.col("s") >= least) if least > 0 else scored.where(F.col("s").isNotNull())


def pair_scores(left: DataFrame, right: DataFrame, fields: list[Field], min_score: float = 0.0, min_field: float = 0.0, scoring: str = "weighted_average", gated: bool = True, once: bool = False) -> DataFrame:
    """``lid, rid, score`` of candidate rows: the weighted mean over the fields in which a pair is a candidate.

    ``left`` has ``lid``, ``right`` has ``rid``, both the fields' columns. A field in which a pair is no candidate, or
    scores below ``min_field``, is left out of its mean. ``once``: only pairs with lid < rid.
    """
    found = None
    single = len(fields) == 1 and scoring == "weighted_average"
    for k, f in enumerate(fields):
        x, y = left.select("lid", F.col(f.left).alias("lv")), right.select("rid", F.col(f.right).alias("rv"))
        least = max(min_field, min_score) if single else min_field
        scores = value_scores(distinct_values(x, "lv", "lv"), distinct_values(y, "rv", "rv"), f, least, gated)
        rows = x.join(scores, "lv").join(y, "rv")
        if once:
            rows = rows.where("lid < rid")
        part = rows.select("lid", "rid", F.lit(float(f.weight)).alias("w"), "s", F.lit(k).alias("field"))
        found = part if found is None else found.unionByName(part)
    if single:
        mean = F.col("s") if fields[0].weight > 0 else F.lit(0.0)
        return found.select("lid", "rid", mean.alias("score")).where(F.col("score") >= min_score)
    weight, total = F.sum("w"), F.sum(F.col("w") * F.col("s"))
    if scoring == "minmax_scaling":
        sums = found.groupBy("lid", "rid").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), weight.alias("w"), total.alias("ws"))
        spread = F.col("hi") - F.col("lo")
        rule = F.when(spread < 1e-10, F.col("ws") / F.col("w")).otherwise((F.col("ws") - F.col("lo") * F.col("w")) / spread / F.col("w"))
        score = F.when(F.col("w") > 0, rule).otherwise(F.lit(0.0))
    else:
        sums = found.groupBy("lid", "rid").agg(weight.alias("w"), total.alias("ws"))
        score = F.when(F.col("w") > 0, F.col("ws") / F.col("w")).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return sums.select("lid", "rid", score.alias("score")).where(F.col("score") >= min_score)


def best_of(pairs: DataFrame, by: str, other: str, top: int = 1) -> DataFrame:
    """The ``top`` best ``other`` for each ``by``; of equal scores the smaller id."""
    if top == 1:
        return pairs.groupBy(by).agg(F.max(F.struct("score", (-F.col(other)).alias("neg"))).alias("b")).select(by, (-F.col("b.neg")).alias(other), F.col("b.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), other))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
