"""How good a set of pairs is against the true one. Pairs have no direction and count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.errors import ValidationError


def undirected(pairs: DataFrame) -> DataFrame:
    a, b = (F.col(c) for c in pairs.columns[:2])
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def confusion_matrix(true: DataFrame, predicted: DataFrame, total_pairs: int | None = None, beta: float = 1.0) -> DataFrame:
    """One row: ``tp, fp, fn, tn, precision, recall, f_score``. ``tn`` needs ``total_pairs`` and isn't below 0.

    Without true and predicted pairs precision and recall are 1; with only one of them, 0.
    """
    if beta < 0:
        raise ValidationError("beta isn't negative")
    t, p = undirected(true).withColumn("t", F.lit(1)), undirected(predicted).withColumn("p", F.lit(1))
    both = t.join(p, ["a", "b"], "full_outer")
    count = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), 1).otherwise(0)), F.lit(0)).cast("long")
    sums = both.agg(count("t = 1 and p = 1").alias("tp"), count("t is null").alias("fp"), count("p is null").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda part: F.when(tp + fp + fn == 0, F.lit(1.0)).when(tp + part == 0, F.lit(0.0)).otherwise(tp / (tp + part))
    tn = F.lit(None).cast("long") if total_pairs is None else F.greatest(F.lit(0), F.lit(total_pairs) - tp - fp - fn).cast("long")
    out = sums.withColumn("tn", tn).withColumn("precision", share(fp)).withColumn("recall", share(fn))
    b2 = float(beta) ** 2
    bottom = b2 * F.col("precision") + F.col("recall")
    return out.withColumn("f_score", F.when(bottom == 0, F.lit(0.0)).otherwise((1 + b2) * F.col("precision") * F.col("recall") / bottom))


def precision(true: DataFrame, predicted: DataFrame) -> float:
    return confusion_matrix(true, predicted).first()["precision"]


def recall(true: DataFrame, predicted: DataFrame) -> float:
    return confusion_matrix(true, predicted).first()["recall"]


def f_score(true: DataFrame, predicted: DataFrame, beta: float = 1.0) -> float:
    return confusion_matrix(true, predicted, beta=beta).first()["f_score"]
