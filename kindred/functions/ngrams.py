"""Character n-grams, common subsequences and substrings, cosine similarities. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.errors import check_positive
from kindred.functions import batches, kernels
from kindred.functions.normalize import normalize_pair, words
from kindred.functions.vectorised import pair_udf, text_udf

#: The largest n.
MOST = 32


def extract_ngrams(s: Column, ngram_size: int = 3, pad: bool = True) -> Column:
    """All n-grams in order; padding puts n - 1 spaces at both ends."""
    n = min(MOST, check_positive(ngram_size, "ngram_size"))
    padded = F.concat(F.lit(" " * (n - 1)), s, F.lit(" " * (n - 1))) if pad else s
    some = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(padded) >= n, some).when(s.isNotNull(), F.array().cast("array<string>"))


def shared_share(a: Column, b: Column, both: Column, rule) -> Column:
    """``rule`` where both sets have something; 1 if both are empty and 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(rule)


def gram_sets(a: Column, b: Column, n: int, pad: bool) -> tuple[Column, Column]:
    return F.array_distinct(extract_ngrams(a, n, pad)), F.array_distinct(extract_ngrams(b, n, pad))


def ngram_similarity(a: Column, b: Column, ngram_size: int = 3, pad: bool = True, normalize: str | None = None) -> Column:
    """Dice coefficient of the gram sets; equal strings are 1."""
    a, b = normalize_pair(a, b, normalize)
    x, y = gram_sets(a, b, ngram_size, pad)
    return F.when(a == b, F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), shared_share(x, y, x, 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))))


def ngram_jaccard(a: Column, b: Column, ngram_size: int = 3, pad: bool = True, normalize: str | None = None) -> Column:
    a, b = normalize_pair(a, b, normalize)
    x, y = gram_sets(a, b, ngram_size, pad)
    both = F.size(F.array_intersect(x, y))
    return F.when(a.isNotNull() & b.isNotNull(), shared_share(x, y, both, both / (F.size(x) + F.size(y) - both)))


def bigram_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    return ngram_similarity(a, b, 2, True, normalize)


def trigram_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    return ngram_similarity(a, b, 3, True, normalize)


def times(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def ngram_profile_similarity(a: Column, b: Column, ngram_size: int = 3) -> Column:
    """Multiset Jaccard of the padded grams: shared occurrences over all."""
    x, y = extract_ngrams(a, ngram_size), extract_ngrams(b, ngram_size)
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(times(x, g), times(y, g)))
    return F.when(a.isNotNull() & b.isNotNull(), shared_share(x, y, both, both / (F.size(x) + F.size(y) - both)))


def cosine(x: Column, y: Column) -> Column:
    """Of the frequencies of two lists' items."""
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda n, g: n + times(x, g) * times(y, g))
    norm = lambda z: F.sqrt(F.aggregate(F.array_distinct(z), F.lit(0.0), lambda n, g: n + times(z, g) * times(z, g)))
    return shared_share(x, y, dot, F.least(F.lit(1.0), dot / (norm(x) * norm(y))))


def cosine_similarity_chars(a: Column, b: Column, normalize: str | None = None) -> Column:
    a, b = normalize_pair(a, b, normalize)
    letters = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    return F.when(a == b, F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), cosine(letters(a), letters(b)))


def cosine_similarity_words(a: Column, b: Column) -> Column:
    """Over lower-cased words."""
    return F.when(a.isNotNull() & b.isNotNull(), cosine(words(F.lower(a)), words(F.lower(b))))


def cosine_similarity_ngrams(a: Column, b: Column, ngram_size: int = 3) -> Column:
    """Over padded grams; 0 for grams of no letters."""
    if ngram_size == 0:
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), cosine(extract_ngrams(a, ngram_size), extract_ngrams(b, ngram_size)))


def lcs_length(a: Column, b: Column) -> Column:
    return text_udf(kernels.lcs_length, "int")(a, b)


def lcs_string(a: Column, b: Column) -> Column:
    return text_udf(kernels.lcs_string, "string")(a, b)


def lcs_share(a: Column, b: Column, rule) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(rule(lcs_length(a, b), x, y))


def lcs_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    return lcs_share(*normalize_pair(a, b, normalize), lambda n, x, y: 2.0 * n / (x + y))


def lcs_similarity_max(a: Column, b: Column) -> Column:
    return lcs_share(a, b, lambda n, x, y: n / F.greatest(x, y))


def longest_common_substring(a: Column, b: Column) -> Column:
    return pair_udf(batches.substrings, "string")(a, b)


def longest_common_substring_length(a: Column, b: Column) -> Column:
    return F.length(longest_common_substring(a, b))


class TfIdfCosine:
    """Cosine similarity of tf-idf vectors over a corpus of documents, itself a DataFrame.

    tf is a word's share of its document, idf is ln((N + 1) / (df + 1)) + 1, and 1 for unknown words.
    """

    def __init__(self, documents: DataFrame | None = None, text: str = "text"):
        self.documents, self.text = documents, text

    def add_documents(self, documents: DataFrame) -> TfIdfCosine:
        """A corpus with more documents; nothing is changed in place."""
        more = documents.select(F.col(self.text))
        return TfIdfCosine(more if self.documents is None else self.documents.select(self.text).unionByName(more), self.text)

    add_document = add_documents

    def num_documents(self) -> int:
        return 0 if self.documents is None else self.documents.count()

    def similarity(self, pairs: DataFrame, key: str, a: str, b: str, into: str = "score") -> DataFrame:
        """``pairs`` with the similarity of columns ``a`` and ``b``; ``key`` tells the pairs apart.

        Words, not texts, are joined with their document frequencies, so nothing has to be broadcast.
        """
        side = lambda c: F.when(F.col(c).isNotNull(), words(F.lower(F.col(c))))
        each = pairs.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), side(a).alias("w")), F.struct(F.lit(1).alias("side"), side(b).alias("w")))).alias("s")).select(key, "s.side", "s.w")
        terms = each.select(key, "side", F.size("w").alias("n"), F.explode("w").alias("word")).groupBy(key, "side", "n", "word").agg(F.count(F.lit(1)).alias("times"))
        total = self.num_documents()
        if self.documents is None:
            weighed = terms.withColumn("idf", F.lit(1.0))
        else:
            df = self.documents.select(F.explode(F.array_distinct(words(F.lower(F.col(self.text))))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
            weighed = terms.join(df, "word", "left").withColumn("idf", F.when(F.col("df").isNull(), F.lit(1.0)).otherwise(F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0))
        weighed = weighed.withColumn("x", F.col("times") / F.col("n") * F.col("idf"))
        one = weighed.groupBy(key, "word").agg(F.sum(F.when(F.col("side") == 0, F.col("x"))).alias("xa"), F.sum(F.when(F.col("side") == 1, F.col("x"))).alias("xb"))
        sums = one.groupBy(key).agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"), F.sqrt(F.sum(F.col("xa") ** 2)).alias("na"), F.sqrt(F.sum(F.col("xb") ** 2)).alias("nb"))
        empty = (F.coalesce(F.size(side(a)), F.lit(0)) == 0) & (F.coalesce(F.size(side(b)), F.lit(0)) == 0)
        score = F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(None).cast("double")).when(empty, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0))))
        return pairs.join(sums, key, "left").withColumn(into, score).drop("dot", "na", "nb")
