"""Indexes: tables of entries that are searched by joins and stored as Parquet.

DataFrames don't change, so adding and removing give new indexes, no lock is needed, and batches of queries are
what a search takes. Ids are global and results are in order of score, whatever the number of partitions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.errors import IndexError_, ValidationError, check_distance, check_positive, check_similarity
from kindred.functions import edit
from kindred.functions.ngrams import extract_ngrams
from kindred.functions.registry import Algorithm, lengths_allow, resolve, scorer
from kindred.operators._arguments import Algo
from kindred.plans import near, shared_grams, similarity_join
from kindred.plans.scratch import with_row_ids
from kindred.plans.similarity_join import all_cores

#: The bounds of an edit index's radius as a FuzzyIndex.
LEAST_RADIUS, MOST_RADIUS = 2, 50


def entries(df: DataFrame, text: str, id_col: str | None, data: str | None) -> DataFrame:
    rows = with_row_ids(df, "id", id_col)
    return rows.select("id", F.col(text).cast("string").alias("text"), (F.col(data).cast("long") if data else F.lit(None).cast("long")).alias("data"))


def queries_of(queries: DataFrame, text: str, query_id: str | None) -> DataFrame:
    return with_row_ids(queries, "query_id", query_id).select("query_id", F.col(text).cast("string").alias("query")).where("query is not null")


def first_of(hits: DataFrame, limit: int | None, order: list) -> DataFrame:
    if limit is None:
        return hits
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= check_positive(limit, "limit")).drop("_rank")


class _Index:
    """What all indexes share: ``items`` (id, text, data) and options that are stored with them."""

    kind = "index"

    def __init__(self, items: DataFrame | None = None, text: str = "text", id_col: str | None = None, data: str | None = None, **options):
        self.options = options
        self.items = None if items is None else self.kept(entries(items, text, id_col, data))

    def kept(self, items: DataFrame) -> DataFrame:
        return items

    def like(self, items: DataFrame | None):
        out = object.__new__(type(self))
        out.options, out.items = self.options, items
        return out

    def add_all(self, items: DataFrame, text: str = "text", id_col: str | None = None, data: str | None = None):
        """An index with more items, numbered after those there are unless they bring ids."""
        new = entries(items, text, id_col, data)
        if self.items is None:
            return self.like(self.kept(new))
        if id_col is None:
            last = self.items.agg(F.max("id")).first()[0]
            new = new.withColumn("id", F.col("id") + (0 if last is None else last + 1))
        return self.like(self.kept(self.items.unionByName(new)))

    add_all_parallel = add_all

    def remove(self, ids: DataFrame | list[int]):
        """Without the items of these ids."""
        if isinstance(ids, DataFrame):
            return self.like(self.items.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_anti"))
        return self.like(self.items.where(~F.col("id").isin(list(ids))))

    def remove_text(self, text: str):
        return self.like(self.items.where(F.col("text") != text))

    def compact(self):
        """With ids 0, 1, 2, ... in the order of the old ones."""
        from kindred.plans.scratch import numbered

        return self.like(numbered(self.items.withColumnRenamed("id", "_old"), ["_old"], "id").select("id", "text", "data"))

    def contains(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """``queries`` whose text is in the index."""
        return queries.join(self.items.select(F.col("text").alias(text)).distinct(), text, "left_semi")

    def get_text(self, item_id: int) -> DataFrame:
        return self.items.where(F.col("id") == item_id).select("text")

    def get_items(self) -> DataFrame:
        return self.items

    def clear(self):
        return self.like(self.items.limit(0))

    def active_count(self) -> int:
        return 0 if self.items is None else self.items.count()

    __len__ = active_count

    def save(self, path: str) -> None:
        """Parquet at ``path``/items and the options, one JSON line, at ``path``/options."""
        codec = "zstd" if self.options.get("compressed") else "snappy"
        self.items.write.mode("overwrite").option("compression", codec).parquet(f"{path}/items")
        line = json.dumps({"kind": self.kind, "options": self.options})
        self.items.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        found = json.loads(spark.read.text(f"{path}/options").first()[0])
        if found["kind"] != cls.kind:
            raise IndexError_(f"{path} holds a {found['kind']} index, not a {cls.kind} one")
        out = object.__new__(cls)
        out.options, out.items = found["options"], spark.read.parquet(f"{path}/items")
        return out


class EditIndex(_Index):
    """Strings by edit distance. Of equal texts the first is kept."""

    kind = "edit"

    def __init__(self, items: DataFrame | None = None, use_damerau: bool = False, text: str = "text", id_col: str | None = None, data: str | None = None):
        super().__init__(items, text, id_col, data, use_damerau=use_damerau)

    def kept(self, items: DataFrame) -> DataFrame:
        least = items.groupBy("text").agg(F.min(F.struct("id", "data")).alias("x"))
        return least.where("text is not null").select("x.id", "text", "x.data")

    def within(self, queries: DataFrame, radius, lower: bool = False, limit: int | None = None, least: float | None = None) -> DataFrame:
        """``query_id, id, text, distance, score, data`` of the items within ``radius``, a number or a column over the query.

        ``radius`` None: the nearest, however far. ``least``: only such scores. With a ``limit`` what can't be among a
        query's best, by score if there is a ``least`` and else by distance, may be left out.

        Edit distances of short strings are found along tries of blocks. Else few strings on both sides are compared outright, by length first. Else a query meets the items that have one
        of its rarest bigrams: an edit changes two of them (a swap three), so more than the radius allows can't all be
        missing. Queries too short for that are compared with all items by length.
        """
        fold = F.lower if lower else (lambda c: c)
        q, items = queries.withColumn("_q", fold(F.col("query"))), self.items.withColumn("_t", fold(F.col("text")))
        n_items, longest = items.agg(F.count(F.lit(1)), F.max(F.length("_t"))).first()
        n_queries, longest_query = q.agg(F.count(F.lit(1)), F.max(F.length("_q"))).first()
        nearest, longest = radius is None, max(longest or 0, longest_query or 0)
        if nearest:
            radius = longest
        q = q.withColumn("_far", F.lit(radius) if isinstance(radius, int) else radius)
        if not self.options["use_damerau"] and longest <= near.LONGEST:
            a = items.select("id", F.col("_t").alias("t"), F.col("text").alias("s"), "data")
            b = q.select(F.col("query_id").alias("id"), F.col("_q").alias("t"), F.col("query").alias("s"), F.col("_far").alias("far"))
            return near.hits_within(a, b, n_items, n_queries, limit, least, nearest)
        close = F.abs(F.length("_q") - F.length("_t")) <= F.col("_far")
        if similarity_join.few(q, "_q") and similarity_join.few(items, "_t"):
            pairs = all_cores(items).join(all_cores(q), close)
        else:
            grams = items.select("id", F.explode(F.array_distinct(extract_ngrams(F.col("_t"), 2, False))).alias("gram"))
            common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
            q = q.withColumn("_g", F.array_distinct(extract_ngrams(F.col("_q"), 2, False))).withColumn("_need", (3 if self.options["use_damerau"] else 2) * F.col("_far") + 1)
            asked = q.where(F.size("_g") >= F.col("_need")).select("query_id", "_need", F.explode("_g").alias("gram")).join(common, "gram", "left")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))
            met = asked.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need")).select("query_id", "gram").join(grams, "gram").select("query_id", "id").distinct()
            pairs = met.join(items, "id").join(q, "query_id").where(close)
            pairs = pairs.unionByName(all_cores(items).join(q.where(F.size("_g") < F.col("_need")), close)).drop("_g", "_need")
        if self.options["use_damerau"]:
            pairs = pairs.withColumn("distance", edit.optimal_string_alignment(F.col("_q"), F.col("_t")))
        else:
            bound = radius if isinstance(radius, int) else None
            pairs = pairs.withColumn("distance", F.levenshtein("_q", "_t", bound) if bound is not None else F.levenshtein("_q", "_t"))
        hits = pairs.where((F.col("distance") >= 0) & (F.col("distance") <= F.col("_far")))
        hits = hits.select("query_id", "query", "id", "text", "distance", edit.per_length(F.col("distance"), F.col("_q"), F.col("_t")).alias("score"), "data")
        return hits if least is None else hits.where(F.col("score") >= least)

    def search(self, queries: DataFrame, max_distance: int | None = None, min_similarity: float | None = None, limit: int | None = None, normalize: str | None = None, text: str = "text", query_id: str | None = None) -> DataFrame:
        """By ``max_distance``, or by ``min_similarity``: within that share of the query's length. By distance, then id."""
        if (max_distance is None) == (min_similarity is None):
            raise ValidationError("give either max_distance or min_similarity")
        q, lower = queries_of(queries, text, query_id), normalize == "lowercase"
        if max_distance is not None:
            return first_of(self.within(q, check_distance(max_distance), lower, limit), limit, ["distance", "id"])
        t = check_similarity(min_similarity)
        return first_of(self.within(q, F.ceil((1.0 - t) * F.length("query")).cast("int"), lower, limit), limit, ["distance", "id"])

    batch_search = search_parallel = search

    def find_nearest(self, queries: DataFrame, limit: int = 1, text: str = "text", query_id: str | None = None) -> DataFrame:
        """The nearest items, however far."""
        return first_of(self.within(queries_of(queries, text, query_id), None, limit=check_positive(limit, "limit")), limit, ["distance", "id"])

    find_nearest_parallel = find_nearest


class NgramIndex(_Index):
    """Strings by the n-grams they share."""

    kind = "ngram"

    def __init__(self, items: DataFrame | None = None, ngram_size: int = 3, min_ngram_ratio: float = 0.2, normalize: bool = True, text: str = "text", id_col: str | None = None, data: str | None = None, **more):
        if check_positive(ngram_size, "ngram_size") < 2:
            raise ValidationError("ngram_size is 2 or more")
        super().__init__(items, text, id_col, data, ngram_size=ngram_size, min_ngram_ratio=check_similarity(min_ngram_ratio, "min_ngram_ratio"), normalize=normalize, **more)

    def grams(self, c):
        return F.array_distinct(extract_ngrams(F.lower(c) if self.options["normalize"] else c, self.options["ngram_size"], False))

    def get_candidates(self, queries: DataFrame, text: str = "text", query_id: str | None = None, min_shared: int | None = None) -> DataFrame:
        """``query_id, id, shared`` of items that share at least one gram, or the index's share of the query's grams."""
        return self._candidates(queries_of(queries, text, query_id), min_shared)

    def _candidates(self, queries: DataFrame, min_shared: int | None = None, compared=lambda c: c, **best) -> DataFrame:
        """The candidates, or those that ``best`` leaves (an algorithm, a least score and a limit) by scores of ``compared`` texts."""
        q = queries.withColumn("_g", self.grams(F.col("query"))).withColumn("n", F.size("_g"))
        least = F.lit(min_shared) if min_shared is not None else F.greatest(F.lit(1), F.ceil(F.lit(float(self.options["min_ngram_ratio"])) * F.col("n")))
        q = q.select("query_id", "query", "_g", least.alias("_least"), "n")
        known = self.items.where("text is not null")
        n_items, longest = known.agg(F.count(F.lit(1)), F.max(F.length("text"))).first()
        n_queries, longest_query = queries.agg(F.count(F.lit(1)), F.max(F.length("query"))).first()
        if max(longest or 0, longest_query or 0) <= near.LONGEST // 2:
            fold = F.lower if self.options["normalize"] else (lambda c: c)
            items = known.select("id", fold(F.col("text")).alias("t"), compared(F.col("text")).alias("s"), F.lit(None).cast("long").alias("data"))
            asked = q.select(F.col("query_id").alias("id"), fold(F.col("query")).alias("t"), compared(F.col("query")).alias("s"), F.col("_least").cast("int").alias("far"))
            return shared_grams.candidates(items, asked, n_items, n_queries, self.options["ngram_size"], **best)
        items = self.items.select("id", self.grams(F.col("text")).alias("_h"))
        grams = items.select("id", F.explode("_h").alias("gram"))
        # an item that shares _least of n grams shares one of the n - _least + 1 rarest: the commonest aren't joined
        common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        asked = q.select("query_id", "n", "_least", F.explode("_g").alias("gram")).join(common, "gram", "left")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))
        rare = asked.withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.col("_least") + 1) & F.col("df").isNotNull())
        met = rare.select("query_id", "gram").join(grams, "gram").select("query_id", "id").distinct()
        both = met.join(items, "id").join(q.drop("query"), "query_id").withColumn("shared", F.size(F.array_intersect("_g", "_h")).cast("long"))
        return both.where((F.col("shared") >= F.col("_least")) & (F.col("shared") > 0)).select("query_id", "id", "shared")

    def search(self, queries: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.0, limit: int | None = None, normalize: str | None = "lowercase", text: str = "text", query_id: str | None = None) -> DataFrame:
        """``query_id, query, id, text, score, data`` of candidates, scored as they are, or in lower case.

        Only scores of at least ``min_similarity``, and of the index's own if it has one.
        """
        t = max(check_similarity(min_similarity), self.options.get("min_similarity", 0.0))
        q = queries_of(queries, text, query_id)
        lower = normalize == "lowercase"
        a, b = (F.lower("query"), F.lower("text")) if lower else (F.col("query"), F.col("text"))
        name = resolve(algorithm) if isinstance(algorithm, (str, Algorithm)) else None
        best = {"algorithm": name, "least": t, "limit": limit if limit is None else check_positive(limit, "limit"), "alike": lower == bool(self.options["normalize"])}
        pairs = self._candidates(q, None, F.lower if lower else (lambda c: c), **best).join(self.items, "id").join(q, "query_id")
        cheap = lengths_allow(algorithm, t, a, b) if t > 0 else None
        pairs = pairs if cheap is None else pairs.where(cheap)
        hits = pairs.withColumn("score", scorer(algorithm)(a, b)).where(F.col("score") >= t)
        return first_of(hits.select("query_id", "query", "id", "text", "score", "data"), limit, [F.col("score").desc(), "id"])

    batch_search = search_parallel = search

    def find_nearest(self, queries: DataFrame, limit: int = 1, algorithm: Algo = "jaro_winkler", text: str = "text", query_id: str | None = None) -> DataFrame:
        return self.search(queries, algorithm, 0.0, limit, text=text, query_id=query_id)

    def compress(self):
        """The same index; entries are stored once each, and as Parquet pages with Zstandard when it is saved."""
        out = self.like(self.items)
        out.options = {**self.options, "compressed": True}
        return out

    def decompress(self):
        out = self.like(self.items)
        out.options = {k: v for k, v in self.options.items() if k != "compressed"}
        return out

    def is_compressed(self) -> bool:
        return bool(self.options.get("compressed"))

    def compression_stats(self) -> DataFrame:
        """One row: distinct grams and postings. Parquet and Spark's rows do the compressing."""
        return self.items.select(F.explode(self.grams(F.col("text"))).alias("gram")).agg(F.countDistinct("gram").alias("grams"), F.count("gram").alias("postings"))


class HybridIndex(NgramIndex):
    """The same as an n-gram index."""

    kind = "hybrid"


class ThreadSafeEditIndex(EditIndex):
    """Tables don't change, so every index may be shared between threads."""


class ThreadSafeNgramIndex(NgramIndex):
    """With defaults of its own: any shared gram makes a candidate, case counts unless ``case_insensitive``, and no
    search gives less than ``min_similarity``."""

    def __init__(self, items: DataFrame | None = None, ngram_size: int = 3, min_similarity: float = 0.0, min_ngram_ratio: float = 0.0, case_insensitive: bool = False, **more):
        super().__init__(items, ngram_size, min_ngram_ratio, case_insensitive, min_similarity=check_similarity(min_similarity), **more)


def spread(index: _Index, shards: int):
    index.options["num_shards"] = check_positive(shards, "num_shards")
    if index.items is not None:
        index.items = index.items.repartition(shards, "text")
    return index


def shard_distribution(index: _Index) -> DataFrame:
    """``shard, items``: how many items each shard holds."""
    return index.items.groupBy(F.pmod(F.hash("text"), F.lit(index.options["num_shards"])).alias("shard")).agg(F.count(F.lit(1)).alias("items"))


class ShardedEditIndex(EditIndex):
    """Items dealt to ``num_shards`` partitions by text; results are the same as without."""

    def __init__(self, items: DataFrame | None = None, num_shards: int = 8, use_damerau: bool = False, **more):
        super().__init__(items, use_damerau, **more)
        spread(self, num_shards)

    shard_distribution = shard_distribution


class ShardedNgramIndex(NgramIndex):
    """Items dealt to ``num_shards`` partitions by text; results are the same as without."""

    def __init__(self, items: DataFrame | None = None, num_shards: int = 8, **more):
        super().__init__(items, **more)
        spread(self, num_shards)

    shard_distribution = shard_distribution


class FuzzyIndex:
    """One face for the three kinds: ``algorithm`` is ngram, edit or hybrid."""

    KINDS = {"ngram": NgramIndex, "edit": EditIndex, "bktree": EditIndex, "hybrid": HybridIndex}

    def __init__(self, items: DataFrame, algorithm: str = "ngram", ngram_size: int = 3, text: str = "text", id_col: str | None = None):
        if algorithm not in self.KINDS:
            raise ValidationError(f"algorithm is one of {', '.join(self.KINDS)}, not {algorithm!r}")
        self.algorithm = "edit" if algorithm == "bktree" else algorithm
        options = {} if self.algorithm == "edit" else {"ngram_size": ngram_size}
        self.index = self.KINDS[algorithm](items, text=text, id_col=id_col, **options)

    @classmethod
    def from_dataframe(cls, df: DataFrame, column: str, algorithm: str = "ngram", ngram_size: int = 3, id_col: str | None = None) -> FuzzyIndex:
        return cls(df, algorithm, ngram_size, column, id_col)

    from_series = from_dataframe

    def search(self, queries: DataFrame, algorithm: Algo = "jaro_winkler", min_similarity: float = 0.0, limit: int | None = None, text: str = "text", query_id: str | None = None) -> DataFrame:
        if self.algorithm != "edit":
            return self.index.search(queries, algorithm, min_similarity, limit, text=text, query_id=query_id)
        t = check_similarity(min_similarity)
        # the radius follows from the longest item that can matter, three times the query's length at most
        longest = self.index.items.agg(F.max(F.length("text"))).first()[0] or 0
        radius = F.least(F.lit(MOST_RADIUS), F.greatest(F.lit(LEAST_RADIUS), F.floor((1.0 - t) * F.greatest(F.lit(longest), 3 * F.length("query"))).cast("int")))
        hits = self.index.within(queries_of(queries, text, query_id), radius, limit=limit, least=t)
        return first_of(hits, limit, [F.col("score").desc(), "id"])

    search_series = batch_search = search

    def get_items(self) -> DataFrame:
        return self.index.items

    def save(self, path: str) -> None:
        self.index.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FuzzyIndex:
        kind = json.loads(spark.read.text(f"{path}/options").first()[0])["kind"]
        out = object.__new__(cls)
        out.algorithm, out.index = kind, cls.KINDS[kind].load(spark, path)
        return out
