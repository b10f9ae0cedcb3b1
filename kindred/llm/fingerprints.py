"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.

A section ends at an empty line, a paragraph at a line end, a clause at punctuation or after 32 characters.
A clause's node is the digest of its text, each other node the digest of its children's nodes, the root the
fingerprint. Cuts lose no character, so equal roots mean equal texts. Where roots differ, only differing
branches are descended: equal sections, then equal paragraphs at both ends are left aside, what is between
them holds the edit. The likeness of two trees is the Dice coefficient of their clauses, each as often as it
occurs; those in equal branches are shared without being looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import blocks_for, table, text_of

SECTION, PARAGRAPH, CLAUSE = r"(?<=\n\n)", r"(?<=\n)", r"(?s).{1,32}?(?:[.!?,;:]\s|\n|\z)|.{1,32}"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def inner(level: str, children: Column) -> Column:
    """The node above some nodes; levels are told apart."""
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def tree_of(text: Column) -> Column:
    """array<struct<node, size, paragraphs array<struct<node, size, clauses array<string>>>>>; sizes in clauses."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda c: F.sha2(c, 256))
        return let(leaves, lambda x: F.struct(inner("p", x).alias("node"), F.size(x).alias("size"), x.alias("clauses")))

    def section(s: Column) -> Column:
        return let(F.transform(F.split(s, PARAGRAPH), paragraph), lambda x: F.struct(inner("s", nodes(x)).alias("node"), clauses(x).alias("size"), x.alias("paragraphs")))

    return F.transform(F.split(text, SECTION), section)


def nodes(parts: Column) -> Column:
    return F.transform(parts, lambda x: x["node"])


def clauses(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, x: n + x["size"])


def root(tree: Column) -> Column:
    return inner("r", nodes(tree))


def equal_ends(a: Column, b: Column) -> Column:
    """struct(before, after): how many entries of two arrays of parts are equal at the beginning, and how many of the others at the end."""

    def run(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: ~p["node"].eqNullSafe(q["node"])), True).cast("int")
        return F.when(at == 0, F.size(x)).otherwise(at - 1)

    both = F.struct(run(a, b).alias("before"), run(F.reverse(a), F.reverse(b)).alias("back"))
    return let(both, lambda r: F.struct(r["before"].alias("before"), F.least(r["back"], F.least(F.size(a), F.size(b)) - r["before"]).alias("after")))


def between(parts: Column, ends: Column) -> Column:
    return F.slice(parts, ends["before"] + 1, F.size(parts) - ends["before"] - ends["after"])


def differing(a: Column, b: Column) -> Column:
    """struct(section, paragraph, a, b): the 1-based first differing section and paragraph in it (0: none), and the clauses of the differing branches."""

    def below(x: Column, name: str) -> Column:
        return F.flatten(F.transform(x, lambda p: p[name]))

    def in_sections(ends: Column) -> Column:
        pair = F.struct(between(a, ends).alias("a"), between(b, ends).alias("b"))
        same = (F.size(a) == F.size(b)) & (ends["before"] == F.size(a))
        return let(pair, lambda m: let(F.struct(below(m["a"], "paragraphs").alias("a"), below(m["b"], "paragraphs").alias("b")), lambda p: in_paragraphs(ends, same, p)))

    def in_paragraphs(above: Column, same: Column, p: Column) -> Column:
        return let(
            equal_ends(p["a"], p["b"]),
            lambda ends: F.struct(
                F.when(same, 0).otherwise(above["before"] + 1).alias("section"),
                F.when(same, 0).otherwise(ends["before"] + 1).alias("paragraph"),
                below(between(p["a"], ends), "clauses").alias("a"),
                below(between(p["b"], ends), "clauses").alias("b"),
            ),
        )

    return let(equal_ends(a, b), in_sections)


def shared(a: Column, b: Column) -> Column:
    """How many entries two arrays share, each as often as it occurs in both."""

    def step(acc: Column, _: Column, x: Column, y: Column) -> Column:
        p, q = F.get(x, acc["i"]), F.get(y, acc["j"])
        done = p.isNull() | q.isNull()
        move = F.struct((acc["i"] + (p <= q).cast("int")).alias("i"), (acc["j"] + (q <= p).cast("int")).alias("j"), (acc["n"] + (p == q).cast("int")).alias("n"))
        return F.when(done, acc).otherwise(move)

    def merged(s: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.size(s["a"]) + F.size(s["b"]) + 1), zero, lambda acc, k: step(acc, k, s["a"], s["b"]))["n"]

    # without repeats on one side each shared entry counts once
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(once, F.size(F.array_intersect(a, b))).otherwise(let(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")), merged))


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """The Dice coefficient of the clauses of two trees that differ in ``apart``; 1 if neither has any."""
    total = clauses(a) + clauses(b)
    same = clauses(a) - F.size(apart["a"]) + shared(apart["a"], apart["b"])
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * same / total)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tree`` and ``fingerprint`` (the root) to ``docs``. A null text is an empty text."""
    return docs.withColumn("tree", tree_of(text_of(text))).withColumn("fingerprint", root(F.col("tree")))


def block_of(value: Column, splits: list[int]) -> Column:
    """How many of the sorted ``splits`` are at most ``value``, by binary search."""
    if not splits:
        return F.lit(0)
    known, n = F.array(*[F.lit(s).cast("long") for s in splits]), len(splits)
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(powers, F.lit(0), lambda at, k: F.when((at + k <= n) & (F.get(known, at + k - 1) <= value), at + k).otherwise(at))


def keys_of(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` blocks that Spark's hash partitioning deals to a partition of its own among ``n``."""
    found = spark.range(40 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    at = {r["at"]: r["id"] for r in found}
    return [at.get(k, 40 * n + k) for k in range(n)]


def with_next(docs: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, t, next_t``: each row with the next in ascending doc_id, the last with the first.

    Quantiles of doc_id cut the rows into blocks of about ``block_bytes``, a partition each; inside them a window
    finds the next row. Each block also gets the first row of the next one, as its last. Texts move once.
    Null ids come first; rows that share an id are ordered by their texts' digest.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").alias("id"), text_of().alias("t"))
    total = ids.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = blocks_for(total, block_bytes)
    cuts = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0] or []
    splits, keys = sorted(set(cuts)), keys_of(spark, n)
    block = F.coalesce(block_of(F.col("id"), splits), F.lit(0))
    starts = sorted((r.block, None if r.none else r.id) for r in ids.groupBy(block.alias("block")).agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none")).collect())
    # one row a block: where the block that follows begins
    after = spark.createDataFrame([(b, starts[(k + 1) % len(starts)][1]) for k, (b, _) in enumerate(starts)], "block int, head long")
    first = {i for _, i in starts}
    is_first = F.col("id").isin(sorted(i for i in first if i is not None)) | (F.col("id").isNull() if None in first else F.lit(False))
    heads = ids.where(is_first).groupBy("id").agg(F.min_by("t", F.sha2("t", 256)).alias("t"))
    ends = after.join(heads, F.col("head").eqNullSafe(F.col("id"))).select("block", "id", "t", F.lit(True).alias("end"))
    every = ids.select(block.alias("block"), "id", "t", F.lit(False).alias("end")).unionByName(ends)
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("block") + 1)
    dealt = every.select(key.alias("key"), "id", "t", "end", F.sha2("t", 256).alias("sha")).repartition(n, "key")
    led = dealt.withColumn("next_t", F.lead("t").over(Window.partitionBy("key").orderBy("end", "id", "sha")))
    return led.where("not end").select(F.col("id").alias("doc_id"), "t", "next_t")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints each text and the text whose second half is replaced by the beginning of the next document.

    One row per input row. Null texts are empty; an empty table gives an empty result; a single row is
    its own next one. Extra columns are ignored.
    """
    pairs = with_next(docs.select("doc_id", "text"))
    edited = pairs.withColumn("e", F.concat(F.expr("left(t, length(t) - length(t) div 2)"), F.expr("left(next_t, cast(length(t) div 2 as int))")))
    trees = edited.withColumns({"tree": tree_of(F.col("t")), "edited_tree": tree_of(F.col("e")), "next_tree": tree_of(F.col("next_t"))})
    apart = trees.withColumns({"apart": differing(F.col("tree"), F.col("edited_tree")), "from_next": differing(F.col("tree"), F.col("next_tree"))})
    return apart.select(
        "doc_id",
        F.length("t").cast("long").alias("n_chars"),
        F.sha2("e", 256).alias("edited_sha256"),
        root(F.col("tree")).alias("fingerprint"),
        root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree"), F.col("apart")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree"), F.col("from_next")).alias("near_next"),
        F.col("apart.section").alias("edit_section"),
        F.col("apart.paragraph").alias("edit_paragraph"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
