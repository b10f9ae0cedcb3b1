"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where its own content says so, each chunk becomes an identifier that
is verified by SHA-256, and two texts are equal when their ordered identifier
lists are. Only digests move between executors; no text is ever shuffled, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import join_counted, mark, mark_of_row, spool, table, text_of, with_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the built-in ``lower``, which is the same there and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends at a line end or at a word whose last letters are a vowel and one of b-g, but is never
    shorter than ``least`` (except a text's last) nor longer than ``most`` characters."""
    return rf"(?s).{{{least},{most}}}?(?:\n|[aeiou][b-g]\s)|.{{1,{most}}}"


def recipes(docs: DataFrame, least: int = 512, most: int = 8192, hash_of: Callable[[Column], Column] = F.xxhash64, marked: Column | None = None) -> DataFrame:
    """``row`` (number of the input row), ``doc_id``, ``mark``, ``text_sha256`` and ``recipe``, the ordered list of verified chunk identifiers.

    ``hash_of`` names the chunks. Names are verified by SHA-256: chunks are deduplicated to pairs of name and
    digest, and where a name has several digests, those go into the identifier.
    """
    norm = docs.select("doc_id", (mark() if marked is None else marked).alias("mark"), normalise(text_of()).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0))
    cut = spool(
        norm.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "mark",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks, lambda c: F.struct(hash_of(c).cast("long").alias("h"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("chunks"),
        ),
        "chunks",
    )
    distinct = cut.select(F.explode("chunks").alias("c")).select("c.h", "c.sha").distinct()
    # names that several chunks have; 64 bits give about 300 of them among 10^11 chunks
    shared = spool(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("h"), "shared")
    plain = F.transform("chunks", lambda c: F.hex(c["h"]))
    if shared.isEmpty():
        return cut.select("row", "doc_id", "mark", "text_sha256", plain.alias("recipe"))
    # only the chunks that have such a name move
    each = cut.select("row", F.posexplode("chunks").alias("at", "c")).select("row", "at", "c.h", "c.sha")
    longer = each.join(shared, "h").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", F.hex("sha").alias("sha")))).alias("more"))
    named = F.transform("chunks", lambda c, k: F.concat(F.hex(c["h"]), F.coalesce(F.concat(F.lit("-"), F.try_element_at("more", k)), F.lit(""))))
    return cut.join(longer, "row", "left").select("row", "doc_id", "mark", "text_sha256", F.when(F.col("more").isNull(), plain).otherwise(named).alias("recipe"))


def exact_dedup(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64, marked: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``mark`` (``marked``, by default a hash of id and text).

    Texts are equal when their recipes are (lists are compared by their SHA-256); ``text_sha256`` is only returned.
    Null texts are empty texts. Of equal texts the largest doc_id stays, of several rows with that doc_id the one
    with the largest mark, of rows that also share the mark any one; a null doc_id is smaller than any other. An
    empty table gives an empty result. Extra columns are ignored.
    """
    lists = recipes(docs, hash_of=hash_of, marked=marked)
    lists = spool(lists.select("row", "doc_id", "mark", "text_sha256", F.unhex(F.sha2(F.array_join("recipe", ","), 256)).alias("list")), "lists")
    groups = spool(lists.groupBy("list").agg(F.max(F.struct("doc_id", "mark", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return join_counted(lists, groups, "list", "group_size").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "mark",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay."""
    row = mark_of_row(docs)
    return with_rows(docs, exact_dedup(docs, marked=row).where("kept").select("doc_id", "mark", F.lit(1).alias("times")), row)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("mark")


OP6_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
