"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words. A document's expected number of copies is its source's target over
its source's size; the whole part is certain and the fractional parts are rounded together: two documents
meet, words are moved at random from one to the other until one of the two fractions is 0 or 1, and the
other goes on to meet the next. Blocks of documents do this side by side, what is left of each block meets
in blocks of the next level, up to one document a source, which a last draw rounds. That draw's error is less
than one document, so large documents settle first: the smaller ones of a source, as far as they have words to
spare, meet the large document that is left as one and share its error evenly, before they settle among
themselves. So a source misses its target by less than one of its small documents where it has enough of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import WORD, mark, mark_of_row, spool, table, text_of, with_rows
from kindred.plans.scratch import numbered

WEIGHTS, MOST = (5, 2, 1), 3
#: Documents that meet in one block of the reduction tree, on average.
FAN_IN = 512


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Raising one water level until the capped targets add up to all sizes is where resharing the excess again and
    again ends. Sources are numbered by range and the level rises by aggregates over whole numbers, so any number
    of sources will do.
    """
    sources = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "nth")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    sources = spool(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    total, open_ = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total / open_ if total else 0.0), None
    while total and level != before:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, open_ = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        level, before = (total - capped) / open_, level
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")).alias("target"))


def draw(seed: int, *what: Column) -> Column:
    """A number in [0, 1) that depends on its arguments only."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 52)) / F.lit(float(1 << 52))


def meet(a: Column, x: Column, seed: int) -> Column:
    """The fraction of ``a`` (what is left so far) and ``x`` after they have met, as struct(pa, px)."""
    up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
    down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
    raised = draw(seed, a["tie"], x["tie"]) * (up + down) < down
    # the one that becomes integral is set to 0 or 1 outright, so no rounding error is left on it
    a_up = F.when((1 - a["p"]) * a["size"] <= x["p"] * x["size"], F.struct(F.lit(1.0).alias("pa"), (x["p"] - up / x["size"]).alias("px"))).otherwise(F.struct((a["p"] + up / a["size"]).alias("pa"), F.lit(0.0).alias("px")))
    a_down = F.when(a["p"] * a["size"] <= (1 - x["p"]) * x["size"], F.struct(F.lit(0.0).alias("pa"), (x["p"] + down / x["size"]).alias("px"))).otherwise(F.struct((a["p"] - down / a["size"]).alias("pa"), F.lit(1.0).alias("px")))
    return F.when(raised, a_up).otherwise(a_down)


def settle(items: Column, seed: int) -> Column:
    """Lets the items of a block meet one after another: struct(left, done), where ``done`` has the rounded ones."""
    item = "struct<row:long,tie:long,size:double,p:double>"
    whole = lambda p: (p <= 0) | (p >= 1)

    def with_p(of: Column, p: Column) -> Column:
        return F.struct(of["row"].alias("row"), of["tie"].alias("tie"), of["size"].alias("size"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        def after(m: Column) -> Column:
            pa, px = m["pa"], m["px"]
            a, b = with_p(acc["left"], pa), with_p(x, px)
            left = F.when(~whole(px), b).when(~whole(pa), a)
            done = F.concat(acc["done"], F.filter(F.array(a, b), lambda y: whole(y["p"])))
            return F.struct(left.alias("left"), done.alias("done"))

        met = F.element_at(F.transform(F.array(meet(acc["left"], x, seed)), after), 1)
        return F.when(acc["left"].isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).otherwise(met)

    zero = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast(f"array<{item}>").alias("done"))
    return F.aggregate(items, zero, step)


def round_together(items: DataFrame, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``row, up`` for ``source, row, tie, size, p`` with 0 < p < 1: up is 1 where p is rounded up; and ``source, error``, the words that the last draws added."""
    decided, width = [], max(1, -(-rows // FAN_IN))
    items = items.withColumn("block", F.pmod(F.xxhash64("tie"), F.lit(width)))
    level = 0
    while True:
        met = items.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("rank"), "tie", "row", "size", "p"))).alias("all"))
        plain = F.transform("all", lambda x: F.struct(x["row"].alias("row"), x["tie"].alias("tie"), x["size"].alias("size"), x["p"].alias("p")))
        met = spool(met.select("source", "block", settle(plain, seed + level).alias("out")), f"level{level}")
        decided.append(met.select(F.explode("out.done").alias("d")).select("d.row", F.col("d.p").cast("int").alias("up")))
        left = met.where("out.left is not null").select("source", "block", "out.left.*")
        if width == 1:
            left = left.withColumn("up", (draw(seed - 1, F.col("tie")) < F.col("p")).cast("int"))
            return reduce(DataFrame.unionByName, decided, left.select("row", "up")), left.select("source", ((F.col("up") - F.col("p")) * F.col("size")).alias("error"))
        width = -(-width // FAN_IN)
        items = left.withColumn("block", F.pmod("block", F.lit(width)))
        level += 1


def turns_of(items: DataFrame) -> DataFrame:
    """``_s`` (source), ``first, second``: the sizes (powers of two) beyond which documents settle in the first turn and in the second.

    The documents up to such a size must be able to take up the error of any one above it, so that
    their fractions stay between 0 and 1. In a source that has too few of them all settle in the last turn.
    """
    tiers = items.groupBy("source", F.ceil(F.log2("size")).alias("power")).agg(F.sum(F.col("size") * F.least("p", 1 - F.col("p"))).alias("spare"), F.max(F.col("size") * F.greatest("p", 1 - F.col("p"))).alias("largest"))
    every = Window.partitionBy("source")
    tiers = tiers.withColumn("spare", F.sum("spare").over(every.orderBy("power"))).withColumn("all", F.max("largest").over(every))
    tiers = tiers.withColumn("first", F.coalesce(F.min(F.when(F.col("spare") >= F.col("all"), F.col("power"))).over(every), F.max("power").over(every)))
    tiers = tiers.withColumn("held", F.max(F.when(F.col("power") <= F.col("first"), F.col("largest"))).over(every))
    tiers = tiers.withColumn("second", F.coalesce(F.min(F.when(F.col("spare") >= F.col("held"), F.col("power"))).over(every), F.col("first")))
    return tiers.groupBy(F.col("source").alias("_s")).agg(F.min("first").alias("first"), F.min(F.least("first", "second")).alias("second"))


def in_turns(items: DataFrame, rows: int, seed: int) -> DataFrame:
    """``row, up`` as of ``round_together``, in three turns from large documents to small ones; each takes up the error of those before."""
    same = F.col("source").eqNullSafe(F.col("_s"))
    power = F.ceil(F.log2("size"))
    turn = F.when(power > F.col("first"), 0).when(power > F.col("second"), 1).otherwise(2)
    items = spool(items.join(turns_of(items), same).select(*items.columns, turn.alias("turn")), "items")
    ups, errors = [], None
    for k in range(3):
        now = items.where(F.col("turn") == k).drop("turn")
        if errors is not None:
            mass = now.groupBy("source").agg(F.sum("size").alias("mass"))
            shift = mass.join(errors.withColumnRenamed("source", "_s"), same).select("_s", (F.col("error") / F.col("mass")).alias("shift"))
            shifted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") - F.coalesce("shift", F.lit(0.0))))
            now = spool(now.join(shift, same, "left").withColumn("q", shifted).drop("_s", "shift"), f"turn{k}")
            errors = errors.unionByName(now.groupBy("source").agg(F.sum(F.col("size") * (F.col("q") - F.col("p"))).alias("error")))
            ups.append(now.where("q <= 0 or q >= 1").select("row", F.col("q").cast("int").alias("up")))
            now = now.where("q > 0 and q < 1").drop("p").withColumnRenamed("q", "p")
        got, error = round_together(now, rows, seed + 100 * k)
        ups.append(got)
        if k < 2:  # what is left of the errors goes to the next turn
            errors = spool((error if errors is None else errors.unionByName(error)).groupBy("source").agg(F.sum("error").alias("error")), f"error{k}")
    return reduce(DataFrame.unionByName, ups)


def among_equals(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: 0, 1, ... among rows that agree in ``same``.

    They are numbered inside each partition of the input, and those numbers offset by how many there are in the
    partitions before, so a row that is repeated very often is never brought to one task.
    """
    here = Window.partitionBy("same", "part")
    local = rows.withColumn("part", F.floor(F.col("row") / F.lit(1 << 33))).withColumn("copy", (F.row_number().over(here.orderBy("row")) - 1).cast("long")).withColumn("here", F.count(F.lit(1)).over(here))
    local = spool(local, "rows")
    before = F.sum("here").over(Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spool(local.where("copy = 0").select("same", "part", before.alias("before"), "here").where("before > 0"), "offsets")
    if offsets.isEmpty():
        return local.drop("part", "here")
    return spool(local.join(offsets.drop("here"), ["same", "part"], "left").withColumn("copy", F.col("copy") + F.coalesce("before", F.lit(0))).drop("part", "here", "before"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17, marked: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, ``copies`` and ``mark`` (``marked``, by default a hash of id and text) for each input row.

    Sources by code point, null last, get ``weights`` in turn. A null or wordless text has size 0 and
    takes nothing. Repeated rows are rounded each by itself. The same rows give the same result in any
    order; where rows that share id, text and source have different marks, their order tells which is taken. An empty table gives an empty result. Extra columns are ignored.
    """
    same = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", "source", F.col("source").isNull())
    kept = docs.select("doc_id", "text", "source", (mark() if marked is None else marked).alias("mark")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "mark", "source", same.alias("same"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")
    )
    rows = among_equals(kept)
    goal = spool(targets(rows, weights, most), "targets")
    joined = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select(rows["*"], "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rated = joined.withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base"))
    # ties are drawn by what a row is and which of its copies, not by its number, so that the order of the input doesn't matter
    items = rated.where("p > 0 and size > 0").select("source", "row", F.xxhash64("same", "copy").alias("tie"), F.col("size").cast("double").alias("size"), "p")
    ups = in_turns(items, rows.count(), seed)
    copies = (F.col("base") + F.coalesce("up", F.lit(0))).cast("long")
    return rated.join(ups, "row", "left").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")).alias("copies"), "mark")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, as often as each is taken."""
    row = mark_of_row(docs)
    return with_rows(docs, mix(docs, weights, most, seed, row).select("doc_id", "mark", F.col("copies").alias("times")), row)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("mark")
