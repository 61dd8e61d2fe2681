"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target number of words; a document of a source is taken target / size times on
average. The whole part is sure, the fraction is rounded: two fractional documents are paired, and
words are moved at random from one to the other until one of them is taken wholly or not at all.
The moves keep the pair's words and each document's expectation. What is left of the pair goes on.

Blocks of some 256 documents are folded in this way side by side; each leaves one fractional
document at most, and these meet in the blocks of the next level, up to one per source: the number
of levels grows with the logarithm of the rows, and no task folds more than a block. Documents above
1/512 of their source (fewer than 512 of them) are rounded first, in three classes of size, and the
fractions of all smaller ones make up for what that rounding added or left out; so a source with
many documents misses its target by one of the small ones at most.

Choices come from a hash of seed and row, so reruns agree. Null text has size 0 and is taken 0
times; null sources form a source of their own, last in order; rows that are equal in all columns
are rounded one by one, and any of them may get the extra copy. An empty table gives an empty
result. Only the columns ``doc_id``, ``text`` and ``source`` mean something; others are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placeshare.llm.common import WORD, stored

BLOCK = 256
#: a document is large if it has more than 1/512 of its source; classes of large documents end here
CLASSES = (8, 64, 512)
KEY = ["row_hash", "doc_id", "source", "size"]


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """From (source, source_size) to each source's ``target``: weight * level, at most ``most`` times its size.

    Sources are sorted by the level at which they reach their limit; the level at which all
    targets add up to ``share`` of all words follows from sums over that order. One row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / after)
        .withColumn("level", F.first(F.expr("if(level <= full_at, level, null)"), ignorenulls=True).over(everything))
        .select("source", "source_size", F.least("limit", F.col("weight") * F.coalesce("level", "full_at")).alias("target"))
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of whole rows in which nulls count, too: a hash of columns alone passes over them."""
    parts = []
    for field in docs.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0 ** -53)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, item_type: str, seed: int) -> Column:
    """One pass over an array of items: ``done`` with ``up`` 0 or 1, and the fractional ``left`` if any."""
    settled = lambda x, up: F.array(x.withField("mass", up.cast("double")))
    none = F.expr(f"cast(array() as array<{item_type}>)")

    def step(state, x):
        r, a, b = state["left"], state["left"]["mass"], x["mass"]
        room_a, room_b = r["size"] - a, x["size"] - b
        numbers = F.struct(
            F.least(a, room_b).alias("give"), F.least(b, room_a).alias("take"),
            _uniform(F.lit(seed), r["row_hash"], r["rep"], x["row_hash"], x["rep"]).alias("u"),
        )

        def moved(v):
            giving = v["u"] * (v["give"] + v["take"]) < v["take"]
            a_ends = F.when(giving, v["give"] == a).otherwise(v["take"] == room_a)
            b_ends = F.when(giving, v["give"] == room_b).otherwise(v["take"] == b)
            by = F.when(giving, -v["give"]).otherwise(v["take"])
            return F.struct(
                F.when(~a_ends, r.withField("mass", a + by)).when(~b_ends, x.withField("mass", b - by)).alias("left"),
                F.concat(
                    state["done"],
                    F.when(a_ends, settled(r, ~giving)).otherwise(none),
                    F.when(b_ends, settled(x, giving)).otherwise(none),
                ).alias("done"),
            )

        whole = (b <= 0) | (room_b <= 0)
        return (
            F.when(whole, F.struct(r.alias("left"), F.concat(state["done"], settled(x, b > 0)).alias("done")))
            .when(r.isNull(), F.struct(x.alias("left"), state["done"].alias("done")))
            .otherwise(_let(numbers, moved))
        )

    start = F.struct(F.expr(f"cast(null as {item_type})").alias("left"), none.alias("done"))
    return F.aggregate(items, start, step)


ITEM = "struct<size:bigint,row_hash:bigint,rep:bigint,doc_id:bigint,mass:double>"


def _listed(items: DataFrame, groups: list[str], **more: Column) -> DataFrame:
    """The items of each group as an array, larger documents first."""
    item = F.struct(
        F.col("size"), F.col("row_hash"), F.col("rep"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("mass"),
    )
    return items.groupBy(*groups).agg(
        F.sort_array(F.collect_list(item), asc=False).cast(f"array<{ITEM}>").alias("items"),
        *(c.alias(name) for name, c in more.items()),
    )


def _rounded(left: Column, seed: int) -> Column:
    """The last fractional document, taken with the probability that it has."""
    return (_uniform(F.lit(seed), F.lit("last"), left["row_hash"], left["rep"]) * left["size"] < left["mass"]).cast("double")


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))


def _large(items: DataFrame, seed: int) -> DataFrame:
    """Rounds the large documents of each source, from the largest class to the smallest.

    ``done`` holds the choices, ``extra`` the words taken beyond the documents' masses. Each class
    makes up for its share of what the classes before it took too much or too little.
    """
    rows = _listed(items, ["source"], source_size=F.first("source_size")).select(
        "*", F.lit(0.0).alias("extra"), F.col("source_size").cast("double").alias("rest"),
        F.expr(f"cast(array() as array<{ITEM}>)").alias("done"),
    )
    above = None
    for part in CLASSES:
        here = lambda x: (x["size"] * part > F.col("source_size")) & (  # noqa: E731, B023
            F.lit(True) if above is None else x["size"] * above <= F.col("source_size"))
        shift = F.coalesce(F.col("extra") / F.nullif("rest", F.lit(0.0)), F.lit(0.0))
        rows = rows.withColumn("plain", F.filter("items", here)).withColumn(
            "moved", F.transform("plain", lambda x: x.withField("mass", _shifted(x["mass"], x["size"], shift)))  # noqa: B023
        )
        rows = rows.withColumn("fold", _fold(F.col("moved"), ITEM, seed)).withColumn("up", _rounded(F.col("fold.left"), seed))
        last = F.when(F.col("fold.left").isNotNull(), F.array(F.col("fold.left").withField("mass", F.col("up"))))
        rows = rows.select(
            "source", "source_size", "items",
            (F.col("extra") + _total(F.col("moved"), lambda x: x["mass"]) - _total(F.col("plain"), lambda x: x["mass"])
             + F.coalesce(F.expr("up * fold.left.size - fold.left.mass"), F.lit(0.0))).alias("extra"),
            (F.col("rest") - _total(F.col("plain"), lambda x: x["size"])).alias("rest"),
            F.concat("done", "fold.done", F.coalesce(last, F.expr(f"cast(array() as array<{ITEM}>)"))).alias("done"),
        )
        above = part
    return rows.select("source", "extra", "done")


def _shifted(mass: Column, size: Column, shift: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(size.cast("double"), mass - shift * size))


def _choices(done: Column, rows: DataFrame) -> DataFrame:
    return rows.select("source", F.explode(done).alias("d")).select(
        "source", "d.size", "d.row_hash", "d.rep", "d.doc_id", F.col("d.mass").cast("long").alias("up"),
    )


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: ``row_hash``, ``doc_id``, ``source``, ``size``, ``rep``, ``copies``, ``source_size``, ``target``."""
    rows = stored(
        docs.select(
            row_hash(docs).alias("row_hash"), "doc_id", "source", _size().alias("size"),
        ).groupBy(*KEY).agg(F.count("*").alias("m")), "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    plan = stored(source_targets(sizes, list(weights), share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    same_source = lambda a, b: a.join(b.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    items = (
        same_source(rows, plan)
        .withColumn("thousand", F.explode(F.expr("sequence(0L, (m - 1) div 1000)")))
        .withColumn("rep", F.explode(F.expr("sequence(thousand * 1000, least(m, thousand * 1000 + 1000) - 1)")))
        .withColumn("base", F.floor(rate)).withColumn("p", rate - F.col("base"))
        .select(*KEY, "rep", "source_size", (F.col("p") * F.col("size")).alias("mass"))
    )
    is_large = F.col("size") * CLASSES[-1] > F.col("source_size")
    large = stored(_large(items.where(is_large), seed), "large")
    small = items.where(~is_large)
    shift = stored(
        small.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        .join(large.select(F.col("source").alias("s"), "extra"), F.expr("source <=> s"), "left").select(
            "source", F.coalesce(F.col("extra") / F.nullif("words", F.lit(0)), F.lit(0.0)).alias("shift"),
            F.ceil(F.col("rows") / BLOCK).alias("blocks"),
        ), "shift",
    )
    level = same_source(small, shift).withColumn("mass", _shifted(F.col("mass"), F.col("size"), F.col("shift")))
    every = _choices(F.col("done"), large)
    depth = 0
    blocks = shift.agg(F.max("blocks")).first()[0] or 0
    while blocks:
        at = F.expr(f"pmod(xxhash64(row_hash, rep, {depth}), blocks)")
        folded = stored(
            _listed(level.withColumn("block", at), ["source", "blocks", "block"])
            .select("source", "blocks", _fold(F.col("items"), ITEM, seed).alias("fold")), "level",
        )
        every = every.unionByName(_choices(F.col("fold.done"), folded))
        level = folded.where("fold.left is not null").select(
            "source", F.expr(f"(blocks + {BLOCK} - 1) div {BLOCK}").alias("blocks"), "fold.left.*",
        )
        blocks = 0 if blocks == 1 else -(-blocks // BLOCK)
        depth += 1
    if depth:
        last = F.struct("row_hash", "rep", "size", "mass")
        every = every.unionByName(level.select(
            "source", "size", "row_hash", "rep", "doc_id", _rounded(last, seed).cast("long").alias("up"),
        ))
    return same_source(every, plan).select(
        "row_hash", "doc_id", "source", "size", "rep",
        F.when(F.col("size") > 0, F.floor(rate) + F.col("up")).otherwise(F.lit(0)).cast("long").alias("copies"),
        "source_size", "target",
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table itself: every row of ``docs`` as often as it is taken, with its columns."""
    same = ["row_hash", "size"]
    taken = stored(
        mixed(docs, **options).groupBy(*same).agg(F.count("*").alias("m"), F.sum("copies").alias("copies")).where("copies > 0"), "taken",
    )
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row_hash(docs).alias("row_hash"), _size().alias("size"))
    each = (
        hashed.join(taken.where("copies >= m"), same)
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies div m)"))).select("doc.*")
    )
    uneven = taken.where("copies % m > 0")
    if uneven.limit(1).count():  # equal rows of which some are taken once more
        once = hashed.join(uneven, same).groupBy("doc").agg(F.first(F.expr("copies % m")).alias("more"))
        each = each.unionByName(once.withColumn("copy", F.explode(F.expr("sequence(1L, more)"))).select("doc.*"))
    return each
