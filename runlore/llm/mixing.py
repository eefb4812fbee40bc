"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Each source has a target number of words. A document of that source is due target / source_size copies: the whole
part is certain, the fraction is a probability. Fractions are rounded by the pivotal method: two documents meet, and one
of them takes as many words from the other as fit, until one has none or a whole copy; the other goes on with the
rest. Which way words go is drawn so that each document's expected copies stay what they are, and the words of both
together never change. What is left of a block meets what is left of other blocks one level up, in a tree whose blocks
are of bounded size, so no task gets a whole source. Large documents meet first, and a number of each source's
documents waits for the last level, where these take up what large ones have left; so in the end a source is off its
target by part of one small document.

Documents meet within classes of like size first, so few words change hands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, small

#: Draws are whole numbers below this.
ONE = 1 << 40
#: Documents of a lowest block on average if one source and class holds all, blocks that meet one level up, and documents
#: of a source, on average, that wait for its last level.
BLOCK, FAN, HELD = 128, 64, 128
#: Up to this many sources, the table of targets is broadcast.
BROADCAST_SOURCES = 50_000


def source_targets(totals: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = (3, 1, 2)) -> DataFrame:
    """Targets of sources from totals(source, source_size, ..), one row per source; other columns stay.

    Weights repeat over the sources in order of code points, null last. The targets sum up to share of all sizes, in
    proportion to the weights, but none is above cap times its source's size: what is above is shared again by weight
    among the others until none is above. That is done on one level, the words for a weight of one, which rises with
    each turn; targets are min(cap * source_size, level * weight). Sources are sorted by range and numbered within
    partitions, so they never stand in one task."""
    number = F.monotonically_increasing_id()  # partition and place in it
    ranked = checkpointed(
        totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", number)
        .withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = (F.col("start") + F.col("at")) % len(weights)
    weighed = checkpointed(
        ranked.join(F.broadcast(starts), "part")
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap))).drop("part", "at", "start")
    )
    due = (weighed.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = -1.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        filled, weight = weighed.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (due - (filled or 0.0)) / weight if weight else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least("most", F.lit(max(level, 0.0)) * F.col("weight"))).drop("weight", "most")


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of items (words w > 0, key k, fraction p) in order: the struct of the item that is
    left (or null) and the array of those that are decided, with take 0 or 1."""
    item = "struct<w:double,k:bigint,p:double,take:int>"
    none = F.array().cast(f"array<{item}>")

    def made(x: Column, p: Column, take: Column) -> Column:
        return F.struct(x["w"].alias("w"), x["k"].alias("k"), p.alias("p"), take.cast("int").alias("take"))

    def meet(acc: Column, x: Column) -> Column:
        a = acc["left"]
        has, other = a["p"] * a["w"], x["p"] * x["w"]
        room, other_room = a["w"] - has, x["w"] - other
        up, down = F.least(room, other), F.least(has, other_room)
        chance = F.pmod(F.xxhash64(F.lit(seed), a["k"], x["k"]), F.lit(ONE)) / F.lit(float(ONE))
        facts = F.struct(
            has.alias("has"), other.alias("other"), room.alias("room"), other_room.alias("other_room"), (chance * (up + down) < down).alias("gains"),
        )

        def decided(m: Column) -> Column:
            gains = m["gains"]
            ends = F.when(gains, m["room"] <= m["other"]).otherwise(m["has"] <= m["other_room"])
            other_ends = F.when(gains, m["other"] <= m["room"]).otherwise(m["other_room"] <= m["has"])
            stays = F.when(gains, m["has"] + m["other"]).otherwise(m["has"] - m["other_room"]) / a["w"]
            other_stays = F.when(gains, m["other"] - m["room"]).otherwise(m["other"] + m["has"]) / x["w"]
            zero, take = F.lit(0.0), gains.cast("int")
            left = F.when(ends & other_ends, F.lit(None)).when(ends, made(x, other_stays, F.lit(0))).otherwise(made(a, stays, F.lit(0)))
            done = F.concat(
                acc["done"], F.when(ends, F.array(made(a, zero, take))).otherwise(none), F.when(other_ends, F.array(made(x, zero, 1 - take))).otherwise(none)
            )
            return F.struct(left.alias("left"), done.alias("done"))

        return F.when(a.isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).otherwise(_with(facts, decided))

    return F.aggregate(items, F.struct(F.lit(None).cast(item).alias("left"), none.alias("done")), meet)


def mix_decisions(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    share: float = 1.5, cap: float = 2.0, weights: tuple = (3, 1, 2), seed: int = 20240, words: str = WORD,
) -> DataFrame:
    """One row per different (id, source, text): id, source, text_hash, n_rows (equal rows in df), size (words),
    source_size, target, copies (of each of these rows).

    A null text has size 0 and a null source is a source of its own, last in order. Equal rows are decided together.
    Rows without words have the whole part of what they are due, as their copies move no words.
    An empty table gives an empty result; sources without words have target 0 and no copies. The result depends on
    rows and seed only, not on their order or partitions."""
    if cap > 2 or cap < 0 or share < 0:
        raise ValueError("share must not be negative, cap must be within 0 and 2")
    units = checkpointed(
        df.select(
            F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("text_hash"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(words)), F.lit(0)).cast("bigint").alias("size"),
        ).groupBy("id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("n_rows"))
    )
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    targets = checkpointed(source_targets(totals, share, cap, weights)).withColumnRenamed("source", "s")
    if small(targets, BROADCAST_SOURCES):
        targets = F.broadcast(targets)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = units.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("due", due).select(
        "*", F.xxhash64(F.lit(seed), "id", "source", "text_hash", "size").alias("k"),
        F.floor("due").cast("int").alias("whole"), (F.col("due") - F.floor("due")).alias("p"),
    ).drop("due")
    n = units.count()
    salts = max(1, math.ceil(n / BLOCK))
    weight = F.col("size") * F.col("n_rows")
    waits = F.pmod(F.xxhash64(F.lit(seed + 7), "k"), F.ceil(F.col("units") / HELD)) == 0
    items = placed.filter((F.col("p") > 0) & (weight > 0)).select(
        "source", waits.alias("waits"), F.floor(F.log2(weight) * 2).cast("int").alias("class"), F.pmod("k", F.lit(salts)).alias("salt"),
        F.struct(weight.cast("double").alias("w"), F.col("k"), F.col("p"), F.lit(0).alias("take")).alias("item"),
    )
    left, decided, level, last = items.filter("not waits"), [], 0, False
    while True:
        keys = ["source"] if last else ["source", "class", "salt"]
        folded = checkpointed(
            left.groupBy(*keys).agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
            .select(*keys, _fold(F.col("items"), seed + level).alias("folded"))
            .select(*keys, "folded.left", "folded.done")
        )
        decided.append(folded.select("source", F.explode("done").alias("x")).select("source", "x.k", "x.take"))
        rest = folded.filter("left is not null")
        if last:  # of each source at most one is left
            decided.append(rest.select("source", "left.k", (F.col("left.p") >= 0.5).cast("int").alias("take")))
            break
        if salts == 1:
            last = True
            left = rest.select("source", F.col("left").alias("item")).unionByName(items.filter("waits").select("source", "item"))
        else:
            left = rest.select("source", "class", F.floor(F.col("salt") / FAN).alias("salt"), F.col("left").alias("item"))
            salts = math.ceil(salts / FAN)
        level += 1
    taken = decided[0]
    for more in decided[1:]:
        taken = taken.unionByName(more)
    taken = taken.select(F.col("source").alias("s"), F.col("k").alias("taken_k"), "take")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("taken_k"))
    return placed.join(taken, same, "left").select(
        "id", "source", "text_hash", "n_rows", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("take", F.lit(0))).alias("copies"),
    )


def each_row(decisions: DataFrame, piece: int = 4096) -> DataFrame:
    """One row for each row that a decision stands for; long runs of equal rows unfold in pieces."""
    pieces = decisions.withColumn("piece", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n_rows") / piece).cast("int"))))
    size = F.least(F.lit(piece), F.col("n_rows") - (F.col("piece") - 1) * piece).cast("int")
    return pieces.withColumn("piece", F.explode(F.sequence(F.lit(1), size))).drop("piece", "n_rows")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """df with each row as often as the mix takes it: not at all, once or twice. Columns stay as they are."""
    made = mix_decisions(df, id_col, text, source, **options).filter("copies > 0").select(
        F.col("id").alias("i"), F.col("source").alias("s"), F.col("text_hash").alias("h"), "copies"
    )
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.col(text)).alias("text_hash"))
    same = (
        F.col(f"row.`{id_col}`").eqNullSafe(F.col("i")) & F.col(f"row.`{source}`").eqNullSafe(F.col("s")) & (F.col("text_hash") == F.col("h"))
    )
    return rows.join(made, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
