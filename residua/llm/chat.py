"""Chat formatting: logged snapshots of a conversation collapse into the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from residua.llm.texts import stored
from residua.operators.layout import small_enough

# turns of a conversation's part; the running hash of each part is completed by the earlier ones
PART_TURNS = 50_000


def chatml(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")),
                    F.lit("<|im_end|>\n"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]


def _numbered_in_tasks(rows: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, role, text) of conversations that are too long for one task.

    All turns are sorted over many tasks. The turns of a conversation follow each
    other in a task, so a place is a count of the turns in earlier tasks and a
    distance from the first one in its own.
    """
    ranged = stored(rows.orderBy("conv_id", *_order()).select(
        "conv_id", "role", "text", F.monotonically_increasing_id().alias("_at")), "sorted-turns")
    ranged = ranged.withColumn("_task", F.shiftright("_at", 33))
    whole = W.partitionBy("conv_id")
    earlier = whole.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    spans = ranged.groupBy("conv_id", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    spans = spans.select("conv_id", "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_n").over(whole).alias("n_turns"))
    return ranged.join(spans, ["conv_id", "_task"]).select(
        "conv_id", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("place"), "n_turns", "role", "text")


def _rolled(placed: DataFrame, split: bool) -> DataFrame:
    """Rolling hashes inside each part, completed by those of earlier parts where there are any."""
    content = [F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0")), F.col("role").isNull(), F.col("text").isNull()]
    one = F.xxhash64("place", *content)
    two = F.xxhash64(*content[::-1], F.xxhash64(*content), "place", F.lit("second"))
    rolling = W.partitionBy("conv_id", "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    marked = placed.withColumns({"_a": one, "_b": two})
    hashed = marked.withColumns({"h1": F.bit_xor("_a").over(rolling), "h2": F.bit_xor("_b").over(rolling)})
    if split:
        ends = marked.groupBy("conv_id", "part").agg(F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
        earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(
            "conv_id", "part", F.coalesce(F.bit_xor("_a").over(earlier), F.lit(0)).alias("_c1"),
            F.coalesce(F.bit_xor("_b").over(earlier), F.lit(0)).alias("_c2"))
        hashed = hashed.join(carried, ["conv_id", "part"]).withColumns(
            {"h1": F.col("h1").bitwiseXOR(F.col("_c1")), "h2": F.col("h2").bitwiseXOR(F.col("_c2"))})
    return hashed.select("conv_id", "part", "place", "n_turns", "h1", "h2", "role", "text")


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, place, n_turns, h1, h2, role, text): each turn with the hash of the conversation up to it.

    The hash of a prefix is the exclusive or of the 64-bit hashes of its turns
    with their places, twice with different contents, so it rolls forward and
    parts of a long conversation are added up afterwards. Parts follow the
    places of turns, whatever their numbers are; conversations of more than
    ``part_turns`` rows are sorted over many tasks, others inside one.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"),
    ).filter("conv_id is not null")
    long = stored(rows.groupBy("conv_id").count().filter(F.col("count") > part_turns).select("conv_id"), "long-conversations")
    several = not long.isEmpty()
    short = rows.distinct()
    if several:
        known = F.broadcast(long) if small_enough(long, 32) else long
        short = rows.join(known, "conv_id", "left_anti").distinct()
    whole = W.partitionBy("conv_id")
    short = short.select(
        "conv_id", F.row_number().over(whole.orderBy(*_order())).cast("long").alias("place"),
        F.count(F.lit(1)).over(whole).alias("n_turns"), "role", "text", F.lit(0).cast("long").alias("part"))
    rolled = _rolled(short, False)
    if not several:
        return rolled
    placed = _numbered_in_tasks(rows.join(known, "conv_id", "left_semi").distinct())
    placed = placed.withColumn("part", F.floor((F.col("place") - 1) / part_turns))
    return rolled.unionByName(_rolled(placed, True))


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, n_turns, kept): which conversations are maximal.

    A conversation goes if its turns (roles and texts in order) are the first
    turns of a longer one; of equal conversations the smallest id stays. Turns
    are ordered by number, then role, then text, nulls first; a repeated row
    counts once; null roles and texts equal only each other. Rows with a null
    id belong to no conversation. An empty table gives an empty one.
    """
    return _maximal(_stored_hashes(prefixes(turns, conv_id, turn, role, text, part_turns)))


def _stored_hashes(rolled: DataFrame) -> DataFrame:
    return stored(rolled.select("conv_id", "place", "n_turns", "h1", "h2"), "turn-hashes")


def _maximal(hashes: DataFrame) -> DataFrame:
    key = ["place", "h1", "h2"]
    whole = hashes.filter("place = n_turns")
    first = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    shorter = hashes.filter("place < n_turns").select(*key).distinct()
    kept = first.join(shorter, key, "left_anti").select("conv_id", F.lit(True).alias("kept"))
    return whole.select("conv_id", "n_turns").join(kept, "conv_id", "left").select(
        "conv_id", "n_turns", F.coalesce("kept", F.lit(False)).alias("kept"))


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           template=chatml, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, rendered): the maximal conversations in a chat template.

    Conversations of up to ``part_turns`` turns are one row; a longer one has a
    row for each part, in order of ``part``, so no row grows without bound.
    """
    rolled = stored(prefixes(turns, conv_id, turn, role, text, part_turns), "turns")
    kept = _maximal(rolled.select("conv_id", "place", "n_turns", "h1", "h2")).filter("kept")
    lines = rolled.join(kept.select("conv_id"), "conv_id", "left_semi").select(
        "conv_id", "part", "n_turns", "place", template(F.col("role"), F.col("text")).alias("line"))
    whole = lines.groupBy("conv_id", "part").agg(
        F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("_lines"))
    return whole.select("conv_id", "part", "n_turns",
                        F.array_join(F.transform("_lines", lambda x: x["line"]), "").alias("rendered"))
