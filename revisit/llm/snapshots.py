"""Collapse of logged conversations that are snapshots of longer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024  # turn numbers whose prefixes are hashed together


def _turn_hashes(role: str, text: str) -> list[Column]:
    """Two 64-bit hashes of a turn that tell null from empty."""
    parts = [F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in ((11, "a"), (23, "b"))]


def prefixes(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, place, n_turns, p1, p2): a rolling hash of each conversation's first ``place`` turns.

    A turn's hash holds its place, and a prefix's hash is the exclusive or of its turns' hashes, so
    the prefixes of a very long conversation are computed in chunks of turn numbers and put
    together from the chunks' totals. Texts are hashed before anything moves.
    """
    hashed = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *_turn_hashes(role, text))
    chunk = F.floor(F.col("turn") / CHUNK).alias("chunk")
    rows = hashed.distinct().select("*", chunk)
    own = Window.partitionBy("conv", "chunk").orderBy("turn", "a", "b")
    of_conv = Window.partitionBy("conv")
    before = of_conv.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def place_of(totals: Column) -> Column:
        return F.coalesce(F.sum(totals).over(before), F.lit(0))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["conv"].eqNullSafe(b["c"]) & a["chunk"].eqNullSafe(b["k"])

    sizes = rows.groupBy("conv", "chunk").agg(F.count("*").alias("n"))
    sizes = sizes.select(
        F.col("conv").alias("c"), F.col("chunk").alias("k"),
        place_of(F.col("n")).alias("earlier"), F.sum("n").over(of_conv).alias("n_turns"),
    )
    placed = rows.withColumn("row", F.row_number().over(own)).join(sizes, same(rows, sizes)).select(
        "conv", "chunk", "n_turns", (F.col("row") + F.col("earlier")).alias("place"), "a", "b"
    )
    placed = placed.select(
        "conv", "chunk", "n_turns", "place",
        F.xxhash64(F.lit(1), "place", "a", "b").alias("t1"),
        F.xxhash64(F.lit(2), "place", "b", "a").alias("t2"),
    )
    upto = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select(
        "conv", "chunk", "n_turns", "place",
        F.bit_xor("t1").over(upto).alias("r1"), F.bit_xor("t2").over(upto).alias("r2"),
    )
    totals = placed.groupBy("conv", "chunk").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    totals = totals.select(
        F.col("conv").alias("c"), F.col("chunk").alias("k"),
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("x2"),
    )
    return rolled.join(totals, same(rolled, totals)).select(
        "conv", "place", "n_turns",
        F.col("r1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("p2"),
    )


def maximal(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, n_turns, n_copies): the conversations that begin no longer one.

    Of equal conversations the smallest id stays; ``n_copies`` is how many there were. A repeated
    row is one turn; turns with equal numbers are put in the order of their hashes; null numbers
    come first; rows without a conversation id are one conversation.
    """
    p = prefixes(turns, conv, turn, role, text)
    whole = p.where("place = n_turns").groupBy("n_turns", "p1", "p2").agg(
        F.min("conv").alias(conv), F.count("*").alias("n_copies")
    )
    longer = p.where("place < n_turns").select("place", "p1", "p2").distinct()
    longer = longer.withColumnRenamed("place", "n_turns")
    return whole.join(longer, ["n_turns", "p1", "p2"], "left_anti").select(conv, "n_turns", "n_copies")


def rendered(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, n_turns, n_copies, chat): the maximal conversations in the chat format.

    Each turn is ``<|im_start|>role``, its text and ``<|im_end|>`` on lines; null roles and texts
    are empty. Turns keep the order of ``maximal``.
    """
    kept = maximal(turns, conv, turn, role, text).withColumnRenamed(conv, "kept")
    said = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), role, text, *_turn_hashes(role, text))
    segment = F.concat(
        F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"),
        F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"),
    )
    of_kept = said.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
    once = of_kept.groupBy("kept", "n_turns", "n_copies", "turn", "a", "b").agg(F.first(segment).alias("segment"))
    whole = once.groupBy("kept", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("turn", "a", "b", "segment"))).alias("turns")
    )
    chat = F.array_join(F.col("turns.segment"), "")
    return whole.select(F.col("kept").alias(conv), "n_turns", "n_copies", chat.alias("chat"))
