"""Chat formatting with cumulative-snapshot collapse. Logs often hold a conversation again after each turn; a
conversation whose turns are the first turns of a longer one is dropped, and of equal ones the smallest id stays.

Each turn has a rolling hash of the turns up to it (128 bits; the running exclusive-or of hashes of position, role
and text). A conversation's last hash that is found among the hashes before the last turn of others is a prefix.
Only distinct hashes are shuffled to that anti-join, so a first turn that a third of all conversations share is one row.

Defined cases: turns are in order of (turn, role, text), nulls first; a row that repeats in all four columns counts
once; a null conv_id is a conversation of its own kind (all null rows together); null role is ``unknown`` and null
text empty in the rendering, though they hash apart from those strings; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, length, a, b): for each turn the hash of the turns up to it, as two longs."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    nulls = [F.col("role").isNull(), F.col("text").isNull()]
    for name in ("a", "b"):
        rows = rows.withColumn(name, F.xxhash64(F.lit(f"turn {name}"), "place", *nulls, "role", "text"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id", "turn", "role", "text", "place", F.count("*").over(Window.partitionBy("conv_id")).alias("length"),
        *[F.bit_xor(name).over(so_far).alias(name) for name in ("a", "b")])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, length, copies): conversations that no longer one begins with; copies counts equal ones."""
    hashes = prefix_hashes(turns).select("conv_id", "place", "length", "a", "b")
    begun = hashes.where("place < length").select("a", "b").distinct()
    whole = hashes.where("place = length").groupBy("a", "b", "length").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(begun, ["a", "b"], "left_anti").select("conv_id", "length", "copies")


def render(turns: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, rendered): one string for each conversation (of ``kept``)."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    if kept is not None:
        right = kept.select(F.col("conv_id").alias("_kept"))
        rows = rows.join(right, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text")), _by_turn).alias("turns")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.coalesce(t.role, F.lit("unknown")), F.lit("\n"), F.coalesce(t.text, F.lit("")), F.lit(CLOSE))), "").alias("rendered"))


def _by_turn(x, y):
    def step(name, rest):
        a, b = x[name], y[name]
        return (F.when(a.isNull() & b.isNull(), rest).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(rest))

    return step("turn", step("role", step("text", F.lit(0))))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations."""
    kept = maximal_conversations(turns)
    copies = kept.select(F.col("conv_id").alias("_kept"), "copies")
    return render(turns, kept).join(copies, F.col("conv_id").eqNullSafe(F.col("_kept"))).select("conv_id", "n_turns", "copies", "rendered")
