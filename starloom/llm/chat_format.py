"""Chat formatting: collapse cumulative snapshots, then render.

A chat service that logs the whole conversation after each turn leaves rows in
which shorter conversations are prefixes of longer ones. Each turn gets a rolling
hash of all turns up to it: two 64-bit XOR accumulations, over a window, of
hashes of (position, role, text). As the position is hashed too, order counts.
A conversation of n turns is a snapshot if its last hash is the hash at turn n of
a longer conversation: an anti-join on (n, hash) retains the others. Of
conversations equal in all turns the smallest id stays.

Hashes are confirmed on turns: at each n, all conversations with one hash must have one role and text
there. If the nth turns are equal, so are the hashes at n - 1, and so on down to the first turn; so where no
hash stands for two turns, equal hashes mean equal conversations. Otherwise everything is hashed anew with
another salt.

All of it is DataFrame operations. Prefix hashes and turns are deduplicated with map-side
combine before shuffles, so that a first turn shared by a third of all
conversations is one row a task.

Defined cases: turns are ordered by ``turn`` (nulls first), then role and text, so
ties and repeated rows have a fixed order. A null role or text differs from an
empty one when compared and renders as empty. Rows with a null conversation id
form one conversation with a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.session import checkpointed

#: Fixed values of the rendered form.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, salt: int = 0) -> DataFrame:
    """Turns with ``n, ha, hb``: their position from 1 and the rolling hash pair."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = (F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("n", F.row_number().over(order))
        .withColumn("da", F.xxhash64(F.lit(2 * salt + 1), "n", *content))
        .withColumn("db", F.xxhash64(F.lit(2 * salt + 2), *content, "n", F.reverse("text")))
        .select("conv_id", "turn", "role", "text", "n", F.expr("bit_xor(da)").over(upto).alias("ha"), F.expr("bit_xor(db)").over(upto).alias("hb"))
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, kept, reason``: every conversation, and whether it is retained.

    reason: ``maximal``, ``snapshot`` (a longer conversation starts with it) or
    ``repeat`` (equal to one with a smaller id).
    """
    salt = 0
    while not confirmed(hashed := prefix_hashes(turns, salt)):
        salt += 1
    marks = checkpointed(hashed.select("conv_id", "n", "ha", "hb"))
    sizes = marks.groupBy("conv_id").agg(F.max(F.struct("n", "ha", "hb")).alias("last"))
    whole = sizes.select("conv_id", F.col("last.n").alias("n"), F.col("last.ha").alias("ha"), F.col("last.hb").alias("hb"))
    key = ["n", "ha", "hb"]
    inner = marks.alias("m").join(whole.alias("w"), F.col("m.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("m.n") < F.col("w.n")), "left_semi").select(*key).distinct()
    snapshots = whole.join(inner, key, "left_semi").select("conv_id", "n", F.lit("snapshot").alias("reason"))
    longest = whole.join(inner, key, "left_anti")
    first = longest.groupBy(*key).agg(F.min("conv_id").alias("first_id"), F.min(F.col("conv_id").isNotNull()).alias("all_ids"))
    stays = F.col("conv_id").eqNullSafe(F.when(F.col("all_ids"), F.col("first_id")))
    others = longest.join(first, key).select("conv_id", "n", F.when(stays, "maximal").otherwise("repeat").alias("reason"))
    return snapshots.unionByName(others).select("conv_id", F.col("n").cast("long").alias("n_turns"), (F.col("reason") == "maximal").alias("kept"), "reason")


def confirmed(hashed: DataFrame) -> bool:
    """Whether each hash of turns up to n stands for one nth turn only."""
    said = hashed.groupBy("n", "ha", "hb", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    return said.groupBy("n", "ha", "hb").agg(F.count(F.lit(1)).alias("turns")).filter("turns > 1").isEmpty()


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, rendered``: each conversation as one training string."""
    turn = F.struct(F.col("turn").isNotNull().alias("o"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = lambda t: F.concat(F.lit(TURN_OPEN), t["role"], F.lit("\n"), t["text"], F.lit(TURN_CLOSE + "\n"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    return grouped.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", one), "").alias("rendered"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Every conversation with its verdict; retained ones with their rendered text, others with null."""
    verdicts = checkpointed(maximal_conversations(turns))
    rows = turns.select("conv_id", "turn", "role", "text")
    kept = verdicts.filter("kept").select(F.col("conv_id").alias("kept_id"))
    texts = render(rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")).select(F.col("conv_id").alias("text_id"), "rendered")
    return verdicts.join(texts, F.col("conv_id").eqNullSafe(F.col("text_id")), "left").select("conv_id", "n_turns", "kept", "reason", "rendered")
