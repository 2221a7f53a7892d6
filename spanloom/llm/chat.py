"""Chat formatting of preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: role, text.
TURN = "<|{0}|>\n{1}<|end|>\n"
#: The role whose turns a model learns.
TRAINED = "assistant"


def rendered(turn: Column) -> Column:
    head, middle, tail = TURN.replace("{0}", "\0").replace("{1}", "\0").split("\0")
    return F.concat(F.lit(head), F.coalesce(turn.role, F.lit("")), F.lit(middle), F.coalesce(turn.text, F.lit("")), F.lit(tail))


def pair_conversations(turns: DataFrame) -> DataFrame:
    """Pairs of neighbouring conversations: conv_id 2k is chosen and 2k + 1 rejected.

    turns: rows (conv_id, turn, role, text). Rows: pair_id, chosen_id, rejected_id (null for a side that is missing),
    chosen and rejected (arrays of structs role, text, by turn, role and text). Rows with a null conv_id form one chosen side,
    with pair_id null. One shuffle.
    """
    side = F.coalesce(F.pmod("conv_id", F.lit(2)), F.lit(0))
    step = F.struct("turn", "role", "text")
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(side == k, step))), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    of = lambda k: F.max(F.when(side == k, F.col("conv_id")))
    return turns.groupBy(F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id")).agg(of(0).alias("chosen_id"), of(1).alias("rejected_id"), pick(0).alias("chosen"), pick(1).alias("rejected"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of each pair of conversations.

    pairs: chosen and rejected as arrays of structs (role, text), and any other columns, which are kept unless they
    have a result's name. Adds n_common (turns at the start that both share: equal role and text, nulls equal to nulls),
    prompt (those turns, rendered once), and for each side chosen_/rejected_completion: the turns after the prompt as an array of
    structs (text, train), whose texts concatenate to the completion; train is true for turns of the trained role, the only
    ones that bear loss. A null or empty side has no turns: n_common is 0 and its completion is empty. If one side begins with
    the whole other side, the other's completion is empty. Null roles and texts are rendered as empty. Map-only.
    """
    turns = lambda side: F.coalesce(F.col(side), F.array().cast(pairs.schema[side].dataType))
    a, b = turns("chosen"), turns("rejected")
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.slice(a, 1, n), lambda t, k: t.role.eqNullSafe(F.get(b, k).role) & t.text.eqNullSafe(F.get(b, k).text)), False)
    common = F.when(differs > 0, differs - 1).otherwise(n).cast("bigint")
    rows = pairs.withColumn("n_common", common)
    rest = lambda side: F.transform(F.slice(side, F.col("n_common").cast("int") + 1, F.size(side)), lambda t: F.struct(rendered(t).alias("text"), F.coalesce(t.role == TRAINED, F.lit(False)).alias("train")))
    return rows.withColumns({
        "prompt": F.array_join(F.transform(F.slice(a, 1, F.col("n_common").cast("int")), rendered), ""),
        "chosen_completion": rest(a),
        "rejected_completion": rest(b),
    })
