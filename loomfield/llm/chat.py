"""Preference formatting: prompt, chosen and rejected completions of conversation pairs.

A pair's two conversations are compared turn by turn on role and text. The turns they begin with in
common are rendered once, as the prompt; each side's other turns are its completion, as segments
that say whether they are trained on: the text and end mark of assistant turns are, headers and
turns of others are not.

Turns are ordered by number, ties by role and text; exact repeats of a row count once. A null turn
number comes first, a null role is `unknown`, a null text is empty; rows whose conversation id is
null take no part. Marks inside a text or a role are broken by a blank, and line ends inside a role are
blanks, so neither can open a turn. A pair that lacks one side keeps the other, with no prompt and a null
completion. Empty tables give empty results. Extra columns are ignored. One conversation is one example,
held in one row.

swapped_replies() makes preferences where a table has none: one reply of a conversation against one from
another conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the conversations of a table of turns, each an array of (role, text)."""
    broken = lambda c: F.regexp_replace(c, r"<\|im_(start|end)\|>", r"<|im_$1 |>")
    role = broken(F.regexp_replace(F.coalesce(F.col(role_col), F.lit("unknown")), r"[\r\n]+", " "))
    text = broken(F.coalesce(F.col(text_col), F.lit("")))
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    return (
        turns.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("conv"))
        .agg(F.sort_array(F.collect_set(one)).alias("turns"))
        .select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both conversations begin with; zero if one of them is missing."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.size(same)), F.lit(0))


def segments(turns: Column) -> Column:
    """Rendered turns as (text, trained) segments."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("trained")),
                F.struct(F.concat(t["text"], F.lit(END + "\n")).alias("text"), (t["role"] == "assistant").alias("trained")),
            ),
        )
    )


def rendered(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def formatted(both: DataFrame) -> DataFrame:
    """both(pair_id, chosen, rejected), arrays of turns -> (pair_id, n_prompt_turns, prompt, chosen, rejected)."""
    both = both.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        F.coalesce(rendered(segments(F.slice("chosen", F.lit(1), F.col("n")))), F.lit("")).alias("prompt"),
        segments(rest("chosen")).alias("chosen"),
        segments(rest("rejected")).alias("rejected"),
    )


def preference_pairs(
    turns: DataFrame,
    pairs: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """pairs(pair_id, chosen_id, rejected_id) -> (pair_id, n_prompt_turns, prompt, chosen, rejected):
    prompt is text, chosen and rejected are arrays of (text, trained)."""
    whole = conversations(turns, id_col, turn_col, role_col, text_col)
    side = lambda name: whole.select(F.col("conv").alias(f"{name}_id"), F.col("turns").alias(name))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    return formatted(both)


def swapped_replies(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, chosen, rejected) for each conversation with a reply (a turn of the assistant); ids are whole
    numbers. Chosen is the conversation to its last reply. Rejected has the same turns before reply number id
    modulo the count of replies, and there the first reply of conversation id + 1 (empty if it has none)."""
    whole = conversations(turns, id_col, turn_col, role_col, text_col)
    spots = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    whole = whole.withColumn("spots", spots).filter(F.size("spots") > 0)
    others = whole.select((F.col("conv") - 1).alias("conv"), F.col("turns")[F.col("spots")[0] - 1]["text"].alias("other"))
    place = F.col("spots")[F.pmod("conv", F.size("spots")).cast("int")]
    reply = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text")))
    return whole.join(others, "conv", "left").select(
        F.col("conv").alias("pair_id"),
        F.slice("turns", F.lit(1), F.element_at("spots", -1)).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), place - 1), reply).alias("rejected"),
    )


def mask_runs(parts: Column) -> Column:
    """length:trained of each segment, comma-joined; lengths in characters."""
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", F.length(s["text"]), s["trained"].cast("int"))), ",")
