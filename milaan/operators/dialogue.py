"""Filling a form by dialogue.

A conversation fills the required fields of its form in order, and "wrong" clears the last one, so all that steers the
dialogue is *how many* required fields are filled.  A turn is therefore a small function on that count, written as an
array (``moves[k]`` is the count after the turn when it was ``k`` before), and running a conversation is composing such
arrays.  Composition is associative: turns are composed per block of ``BLOCK`` turn numbers, the blocks are run in
order, then every block replays its own turns from its entry count.  Blocks are composed to blocks of blocks in the same way,
as many levels as the largest turn number needs, so a conversation with a huge number of turns is cut over many tasks and no
list holds more than two blocks (one on either side of turn 0), whether turns are counted or are time stamps.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import dims
from milaan.functions import spoken, text, validators

BLOCK = 1024


def required_fields(spark) -> DataFrame:
    """One row per service: the required form keys in order."""
    rows = {}
    for sid, key, _n, _label, _to, _doc, stakes in dims.form_field_rows():
        rows.setdefault(sid, []).extend([key] if stakes else [])
    return dims.literal_table(spark, "service_id string, required array<string>", list(rows.items()))


def with_moves(turns: DataFrame) -> DataFrame:
    """Add ``required``, ``intent``, ``heard`` and ``moves`` to turns (conv_id, service_id, turn, transcript).  No shuffle."""
    turns = turns.join(required_fields(turns.sparkSession), "service_id")
    heard = spoken.spelled_out(spoken.without_lead_ins(F.coalesce("transcript", F.lit(""))))
    turns = turns.withColumns({"intent": spoken.intent(F.col("transcript")), "heard": heard})
    return turns.withColumn("moves", _moves())


@cache
def _moves() -> Column:
    count = F.size("required")

    def after(k: Column) -> Column:
        key = F.get("required", k)
        accepted = validators.spoken_problem(key, spoken.block_letters(F.col("heard"), key)).isNull()
        return (
            F.when(F.col("intent") == "clear", F.greatest(F.lit(0), k - 1))
            .when((F.col("intent") != "answer") | (k >= count), k)
            .otherwise(F.when(accepted, k + 1).otherwise(k))
        )

    return F.transform(F.sequence(F.lit(0), count), after)


def levels_for(turns: DataFrame, order: str = "turn") -> int:
    """How often turn numbers must be divided by ``BLOCK`` until all of them are in one block; one aggregate over one column."""
    ends = turns.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    left, levels = max(abs(ends["low"] or 0), abs(ends["high"] or 0)), 1
    while left >= BLOCK:
        left, levels = left // BLOCK, levels + 1
    return levels


def counts_before(turns: DataFrame, order: str = "turn", levels: int | None = None, entry: DataFrame | None = None) -> DataFrame:
    """Add ``before``: the number of filled fields when each turn starts.

    ``turns`` needs conv_id, the integer ``order`` column (unique per conversation) and ``moves``; ``entry`` optionally
    gives (conv_id, before) to start from instead of 0.  ``levels`` comes from the turn numbers unless given.
    """
    levels = levels or levels_for(turns, order)
    payload = F.struct(order, *[c for c in turns.columns if c not in ("conv_id", order)])
    block = F.expr(f"{order} div {BLOCK}") if levels > 1 else F.lit(0).cast("long")
    blocks = (
        turns.withColumn("_block", block)
        .groupBy("conv_id", "_block")
        .agg(F.array_sort(F.collect_list(payload), _by(order)).alias("_rows"))
    )
    if levels > 1:
        identity = F.sequence(F.lit(0), F.size(F.element_at("_rows", 1)["moves"]) - 1)
        composed = F.aggregate("_rows", identity, lambda state, row: F.transform(state, lambda k: F.get(row["moves"], k)))
        summaries = blocks.select("conv_id", F.col("_block").alias("_at"), composed.alias("moves"))
        starts = counts_before(summaries, "_at", levels - 1, entry).select(
            "conv_id", F.col("_at").alias("_block"), "before"
        )
        blocks = blocks.join(starts, ["conv_id", "_block"])
    elif entry is not None:
        blocks = blocks.join(entry, "conv_id", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    else:
        blocks = blocks.withColumn("before", F.lit(0))

    def replay(state: Column, row: Column) -> Column:
        return F.struct(
            F.get(row["moves"], state["now"]).alias("now"),
            F.concat(state["seen"], F.array(state["now"])).alias("seen"),
        )

    start = F.struct(F.col("before").cast("int").alias("now"), F.array().cast("array<int>").alias("seen"))
    seen = F.aggregate("_rows", start, replay, lambda state: state["seen"])
    return (
        blocks.select("conv_id", F.explode(F.arrays_zip("_rows", seen.alias("before"))).alias("z"))
        .select("conv_id", "z._rows.*", "z.before")
        .select(*turns.columns, "before")
    )


def _by(order: str):
    def compare(a: Column, b: Column) -> Column:
        return F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)

    return compare


def outcomes(run: DataFrame) -> DataFrame:
    """What each turn did, from ``before``: action, field update, next field.  No shuffle."""
    k, count, told = F.col("before"), F.size("required"), F.col("intent")
    after = F.get("moves", k)
    key = F.get("required", k)
    saved = (told == "answer") & (after > k)
    cleared = (told == "clear") & (after < k)
    action = (
        F.when(told.isin("blank", "clear", "redo"), "ask")
        .when(told == "documents", "answer")
        .when(told == "done", F.when(k < count, "ask").otherwise("redirect"))
        .when(k >= count, "redirect")
        .when(~saved, "clarify")
        .otherwise(F.when(after < count, "ask").otherwise("redirect"))
    )
    return run.select(
        "conv_id", "service_id", "turn", action.alias("action"),
        F.when(saved, key).when(cleared, F.get("required", k - 1)).alias("update_key"),
        F.when(saved, spoken.block_letters(F.col("heard"), key)).when(cleared, F.lit("")).alias("update_value"),
        F.get("required", after).alias("next_field"),
    )


def turn_outcomes(turns: DataFrame) -> DataFrame:
    return outcomes(counts_before(with_moves(turns)))


def form_state(turn_results: DataFrame) -> DataFrame:
    """The answers each conversation ends with: the last update per field, cleared ones left out."""
    updates = turn_results.where("update_key IS NOT NULL")
    return (
        updates.groupBy("conv_id", "service_id", F.col("update_key").alias("form_key"))
        .agg(F.max_by("update_value", "turn").alias("value"))
        .where("value <> ''")
    )


def action_rates(turn_results: DataFrame) -> DataFrame:
    per_action = turn_results.groupBy("service_id", "action").agg(F.count(F.lit(1)).alias("turns"))
    totals = per_action.groupBy("service_id").agg(F.sum("turns").alias("all_turns"))
    return per_action.join(totals, "service_id").select(
        "service_id", "action", "turns", (F.col("turns") / F.col("all_turns")).alias("rate")
    )


def agent_turns(requests: DataFrame) -> DataFrame:
    """Independent turns that bring their own state: service_id, transcript, answers (map), active_field.

    Unlike :func:`turn_outcomes` the answers may be any subset of the form, so the open field is looked up per row.
    """
    spark = requests.sparkSession
    all_keys = {}
    for sid, key, *_rest in dims.form_field_rows():
        all_keys.setdefault(sid, []).append(key)
    forms = dims.literal_table(spark, "service_id string, form_keys array<string>", list(all_keys.items()))
    rows = requests.join(forms, "service_id").join(required_fields(spark), "service_id")

    def empty(key: Column) -> Column:
        return text.strip(F.coalesce(F.try_element_at("answers", key), F.lit(""))) == ""

    first_open = F.get(F.filter("required", empty), 0)
    rows = rows.withColumns(
        {
            "intent": spoken.intent(F.col("transcript")),
            "open_field": F.when(F.col("active_field").isNotNull() & empty(F.col("active_field")), F.col("active_field")).otherwise(first_open),
            "last_filled": F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter("form_keys", lambda k: ~empty(k))), -1),
            "first_open": first_open,
        }
    )
    value = spoken.form_value(F.col("transcript"), F.col("open_field"))
    rows = rows.withColumn("value", F.when(F.col("intent") == "answer", value))
    problem = validators.spoken_problem(F.col("open_field"), F.col("value"))
    told, target = F.col("intent"), F.col("open_field")
    rows = rows.withColumn("ok", (told == "answer") & target.isNotNull() & problem.isNull())
    others_open = F.filter("required", lambda k: empty(k) & (k != target))
    next_field = (
        F.when((told == "clear") & F.col("last_filled").isNotNull(), F.col("last_filled"))
        .when(told == "done", F.col("first_open"))
        .when(F.col("ok"), F.get(others_open, 0))
        .otherwise(target)
    )
    action = (
        F.when(told.isin("blank", "clear", "redo"), "ask")
        .when(told == "documents", "answer")
        .when(told == "done", F.when(F.col("first_open").isNotNull(), "ask").otherwise("redirect"))
        .when(target.isNull(), "redirect")
        .when(~F.col("ok"), "clarify")
        .otherwise(F.when(F.size(others_open) > 0, "ask").otherwise("redirect"))
    )
    cleared = (told == "clear") & F.col("last_filled").isNotNull()
    return rows.select(
        *requests.columns, action.alias("action"),
        F.when(F.col("ok"), target).when(cleared, F.col("last_filled")).alias("update_key"),
        F.when(F.col("ok"), F.col("value")).when(cleared, F.lit("")).alias("update_value"),
        next_field.alias("next_field"),
    )
