"""Chat formatting in budgeted windows, by DataFrame functions alone.

A conversation's turns become windows of text. Prefix sums of the turns' tokens choose
turn-aligned spans within the budget; every window repeats the leading system turn and the
latest turns before its span that fit the history budget. The loss mask holds the assistant
texts of the span only, so a repeated target is masked and each is learned once.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Within roles and texts a
backslash is doubled and `<|` becomes `<\\|` (a line feed in a role `\\n`), so no text holds
a control string and read_back() restores everything.

Null roles and texts count as empty. Turns are ordered by turn (null first), ties by role and
text; repeated rows are turns of their own. A null conv_id is a conversation. A turn over the budget is a window alone,
however long. An empty table gives an empty result; columns besides the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
#: Values of a run of prefix sums.
RUN = 256
#: Tokens of a turn besides its words: start, role and end.
TURN_TOKENS = 3
START, END = "<|im_start|>", "<|im_end|>\n"


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(x: Column) -> Column:
    return _replace(_replace(x, "\\", "\\\\"), "<|", "<\\|")


def unescape(x: Column) -> Column:
    parts = F.transform(F.split(x, r"\\\\", -1), lambda p: _replace(_replace(p, "<\\|", "<|"), "\\n", "\n"))
    return F.array_join(parts, "\\")


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, t: s + t[field])


def _running(values: Column) -> Column:
    """Prefix sums of an array: within runs of RUN values, and then of the runs' totals, so copying costs n * sqrt(n) at most."""

    def sums(own):
        return F.aggregate(own, F.array().cast("array<bigint>"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("bigint")) + v)))

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
    runs = F.transform(starts, lambda k: sums(F.slice(values, k * RUN + 1, F.lit(RUN))))
    return _bind(runs, lambda r: _bind(sums(F.transform(r, lambda x: F.element_at(x, -1))), lambda before: F.flatten(F.transform(r, lambda x, k: F.transform(x, lambda v: v + F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(before, k - 1)))))))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, n_context (repeated turns at its start), formatted, loss array of (start, end) code points."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+")).cast("bigint") + TURN_TOKENS
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        text.alias("text"),
        words.alias("tokens"),
        F.concat(F.lit(START), _replace(escape(role), "\n", "\\n"), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
    )
    grouped = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    lead = F.when(F.get("turns", F.lit(0))["role"] == "system", F.lit(1)).otherwise(F.lit(0))
    parted = grouped.withColumn("n_system", lead).withColumn("system_tokens", F.when(F.col("n_system") == 1, F.get("turns", F.lit(0))["tokens"]).otherwise(F.lit(0)))
    parted = parted.withColumn("ends", F.when(F.size("turns") > 0, _running(F.transform("turns", lambda t: t["tokens"]))))

    # Spans: a window starts where the tokens since the last start, with system turn and history, would pass the budget.
    room = F.greatest(F.lit(budget) - F.col("system_tokens") - F.lit(history), F.lit(1))

    def cut(state, i):
        start = F.try_element_at(state, F.lit(-1))
        base = F.when(start > 0, F.get("ends", start - 1)).otherwise(F.lit(0))
        return F.when((i > start) & (F.get("ends", i) - base > room) & (i > F.col("n_system")), F.concat(state, F.array(i))).otherwise(state)

    parted = parted.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), F.array(F.lit(0)), cut))
    # Every window takes its own turns out of the conversation before rows are made of them.
    def window(start, k):
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        # No more turns than this fit the history, as each has TURN_TOKENS at least.
        low = F.greatest(F.col("n_system"), start - (history // TURN_TOKENS + 1))
        spent = lambda j: F.get("ends", start - 1) - F.when(j > 0, F.get("ends", j - 1)).otherwise(F.lit(0).cast("bigint"))
        fits = F.filter(F.sequence(low, F.greatest(low, start - 1)), lambda j: spent(j) <= history)
        first = F.coalesce(F.get(fits, F.lit(0)), start)
        past = F.slice("turns", first + 1, F.greatest(start - first, F.lit(0)))
        context = F.when(start > 0, F.concat(F.slice("turns", F.lit(1), F.col("n_system")), past)).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
        return F.struct(context.alias("context"), F.slice("turns", start + 1, stop - start).alias("new"))

    rows = parted.select("conv_id", F.posexplode(F.transform("starts", window)).alias("window", "w")).select("conv_id", "window", "w.*")
    pieces = F.transform(F.concat("context", "new"), lambda t: F.concat(t["head"], t["body"], F.lit(END)))

    def place(state, t):
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        kept = F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), kept.alias("spans"))

    offset = F.aggregate("context", F.lit(0), lambda s, t: s + F.length(t["head"]) + F.length(t["body"]) + len(END))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    loss = F.aggregate("new", F.struct(offset.alias("at"), nothing.alias("spans")), place)["spans"]
    return rows.select("conv_id", "window", F.size("context").alias("n_context"), F.array_join(pieces, "").alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns array of (role, text), loss_text and formatted_chars, from the windows alone."""
    raw = F.transform(
        F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context") + 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)), F.lit(1))),
        lambda t: _bind(
            F.substring(t, F.lit(1), F.length(t) - len(END)),
            lambda own: F.struct(
                unescape(F.substring_index(own, "\n", 1)).alias("role"),
                unescape(F.substring(own, F.length(F.substring_index(own, "\n", 1)) + 2, F.length(own))).alias("text"),
            ),
        ),
    )
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    parts = windows.select("conv_id", F.struct("window", raw.alias("turns"), learned.alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    grouped = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return grouped.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda s, w: s + w["chars"]).alias("formatted_chars"),
        F.size("w").alias("n_windows"),
    )
