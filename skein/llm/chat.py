"""Chat formatting in budgeted windows, by DataFrame functions only.

Turns are laid out in order; prefix sums of their tokens put each turn into the span that its end falls into, so spans are
aligned to turns and hold at most ``budget`` tokens together with the retained system turn and the repeated history (a turn that
alone is larger gets a span and the ``over_budget`` mark). A window is a span's new turns, before them up to ``HISTORY`` earlier
turns of limited size, and in front the conversation's system turn. Only a new assistant turn is under the loss mask, so each
target counts once; repeated ones are masked.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; a line
break in a role becomes ``<\\n|``. So no text can hold a mark, and reading back is exact.

Defined cases: a null text or role is empty; a null conv_id is one conversation; equal turn numbers go by role, then text;
repeated rows are turns of their own; an empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2
HISTORY_TOKENS = 128
MARKS = 4  # tokens that a turn's marks and role take

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n|"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """Words and single marks of a text: the unit of the budget."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) + MARKS


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window, formatted, turns (rank, repeated), loss (start, stop in code points of formatted), n_tokens, over_budget."""
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", tokens(F.col("text")))
    rows = rows.select(
        "*",
        (F.row_number().over(order) - 1).alias("rank"),
        F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head_size = F.first(F.when(F.col("role") == "system", F.col("tokens"))).over(whole)
    rows = rows.select("*", head_size.alias("head_size"))
    core = F.greatest(F.lit(budget - history_tokens) - F.coalesce("head_size", F.lit(0)), F.lit(2))
    # a turn of over half the room is a span of its own; the others share cells of a grid that leaves room for the longest of them
    rows = rows.withColumn("core", core).withColumn("large", 2 * F.col("tokens") > F.col("core"))
    rows = rows.withColumn("longest", F.coalesce(F.max(F.when(~F.col("large"), F.col("tokens"))).over(own), F.lit(0)))
    cell = F.floor((F.col("upto") - 1) / (F.col("core") - F.col("longest"))).alias("cell")
    rows = rows.select("*", cell, (F.col("upto") - F.col("tokens")).alias("before"))
    last = F.lag(F.struct("cell", "large")).over(order)
    rows = rows.withColumn("opens", F.coalesce(F.col("large") | last["large"] | (last["cell"] != F.col("cell")), F.lit(True)))
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    leads = [F.lead(F.struct("opens", "window", "before"), j).over(order).alias(f"next{j}") for j in range(1, history + 1)]
    rows = rows.select("*", *leads, F.first(F.struct("role", "text")).over(whole).alias("head"))
    # the system turn goes where a later window opens, unless it is among the repeated turns already
    as_history = (F.col("rank") <= history) & (F.col("before") <= history_tokens)
    needs = F.col("opens") & F.col("head_size").isNotNull() & (F.col("rank") > 0) & ~as_history
    rows = rows.withColumn("head", F.when(needs, F.col("head")))
    place = lambda window, repeated, rank: F.struct(window.alias("window"), F.lit(repeated).alias("repeated"), rank.alias("rank"))
    to = [place(F.col("window"), False, F.col("rank"))]
    for j in range(1, history + 1):  # the windows that repeat a turn: those that open within the next ``history`` turns
        n = F.col(f"next{j}")
        ok = n["opens"] & (n["window"] != F.col("window")) & (n["before"] - F.col("before") <= history_tokens)
        to.append(F.when(ok, place(n["window"], True, F.col("rank"))))
    to.append(F.when(F.col("head").isNotNull(), place(F.col("window"), True, F.lit(-1))))
    placed = rows.withColumn("to", F.explode(F.array_compact(F.array(*to))))
    of_head = F.col("to.rank") < 0
    role, text = F.when(of_head, F.col("head.role")).otherwise(F.col("role")), F.when(of_head, F.col("head.text")).otherwise(F.col("text"))
    size = F.when(of_head, F.col("head_size")).otherwise(F.col("tokens"))
    lead_in = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turn = F.struct(
        F.col("to.rank").alias("rank"), F.col("to.repeated").alias("repeated"), size.alias("tokens"), lead_in.alias("lead_in"), escape(text).alias("body"),
        ((role == "assistant") & ~F.col("to.repeated")).alias("target"),
    )
    made = placed.groupBy("conv_id", F.col("to.window").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    start_state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("loss"))

    def lay(a, x):
        begin = a["at"] + F.length(x["lead_in"])
        stop = begin + F.length(x["body"])
        span = F.struct(begin.alias("start"), stop.alias("stop"))
        return F.struct((stop + len(END)).alias("at"), F.when(x["target"], F.array_append(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    n_tokens = F.aggregate("t", F.lit(0), lambda a, x: a + x["tokens"])
    return made.select(
        "conv_id",
        "window",
        F.array_join(F.transform("t", lambda x: F.concat(x["lead_in"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["rank"].alias("rank"), x["repeated"].alias("repeated"))).alias("turns"),
        F.aggregate("t", start_state, lay)["loss"].alias("loss"),
        n_tokens.alias("n_tokens"),
        (n_tokens > budget).alias("over_budget"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted windows: the turns, what is under the loss mask, and sizes."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    zipped = F.filter(F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("raw"), F.col("turns").alias("turn")), lambda x: ~x["turn"]["repeated"])

    def read(x):
        raw = F.substr(x["raw"], F.lit(len(START) + 1))
        role = F.substring_index(raw, "\n", 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substr(raw, F.length(role) + 2)), F.lit("\n"))

    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    window = F.struct(
        "window", F.size(zipped).alias("n"), F.array_join(F.transform(zipped, read), "").alias("turns"), F.array_join(targets, "").alias("loss"), F.length("formatted").alias("chars")
    )
    rows = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(window)).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[name])
    return rows.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
