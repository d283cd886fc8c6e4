"""Chat formatting in windows of a token budget, with DataFrame operations only.

Turns get a place in their conversation and the tokens before them from prefix sums over blocks of
turns. The line of tokens is cut into stretches of the budget: the turns that lie inside one stretch
are a span, a turn that reaches over an end is a span of its own. So spans need no pass from turn to
turn, and a conversation of any length is cut in parallel. A window is the system turn, the whole
turns of the last HISTORY tokens before the span, and the span. Only the span's assistant turns are
targets; history is masked, so each assistant turn is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.numbering import with_dense_ids
from linkloom.session import stage

# A turn counts as many tokens as it has bytes in UTF-8 with its control strings: no byte-level tokenizer
# makes more of it. So a window never has more than its budget by the tokenizer's own count; of plain
# English it has about a quarter.
BUDGET = 8192
HISTORY = 2048
BLOCK = 256  # turns
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No control string is left: ``<|`` becomes ``<\\|``, and the backslash is doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    """Also without line breaks, as one ends the role: they become ``\\n``."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Between doubled backslashes, a backslash begins one of the two other escapes."""
    parts = F.transform(
        F.split(role, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")),
    )
    return F.array_join(parts, "\\")


def _tokens(role: Column, text: Column) -> Column:
    """The bytes of a turn as it is written: the most tokens it can have."""
    written = F.concat(F.lit(START), escaped_role(role), F.lit("\n"), escaped(text), F.lit(f"{END}\n"))
    return F.octet_length(written).cast("long")


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text, tokens, and first and last rank of the conversation."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ranked = with_dense_ids(rows, ["conv_id", "turn", "role", "text"], "rank", start=0)
    extent = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    # one row for each block of ranks, so that no key of the join has more than BLOCK turns
    extent = extent.select(
        F.col("conv_id").alias("own"),
        "first",
        F.explode(F.sequence(F.shiftright("first", 8), F.shiftright("last", 8))).alias("rank_block"),
    )
    blocked = ranked.withColumn("of_block", F.shiftright("rank", 8))
    same = (blocked["of_block"] == extent["rank_block"]) & blocked["conv_id"].eqNullSafe(extent["own"])
    return blocked.join(extent, same).select(
        "conv_id",
        (F.col("rank") - F.col("first")).alias("place"),
        "role",
        "text",
        _tokens(F.col("role"), F.col("text")).alias("tokens"),
    )


def _with_prefix(placed: DataFrame) -> DataFrame:
    """Add begin: tokens of the conversation's turns before, without the system turn's."""
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    counted = placed.withColumn("is_system", is_system).withColumn(
        "counted", F.when(is_system, F.lit(0)).otherwise(F.col("tokens"))
    )
    counted = counted.withColumn("block", F.shiftright("place", 8))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("conv_id", "block").agg(F.sum("counted").alias("n"))
    blocks = blocks.select(
        F.col("conv_id").alias("own"),
        F.col("block").alias("own_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_begin"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = counted.withColumn("inside", F.coalesce(F.sum("counted").over(inside), F.lit(0)))
    same = (turns["block"] == blocks["own_block"]) & turns["conv_id"].eqNullSafe(blocks["own"])
    return turns.join(blocks, same).select(
        "conv_id", "place", "role", "text", "tokens", "is_system", "counted",
        (F.col("inside") + F.col("block_begin")).alias("begin"),
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_turns, n_repeated, n_tokens and loss spans of every window.

    ``turns``: conv_id, turn, role, text, a row a turn. ``window`` sorts the windows of a
    conversation. The first ``n_repeated`` turns of a window stand in an earlier one too. ``loss`` is
    an array of (begin, length) in code points of ``formatted``: the targets' texts. n_tokens is
    the bytes of ``formatted``, a bound of its tokens by any byte-level tokenizer. A window keeps to
    ``budget`` but for a single turn or a system turn that is longer than what is left of it. A null role or text is
    empty; turns with the same number are ordered by role and text, null numbers first; repeated
    rows are turns of their own; null conv_ids are one conversation. An empty table gives no rows.
    Other columns are not looked at.
    """
    least = budget // 4
    history = min(history, least)
    turns = stage(_with_prefix(_placed(turns)))
    # What a window of this conversation has for its span; system turns are one row a conversation.
    system = turns.where("is_system").select(
        F.col("conv_id").alias("own"), F.struct("role", "text").alias("system"), F.col("tokens").alias("system_tokens")
    )
    extent = turns.groupBy("conv_id").agg(F.max(F.shiftright("place", 8)).alias("last_block"))
    system = system.join(extent, F.col("own").eqNullSafe(F.col("conv_id"))).select(
        "own", "system", "system_tokens", F.explode(F.sequence(F.lit(0).cast("long"), "last_block")).alias("own_block")
    )
    system = stage(system)
    turns = turns.withColumn("block", F.shiftright("place", 8))
    sized = system.select("own", "own_block", "system_tokens")
    turns = turns.join(
        sized, (turns["block"] == sized["own_block"]) & turns["conv_id"].eqNullSafe(sized["own"]), "left"
    ).drop("own", "own_block")
    room = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(least)).cast("long")
    turns = turns.withColumn("room", room)
    stretch = F.floor(F.col("begin") / F.col("room"))
    over = F.floor((F.col("begin") + F.greatest("counted", F.lit(1)) - 1) / F.col("room")) > stretch
    turns = turns.withColumn("stretch", stretch).withColumn("over", over.cast("int"))

    # History: turns that end within ``history`` tokens before the span begins.
    spans = turns.groupBy("conv_id", "stretch", "over").agg(
        F.min("begin").alias("span_begin"), F.min("place").alias("span_place")
    )
    spans = spans.withColumnsRenamed({"conv_id": "span_conv", "stretch": "span_stretch", "over": "span_over"})
    turn = F.struct("place", "role", "text", F.lit(True).alias("own"), "tokens")
    own = turns.select("conv_id", "stretch", "over", turn.alias("turn"))
    past = turns.where(~F.col("is_system")).select(
        "conv_id", "place", "role", "text", "tokens", "begin", "room",
        F.explode(F.array_distinct(F.array("stretch", F.floor((F.col("begin") + history) / F.col("room"))))).alias("to"),
    )
    repeated = past.join(
        spans,
        past["conv_id"].eqNullSafe(spans["span_conv"])
        & (F.col("to") == F.col("span_stretch"))
        & (F.col("begin") + F.col("tokens") <= F.col("span_begin"))
        & (F.col("begin") + history >= F.col("span_begin"))
        & (F.col("place") < F.col("span_place")),
    ).select(
        "conv_id", F.col("span_stretch").alias("stretch"), F.col("span_over").alias("over"),
        F.struct("place", "role", "text", F.lit(False).alias("own"), "tokens").alias("turn"),
    )
    grouped = own.unionByName(repeated).groupBy("conv_id", "stretch", "over").agg(
        F.sort_array(F.collect_list("turn")).alias("turns")
    )
    grouped = grouped.withColumn("block", F.shiftright(F.get("turns", F.lit(0))["place"], 8))
    grouped = grouped.join(
        system, (grouped["block"] == system["own_block"]) & grouped["conv_id"].eqNullSafe(system["own"]), "left"
    )
    has_own = F.get("turns", F.lit(0))["place"] == 0
    kept = F.struct(
        F.lit(0).cast("long").alias("place"), F.col("system.role").alias("role"), F.col("system.text").alias("text"),
        F.lit(False).alias("own"), F.col("system_tokens").alias("tokens"),
    )
    all_turns = F.when(F.col("system").isNull() | has_own, F.col("turns")).otherwise(F.concat(F.array(kept), "turns"))
    # The order of windows is that of their first own turn.
    first = F.array_min(F.transform(F.filter("turns", lambda t: t["own"]), lambda t: t["place"]))
    return _formatted(grouped.select("conv_id", first.alias("window"), all_turns.alias("turns")))


def _formatted(grouped: DataFrame) -> DataFrame:
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["own"] & (t["role"] == "assistant")).alias("target"),
        ),
    )
    tail = f"{END}\n"
    rows = grouped.select(
        "conv_id",
        "window",
        pieces.alias("pieces"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )
    empty = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans")
    )

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        length = F.length(p["body"]).cast("long")
        span = F.struct(begin.cast("long").alias("begin"), length.alias("length"))
        spans = F.when(p["target"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + length + len(tail)).cast("long").alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return rows.select(
        "conv_id",
        "window",
        text.alias("formatted"),
        "n_turns",
        "n_repeated",
        "n_tokens",
        F.aggregate("pieces", empty, step)["spans"].alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """role and text of every turn of a formatted window, from its control strings alone."""
    segments = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(
        segments,
        lambda s: F.struct(
            unescaped_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescaped(
                F.substr(s, F.instr(s, F.lit("\n")) + 1, F.length(s) - F.instr(s, F.lit("\n")) - len(END) - 1)
            ).alias("text"),
        ),
    )


def read_targets(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["begin"] + 1).cast("int"), s["length"].cast("int"))))


def digests(written: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, their digest, targets, their digest.

    Each digest is one SHA-256 over the whole conversation, as its definition asks; the windows it is
    made from are not bounded in number, only here.
    """
    fresh = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.col("n_turns"), F.lit(1)))
    turns = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = written.select(
        "conv_id",
        "window",
        (F.col("n_turns") - F.col("n_repeated")).cast("long").alias("n"),
        turns.alias("turns"),
        F.array_join(read_targets(F.col("formatted"), F.col("loss")), "").alias("targets"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    joined = joined.select(
        "conv_id",
        "n_turns",
        F.array_join("parts.turns", "").alias("turns"),
        F.array_join("parts.targets", "").alias("targets"),
        "formatted_chars",
    )
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
    )
