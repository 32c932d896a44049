"""Chat formatting: conversations as training windows under a token budget, with a loss mask. DataFrame functions only.

A turn is ``<s>``, a marker of its role, its text and ``</s>``. Prefix sums of the turns' tokens choose windows greedily: a window
takes turns, whole ones, as long as its tokens stay within the budget. Each window but the first repeats the system turn and a few
turns before its own, as far as they fit. The loss mask, spans of code points, covers the texts of assistant turns that are new in
the window, so each of them is learned once.

A conversation is worked on in segments of consecutive turn numbers, so one of a hundred million turns is many groups, not one; the
turns at a segment's end go to the next segment too, as its history, and the system turn to all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY_TOKENS, HISTORY_TURNS = 128, 3
SEGMENT_TURNS = 256
#: Tokens that the markers of a turn count for.
MARKER_TOKENS = 4
#: Tokens of a text: runs of up to six ASCII letters or digits, and each other character that is no white space.
TOKEN = r"[A-Za-z0-9]{1,6}|[^A-Za-z0-9\x20\x09-\x0D]"
#: Ids of conversations of several segments that are broadcast; beyond, every conversation is treated as one of several.
MOST_IDS = 500_000

MARKERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
OPEN, CLOSE = "<s>", "</s>"
#: Turn number of a system turn that stands at the start of a later segment.
HEAD = -2
#: What follows the first character of a control string: these and the ends of a named role, ``[ROLE]x[/ROLE]``.
_REST = r"/?(?:s>|SYS\]|INST\]|ROLE\])"


def escaped(text: Column) -> Column:
    """``text`` without any control string: backslashes are doubled, and one follows the first character of a control string. As
    control strings hold no backslash, none can arise anew, and :func:`unescaped` gives the text back."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={_REST})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _marker(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]"))
    for name, marker in MARKERS.items():
        out = F.when(role == name, F.lit(marker)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + MARKER_TOKENS


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    return conversations.select(F.col("conv_id").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.greatest(F.floor(turn / SEGMENT_TURNS), F.lit(0)).cast("long").alias("segment"))


def _spread(turns: DataFrame) -> DataFrame:
    """(conv_id, first): conversations with a turn beyond the first segment, and number and role of their first turn."""
    return turns.groupBy("conv_id").agg(F.max("segment").alias("last"), F.min(F.struct("turn", "role")).alias("first")).where("last > 0").drop("last")


def _heads(turns: DataFrame) -> DataFrame:
    """The system turns of conversations of several segments, once for each of their segments but the first."""
    spread = _spread(turns).where("first.role = 'system'").select(F.col("conv_id").alias("c"), "first.turn")
    known = turns.where("role = 'system'").withColumnRenamed("turn", "t")
    texts = known.join(spread, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("t") == F.col("turn"))).groupBy("conv_id").agg(F.min("text").alias("text"))
    segments = turns.where("segment > 0").select(F.col("conv_id").alias("c"), "segment").distinct()
    each = segments.join(texts, F.col("conv_id").eqNullSafe(F.col("c")))
    return each.select("conv_id", F.lit(HEAD).cast("long").alias("turn"), F.lit("system").alias("role"), "text", "segment", F.lit(True).alias("again"))


def windows(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row for each window: conv_id, segment, window (numbers in order), text, loss (array of start and end, code points, end
    exclusive), n_turns, n_repeated (those at its start that an earlier window holds), tokens, over_budget.

    ``conversations``: conv_id, turn, role, text; other columns are ignored. Turns follow their number, ties role and text; repeated
    rows are turns each. Null text and role are empty, a null turn comes first, rows of a null conv_id are one conversation. The
    system turn is the first turn if its role is system; others are turns like any. A turn that is over the budget alone is a window
    without history, marked ``over_budget``. Turn numbers are taken to be consecutive, as segments are cut by them: gaps only make
    windows shorter. An empty table gives no rows.
    """
    turns = _turns(conversations)
    at_end = (F.col("turn") + 1) - (F.col("segment") + 1) * SEGMENT_TURNS > -history_turns
    own = turns.withColumn("again", F.lit(False))
    carried = turns.where(at_end & F.lit(history_turns > 0)).withColumns({"segment": F.col("segment") + 1, "again": F.lit(True)})
    rows = own.unionByName(carried).unionByName(_heads(turns))
    marker = _marker(F.col("role"))
    text = escaped(F.col("text"))
    rows = rows.select("conv_id", "segment", "turn", "again", "role", (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"), token_count(F.col("text")).alias("tokens"), F.concat(F.lit(OPEN), marker, text, F.lit(CLOSE)).alias("shown"), F.length(F.concat(F.lit(OPEN), marker)).alias("lead"))

    # Prefix sums, in tokens and in characters, of a segment's turns.
    order = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "shown")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"at": F.row_number().over(order) - 1, "after": F.sum("tokens").over(upto), "chars_after": F.sum(F.length("shown").cast("long")).over(upto)})
    rows = rows.withColumns({"headed": F.first(F.col("system") & ((F.col("turn") == HEAD) | (F.col("segment") == 0))).over(upto), "head_tokens": F.first("tokens").over(upto)})
    before, head = F.col("after") - F.col("tokens"), F.when(F.col("headed"), F.col("head_tokens")).otherwise(0)
    room = F.least(F.lit(history_tokens), budget - head - F.col("tokens"))
    # before of the turn k places earlier; a turn is history if it isn't the head and all from it on fit.
    fits = [F.coalesce((F.col("at") - k >= F.col("headed").cast("int")) & (before - (F.lag("after", k).over(order) - F.lag("tokens", k).over(order)) <= room), F.lit(False)) for k in range(1, history_turns + 1)]
    back = sum((f.cast("int") for f in fits), F.lit(0))
    rows = rows.withColumn("back", back).withColumn("turn_", F.struct("at", "again", "target", "tokens", "after", "chars_after", "headed", "back", "lead", "shown"))
    groups = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("turn_")).alias("turns"))

    at = lambda i: F.element_at("turns", i + 1)
    first = at(F.lit(0))
    head_tokens = F.when(first["headed"], first["tokens"]).otherwise(F.lit(0))
    begin = lambda e: e["after"] - e["tokens"]
    none = F.array().cast("array<struct<own:int,from:int>>")
    state = F.struct(none.alias("starts"), F.lit(0).cast("long").alias("base"))

    def step(s, e):
        """A new window if the turn doesn't fit; its base is where its history begins, less the head."""
        start = F.struct(e["at"].alias("own"), (e["at"] - e["back"]).alias("from"))
        whole = e["at"] == 0
        base = F.when(whole, F.lit(0).cast("long")).otherwise(begin(F.element_at("turns", e["at"] - e["back"] + 1)) - head_tokens).cast("long")
        opens = (F.size(s["starts"]) == 0) | (e["after"] - s["base"] > budget)
        opened = F.struct(F.array_append(s["starts"], start).alias("starts"), base.alias("base"))
        return F.when(~e["again"] & opens, opened).otherwise(s)

    groups = groups.select("conv_id", "segment", "turns", F.aggregate("turns", state, step, lambda s: s["starts"]).alias("starts"))

    def window(s, k):
        end = F.coalesce(F.get("starts", k + 1)["own"], F.size("turns"))
        headed = first["headed"] & (s["own"] > 0)
        parts = F.slice("turns", s["from"] + 1, end - s["from"])
        head = F.when(headed, first["shown"]).otherwise(F.lit(""))
        shift = F.when(headed, F.length(first["shown"]).cast("long")).otherwise(F.lit(0).cast("long")) - (at(s["from"])["chars_after"] - F.length(at(s["from"])["shown"]))
        targets = F.filter(parts, lambda e: e["target"] & (e["at"] >= s["own"]))
        start = lambda e: e["chars_after"] - F.length(e["shown"]) + e["lead"] + shift
        spans = F.transform(targets, lambda e: F.struct(start(e).alias("start"), (e["chars_after"] - len(CLOSE) + shift).alias("end")))
        repeated = s["own"] - s["from"] + headed.cast("int")
        tokens = at(end - 1)["after"] - begin(at(s["from"])) + F.when(headed, first["tokens"]).otherwise(F.lit(0))
        return F.struct(k.alias("window"), F.concat(head, F.array_join(F.transform(parts, lambda e: e["shown"]), "")).alias("text"), spans.alias("loss"), (end - s["own"] + repeated).alias("n_turns"), repeated.alias("n_repeated"), tokens.alias("tokens"), (tokens > budget).alias("over_budget"))

    return groups.select("conv_id", "segment", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "segment", "w.*")


def turns_of(formatted: DataFrame, new_only: bool = True) -> DataFrame:
    """``formatted``, as :func:`windows` gives it, with ``turns`` (array of role and text) and ``learned`` (array of text) read back
    from its text and mask; without the repeated turns if ``new_only``."""
    skip = F.col("n_repeated") if new_only else F.lit(0)
    pieces = F.slice(F.split("text", re.escape(CLOSE), -1), skip + 1, F.col("n_turns") - skip)

    def turn(piece):
        named = rf"(?s)^{OPEN}\[ROLE\](.*?)\[/ROLE\](.*)$"
        role, text = unescaped(F.regexp_extract(piece, named, 1)), F.regexp_extract(piece, named, 2)
        for name, marker in MARKERS.items():
            own, n = F.startswith(piece, F.lit(OPEN + marker)), len(OPEN + marker)
            role, text = F.when(own, F.lit(name)).otherwise(role), F.when(own, piece.substr(F.lit(n + 1), F.length(piece))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    learned = F.transform("loss", lambda s: unescaped(F.col("text").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "learned": learned})


def digest(conversations: DataFrame, formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_windows. A digest needs its conversation as one string, of 2 GB at most; the windows don't.

    Strings of conversations of one segment are hashed where they are; only those of others are shuffled by conversation.
    """
    spread = _spread(_turns(conversations)).select(F.col("conv_id").alias("c"))
    n = spread.limit(MOST_IDS + 1).count()
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = turns_of(formatted).select("conv_id", "segment", "window", listed.alias("said"), F.array_join("learned", "").alias("learned"), F.length("text").cast("long").alias("chars"), F.size("turns").cast("long").alias("n"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    parts = parts.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("parts"), F.sum("chars").alias("chars"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows"))
    parts = parts.select("conv_id", "segment", "chars", "n", "windows", joined("said").alias("said"), joined("learned").alias("learned"))
    if 0 < n <= MOST_IDS:
        parts = parts.join(F.broadcast(spread.withColumn("several", F.lit(True))), F.col("conv_id").eqNullSafe(F.col("c")), "left")
        alone = F.col("several").isNull()
    else:
        alone = F.lit(n == 0)
    own = [F.when(alone, F.sha2(c, 256)).alias(f"{c}_sha") for c in ("said", "learned")]
    kept = F.when(~alone, F.struct("segment", "said", "learned"))
    parts = parts.select("conv_id", "chars", "n", "windows", F.length("learned").cast("long").alias("loss"), *own, kept.alias("part"))
    whole = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("chars", "n", "windows", "loss")], F.max("said_sha").alias("said_sha"), F.max("learned_sha").alias("learned_sha"), F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.col("n").alias("n_turns"), F.coalesce("said_sha", F.sha2(joined("said"), 256)).alias("turns_sha256"), F.col("loss").alias("loss_chars"), F.coalesce("learned_sha", F.sha2(joined("learned"), 256)).alias("loss_sha256"), F.col("chars").alias("formatted_chars"), F.col("windows").alias("n_windows"))
