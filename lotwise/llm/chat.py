"""Chat formatting: conversations rebuilt from event logs and rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The template. A turn of the assistant is `<s>text</s>`, any other is `[INST] role\ntext [/INST]`.
TARGET = "assistant"
OPEN, CLOSE = "[INST] ", " [/INST]"
TARGET_OPEN, TARGET_CLOSE = "<s>", "</s>"

# Control strings, with any backslashes that escaping has put inside.
_CONTROL = r"(</?|\[/?)(\\*)(s>|INST\])"
_ESCAPED = r"(</?|\[/?)\\(\\*)(s>|INST\])"
_TURN = r"(?s)\[INST\] (?:[^\n]*)\n(?:.*?) \[/INST\]|<s>(?:.*?)</s>"


def escape(text: Column) -> Column:
    """Put a backslash into every control string, and one more into those that have some."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The text before ``escape``."""
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def escape_role(role: Column) -> Column:
    """A role as one line without control strings."""
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("[", "%5B"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("[", "%5B"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of event logs: conv_id, turn, role, text.

    ``events`` has conv_id, seq (order within the conversation), turn (the message it is about),
    kind, role and text. Kinds: ``message`` begins a message with a text, ``delta`` adds to it,
    ``edit`` replaces it, ``regenerate`` begins it again and voids everything said so far in later
    turns. Null text counts as empty, null role as the empty role; events of one seq are taken in
    the order message, regenerate, edit, delta, then by text. Several ``message`` events of one turn
    and seq are repeated rows and stay separate messages, by role and text. Deltas with nothing
    before them begin a message.
    """
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    log = events.select("conv_id", "seq", "turn", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Voided: a later regeneration of an earlier turn, found walking the log backwards.
    back = Window.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("rank").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    again = F.min(F.when(F.col("rank") == 1, F.col("turn"))).over(back)
    log = log.withColumn("again", again).where(F.col("again").isNull() | F.col("turn").isNull() | (F.col("turn") <= F.col("again")))
    # A message starts afresh at its last text-setting event; earlier ones give it only its role.
    own = Window.partitionBy("conv_id", "turn")
    fresh = F.max(F.when(F.col("rank") < 3, F.struct("seq", "rank"))).over(own)
    log = log.withColumn("fresh", fresh).withColumn("at", F.struct("seq", "rank"))
    first = F.min(F.struct("seq", "rank", "role")).over(own)["role"]
    log = log.withColumn("role", F.when(F.col("rank") == 0, F.col("role")).otherwise(first))
    log = log.where(F.col("fresh").isNull() | (F.col("at") >= F.col("fresh")))
    # Repeated message rows of one place are told apart by role and text.
    copy = F.when(F.col("rank") == 0, F.row_number().over(Window.partitionBy("conv_id", "turn", "rank").orderBy("role", "text"))).otherwise(1)
    parts = log.withColumn("copy", copy).groupBy("conv_id", "turn", "copy").agg(
        F.min(F.struct("seq", "rank", "role"))["role"].alias("role"), F.sort_array(F.collect_list(F.struct("seq", "rank", "text"))).alias("parts")
    )
    return parts.select("conv_id", "turn", "copy", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted and the spans of ``formatted`` under the loss.

    Messages are sorted by turn, then role and text. A span is (start, length) in code points and
    holds an escaped assistant text without its marks. A conversation is one text, so its rows meet
    in one row of the result.
    """
    target = F.col("role") == TARGET
    piece = F.when(target, F.concat(F.lit(TARGET_OPEN), escape(F.col("text")), F.lit(TARGET_CLOSE))).otherwise(
        F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    )
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = messages.withColumn("piece", piece).withColumn("size", F.length("piece"))
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(own), F.lit(0)))
    span = F.when(target, F.struct((F.col("start") + len(TARGET_OPEN)).alias("start"), (F.col("size") - len(TARGET_OPEN) - len(TARGET_CLOSE)).alias("length")))
    # Rows of equal start are empty of text only if equal, so the order is the one of the window.
    rows = placed.select("conv_id", F.struct("start", "turn", "role", "text", "piece").alias("row"), span.alias("span"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return packed.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of rendered conversations, read from the text alone and from its mask.

    Adds turns (array of role and text) and loss_text (what the spans cover, unescaped).
    """
    turns = F.transform(
        F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)),
        lambda t: F.when(
            t.startswith(OPEN),
            F.struct(
                unescape_role(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
                unescape(F.substr(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(CLOSE))).alias("text"),
            ),
        ).otherwise(
            F.struct(F.lit(TARGET).alias("role"), unescape(F.substr(t, F.lit(len(TARGET_OPEN) + 1), F.length(t) - len(TARGET_OPEN) - len(TARGET_CLOSE))).alias("text"))
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


def digest_columns(read: DataFrame) -> DataFrame:
    """One row of figures and digests per conversation that was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
