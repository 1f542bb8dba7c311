"""Chat formatting from event logs.

A conversation is a log of events (conv_id, turn, seq, kind, role, text):

    message, edit   the turn's text is this from here on
    regenerate      the turn's text so far is void; this text, if any, begins the new one
    delta           this text is appended

The log is partitioned by conversation (long ones by blocks of PART_TURNS turns), sorted by sequence, and folded into
final messages, which are rendered with a template that marks turns. Control strings inside texts and roles are escaped
reversibly, so that the rendered string can be split and read back whatever users typed.

A table of finished turns becomes a log first: a draft that is edited, or one that is regenerated and streamed again as
deltas without a role, so that the same fold makes its messages.

A long conversation is never gathered in one task while it is folded and rendered. Output rows are parts of a
conversation, in order of `part`: (block of PART_TURNS turns, turn, bucket). Where a block's turns are repeated so often
that it has more than CROWDED messages, each of its turns is dealt to buckets by a hash of role and text, and these are
parts of their own; only equal messages of one turn stay together.

Native: DataFrame functions only.

Defined results: null text is empty; a message has the last role that is not null in its log, and the empty one if there
is none; a null conv_id is a conversation of its own; a null turn comes first (block -1); events of one turn with equal seq
are taken in the order of kind, role and text; messages that repeat a turn come in the order of role and text, in crowded
blocks by bucket before; a kind that is none of these four, or null, is an error; a log without rows gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.session import materialize

#: Turns to a part, messages of a block from which on its turns are dealt to buckets, code points to a streamed delta.
PART_TURNS, CROWDED, DELTA = 256, 1024, 256
#: The template's marks; every one of them begins with "<|", which no escaped text contains.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Beginnings of control strings, ours and those of common templates: "<|", "<s>", "</s>", "[INST]", "[/INST]".
CONTROL = r"<(?=\||s>|/s>)|\[(?=/?INST\])"
EVENT_KINDS = ("message", "edit", "regenerate", "delta")
EVENT = "struct<seq:bigint,kind:string,role:string,text:string>"


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_from_turns(rows: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log, with message and salt.

    Every row is a message of its own: `message` tells rows that repeat a turn apart, `salt` is the hash of role and text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    event = lambda seq, kind, role, said: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), said.cast("string").alias("text"))
    draft, none = F.concat(F.substring(text, 1, 24), F.lit(" ...")), F.lit(None)
    edited = F.array(event(0, "message", F.col("role"), draft), event(1, "edit", none, text))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda x, i: F.struct((i + 2).cast("bigint").alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), x.alias("text")))
    streamed = F.concat(F.array(event(0, "message", F.col("role"), draft), event(1, "regenerate", none, none)), deltas)
    salt = F.xxhash64("role", text)
    log = F.when(F.pmod(salt, F.lit(2)) == 0, edited).otherwise(streamed)
    out = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.monotonically_increasing_id().alias("message"), salt.alias("salt"), log.alias("log"))
    return out.select("conv_id", "turn", "message", "salt", F.explode("log").alias("e")).select("conv_id", "turn", "message", "salt", "e.*")


def crowded_turns(messages: DataFrame) -> DataFrame:
    """conv, at, buckets for the turns of blocks with more than CROWDED messages. messages: conv_id, turn, a row each.

    The table is written, so that its size is known where it is joined: it goes to all tasks if it is small.
    """
    turns = messages.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    blocks = turns.groupBy("conv_id", block_of("turn").alias("block")).agg(F.sum("n").alias("all"), F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("at"), "n")).alias("turns"))
    out = blocks.where(F.col("all") > CROWDED).select(F.col("conv_id").alias("conv"), F.explode("turns").alias("t"))
    return materialize(out.select("conv", "t.at", F.ceil(F.col("t.n") / PART_TURNS).cast("bigint").alias("buckets")), "crowded-turns")


def block_of(turn: str) -> Column:
    return F.coalesce(F.floor(F.col(turn) / PART_TURNS), F.lit(-1)).cast("bigint")


def with_part(events: DataFrame, crowded: DataFrame) -> DataFrame:
    """events with part, dealt by conversation and part: one exchange serves the fold and the rendering."""
    own = events.join(crowded, events["conv_id"].eqNullSafe(crowded["conv"]) & (F.coalesce(events["turn"], F.lit(-1)) == crowded["at"]), "left")
    dealt = F.col("buckets").isNotNull()
    part = F.struct(
        block_of("turn").alias("block"), F.when(dealt, F.coalesce("turn", F.lit(-1))).alias("turn"),
        F.when(dealt, F.pmod("salt", "buckets")).otherwise(F.lit(0)).cast("bigint").alias("bucket"),
    )
    return own.withColumn("part", part).drop("conv", "at", "buckets").repartition("conv_id", "part")


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, part, turn, message, role, text) of a log with parts."""
    known = F.when(F.col("kind").isin(*EVENT_KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))).cast("string"))
    event = F.struct("seq", known.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind") != "delta"
    log = events.groupBy("conv_id", "part", "turn", "message").agg(F.array_sort(F.collect_list(event)).alias("log"), F.max(F.when(resets, event)).alias("reset"))
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.select(
        "conv_id", "part", "turn", "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_spans (code points in formatted: start, end exclusive)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    one = messages.select(
        "conv_id", "part",
        F.struct(
            "turn", F.col("role").alias("by"), F.col("text").alias("said"), F.concat(head, text, F.lit(END)).alias("body"),
            F.char_length(head).alias("from"), F.char_length(text).alias("length"), (F.col("role") == loss_role).alias("loss"),
        ).alias("m"),
    )
    parts = one.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    sizes = F.transform("ms", lambda m: F.char_length(m["body"]))
    before = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x)
    spans = F.transform(
        F.filter(F.transform("ms", lambda m, i: F.struct(m["loss"].alias("loss"), (before(i) + m["from"]).alias("start"), (before(i) + m["from"] + m["length"]).alias("end"))), lambda s: s["loss"]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )
    return parts.withColumn("sizes", sizes).select(
        "conv_id", "part", F.size("ms").cast("long").alias("n_turns"),
        F.array_join(F.transform("ms", lambda m: m["body"]), "").alias("formatted"), spans.alias("loss_spans"),
    )


def format_events(events: DataFrame, loss_role: str = "assistant", messages: DataFrame | None = None) -> DataFrame:
    """From a log (conv_id, turn, seq, kind, role, text) to rendered parts.

    A log whose turns hold several messages has columns message and salt too, and messages: conv_id and turn of each.
    """
    several = messages is not None
    log = events.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("seq").cast("bigint").alias("seq"), "kind", "role", "text",
        *(F.col(c) if several else F.lit(0).cast("bigint").alias(c) for c in ("message", "salt")),
    )
    if not several:  # a block has one message a turn at most
        messages = log.select("conv_id", "turn").limit(0)
    return render(fold_messages(with_part(log, crowded_turns(messages))), loss_role)


def format_turns(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """From finished turns (conv_id, turn, role, text) to rendered parts, by way of a log."""
    return format_events(events_from_turns(rows), loss_role, rows.select("conv_id", F.col("turn").cast("bigint").alias("turn")))


def read_back(parts: DataFrame) -> DataFrame:
    """Split rendered parts again: conv_id, part, turns (array of role and text, unescaped), formatted, loss_spans."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )
    return parts.withColumn("turns", turns)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, rendered, read back and digested."""
    trick = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", trick), (-7, 1, "assistant", trick)], "conv_id bigint, turn bigint, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    parts = read_back(format_turns(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    slim = parts.select("conv_id", F.struct("part", said.alias("said"), masked.alias("masked")).alias("p"), F.size("turns").cast("long").alias("n"), F.char_length("formatted").cast("long").alias("chars"))
    # A digest needs its whole conversation in one value; nothing else does.
    whole = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.transform("ps", lambda p: p[field]), "")
    return whole.withColumn("masked", joined("masked")).select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars",
    )


#: formatted_chars: per turn the marks' 23 characters, role and text, one more for each backslash and control string.
OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(24 + length(role) + length(text)
      + length(regexp_replace(role || chr(1) || text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(role || chr(1) || text, '<\||<s>|</s>|\[/?INST\]')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
