"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation  level turn*
    level         "0" or "1", and a line feed
    turn          "[INST] " role line-feed text "</s>"

A conversation is first rendered as it is (level 0) and parsed again; where the recovered turns differ from the source,
its roles and texts are rendered with their control strings escaped (level 1), which the parser turns back. Escaped
texts hold no control string, so level 1 always comes back the same.

Edge cases: null roles and texts are empty; turns that share a number are ordered by role, then text; rows with a null
turn come first; repeated rows are repeated turns; conversations with a null id form one conversation; a very long
text is rendered and parsed whole, in one row, as a conversation is; other columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN, CLOSE, ASK, ANSWER = "[INST] ", "</s>", "[INST]", "[/INST]"
#: What stands for the escape sign and the control strings in a text. The first must be escaped first and restored last.
ESCAPES = (("\\", "\\b"), (CLOSE, "\\s"), (ASK, "\\i"), (ANSWER, "\\j"))
#: A line feed ends a role.
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
LOSS_ROLE = "assistant"


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: Column, level: int) -> Column:
    def turn(t: Column) -> Column:
        role, text = (escape(t["role"], ROLE_ESCAPES), escape(t["text"])) if level else (t["role"], t["text"])
        return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))

    each = F.transform(turns, turn)
    return F.concat(F.lit(f"{level}\n"), F.array_join(each, ""))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; null where it doesn't follow the grammar."""
    level = F.substring(formatted, 1, 1)
    body = F.substring(formatted, 3, 1 << 30)
    parts = F.split(body, r"</s>", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        role, text = F.substring(head, len(OPEN) + 1, 1 << 30), F.substring(x, F.length(head) + 2, F.length(x))
        return F.struct(
            F.when(level == "1", unescape(role, ROLE_ESCAPES)).otherwise(role).alias("role"),
            F.when(level == "1", unescape(text)).otherwise(text).alias("text"),
        )

    sound = F.forall(turns, lambda x: x.startswith(OPEN) & x.contains("\n") & ~F.substring(x, len(OPEN) + 1, 1 << 30).contains(ASK) & ~x.contains(ANSWER))
    return F.when(sound & (F.element_at(parts, -1) == ""), F.transform(turns, turn))


def format_chats(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, parsed): the text of each conversation and the turns that the parser recovers from it."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = conversations.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    source = source.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", render(F.col("turns"), 0))
    same = F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False))
    done = plain.withColumn("formatted", F.when(same, F.col("plain")).otherwise(render(F.col("turns"), 1)))
    return done.select("conv_id", "formatted", parse(F.col("formatted")).alias("parsed"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: turns, their digest, and the text under the loss mask."""
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
