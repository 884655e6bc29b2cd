"""Chat formatting with DataFrame expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one block with one role
header, in which a mark keeps the single turns apart. So the output is one string a conversation, plus the byte spans
of it that carry loss (each assistant turn's text). Every control string that a text may hold is broken by a backslash
after its first character, and backslashes themselves are doubled; ``unescape`` reverses both.

Defined cases: a null text is an empty text; a null role is an empty role; turns are ordered by turn (null first), then
role, then text, so that ties and repeated rows have one order, and each of them stays a turn of its own; columns other
than the four named ones are ignored, whatever they are called; an empty table gives no conversations. A conversation is
one row of the result, so all its texts together, escaped, must stay below the 2 GB that a string can hold; a null
conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

OPEN, MARK, CLOSE = "<|im_start|>", "<|im_turn|>", "<|im_end|>"
#: What a text must not contain unbroken (control strings of common chat templates).
CONTROL = r"([<\[])(?=\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>|/?bos>|/?eos>|start_of_turn>|end_of_turn>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """Roles stand in a header line: percent signs, line ends and opening brackets are percent-encoded."""
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("[", "%5B"), ("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _starts(widths: Column, kind: str = "array<bigint>", chunk: int = 256) -> Column:
    """Running sums before each element, made in chunks so that no long array is copied once per element."""
    firsts = F.when(F.size(widths) > 0, F.sequence(F.lit(1), F.size(widths), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
    run = lambda start, items: F.aggregate(items, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), lambda a, w: F.struct((a["at"] + w).alias("at"), _append(a["out"], a["at"]).alias("out")))["out"]
    totals = F.transform(firsts, lambda f: F.aggregate(F.slice(widths, f, chunk), F.lit(0).cast("long"), lambda a, w: a + w))
    begins = run(F.lit(0).cast("long"), totals)
    return F.flatten(F.zip_with(firsts, begins, lambda f, b: run(b, F.slice(widths, f, chunk))))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start, length>> in UTF-8 bytes of ``formatted``.

    Texts are escaped row by row before the shuffle, so a long conversation costs its one task only a sort and a
    concatenation. A block is ``<|im_start|>role\\n`` + texts joined by ``<|im_turn|>`` + ``<|im_end|>\\n``.
    """
    name, body = F.coalesce(named(role), F.lit("")), F.coalesce(named(text), F.lit(""))
    rows = turns.select(named(conv_id).alias("conv_id"), F.struct(named(turn).alias("turn"), name.alias("role"), body.alias("text"), escape(body).alias("body")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def lead(t: Column, i: Column) -> Column:
        """What stands before a turn's text: a mark inside a block, else the end of the last block and a header."""
        first = F.concat(F.when(i > 0, F.lit(CLOSE + "\n")).otherwise(F.lit("")), F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
        return F.when((i > 0) & (F.get(F.col("ts"), i - 1)["role"] == t["role"]), F.lit(MARK)).otherwise(first)

    chats = chats.select("conv_id", F.transform("ts", lambda t, i: F.struct(lead(t, i).alias("lead"), t["body"].alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))).alias("parts"))
    chats = chats.withColumn("starts", _starts(F.transform("parts", lambda p: (F.octet_length(p["lead"]) + F.octet_length(p["body"])).cast("long"))))
    spans = F.transform(F.arrays_zip("parts", "starts"), lambda x: F.when(x["parts"]["loss"], F.struct((x["starts"] + F.octet_length(x["parts"]["lead"])).alias("start"), F.octet_length(x["parts"]["body"]).cast("long").alias("length"))))
    return chats.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE + "\n")).alias("formatted"),
        F.array_compact(spans).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that ``formatted`` holds: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, f"\\Q{CLOSE}\\E\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substring(head, len(OPEN) + 1, 1 << 30))
        texts = F.split(F.substring(block, F.length(head) + 2, F.lit(1 << 30)), f"\\Q{MARK}\\E", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask: array<string>."""
    data = F.encode(formatted, "UTF-8")
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
