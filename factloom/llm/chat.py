"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds an ordered array of parts: text, image, audio or document. A visitor (one Column function per part type)
flattens the parts into text with ordered placeholders, and records for every attachment its reference and the
number of tokens that its placeholder expands to.

Output of format_chat: formatted text, the turns' character spans, the loss mask as character spans of assistant
bodies, and the attachments in order. Control strings inside texts are escaped and can be restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Side of an image patch in pixels, audio frames a second, tokens a document page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    """Make control strings impossible inside a text, also where two parts meet. unescape() restores it exactly."""
    return F.regexp_replace(F.replace(text, F.lit("&"), F.lit("&amp;")), r"<(?=\||\z)", "&lt;")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """A role is a header line: line feeds are escaped besides the control strings."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A parts array that holds one text."""
    none = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"),
        none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"),
    ))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text. Missing sizes count as the smallest unit."""
    whole = lambda x, unit: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / F.lit(unit))
    return (
        F.when(part["type"] == "image", whole(part["width"], IMAGE_PATCH) * whole(part["height"], IMAGE_PATCH) + 2)
        .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(0).cast("long")
    )


def is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDER), F.lit(False))


def visit_part(part: Column) -> Column:
    """What a part becomes in the flat text: media a placeholder, anything else its escaped text (null: empty)."""
    media = F.coalesce(*[F.when(part["type"] == k, F.lit(v)) for k, v in PLACEHOLDER.items()])
    return F.coalesce(media, escape(F.coalesce(part["text"], F.lit(""))))


def flatten_parts(parts: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), visit_part), "")


def part_attachments(parts: Column) -> Column:
    """array<struct<part,type,ref,n_tokens>> of the media parts in order; part is the index in the turn."""
    numbered = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p, i: F.struct(i.alias("part"), p.alias("p")))
    return F.transform(
        F.filter(numbered, lambda x: is_media(x["p"])),
        lambda x: F.struct(x["part"], x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), expanded_tokens(x["p"]).alias("n_tokens")),
    )


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_spans, attachments, media_tokens.

    Turns are ordered by `turn` (nulls first), equal ones by role and then flat text, so repeated rows keep a defined
    place. Null roles count as empty; a null conversation id is a conversation of its own; an empty table gives an
    empty table. loss_spans: array<struct<from,until>> of character positions in `formatted` (0-based, end
    exclusive), one per turn of loss_role. The window and the aggregate share one shuffle by conversation. One
    conversation becomes one row, so a conversation must fit in a task; nothing larger is gathered.
    """
    flat = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"),
        flatten_parts(F.col(parts)).alias("body"), part_attachments(F.col(parts)).alias("att"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("r")), F.lit("\n"))
    flat = flat.withColumn("head", head).withColumn("whole", F.concat("head", "body", F.lit(END + "\n"))).withColumn("loss", F.col("r") == loss_role)
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "body")
    flat = flat.withColumn("i", F.row_number().over(order)).withColumn(
        "at", F.sum(F.char_length("whole")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("whole")
    )
    span = F.struct((F.col("at") + F.char_length("head")).alias("from"), (F.col("at") + F.char_length("head") + F.char_length("body")).alias("until"))
    item = F.struct("i", "whole", F.when(F.col("loss"), span).alias("span"), "att")
    grouped = flat.groupBy("c").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(
        F.col("c").alias(conv), F.size("items").cast("long").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: x["whole"]), "").alias("formatted"),
        F.filter(F.transform("items", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("items", lambda x: F.transform(x["att"], lambda a: F.struct(
            (x["i"] - 1).alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> parsed back from a formatted text (placeholders stay as they are)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def one(piece):
        inner = F.substring_index(piece, END, 1)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(inner, F.char_length(role) + 2)).alias("text"))

    return F.transform(pieces, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    cut = lambda s: unescape(F.substr(formatted, (s["from"] + 1).cast("int"), (s["until"] - s["from"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")
