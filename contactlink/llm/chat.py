"""Chat formatting with typed content parts, as column expressions.

A turn's content is an array of parts of type text, image, audio or document. A visitor turns each part into text:
text parts are escaped, the others become placeholders that name kind and place, and what they point to is recorded
with the number of tokens it will expand to. Control strings start with ``<|``; inside content a backslash is doubled
and ``<|`` becomes ``<\\|``, so no content can look like a control string and the original comes back exactly. A part that
ends in ``<`` with another part after it ends in ``<\\.`` instead, so parts cannot form a control string together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlink.llm.tables import exact

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
PART_TYPE = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"

# Expansion of attachments: pixels per image patch, tokens per second of sound and per document page.
PATCH_PIXELS, SOUND_TOKENS, PAGE_TOKENS = 28, 25, 512


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_part(text: Column, is_last: Column) -> Column:
    """A text part; one that ends in ``<`` is set apart from the part that follows it."""
    own = escaped(text)
    return F.when(~is_last & own.endswith("<"), F.concat(own, F.lit("\\."))).otherwise(own)


def unescaped(text: Column) -> Column:
    whole = F.replace(F.replace(text, F.lit("<\\."), F.lit("<")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(whole, F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """Roles end at the line's end, so line feeds are escaped too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """Plain text as the one part of a turn; null is empty."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.alias("uri"), null.alias("width"),
                            null.alias("height"), null.alias("seconds"), null.alias("pages"))).cast(PART_TYPE)


def visit(kind: Column, visitors: dict[str, Column], otherwise: Column) -> Column:
    """One column per part type, chosen by ``kind``."""
    out = F
    for name, column in visitors.items():
        out = out.when(kind == name, column)
    return out.otherwise(otherwise)


def rendered(part: Column, place: Column, parts: Column) -> Column:
    """A part as text. Unknown types and missing parts leave nothing behind."""
    marks = {kind: F.concat(F.lit(f"<|{kind}:"), place.cast("string"), F.lit("|>")) for kind in ("image", "audio", "document")}
    return visit(part["type"], {"text": F.coalesce(escaped_part(part["text"], place == F.size(parts) - 1), F.lit("")), **marks}, F.lit(""))


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment expands to: image patches, sound or pages; one at least. Unknown sizes count as one."""
    patches = F.ceil(part["width"] / PATCH_PIXELS) * F.ceil(part["height"] / PATCH_PIXELS)
    sizes = {"image": patches, "audio": F.ceil(part["seconds"] * SOUND_TOKENS), "document": part["pages"] * PAGE_TOKENS}
    known = visit(part["type"], {k: v.cast("long") for k, v in sizes.items()}, F.lit(None).cast("long"))
    return F.greatest(F.coalesce(known, F.lit(1).cast("long")), F.lit(1).cast("long"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted``, ``loss_spans`` (start and length in code points of
    ``formatted``, one for each assistant turn) and ``attachments`` (turn number, place in the turn, type, uri, span
    start, tokens), in order.

    Turns are ordered by ``turn``, rows of one turn by role and content; nulls come first. A null role is empty, null
    parts are no content; rows without a conversation id form one conversation. Other columns are ignored. A
    conversation is one string in one row, which is what the format means; all conversations are spread by their id.
    """
    parts = F.coalesce(exact(parts_col), F.array().cast(PART_TYPE))
    role = F.coalesce(exact(role_col), F.lit(""))
    rows = turns.select(exact(conv_col).alias("conv"), exact(turn_col).alias("turn"), role.alias("role"), parts.alias("parts"))
    rows = rows.select(
        "conv", "turn", "role", "parts",
        F.transform("parts", lambda part, place: rendered(part, place, F.col("parts"))).alias("texts"),
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
    )
    rows = rows.select("conv", "turn", "role", "parts", "texts", "head", F.array_join("texts", "").alias("body"))
    length = F.char_length("head") + F.char_length("body") + len(END)
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    placed = rows.select(
        "conv", "role", "head", "body", "parts", "texts",
        F.row_number().over(in_order).alias("no"),
        (F.sum(length).over(in_order.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    start = F.coalesce("before", F.lit(0)) + F.char_length("head")

    def attachment(part, place):
        ahead = F.aggregate(F.slice("texts", F.lit(1), place), F.lit(0).cast("long"), lambda n, t: n + F.char_length(t))
        return F.struct(F.col("no").alias("turn"), place.alias("place"), part["type"].alias("type"), part["uri"].alias("uri"),
                        (start + ahead).alias("start"), expanded_tokens(part).alias("tokens"))

    attached = F.filter(F.transform("parts", attachment), lambda a: a["type"].isin("image", "audio", "document"))
    one = placed.select(
        "conv",
        F.struct(
            "no", F.concat("head", "body", F.lit(END)).alias("text"),
            F.when(F.col("role") == TRAINED_ROLE, F.struct(start.alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span"),
            attached.alias("attachments"),
        ).alias("t"),
    )
    joined = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return joined.select(
        F.col("conv").alias(conv_col),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.col("t.text"), "").alias("formatted"),
        F.array_compact(F.col("t.span")).alias("loss_spans"),
        F.flatten(F.col("t.attachments")).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of ``role`` and ``text``; placeholders stay as they are."""
    pieces = F.split(formatted, "<\\|im_end\\|>\n")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescaped_role(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescaped(F.substr(t, F.instr(t, "\n") + 1)).alias("text"),
    ))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The content under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
