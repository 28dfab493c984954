"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is a list of parts. A visitor (one expression per part type)
flattens them in order: text is escaped and kept, and images, audio and
documents become placeholders, each with an attachment record of its
reference, its turn and the tokens it expands to.

The template marks turns with control strings. Inside texts and roles every
backslash is doubled and a backslash goes into each control string after its
first character; taking the character after each backslash undoes both.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings and the tokens that attachments expand to."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    other: str = "<|attachment|>"
    part: str = "<|part|>"         # between the parts of a turn, so that no control string arises across them
    #: further strings that trained models read as control strings
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_role: str = "assistant"
    image_patch: int = 14          # pixels a side of the square that one image token covers
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 256

    def control_pattern(self) -> str:
        return r"(<)(?=\|)|" + "|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.reserved)


PART_TYPE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])


def escape(c: Column, template: ChatTemplate) -> Column:
    doubled = F.regexp_replace(c, r"\\", r"\\\\")
    groups = "".join(f"${i + 1}" for i in range(len(template.reserved) + 1))
    return F.regexp_replace(doubled, template.control_pattern(), groups + r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART_TYPE.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *nothing))


def part_tokens(part: Column, template: ChatTemplate) -> Column:
    """Tokens that a part's placeholder expands to; text has none, missing measures count as 0."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) / template.image_patch)
    return (F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
            .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * template.audio_tokens_per_second))
            .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * template.document_tokens_per_page)
            .otherwise(0)).cast("bigint")


def visit_part(part: Column, template: ChatTemplate) -> Column:
    """What a part becomes in the text: escaped text, or its type's placeholder."""
    return (F.when(F.coalesce(part["type"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit("")), template))
            .when(part["type"] == "image", F.lit(template.image))
            .when(part["type"] == "audio", F.lit(template.audio))
            .when(part["type"] == "document", F.lit(template.document))
            .otherwise(F.lit(template.other)))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask, attachments, expanded_tokens``.

    ``parts_col`` is an array of ``PART_TYPE``; null stands for no parts, null
    parts are skipped, a part without type is text and null text is empty. Unknown types
    keep a placeholder and an attachment of 0 tokens. Turns go by ``turn_col`` (nulls
    first), ties and repeated turns by role and content; null roles are empty. ``loss_mask`` holds the code
    point ranges (end exclusive) of the bodies of ``template.loss_role`` turns. Rows with
    a null conversation id form one conversation. No rows give no rows; other columns
    are not read. A conversation's text is one value, so it is built in one task.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(T.ArrayType(PART_TYPE))), lambda p: p.isNotNull())
    flat = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.col(parts_col).cast(T.ArrayType(PART_TYPE)).alias("parts"))
    flat = flat.withColumn("parts", parts)
    attached = F.transform(F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text"),
                           lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p, template).alias("tokens")))
    flat = flat.select("conv_id", F.struct(
        "turn", "role", F.concat_ws(template.part, F.transform("parts", lambda p: visit_part(p, template))).alias("body"), attached.alias("attached")).alias("t"))
    head = F.concat(F.lit(template.turn), escape(F.col("t.role"), template), F.lit(template.body))
    flat = flat.select("conv_id", "t", head.alias("head"), F.length("t.body").cast("bigint").alias("long"))
    order = Window.partitionBy("conv_id").orderBy("t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.col("long") + len(template.end)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    laid = flat.select("conv_id", F.struct(
        F.row_number().over(order).alias("place"), F.concat("head", "t.body", F.lit(template.end)).alias("piece"), F.col("t.attached").alias("attached"),
        F.when(F.col("t.role") == template.loss_role, F.struct(start.alias("start"), (start + F.col("long")).alias("end"))).alias("mask")).alias("u"))
    chats = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list("u")).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda u: F.transform(
        u["attached"], lambda a: F.struct((u["place"] - 1).alias("turn_index"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = chats.select("conv_id", F.concat_ws("", "turns.piece").alias("formatted"),
                       F.filter("turns.mask", lambda m: m.isNotNull()).alias("loss_mask"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``formatted`` (a row a ``conv_id``) with ``turns`` (array of role and text) and ``loss_text``
    (unescaped text under the mask) read from the formatted text alone; attachment placeholders stay in the texts.

    The text is cut once at its turn marks; running lengths tell where each body
    starts, and the mask's ranges, which are whole bodies, are joined on that. Read a
    written table: a text that is still to be built would be built for both sides.
    """
    quoted = lambda x: r"\Q" + x + r"\E"
    plain = lambda x: unescape(F.replace(x, F.lit(template.part), F.lit("")))
    pieces = formatted.select("conv_id", F.posexplode(F.filter(F.split("formatted", quoted(template.turn)), lambda x: x != "")).alias("place", "x"))
    cut = F.split(F.regexp_replace("x", quoted(template.end) + r"\z", ""), quoted(template.body), 2)
    pieces = pieces.select("conv_id", "place", (F.length("x") + len(template.turn)).cast("bigint").alias("long"),
                           F.get(cut, F.lit(0)).alias("role"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("long").over(before), F.lit(0)) + len(template.turn) + F.length("role") + len(template.body)
    pieces = pieces.withColumn("at", at)
    masks = formatted.select(F.col("conv_id").alias("of"), F.explode("loss_mask").alias("m")).select("of", "m.start", F.col("m.end").alias("stop"))
    both = pieces.join(masks, pieces.conv_id.eqNullSafe(masks.of) & (pieces.at == masks.start), "left")
    masked = F.when(F.col("start").isNotNull(), plain(F.substring(F.col("body"), F.lit(1), (F.col("stop") - F.col("start")).cast("int"))))
    turn = F.struct("place", F.struct(unescape(F.col("role")).alias("role"), plain(F.col("body")).alias("text")).alias("turn"), masked.alias("masked"))
    read = both.groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    read = read.select("of", F.col("turns.turn").alias("turns"), F.concat_ws("", "turns.masked").alias("loss_text"))
    return formatted.join(read, formatted.conv_id.eqNullSafe(read.of)).drop("of")
