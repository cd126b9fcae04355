"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts. A visitor over the array turns text into escaped text and an
image, audio or document part into a placeholder; it records each attachment's place (its turn in the
conversation and its number among all of the conversation's attachments), its reference and the tokens its
placeholder stands for. A turn reads ``<turn ROLE>TEXT</turn>`` and a newline, a placeholder ``<TYPE/>``; in
roles, types and texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no control
string can occur in them and reading back is exact. The loss mask lists the spans of assistant text, end
exclusive, in code points; placeholders are in none of them.

Defined results: a null text is an empty text, a null role an empty role, null parts are skipped and a null
array is no parts; a part without a type is an attachment of type ``?``; turns that tie are ordered by role,
then content; rows without a conversation id form one conversation; repeated rows are repeated turns; texts
are taken whole, however long; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, starts, text_of

#: A typed part: text in ``text``, else a reference and what its token count follows from.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Tokens: images a patch of 14 x 14 pixels, audio 25 a second, documents 500 a page; a placeholder counts 1 at least.
PATCH, PER_SECOND, PER_PAGE = 14, 25.0, 500
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def text_part(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )


def _tokens(p: Column) -> Column:
    of = F.when(_kind(p) == "image", F.ceil(F.coalesce(p["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(1)) / PATCH))
    of = of.when(_kind(p) == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND))
    return F.greatest(F.lit(1), F.coalesce(of.otherwise(F.coalesce(p["pages"], F.lit(1)) * PER_PAGE), F.lit(1))).cast("long")


def _kind(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("?"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(pieces, attachments) of an array of parts: array<struct<piece, text>> in order, text telling whether it is one, and array<struct<type, ref, tokens>>."""
    own = F.filter(F.coalesce(parts, F.array()), lambda p: p.isNotNull())
    attached = F.filter(own, lambda p: _kind(p) != "text")
    refs = F.transform(attached, lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))

    def piece(p: Column) -> Column:
        text = _kind(p) == "text"
        held = F.concat(F.lit("<"), escape(_kind(p)), F.lit("/>"))
        return F.struct(F.when(text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(held).alias("piece"), text.alias("text"))

    return F.transform(own, piece), refs


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, attachments, n_tokens_attached) from rows (conv_id, turn, role, parts).

    ``attachments`` is array<struct<position, turn, type, ref, tokens>>: the position counts the attachments of
    the whole conversation, the turn its turns, from 0.
    """
    pieces, refs = visit(F.col("parts"))
    content = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    plain = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), pieces.alias("pieces"), refs.alias("refs")).alias("t"))
    whole = plain.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">"))
    tail = F.lit("</turn>\n")
    fixed = lambda c: F.array(F.struct(c.alias("piece"), F.lit(False).alias("loss")))

    def laid(t: Column) -> Column:
        own = F.transform(t["pieces"], lambda p: F.struct(p["piece"].alias("piece"), (p["text"] & (t["role"] == "assistant")).alias("loss")))
        return F.concat(fixed(head(t)), own, fixed(tail))

    def mask(pieces: Column) -> Column:
        span = lambda p, at: F.struct(at.alias("start"), (at + F.length(p["piece"])).alias("end"), p["loss"].alias("loss"))
        laid_out = F.zip_with(pieces, starts(F.transform(pieces, lambda p: F.length(p["piece"]))), span)
        return F.transform(F.filter(laid_out, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    numbered = F.flatten(F.transform("turns", lambda t, i: F.transform(t["refs"], lambda r: F.struct(i.alias("turn"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    placed = F.transform(numbered, lambda r, i: F.struct(i.alias("position"), r["turn"].alias("turn"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))
    flat = whole.select("conv_id", F.flatten(F.transform("turns", laid)).alias("pieces"), placed.alias("attachments"))
    return flat.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        mask(F.col("pieces")).alias("loss_mask"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("n_tokens_attached"),
    )


def _turns(formatted: Column) -> Column:
    """array<struct<role, content>>, both as they are in the formatted text."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len("<turn ") + 1)))
    return F.transform(body, lambda p: F.struct(F.substring_index(p, ">", 1).alias("role"), F.substr(p, F.locate(">", p) + 1).alias("content")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay as they are."""
    return F.transform(_turns(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["content"]).alias("text")))


def read_parts(formatted: Column, attachments: Column) -> Column:
    """array<struct<role, parts: array<struct<type, text, ref, tokens>>>>: texts and, at their places, the attachments of a conversation.

    Empty texts and borders between texts that stood side by side are not in the formatted text.
    """

    def parts(t: Column, i: Column) -> Column:
        own = F.filter(attachments, lambda a: a["turn"] == i)
        # texts stand between placeholders, the only runs of <.../>
        texts = F.split(t["content"], r"<[^<>]*/>", -1)
        text = lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
        held = lambda a: F.struct(a["type"].alias("type"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        both = F.transform(texts, lambda x, k: F.when(k == 0, F.array(text(x))).otherwise(F.array(held(F.get(own, k - 1)), text(x))))
        return F.struct(unescape(t["role"]).alias("role"), F.filter(F.flatten(both), lambda p: (p["type"] != "text") | (p["text"] != "")).alias("parts"))

    return F.transform(_turns(formatted), parts)


def loss_text(formatted: Column, mask: Column) -> Column:
    return unescape(F.array_join(F.transform(mask, lambda s: F.substr(formatted, s["start"] + 1, s["end"] - s["start"])), ""))


def with_extra_conversation(turns: DataFrame) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_extra_conversation(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    path = shared_path(spark, "chat")
    format_conversations(turns.select("conv_id", "turn", "role", F.array(text_part(text_of())).alias("parts"))).write.parquet(path)
    out = spark.read.parquet(path).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
