"""Chat formatting: typed content parts to one training string with a loss mask, and back.

A turn holds an array of parts, each a struct ``kind, text, ref, width, height, seconds, pages``.
Every part is visited in order: text is escaped, an image, audio or document part becomes a
placeholder, and its reference and expanded token count go to ``attachments``. Reading back gives
the parts again: what is escaped is text, what is not is a placeholder. All of it is column
expressions; the one shuffle brings the turns of a conversation together.

Defined results
    null or empty parts, null text, null role: empty strings; a part of null kind is text, one of any
    other unknown kind an attachment without tokens (placeholder ``<|attachment|>``, its kind and ref
    kept, its text put after it); a null turn sorts first; a null conv_id is a conversation of its own; turns that tie are ordered by role, then content;
    repeated rows are turns of their own; an empty table gives no rows; columns of other names
    are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, and what an attachment expands to. ``mark`` opens every control string."""

    mark: str = "<|"
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained_role: str = "assistant"
    patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 256


def escape_text(col: Column) -> Column:
    """No ``<|`` is left: a backslash becomes ``\\s``, then ``<|`` becomes ``<\\p``."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape_text(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("<\\p"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(col: Column) -> Column:
    """As for text, and a line break, which ends the role, becomes ``\\n``."""
    return F.replace(escape_text(col), F.lit("\n"), F.lit("\\n"))


def unescape_role(col: Column) -> Column:
    return unescape_text(F.replace(col, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text turn as an array of one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"] != "text", F.lit(False))


def _rendered(part: Column) -> Column:
    said = escape_text(F.coalesce(part["text"], F.lit("")))
    known = part["kind"].isin("image", "audio", "document")
    return F.when(known, F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).when(_attached(part), F.concat(F.lit("<|attachment|>"), said)).otherwise(said)


def _expanded(part: Column, t: ChatTemplate) -> Column:
    side = lambda c: F.ceil(F.coalesce(part[c], F.lit(0)) / F.lit(float(t.patch)))
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * t.audio_tokens_per_second))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * t.document_tokens_per_page)
        .otherwise(0)
        .cast("long")
    )


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conv_id, turn, role, parts`` to a row per conversation.

    Gives ``conv_id, formatted, loss_spans array<struct<start,length>>`` (code points, from 0, over
    the trained role's contents), ``attachments array<struct<position,kind,ref,tokens>>`` (position:
    the turn's, from 0) and ``attachment_tokens``.
    """
    t = template
    each = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    each = each.withColumns({
        "head": F.concat(F.lit(t.start), escape_role(F.col("role")), F.lit("\n")),
        "body": F.array_join(F.transform("parts", _rendered), ""),
        "found": F.transform(
            F.filter("parts", _attached),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p, t).alias("tokens")),
        ),
    })
    each = each.withColumn("piece", F.concat("head", "body", F.lit(t.end + "\n"))).drop("parts")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body", F.xxhash64("found"))
    each = each.withColumns({
        "at": F.row_number().over(order),
        "before": F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece"),
    })
    trained = F.when(F.col("role") == t.trained_role, F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    one = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", trained.alias("span"), "found"))).alias("rows"))
    attachments = F.flatten(
        F.transform("rows", lambda r: F.transform(r["found"], lambda a: F.struct((r["at"] - 1).cast("long").alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    return one.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"]).alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Turns and trained texts, parsed from ``formatted`` and ``loss_spans`` alone.

    With ``attachments`` there is ``parts`` too: for each turn its parts ``kind, text, ref, tokens``,
    neighbouring texts as one and empty ones left out.
    """
    t = template
    ended = "".join(f"\\{c}" if c in "|<>" else c for c in t.end) + "\n"
    pieces = F.split("formatted", ended)
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(F.substr(p, F.lit(len(t.start) + 1)), "\n", 1)).alias("role"),
        unescape_text(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
    )
    if "attachments" in formatted.columns:
        # A turn's body is cut before each placeholder: text, then a placeholder's name and what follows it.
        part = lambda kind, text, ref, tokens: F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), tokens.alias("tokens"))
        said = lambda text: part(F.lit("text"), unescape_text(text), F.lit(None).cast("string"), F.lit(None).cast("long"))

        def parts(piece: Column, i: Column) -> Column:
            own = F.filter("attachments", lambda a: a["position"] == i)
            cuts = F.split(F.substr(piece, F.instr(piece, "\n") + 1), r"<\|")
            put = lambda c, j: F.array(part(F.get(own, j)["kind"], F.lit(None).cast("string"), F.get(own, j)["ref"], F.get(own, j)["tokens"]), said(F.substr(c, F.instr(c, "|>") + 2)))
            each = F.transform(cuts, lambda c, j: F.when(j == 0, F.array(said(c))).otherwise(put(c, j - 1)))
            return F.filter(F.flatten(each), lambda p: (p["kind"] != "text") | (p["text"] != ""))

        formatted = formatted.withColumn("parts", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parts))
    return formatted.withColumns({
        "turns": F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn),
        "loss_texts": F.transform("loss_spans", lambda s: unescape_text(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))),
    })


def chat_digests(conversations: DataFrame) -> DataFrame:
    """What the query returns: all of it read back from the formatted strings."""
    turns = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    back = read_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
