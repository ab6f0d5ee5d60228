"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts, ``struct<kind, value, ref, tokens>`` with kind
text, image, audio or document.  The visitor walks the parts in order: text is
escaped, every other part becomes a placeholder numbered within its turn, and its
reference and expanded token count are recorded.

The template::

    <turn role="user">escaped text<image 1></turn>
    <turn role="assistant"><loss>escaped text</loss></turn>

Escaping replaces ``&`` by ``&amp;`` and then ``<`` by ``&lt;``; no control string can
arise from a text, and the two replacements undo each other in reverse order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("text", "image", "audio", "document")
PART = "struct<kind: string, value: string, ref: string, tokens: int>"
#: Tokens that a placeholder expands to when its part names no count.
TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A single text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("value"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(parts: Column) -> Column:
    """``struct<body, attachments>`` of a list of parts, in their order.

    A null list is empty.  An unknown kind raises; attachments are ``struct<place,
    kind, ref, tokens>`` with the placeholder's number from 1.
    """
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))
    known = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    checked = F.transform(known, lambda p: F.when(kind(p).isin(*KINDS), p).otherwise(F.raise_error(F.concat(F.lit("unknown kind of part: "), kind(p))).cast(PART)))
    others = F.filter(checked, lambda p: kind(p) != "text")
    default = F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair])
    attachments = F.transform(others, lambda p, i: F.struct((i + 1).alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], default[p["kind"]]).alias("tokens")))
    # a part's number: the attachments among the parts up to it
    numbered = F.transform(checked, lambda p, i: F.when(kind(p) == "text", escape(F.coalesce(p["value"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind(p), F.lit(" "), F.size(F.filter(F.slice(checked, 1, i + 1), lambda q: kind(q) != "text")).cast("string"), F.lit(">"))))
    return F.struct(F.array_join(numbered, "").alias("body"), attachments.alias("attachments"))


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), parts: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, attachments, expanded_tokens``.

    ``turns`` has ``conv_id, turn, role`` and ``text``, or an array of parts in the column
    that ``parts`` names; other columns are not read.  Turns are ordered by turn, then role, then body, nulls first;
    null role counts as empty.  Repeated rows are repeated turns, a null conv_id is a
    conversation of its own, an empty table gives none.  A conversation is one string,
    so its turns meet in one task; nothing else does.
    """
    content = F.col(f"`{parts}`") if parts else text_parts(F.col("text"))
    seen = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), visit(content).alias("seen"))
    is_loss = F.col("role").isin(*loss_roles)
    rendered = F.concat(
        F.lit('<turn role="'), F.replace(escape(F.col("role")), F.lit('"'), F.lit("&quot;")), F.lit('">'),
        F.when(is_loss, F.lit("<loss>")).otherwise(F.lit("")), F.col("seen.body"), F.when(is_loss, F.lit("</loss>")).otherwise(F.lit("")), F.lit("</turn>\n"),
    )
    rows = seen.select("conv_id", F.struct("turn", "role", rendered.alias("rendered"), F.col("seen.attachments").alias("attachments")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["turn"].alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = whole.select("conv_id", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("formatted"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + F.coalesce(a["tokens"], F.lit(0))))


def read_parts(body: Column, attachments: Column | None = None) -> Column:
    """Back from a turn's body: its parts in order, ``struct<kind, value, ref, tokens>``.

    An escaped text holds no ``<``, so every ``<`` begins a placeholder and a text that
    looks like one stays text.  ``attachments`` of the same turn give references and
    token counts.  Neighbouring text parts come back as one, empty ones not at all.
    """
    none = F.lit(None).cast("string")

    def attached(mark: Column) -> Column:
        place = F.substring_index(mark, " ", -1).cast("int")
        kind = F.substring_index(mark, " ", 1)
        if attachments is None:
            return F.struct(kind.alias("kind"), none.alias("value"), none.alias("ref"), F.lit(None).cast("int").alias("tokens"))
        of = F.element_at(F.filter(attachments, lambda a: a["place"] == place), 1)
        return F.struct(kind.alias("kind"), none.alias("value"), of["ref"].alias("ref"), of["tokens"].alias("tokens"))

    def said(text: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), unescape(text).alias("value"), none.alias("ref"), F.lit(None).cast("int").alias("tokens"))

    pieces = F.split(body, "<", -1)
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.array(attached(F.substring_index(p, ">", 1)), said(F.substr(p, F.instr(p, ">") + 1))))
    return F.filter(F.flatten(F.concat(F.array(F.array(said(F.element_at(pieces, 1)))), rest)), lambda p: (p["kind"] != "text") | (p["value"] != ""))


def read_turns(formatted: Column) -> Column:
    """Back from the formatted string: array of ``struct<role, text, loss, body>``.

    ``body`` is the escaped content, from which ``read_parts`` gives typed parts; in
    ``text`` it is unescaped, with placeholders as they are.
    """
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def one(piece: Column) -> Column:
        at = F.instr(piece, '">')
        role = F.substr(piece, F.lit(len('<turn role="') + 1), at - len('<turn role="') - 1)
        rest = F.substr(piece, at + 2)
        loss = F.startswith(rest, F.lit("<loss>"))
        text = F.when(loss, F.substr(rest, F.lit(len("<loss>") + 1), F.length(rest) - len("<loss></loss>"))).otherwise(rest)
        return F.struct(unescape(F.replace(role, F.lit("&quot;"), F.lit('"'))).alias("role"), unescape(text).alias("text"), loss.alias("loss"), text.alias("body"))

    return F.transform(pieces, one)
