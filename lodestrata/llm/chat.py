"""Chat formatting: typed content parts flattened into one marked-up training text.

DataFrame functions only. A *visitor*, one expression per kind of part, turns text parts into escaped
text and image, audio and document parts into numbered placeholders, and records the attachment
references and the tokens that the placeholders expand to.

Control characters never occur inside a text: a backslash becomes ``\\s``, ``<`` becomes ``\\l`` and ``#``
becomes ``\\h``; in a role and in a part's kind ``:`` becomes ``\\c``, in a kind ``>`` becomes ``\\g``. Every backslash in an escaped text is one of these pairs, so the replacements are
undone in the opposite order, a turn's end mark is found by a plain split, and its role's by the first colon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's fixed marks.
OPEN, SEP, CLOSE = "### ", ":\n", "</turn>\n"
#: Escaped characters and what stands for them.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
KIND_ESCAPES = (*ROLE_ESCAPES, (">", "\\g"))
#: Known kinds of attachments and the tokens that one unit of each takes; a unit of any other kind takes OTHER.
OTHER = 1
EXPANDS = {"image": 256, "audio": 50, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def kind_of(part: Column) -> Column:
    """A part's kind in lower case; null: text."""
    return F.lower(F.coalesce(part["kind"], F.lit("text")))


def attached(part: Column) -> Column:
    """Whether a part is an attachment: of a known kind, or of any other than text if it has a reference."""
    return kind_of(part).isin(*EXPANDS) | ((kind_of(part) != "text") & part["ref"].isNotNull())


def visited(part: Column, at: Column) -> Column:
    """What a part becomes: escaped text, or a placeholder with the part's place in the turn."""
    mark = F.concat(F.lit("<"), escaped(kind_of(part), KIND_ESCAPES), F.lit(":"), at.cast("string"), F.lit(">"))
    return F.when(attached(part), mark).otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def expanded(part: Column) -> Column:
    """Tokens of an attachment part, 0 for text; no or negative units count as one unit."""
    per = F.create_map(*[x for k, v in EXPANDS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(attached(part), F.coalesce(per[kind_of(part)], F.lit(OTHER)) * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))).otherwise(0)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str | None = None, text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, formatted, loss, attachments, attachment_tokens``.

    ``turns`` has a row per turn, with typed ``parts`` (see PARTS) or a plain ``text``. ``loss`` lists
    (start, length), in code points of ``formatted``, of each assistant turn's body. ``attachments`` lists
    (turn, part, kind, ref, tokens) in order. Kinds are compared in lower case; a part of a kind that is not known is an attachment
    if it has a reference, and text otherwise.

    Null text and null parts: empty. Null role: an empty role. Null conversation id: a conversation of its
    own. Equal turn numbers go by role and content; repeated rows stay as turns of their own. Other columns
    are ignored. No rows give no rows.

    A conversation is one value of the result, so its rows meet in one task; it must fit a row.
    """
    body = F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))) if parts is None else F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS))
    rows = turns.select(F.col(conv).alias("__c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), body.alias("__p"))
    rows = rows.select(
        "__c", "t", "r",
        F.array_join(F.transform("__p", lambda p, i: visited(p, i)), "").alias("x"),
        F.transform(F.filter(F.transform("__p", lambda p, i: F.struct(attached(p).alias("on"), F.struct(F.col("t").alias("turn"), i.alias("part"), kind_of(p).alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens")).alias("a"))), lambda x: x["on"]), lambda x: x["a"]).alias("a"),
    )
    talks = rows.groupBy("__c").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x", "a"))).alias("s"))
    head = lambda u: F.concat(F.lit(OPEN), escaped(u["r"], ROLE_ESCAPES), F.lit(SEP))
    sizes = F.transform("s", lambda u: F.struct(F.length(head(u)).alias("h"), F.length(u["x"]).alias("b"), (u["r"] == "assistant").alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        span = F.array(F.struct((acc["at"] + z["h"]).alias("start"), z["b"].alias("length")))
        return F.struct((acc["at"] + z["h"] + z["b"] + len(CLOSE)).alias("at"), F.when(z["on"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return talks.select(
        F.col("__c").alias(conv),
        F.array_join(F.transform("s", lambda u: F.concat(head(u), u["x"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate(sizes, start, step, lambda acc: acc["out"]).alias("loss"),
        F.flatten(F.transform("s", lambda u: u["a"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("s", lambda u: u["a"])), F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted text; placeholders stay in the text."""
    turns = F.split(formatted, F.lit(CLOSE), -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    cut = lambda u: F.instr(u, SEP)
    return F.transform(turns, lambda u: F.struct(unescaped(F.substring(u, F.lit(len(OPEN) + 1), cut(u) - 1 - len(OPEN)), ROLE_ESCAPES).alias("role"), unescaped(F.substring(u, cut(u) + len(SEP), F.length(u))).alias("text")))


def read_parts(formatted: Column, attachments: Column) -> Column:
    """The turns of a formatted text as (role, parts): what stands between placeholders as one text part, and the attachments by kind and reference in their order."""
    turns = F.split(formatted, F.lit(CLOSE), -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    cut = lambda u: F.instr(u, SEP)
    bodies = F.transform(turns, lambda u: F.struct(unescaped(F.substring(u, F.lit(len(OPEN) + 1), cut(u) - 1 - len(OPEN)), ROLE_ESCAPES).alias("role"), F.regexp_extract_all(F.substring(u, cut(u) + len(SEP), F.length(u)), F.lit("(<[^>]*>|[^<]+)"), 1).alias("x")))
    mark = lambda x: F.startswith(x, F.lit("<"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<role:string,parts:array<struct<kind:string,text:string,ref:string>>>>").alias("out"))

    def step(acc: Column, turn: Column) -> Column:
        place = lambda i: acc["n"] + F.size(F.filter(F.slice(turn["x"], 1, i + 1), mark)) - 1
        none = F.lit(None).cast("string")
        text = lambda x: F.struct(F.lit("text").alias("kind"), unescaped(x).alias("text"), none.alias("ref"))
        thing = lambda i: F.struct(F.get(attachments, place(i))["kind"].alias("kind"), none.alias("text"), F.get(attachments, place(i))["ref"].alias("ref"))
        parts = F.transform(turn["x"], lambda x, i: F.when(mark(x), thing(i)).otherwise(text(x)))
        return F.struct((acc["n"] + F.size(F.filter(turn["x"], mark))).alias("n"), F.concat(acc["out"], F.array(F.struct(turn["role"].alias("role"), parts.alias("parts")))).alias("out"))

    return F.aggregate(bodies, start, step, lambda acc: acc["out"])


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda z: unescaped(F.substring(formatted, z["start"] + 1, z["length"]))), "")
