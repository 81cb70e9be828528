"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor flattens the parts of each message (text, image, audio, document) into one string per
conversation. Attachments become ordered placeholders; their references and the tokens that they
expand to are recorded beside the text. Control strings inside texts are broken by an escape that the
reader takes back, so that turns and placeholders can always be told from content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The type of the column `parts` of a message.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
BOS, EOS, HEAD, HEAD_END = "<s>", "</s>", "[INST]", "[/INST]"
MARKS = {"image": "IMG", "audio": "AUD", "document": "DOC"}
_NAMES = "|".join(["INST", *MARKS.values()])
#: What must not appear in a text: sentence marks, turn marks and placeholder marks.
_CONTROL = rf"([<\[])(/?(?:s>|(?:{_NAMES})\]))"


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that attachments expand to: one for each image patch, and fixed rates for audio and documents."""

    patch: int = 14
    image_extra: int = 2
    audio_per_second: float = 25.0
    per_page: int = 1024


def escape(text: Column) -> Column:
    r"""Doubles each backslash and puts \~ after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit(r"$1\\~$2"))


def unescape(text: Column) -> Column:
    """Takes back escape()."""
    return F.regexp_replace(text, F.lit(r"\\(?:(\\)|~)"), F.lit("$1"))


def text_part(text: Column) -> Column:
    """The `parts` of a message that is one text; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"))).cast("array<struct<kind:string,text:string>>")


def _is_attachment(p: Column) -> Column:
    return F.coalesce(p["kind"].isin(*MARKS), F.lit(False))


def _visit(p: Column, turn: Column, i: Column) -> Column:
    """One part as text: escaped text, or a placeholder with the turn's and the part's place."""
    out = escape(F.coalesce(p["text"], F.lit("")))
    for kind, mark in MARKS.items():
        out = F.when(p["kind"] == kind, F.concat(F.lit(f"[{mark}]"), turn.cast("string"), F.lit("."), i.cast("string"), F.lit(f"[/{mark}]"))).otherwise(out)
    return out


def _tokens(p: Column, c: TokenCosts) -> Column:
    whole = lambda x: F.coalesce(F.ceil(x), F.lit(0)).cast("long")
    return (
        F.when(p["kind"] == "image", whole(p["width"] / c.patch) * whole(p["height"] / c.patch) + c.image_extra)
        .when(p["kind"] == "audio", whole(p["seconds"] * c.audio_per_second))
        .otherwise(F.coalesce(p["pages"], F.lit(0)).cast("long") * c.per_page)
    )


def format_conversations(messages: DataFrame, costs: TokenCosts | None = None, train_role: str = "assistant") -> DataFrame:
    """One row per conversation from messages(conv_id, turn, role, parts).

    parts: PARTS, or an array of structs of which some fields are missing. Returns conv_id, n_turns,
    formatted, loss_mask (runs of code points, in order, over all of `formatted`; texts of the trained role are
    in the loss, its placeholders are not), attachments (in order: turn, part, kind, ref, n_tokens) and expanded_tokens. Turns are ordered by turn (null first), role and
    parts, and numbered from 0; repeated rows are repeated turns. A null role or text counts as empty, null
    parts as none; an unknown kind of part gives its text. Rows with a null conv_id form one conversation; as any
    conversation it becomes one row, so it must fit into a task's memory, as its text must fit into a string.
    An empty table gives no rows; other columns of the messages are ignored.
    """
    costs = costs or TokenCosts()
    have = messages.schema["parts"].dataType.elementType.fieldNames()
    types = dict(f.split(":") for f in PARTS[13:-2].split(","))
    fill = lambda p: F.struct(*[(p[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
    rows = messages.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.transform("parts", fill), F.array().cast(PARTS)).alias("parts")).alias("_m"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_m")).alias("_t"))

    def turn(m: Column, t: Column) -> Column:
        head = F.concat(F.lit(HEAD), escape(m["role"]), F.lit(HEAD_END))
        pieces = F.transform(m["parts"], lambda p, i: F.struct(_visit(p, t, i).alias("text"), ((m["role"] == train_role) & ~_is_attachment(p)).alias("loss")))
        return F.struct(head.alias("head"), pieces.alias("pieces"))

    def attached(m: Column, t: Column) -> Column:
        found = F.transform(m["parts"], lambda p, i: F.struct(t.cast("int").alias("turn"), i.cast("int").alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p, costs).alias("n_tokens")))
        return F.filter(found, lambda a: _is_attachment(a))

    def runs(x: Column) -> Column:
        run = lambda n, on: F.struct(n.cast("int").alias("n_chars"), on.alias("in_loss"))
        return F.concat(F.array(run(F.length(x["head"]), F.lit(False))), F.transform(x["pieces"], lambda p: run(F.length(p["text"]), p["loss"])), F.array(run(F.lit(len(EOS)), F.lit(False))))

    convs = convs.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.transform("_t", turn).alias("_x"), F.flatten(F.transform("_t", attached)).alias("attachments"))
    start = F.array(F.struct(F.lit(len(BOS)).alias("n_chars"), F.lit(False).alias("in_loss")))
    return convs.select(
        "conv_id",
        "n_turns",
        F.concat(F.lit(BOS), F.array_join(F.transform("_x", lambda x: F.concat(x["head"], F.array_join(x["pieces"]["text"], ""), F.lit(EOS))), "")).alias("formatted"),
        F.concat(start, F.flatten(F.transform("_x", runs))).alias("loss_mask"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, body>> read from a formatted conversation; the body still has its escapes and placeholders."""
    segments = F.split(F.substr(formatted, F.lit(len(BOS) + 1)), EOS)
    segments = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def one(s: Column) -> Column:
        at = F.instr(s, HEAD_END)
        role = F.substr(s, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        return F.struct(unescape(role).alias("role"), F.substr(s, at + len(HEAD_END)).alias("body"))

    return F.transform(segments, one)


def read_parts(body: Column) -> Column:
    """array<string> of a turn's body: unescaped texts, and placeholders as they stand."""
    marks = "|".join(MARKS.values())
    cut = F.split(body, F.lit(rf"(?=\[(?:{marks})\]\d)|(?<=\[/(?:{marks})\])"))
    kept = F.filter(cut, lambda p: p != "")
    return F.transform(kept, lambda p: F.when(p.rlike(rf"^\[(?:{marks})\]"), p).otherwise(unescape(p)))


def _cut(text: Column, pieces: Column, length: Callable[[Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(piece's text, piece) for each of the pieces that text consists of, in order; null ones are left out."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        got = made(F.substr(text, acc["at"], length(piece)), piece)
        return F.struct((acc["at"] + length(piece)).alias("at"), F.when(got.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(got))).alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    A substring is found by counting from the start of its text, so runs are not cut from the whole text: that is
    first cut into blocks of about the square root of the number of runs, and these into runs. Time grows as the
    runs to the power 1.5.
    """
    run = "struct<n_chars:int,in_loss:boolean>"
    block = F.ceil(F.sqrt(F.size(mask))).cast("int")
    starts = F.sequence(F.lit(1), F.size(mask), block)
    parts = F.transform(starts, lambda s: F.slice(mask, s, block))
    sized = F.transform(parts, lambda p: F.struct(p.alias("runs"), F.aggregate(p, F.lit(0), lambda n, r: n + r["n_chars"]).alias("n_chars")))
    blocks = _cut(formatted, sized, lambda b: b["n_chars"], lambda t, b: F.struct(t.alias("text"), b["runs"].alias("runs")), f"struct<text:string,runs:array<{run}>>")
    texts = F.transform(blocks, lambda b: F.array_join(_cut(b["text"], b["runs"], lambda r: r["n_chars"], lambda t, r: F.when(r["in_loss"], t), "string"), ""))
    return F.when(F.size(mask) == 0, F.lit("")).otherwise(unescape(F.array_join(texts, "")))
