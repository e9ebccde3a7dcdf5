r"""Chat formatting with typed content parts.

A visitor walks the parts of each turn in order. Text parts give their text; image, audio and document parts give an
ordered placeholder, a reference in ``attachments`` and the number of tokens that it stands for. Turns are marked

    <|im_start|>ROLE\nCONTENT<|im_end|>\n

and ``\``, ``<|`` (and, in roles, newlines) are escaped in roles and texts, so control strings that a user types are
ordinary text and the original comes back exactly. The loss mask covers the escaped texts of assistant turns.

A conversation is one row of the result, so its turns meet in one task at last: as one row from each task that held
some of them, already rendered. Nothing else is gathered.

A segment is a piece of the formatted text that is under the loss mask or not: turn marks and placeholders are segments
of their own without loss, the texts of an assistant turn have it.

Defined results: null text, role, parts or part: empty; a kind other than text, image, audio and document is an error
that names it, since nothing says what it stands for; a null turn sorts first; equal turns are ordered by role, then
content; a null conversation id is a conversation of its own; repeated rows stay; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one attachment of a kind expands to when the part names no count itself.
EXPANDED_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<kind:string,text:string,uri:string,n_tokens:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    r"""Inverse of ``escape`` and ``escape_role``: cut at ``\\`` first, as every escape starts at an even place."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def text_part(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("n_tokens")))


def _kind(part: Column) -> Column:
    """One of the four kinds (null: text). Kinds are written into the output as they are, so others must not pass."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", *EXPANDED_TOKENS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of part: "), kind)))


def _visit(part: Column) -> Column:
    """(kind, text) that a part adds to the formatted turn. Placeholders hold the kind only: order ties them to attachments."""
    kind = _kind(part)
    text = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("_pad|>")))
    return F.struct(kind.alias("kind"), text.alias("text"))


def _reference(part: Column, turn: Column) -> Column:
    default = F.coalesce(*[F.when(part["kind"] == k, F.lit(n)) for k, n in EXPANDED_TOKENS.items()], F.lit(0))
    return F.struct(turn.alias("turn"), part["kind"].alias("kind"), part["uri"].alias("uri"), F.coalesce(part["n_tokens"], default).alias("n_tokens"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (text, loss; joined they are ``formatted``), attachments, n_attachment_tokens.

    ``turns``: conv_id, turn, role and ``parts`` (array of kind, text, uri, n_tokens). Each turn is rendered before
    the shuffle; the turns of a conversation are gathered by a partial aggregate, so that a task sends one row for
    each conversation that it holds, however many turns one has.
    """
    parts = F.coalesce(turns["parts"], F.array().cast(f"array<{PART}>"))
    role = F.coalesce(turns["role"], F.lit(""))
    rendered = turns.select(
        turns["conv_id"].alias("conv_id"),
        F.struct(
            turns["turn"].alias("turn"), role.alias("role"), F.transform(parts, _visit).alias("content"),
            F.transform(F.filter(parts, lambda p: p["kind"].isin(*EXPANDED_TOKENS)), lambda p: _reference(p, turns["turn"])).alias("refs"),
        ).alias("t"),
    )
    threads = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.concat(
                F.array(seg(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")), F.lit(False))),
                F.transform(t["content"], lambda c: seg(c["text"], (t["role"] == "assistant") & (c["kind"] == "text"))),
                F.array(seg(F.lit(END), F.lit(False))),
            ),
        )
    )
    refs = F.flatten(F.transform("ts", lambda t: t["refs"]))
    out = threads.select("conv_id", segments.alias("segments"), refs.alias("attachments"))
    return out.select(
        "conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "attachments",
        F.aggregate("attachments.n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds, unescaped."""
    marked = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s != "")
    head = len(START)

    def turn(s: Column) -> Column:
        line = F.locate("\n", s)
        return F.struct(unescape(F.substring(s, F.lit(head + 1), line - head - 1)).alias("role"), unescape(F.substring(s, line + 1, F.length(s))).alias("text"))

    return F.transform(marked, turn)


def read_loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
