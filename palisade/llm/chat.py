"""Chat formatting with Spark expressions only.

The template, by adjacent turns of one role (a block):

    ### Role: text of the first turn</part>text of the next</turn>

one block a line. Texts and roles are escaped so that these controls can't come up in them: a backslash
becomes two, "#" becomes "\\#", "</" becomes "<\\/", and in roles ":" becomes "\\:". A backslash and the
character after it stand for that character, so escaping is undone exactly. The loss mask is a list of
spans of the formatted text, one for each assistant turn's escaped text.

Turns go by (turn, role, text), nulls first; repeated rows stay. A null role is an empty role; a null text
is empty. A conversation is one row of output, so one conversation's turns meet in one row, whatever its
length: that is the operator's result, and the only thing that is gathered: its turns are sorted as structs and
merged by aggregations over the array. Rows with a null conv_id make up one conversation. Roles and
texts may be of any length that a row holds. Columns other than conv_id, turn, role and text are not read. No rows, no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, TURN = "</part>", "</turn>\n"
LOSS_ROLE = "assistant"
#: Turns that one aggregation goes over.
TURNS = 512


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</"), F.lit("<\\/"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of structs begin, length in code points of formatted)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = chats.select("conv_id", _merged(F.col("turns")).alias("parts"))
    # where a part begins: few numbers, as a part has many turns
    placed = parts.select(
        "conv_id",
        "parts",
        F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["size"]))).alias("at"),
    )
    spans = F.transform(
        "parts",
        lambda p, i: F.transform(p["spans"], lambda s: F.struct((s["begin"] + F.get(F.col("at"), i)).alias("begin"), s["length"].alias("length"))),
    )
    return placed.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.array_join(p["pieces"], "")), ""), F.lit(TURN)).alias("formatted"),
        F.flatten(spans).alias("loss_spans"),
    )


def _merged(turns: Column) -> Column:
    """Sorted turns, merged where neighbours have one role, in parts of TURNS turns, so that what an aggregation
    carries from turn to turn is bounded: an array of structs pieces (of the formatted text), size (its code
    points) and spans (of the loss, from where the part begins)."""
    nothing = F.struct(
        F.lit("").alias("role"),
        F.lit(0).alias("size"),
        F.array().cast("array<string>").alias("pieces"),
        F.array().cast("array<struct<begin:int,length:int>>").alias("spans"),
    )

    def part(k: Column) -> Column:
        # what the turn before the part has for a role; the first part has none before it
        last = F.get(turns, k * TURNS - 1)
        begun = nothing.withField("role", last["role"])
        return F.aggregate(F.slice(turns, k * TURNS + 1, TURNS), begun, put, lambda a: a.dropFields("role"))

    def put(a: Column, t: Column) -> Column:
        head = F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "))
        # a part mark within a block of one role, else the end of a block and a new head
        before = F.when(a["role"].isNull(), head).when(a["role"] == t["role"], F.lit(PART)).otherwise(F.concat(F.lit(TURN), head))
        body = escape(t["text"])
        at, length = a["size"] + F.length(before), F.length(body)
        span = F.array(F.struct(at.alias("begin"), length.alias("length")))
        return F.struct(
            t["role"].alias("role"),
            (at + length).alias("size"),
            F.concat(a["pieces"], F.array(F.concat(before, body))).alias("pieces"),
            F.when(t["role"] == LOSS_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / TURNS).cast("int")), part)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted chat: array of structs role, text."""
    blocks = F.filter(F.split(formatted, TURN), lambda b: F.length(b) > 0)

    def block(b: Column) -> Column:
        # possessive groups, which Java's engine matches in a loop; else a long role would use up its stack
        head = F.regexp_extract(b, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
        body = F.substring(b, F.length(head) + F.lit(len("### : ") + 1), F.length(b))
        return F.transform(F.split(body, PART), lambda p: F.struct(unescape(head).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["begin"] + 1, s["length"])), ""))


def report(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all but conv_id read back
    from the formatted text and its mask."""
    back = format_chats(turns).select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: What conversation -7 says: the template's own control strings, as plain text.
PROBE = "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, a user and an assistant row that both say PROBE."""
    rows = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    probe = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
