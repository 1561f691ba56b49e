r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar: a conversation is a sequence of turns, each ``### <Role>:\n<text></turn>\n``. A text is written as it is if a
deterministic parser recovers it from the rendered turn; the others are escaped and tried again until they are recovered:

level 0  the text itself
level 1  a backslash inside each control string (``</turn>`` to ``<\/turn>``, ``### `` to ``##\# ``)
level 2  level 1 with every backslash of the text doubled first; this level always reads back

The parser is strict: a turn must have its head, and neither control string may stand in its text; what breaks this is read as null,
which equals no source. Each level is rendered and parsed, and the first that gives the turn back is used. The terminator has no
border, so no text can form one together with what follows it, and turns can be checked one by one; the whole conversation is parsed
again afterwards (``round_trip``), and one that does not come back identical stops the job.

Defined cases: null text is empty, null role is an empty role; roles may hold any characters (newline, colon and backslash
are escaped); turns are ordered by (turn, role, text); repeated rows are turns of their own; a null conv_id is one conversation; an empty
table gives none. A conversation is one training example and so one output row, however many turns it has.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
HEAD = "### "


def unescape(text: Column) -> Column:
    r"""Undo ``escape``: ``\\``, ``\/`` and ``\#`` lose their first backslash, from left to right."""
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 2:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(END), F.lit("<\\/turn>")), F.lit(HEAD), F.lit("##\\# "))


def escape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(role, F.lit("\n"), F.lit("\\n")), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":"))
    return F.replace(role, F.lit("\\b"), F.lit("\\"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read from rendered turns; null for a piece that is no turn."""
    pieces = F.filter(F.split(formatted, END + "\n", -1), lambda x: x != "")
    head = r"\A### ([^\n]*):\n"

    def turn(x: Column) -> Column:
        body = F.regexp_replace(x, head, "")
        found = F.struct(unescape_role(F.regexp_extract(x, head, 1)).alias("role"), unescape(body).alias("text"))
        return F.when(F.regexp_like(x, F.lit(head)) & ~F.contains(body, F.lit(END)) & ~F.contains(body, F.lit(HEAD)), found)

    return F.transform(pieces, turn)


def render(role: Column, escaped: Column) -> Column:
    return F.concat(F.lit(HEAD), escape_role(role), F.lit(":\n"), escaped, F.lit(END + "\n"))


def reads_back(role: Column, escaped: Column, text: Column) -> Column:
    """Whether the parser recovers exactly this turn from its rendered form."""
    return F.coalesce(parse(render(role, escaped)) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array<struct<start, length>>, code points, of assistant texts as written), n_turns, round_trip."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    tries = [escape(F.col("text"), level) for level in (0, 1, 2)]
    good = [reads_back(F.col("role"), t, F.col("text")) for t in tries[:2]]
    rows = rows.withColumn("escaped", F.when(good[0], tries[0]).when(good[1], tries[1]).otherwise(tries[2]))
    rows = rows.withColumn("rendered", render(F.col("role"), F.col("escaped")))
    rows = rows.withColumn("head_chars", (F.char_length("rendered") - F.char_length("escaped") - len(END + "\n")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    start = F.sum(F.char_length("rendered").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.char_length("rendered")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("start", start + F.col("head_chars"))
    turn = F.struct("no", "rendered", "start", F.char_length("escaped").cast("long").alias("length"), "role", "text")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), "")).withColumn("loss_spans", spans)
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.coalesce(parse(F.col("formatted")) == source, F.lit(False))
    checked = F.when(same, True).otherwise(F.raise_error(F.lit("a formatted conversation does not read back")).cast("boolean"))
    return whole.select("conv_id", "formatted", "loss_spans", F.size("turns").cast("long").alias("n_turns"), checked.alias("round_trip"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader recovers from ``formatted`` and its loss mask."""
    turns = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    out = formatted.withColumn("parsed", parse(F.col("formatted"))).withColumn("loss_text", F.array_join(masked, ""))
    return out.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
