"""Chat formatting with a grammar round trip, in DataFrame functions only.

Each turn is rendered as ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a line break.  The
rendered text is read back by a deterministic parser: it splits at the end mark, wants each piece to
begin with the start mark, takes the role up to the first line break, allows no ``<|`` inside, and
undoes escapes.  Turns that do not come back as they were are escaped and the text is rendered and
parsed again, until it is identical.

The escape puts one ``\\`` more into every ``<``, ``\\``..., ``|``, so it is undone by taking one out, and an
escaped text holds no control string.  A role's line breaks become ``<|nl|>`` after that, which no
escaped text contains.  Hence the second rendering always comes back; a failure of it is an error.

Nulls and edge cases: null roles and texts are empty; turns are ordered by turn, role, text, with null turns
first; repeated rows are turns of their own; rows with a null conv_id form one conversation; other
columns are ignored; an empty table gives an empty result.  A conversation is one output row, so its
turns meet in one task by contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def _rendered(turns: Column) -> Column:
    """The text of all turns; those flagged ``hard`` are escaped."""
    one = lambda t: F.concat(
        F.lit(START), F.when(t.hard, _escaped_role(t.role)).otherwise(t.role), F.lit("\n"), F.when(t.hard, escaped(t.text)).otherwise(t.text), F.lit(END + "\n")
    )
    return F.array_join(F.transform(turns, one), "")


def parsed(text: Column) -> Column:
    """Turns (role, text, raw_role, raw, sound) of a rendered text, read from the text alone."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    head = len(START)

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece, head + 1)
        role, body = piece.substr(F.lit(head + 1), cut - head - 1), piece.substr(cut + 1, F.length(piece))
        plain = F.replace(role, F.lit(LINE), F.lit(""))
        sound = piece.startswith(START) & (cut > 0) & ~plain.contains("<|") & ~body.contains("<|")
        return F.struct(unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text"), role.alias("raw_role"), body.alias("raw"), sound.alias("sound"))

    # nothing may follow the last end mark
    return F.when(F.element_at(pieces, -1) == "", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))


def _same(turns: Column, back: Column) -> Column:
    pairs = F.zip_with(turns, back, lambda a, b: b.sound & (a.role == b.role) & (a.text == b.text))
    return F.coalesce((F.size(turns) == F.size(back)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def _alone_fails(turn: Column) -> Column:
    """Whether one turn, rendered by itself, does not come back."""
    single = F.array(F.struct(turn.role.alias("role"), turn.text.alias("text"), F.lit(False).alias("hard")))
    return ~_same(single, parsed(_rendered(single)))


def formatted(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, the formatted text, and its turns as parsed from it."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), F.lit(False).alias("hard"))))
    tried = plain.withColumn("formatted", _rendered(F.col("turns"))).withColumn("same", _same(F.col("turns"), parsed(F.col("formatted"))))
    hard = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), _alone_fails(t).alias("hard")))
    again = tried.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(hard)).withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(_rendered(F.col("turns"))))
    read = again.withColumn("parsed", parsed(F.col("formatted")))
    proven = F.when(_same(F.col("turns"), F.col("parsed")), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text")))
    return read.select("conv_id", "formatted", proven.alias("turns"))


def loss_spans(turns: Column) -> Column:
    """Character ranges (start, end) of the formatted text that are trained on, from the parsed turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state.at + len(START) + F.length(t.raw_role) + 1
        last = first + F.length(t.raw)
        own = F.array(F.struct(first.cast("long").alias("start"), last.cast("long").alias("end")))
        return F.struct((last + len(END) + 1).cast("long").alias("at"), F.when(t.role == TRAINED, F.concat(state.spans, own)).otherwise(state.spans).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s.spans)


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the text as read back."""
    everything = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("turns", lambda t: t.role == TRAINED), lambda t: t.text), "")
    return conversations.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(everything, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
