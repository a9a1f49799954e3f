"""Chat formatting with a grammar round trip, in DataFrame operations only.

The grammar: a formatted conversation is a run of turns, each an opening marker, a body without
markers, and the closing marker of the same kind. A deterministic parser splits at the closing
markers. Every turn is rendered and parsed again; a text that doesn't come back as it was is
escaped. The conversation is then parsed as a whole; if any turn differs, all its texts are
escaped, and if one still differs the job fails.

Escaping adds a backslash after the first character of whatever would read as a marker or as an
escaped marker; unescaping takes one away. So ordinary backslashes stay as they are.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null text is
empty, a null role is the empty role; repeated rows are repeated turns. Rows with a null
conversation id form one conversation. A conversation's digest needs its turns in one place, so
they are gathered by conversation after rendering, and nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing markers by role; other roles are written in hexadecimal before the text.
MARKERS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]")
OPENING, CLOSING = r"^(?:<s>|\[(?:INST|SYS|ROLE)\])", r"</s>|\[/(?:INST|SYS|ROLE)\]"
ANY_MARKER = r"</?s>|\[/?(?:INST|SYS|ROLE)\]"
_ESCAPABLE = ((r"<(\\*)(/?s>)", "<"), (r"\[(\\*)(/?(?:INST|SYS|ROLE)\])", "["))
_ESCAPED = ((r"<\\(\\*)(/?s>)", "<"), (r"\[\\(\\*)(/?(?:INST|SYS|ROLE)\])", "["))


def escape(text: Column) -> Column:
    for pattern, first in _ESCAPABLE:
        text = F.regexp_replace(text, pattern, first + r"\\$1$2")
    return text


def unescape(text: Column) -> Column:
    for pattern, first in _ESCAPED:
        text = F.regexp_replace(text, pattern, first + "$1$2")
    return text


def _by_role(role: Column, index: int) -> Column:
    out = F.lit(OTHER[index])
    for name, markers in MARKERS.items():
        out = F.when(role == name, markers[index]).otherwise(out)
    return out


def _named(role: Column) -> Column:
    """What stands before the text of a role without markers of its own."""
    return F.when(role.isin(*MARKERS), "").otherwise(F.concat(F.hex(F.encode(role, "UTF-8")), F.lit("\n")))


def render(role: Column, text: Column) -> Column:
    return F.concat(_by_role(role, 0), _named(role), text, _by_role(role, 1))


def parse(formatted: Column) -> Column:
    """Array of (role, text, open, body, close); null if the text isn't of the grammar."""
    pieces = F.split(formatted, CLOSING)

    def turn(piece: Column) -> Column:
        opening = F.regexp_extract(piece, OPENING, 0)
        body = F.substr(piece, F.char_length(opening) + 1)
        role = F.lit(None).cast("string")
        for name, markers in MARKERS.items():
            role = F.when(opening == markers[0], name).otherwise(role)
        name = F.substring_index(body, "\n", 1)
        other = opening == OTHER[0]
        role = F.when(other, F.decode(F.unhex(name), "UTF-8")).otherwise(role)
        text = F.when(other, F.substr(body, F.char_length(name) + 2)).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"), opening.alias("open"), body.alias("body"), _by_role(role, 1).alias("close"))

    found = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
    sound = (F.element_at(pieces, -1) == "") & ~F.exists(found, lambda t: t["role"].isNull() | t["body"].rlike(ANY_MARKER))
    again = F.array_join(F.transform(found, lambda t: F.concat(t["open"], t["body"], t["close"])), "")
    return F.when(sound & (again == formatted), found)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def formatted_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, turns (as parsed from it) and loss_mask, runs of
    (chars, on) over the formatted text, on for the assistant's bodies."""
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("again", _plain(parse(render(F.col("role"), F.col("text")))))
    same = F.coalesce(F.col("again") == F.array(F.struct("role", "text")), F.lit(False))
    rows = rows.select("c", "turn", "role", "text", render(F.col("role"), F.when(same, F.col("text")).otherwise(escape(F.col("text")))).alias("shown"))
    whole = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text", "shown"))).alias("source"))
    whole = whole.withColumn("first", F.array_join(F.col("source.shown"), "")).withColumn("source", _plain(F.col("source")))
    whole = whole.withColumn("ok", F.coalesce(_plain(parse(F.col("first"))) == F.col("source"), F.lit(False)))
    escaped = F.array_join(F.transform("source", lambda t: render(t["role"], escape(t["text"]))), "")
    whole = whole.withColumn("formatted", F.when(F.col("ok"), F.col("first")).otherwise(escaped)).withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(_plain(F.col("turns")) == F.col("source"), F.lit(False))
    whole = whole.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't come back from its formatted text"))))
    run = lambda chars, on: F.struct(chars.alias("chars"), on.alias("on"))
    mask = F.flatten(F.transform("turns", lambda t: F.array(run(F.char_length(t["open"]), F.lit(False)), run(F.char_length(t["body"]), t["role"] == "assistant"), run(F.char_length(t["close"]), F.lit(False)))))
    return whole.select(F.col("c").alias(conv_col), "formatted", _plain(F.col("turns")).alias("turns"), mask.alias("loss_mask"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from the formatted text: counts and digests by conversation."""
    back = formatted.select(conv_col, "formatted", parse(F.col("formatted")).alias("turns"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    back = back.select(conv_col, "formatted", F.size("turns").cast("long").alias("n_turns"), turns.alias("all"), loss.alias("loss"))
    return back.select(conv_col, "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
