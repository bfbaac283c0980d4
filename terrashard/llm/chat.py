"""Chat formatting with a grammar round trip.

A conversation is rendered as one string of turns

    <|turn|>ROLE LEVEL\nTEXT<|end|>\n

Rendered text is reparsed by a deterministic parser (split at the turn mark, then header, body and end mark), whose
grammar has no place for a control string in a header or body, and compared with its source, turn by turn. Each
conversation is first rendered with its texts as they are (level 0). Where the parse differs from the source, it is
rendered at the next level and compared again, until both are identical: level 1 puts a backslash inside every control
string and one more inside every string that looks escaped already; level 2 spells every character that could take part in
one. A conversation that no level gives back is an error, so round_trip, the outcome of the last comparison, is always true.
The control strings are those of this template and the customary <s>, </s>, [INST], [/INST] and <|...|>.

The loss mask is a list of code-point spans of the formatted string: the assistant's texts. All is built-in column
expressions after one grouping by conversation; a conversation is one string, so its turns do meet in one row.

Defined results: null text or role is empty; turns go by turn (null first), ties by role and text, repeated rows are
repeated turns; a null conv_id is a conversation; an empty table gives an empty one. Only conv_id, turn, role and text
are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: What could be taken for control: an opening character, backslashes that escaping put there, the rest; and control itself.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
BARE = r"[<\[](\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
LOSS_ROLE = "assistant"
#: Turns whose places are summed at a time.
GROUP = 300
#: Level 2: characters and how they are spelled, the backslash first.
SPELLED = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def spell(text: Column) -> Column:
    for plain, spelled in SPELLED:
        text = F.replace(text, F.lit(plain), F.lit(spelled))
    return text


def read_out(text: Column) -> Column:
    for plain, spelled in reversed(SPELLED):
        text = F.replace(text, F.lit(spelled), F.lit(plain))
    return text


def each(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escape_role(role: Column) -> Column:
    r"""A role on one line: \\ becomes \\s and a newline \\n, before control strings are escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def levels() -> tuple:
    """(role, text) as each level writes them, and as it reads them back."""
    same_ = lambda c: c
    return ((same_, same_, same_, same_), (escape_role, escape, unescape_role, unescape), (spell, spell, read_out, read_out))


def turn_string(role: Column, text: Column, level: int) -> Column:
    write_role, write_text, _, _ = levels()[level]
    return F.concat(F.lit(TURN), write_role(role), F.lit(f" {level}\n"), write_text(text), F.lit(f"{END}\n"))


def rendered(turns: Column, level: int) -> Column:
    return F.array_join(F.transform(turns, lambda t: turn_string(t["role"], t["text"], level)), "")


def read_at(level: Column, value: Column, k: int) -> Column:
    """A role (k = 2) or text (k = 3) as it was before a level wrote it; null where the level's grammar has no such string."""
    zero, one, two = (how[k] for how in levels())
    return F.when((level == "0") & ~F.rlike(value, F.lit(CONTROL)), zero(value)).when((level == "1") & ~F.rlike(value, F.lit(BARE)), one(value)).when((level == "2") & ~F.rlike(value, F.lit(r"[<\[]")), two(value))


def parsed(formatted: Column) -> Column:
    """Turns of a formatted string: role, head (length of the header), body (as written) and text (unescaped); null roles and texts where it breaks the grammar."""

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2, F.greatest(F.length(part) - F.length(head) - F.lit(len(END) + 2), F.lit(0)))
        level = F.substring_index(head, " ", -1)
        role = F.substr(head, F.lit(1), F.greatest(F.length(head) - F.length(level) - 1, F.lit(0)))
        ended = F.endswith(part, F.lit(f"{END}\n"))
        return F.struct(F.when(ended, read_at(level, role, 2)).alias("role"), F.length(head).alias("head"), body.alias("body"), F.when(ended, read_at(level, body, 3)).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>"), lambda p, i: i > 0), turn)


def same(formatted: Column, turns: Column) -> Column:
    """Whether the parse gives back the turns."""
    plain = lambda ts: F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return plain(parsed(formatted)).eqNullSafe(plain(turns))


def fitted(turns: Column, level: int = 0) -> Column:
    """struct<formatted, level, round_trip> of the first level, from this one on, whose rendering parses back to the turns."""
    if level == len(levels()):
        return F.raise_error(F.lit("no level gives a conversation back")).cast("struct<formatted:string,level:int,round_trip:boolean>")
    return each(rendered(turns, level), lambda made: each(same(made, turns), lambda ok: F.when(ok, F.struct(made.alias("formatted"), F.lit(level).alias("level"), ok.alias("round_trip"))).otherwise(fitted(turns, level + 1))))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, level, round_trip, loss_spans (array of start, length in code points, from 0)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chosen = turns.select("conv_id", fitted(F.col("turns")).alias("f")).select("conv_id", "f.formatted", "f.level", "f.round_trip")
    checked = chosen.select("*", placed(F.col("formatted")).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["role"] == LOSS_ROLE), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return checked.select("conv_id", "formatted", "level", "round_trip", spans.alias("loss_spans"))


def before(sizes: Column) -> Column:
    """Sums of the numbers before each: within groups of GROUP, and over the groups' sums, so that no long array is copied for each number."""
    added = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    groups = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / GROUP).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    run = lambda first, a: F.aggregate(a, F.array(first), lambda x, y: F.array_append(x, F.element_at(x, -1) + y))
    part = lambda a, g: F.slice(a, g * GROUP + 1, F.lit(GROUP))
    starts = lambda a: run(F.lit(0).cast("long"), F.transform(groups(F.size(a)), lambda g: added(part(a, g))))
    within = lambda a, s: F.flatten(F.transform(groups(F.size(a)), lambda g: each(part(a, g), lambda p: F.slice(run(F.get(s, g), p), F.lit(1), F.size(p)))))
    return each(sizes, lambda a: each(starts(a), lambda s: within(a, s)))


def placed(formatted: Column) -> Column:
    """parsed(), and start and length of each body in the formatted string, in code points from 0."""

    def with_starts(parts: Column) -> Column:
        size = F.transform(parts, lambda p: (F.lit(len(TURN) + len(END) + 2) + p["head"] + F.length(p["body"])).cast("long"))
        return F.zip_with(parts, before(size), lambda p, at: F.struct(p["role"].alias("role"), p["body"].alias("body"), p["text"].alias("text"), (at + len(TURN) + p["head"] + 1).alias("start"), F.length(p["body"]).cast("long").alias("length")))

    return each(parsed(formatted), with_starts)


def digests(made: DataFrame) -> DataFrame:
    """What is read back from formatted strings and their loss spans."""
    level = F.col("level")
    plain = lambda x: F.when(level == 0, x).when(level == 1, unescape(x)).otherwise(read_out(x))
    read = made.select("conv_id", "formatted", "level", "round_trip", "loss_spans", placed(F.col("formatted")).alias("parts"))
    # Spans are in order, and so are the parts that they point to: both are gone through once, where cutting each span out would read the string again from its beginning.
    of_loss = F.filter("parts", lambda p: p["role"] == LOSS_ROLE)
    wrong = F.raise_error(F.lit("a loss span is no assistant's text")).cast("string")
    loss = F.zip_with(of_loss, "loss_spans", lambda p, s: F.when((p["start"] == s["start"]) & (p["length"] == s["length"]), plain(p["body"])).otherwise(wrong))
    read = read.select("conv_id", "formatted", "round_trip", "parts", F.array_join(loss, "").alias("loss"))
    turns = F.array_join(F.transform("parts", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )
