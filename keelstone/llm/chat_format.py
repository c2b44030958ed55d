"""Chat formatting by a grammar round trip, in DataFrame operations only.

A conversation is written as its turns, joined by newlines::

    conversation := turn ("\\n" turn)*
    turn         := "<turn " role ">" text "</turn>"

No text may hold ``<turn `` or ``</turn>``, and no role ``<`` or ``>``.  A deterministic
parser cuts at the closing marks and reads every role and text through
``unescape``.  Turns are first rendered as they are; those that the parser would not
give back are escaped, and a conversation that still differs is escaped as a whole.
Nothing leaves here that does not parse back to its source.

Escapes put one backslash after a character that is not one, while every backslash
of the source is doubled; so a single backslash always marks an escape, and
undoing them in order is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>"
#: What stands for a control string in an escaped role or text.
ESCAPES = {CLOSE: "<\\/turn>", OPEN: "<\\turn "}
ROLE_ESCAPES = {"<": "-\\l", ">": "-\\g"}


def _swap(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, role: bool = False) -> Column:
    return _swap(c, [("\\", "\\\\"), *(ROLE_ESCAPES if role else ESCAPES).items()])


def unescape(c: Column) -> Column:
    return _swap(c, [*((b, a) for a, b in (ESCAPES | ROLE_ESCAPES).items()), ("\\\\", "\\")])


def conflicts(c: Column, role: bool = False) -> Column:
    """Whether a role or text would not be read back as it is."""
    bad = unescape(c) != c
    for mark in ROLE_ESCAPES if role else ESCAPES:
        bad = bad | F.contains(c, F.lit(mark))
    return bad


def _render(turns: Column, always: bool) -> Column:
    def one(t: Column) -> Column:
        role = escape(t["role"], True) if always else F.when(conflicts(t["role"], True), escape(t["role"], True)).otherwise(t["role"])
        text = escape(t["text"]) if always else F.when(conflicts(t["text"]), escape(t["text"])).otherwise(t["text"])
        return F.concat(F.lit(OPEN), role, F.lit(">"), text, F.lit(CLOSE))

    return F.array_join(F.transform(turns, one), "\n")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(formatted: Column) -> Column:
    """What stands before each closing mark, and after the last."""
    return F.split(formatted, r"\Q" + CLOSE + r"\E", -1)


def running_sums(values: Column) -> Column:
    """The sum of an array up to each place, by doubling: ``log2(n)`` steps over the whole array."""
    shifts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: F.pow(F.lit(2), j).cast("int")), lambda s: s < F.size(values))
    return F.aggregate(shifts, values, lambda p, s: F.transform(p, lambda x, i: x + F.when(i >= s, F.get(p, i - s)).otherwise(F.lit(0).cast("long"))))


def parse(formatted: Column) -> Column:
    """Turns as an array of (role, text, start, length); the last two are the raw text's place in code points.

    Null where the text does not follow the grammar.
    """

    def read(block: Column, i: Column) -> Column:
        """One turn, with its block's length; null if it does not follow the grammar."""
        joined = i > 0  # all but the first begin with the newline that joins them to the one before
        body = F.when(~joined, block).when(F.startswith(block, F.lit("\n")), F.substring(block, 2, 2147483647))
        head = F.substring_index(body, ">", 1)
        raw = F.length(body) - F.length(head) - 1
        text = F.substring(body, F.length(head) + 2, 2147483647)
        good = F.startswith(body, F.lit(OPEN)) & (raw >= 0) & ~F.contains(text, F.lit(OPEN))
        role = unescape(F.substring(head, len(OPEN) + 1, 2147483647))
        return F.when(good, F.struct(role.alias("role"), unescape(text).alias("text"), raw.cast("long").alias("length")))

    def place(blocks: Column, turns: Column) -> Column:
        """A raw text ends where its block does."""
        ends = running_sums(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.length(b).cast("long") + len(CLOSE)))
        placed = F.zip_with(turns, ends, lambda t, e: F.struct(t["role"].alias("role"), t["text"].alias("text"), (e - len(CLOSE) - t["length"]).alias("start"), t["length"].alias("length")))
        whole = (F.element_at(blocks, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
        return F.when(whole, placed)

    return _let(_blocks(formatted), lambda blocks: _let(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), read), lambda turns: place(blocks, turns)))


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per ``conv_id``: ``turns``, ``formatted`` and ``loss_spans``.

    Rows are ordered by ``turn`` (nulls first), then role and text; equal rows are all
    kept.  A null role or text is empty.  Rows with a null ``conv_id`` form one
    conversation.  ``turns`` are read back from ``formatted``; ``loss_spans`` are
    (start, length, turn) of the texts of ``loss_roles`` there, still escaped: the place in
    code points and the number of the turn, from 0.
    Fails if a conversation cannot be read back.  Other columns are ignored; an empty
    table gives an empty result.  A conversation is one string, so it has to fit in
    a task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))
    plain = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    read = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = convs.select("conv_id", plain.alias("source"))
    convs = convs.withColumn("formatted", _render(F.col("source"), always=False)).withColumn("parsed", parse(F.col("formatted")))
    same = F.coalesce(read(F.col("parsed")) == F.col("source"), F.lit(False))
    convs = convs.withColumn("same", same)
    convs = convs.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(_render(F.col("source"), always=True)))
    convs = convs.withColumn("parsed", F.when(F.col("same"), F.col("parsed")).otherwise(parse(F.col("formatted"))))
    ok = F.coalesce(read(F.col("parsed")) == F.col("source"), F.lit(False))
    turns = F.when(ok, F.col("parsed")).otherwise(F.raise_error(F.concat(F.lit("conversation cannot be read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    numbered = F.transform("turns", lambda t, i: F.when(t["role"].isin(*loss_roles), F.struct(t["start"].alias("start"), t["length"].alias("length"), i.alias("turn"))))
    spans = F.filter(numbered, lambda s: s.isNotNull())
    return convs.select("conv_id", "formatted", turns.alias("turns")).select("conv_id", read(F.col("turns")).alias("turns"), "formatted", spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    A span ends where its turn's block does, so it is read there; counting code points from
    the text's beginning for every span would take quadratic time.
    """

    def read(blocks: Column) -> Column:
        own = lambda s: F.get(blocks, s["turn"])
        texts = F.transform(spans, lambda s: unescape(F.substring(own(s), F.length(own(s)) - s["length"].cast("int") + 1, s["length"].cast("int"))))
        return F.array_join(texts, "")

    return _let(_blocks(formatted), read)
