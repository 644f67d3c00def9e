"""Format conversations for training, with Spark expressions only.

A conversation is a run of blocks, one for each run of adjacent turns of the same role::

    <|im_start|>ROLE
    TEXT<|im_next|>TEXT<|im_end|>

each block ends with a line break. In texts and roles a control string can't occur: a backslash goes
between ``<`` and ``|``, and one more where there are some already, so that the original can be read
back. In roles, line breaks and percent signs are written as ``%0A`` and ``%25`` on top of that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START = "<|im_start|>"
NEXT = "<|im_next|>"
END = "<|im_end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """A text in which no control string can be found."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and however often ``body`` uses it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """For each item of an array, the sum of those before it. Every step copies what there is: for short arrays."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(
        lengths,
        start,
        lambda seen, length: F.struct(
            (seen["sum"] + length).alias("sum"), F.array_append(seen["all"], seen["sum"]).alias("all")
        ),
        lambda seen: seen["all"],
    )


def _before(lengths: Column) -> Column:
    """For each item of an array of lengths, the sum of the items before it.

    The array is cut into as many pieces as a piece has items. Sums run inside each piece and over the pieces, so what is
    copied are n times the root of n references: for a million items not much more than the items themselves.
    """

    def summed(lengths: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
        cut = _let(width, lambda w: F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.slice(lengths, i * w + 1, w)))
        total = F.lit(0).cast("bigint")

        def joined(pieces: Column) -> Column:
            starts = _running(F.transform(pieces, lambda piece: F.aggregate(piece, total, lambda a, b: a + b)))
            inside = F.transform(pieces, _running)
            return F.flatten(F.zip_with(inside, starts, lambda sums, first: F.transform(sums, lambda s: s + first)))

        return _let(cut, joined)

    return _let(lengths, summed)


_SPANS = "array<struct<turn:int,start:bigint,length:int>>"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: one row per conversation.

    The rows (``conv_id, turn, role, text``) of a conversation are sorted by ``turn``, then ``role``
    and ``text``, so ties have one order; a null ``turn`` comes first. Null texts and roles are empty. Equal
    rows are turns of their own. Rows without ``conv_id`` are one conversation without id. An empty
    table gives an empty result, and other columns are not read. ``loss`` lists the spans of
    assistant texts in ``formatted``: the number of the turn in that order, and start and length in code points. Empty
    texts have spans too. Time and memory grow with the turns of a conversation and the length of its texts.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    return collected.select("conv_id", _let(_blocks(F.col("turns")), _written).alias("out")).select("conv_id", "out.*")


def _blocks(turns: Column) -> Column:
    """Adjacent turns of a role as ``role, first`` (the number of its first turn) ``, texts``."""

    def merged(heads: Column) -> Column:
        def block(head: Column, i: Column) -> Column:
            after = F.coalesce(F.get(heads, i + 1), F.size(turns))
            texts = F.transform(F.slice(turns, head + 1, after - head), lambda turn: escaped(turn["text"]))
            return F.struct(
                _escaped_role(F.get(turns, head)["role"]).alias("role"),
                (F.get(turns, head)["role"] == ASSISTANT).alias("learned"),
                head.alias("first"),
                texts.alias("texts"),
            )

        return F.transform(heads, block)

    heads = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    return _let(heads, merged)


def _written(blocks: Column) -> Column:
    """``formatted`` and ``loss`` of a conversation's blocks."""

    def text_of(block: Column) -> Column:
        return F.concat(
            F.lit(START), block["role"], F.lit("\n"), F.array_join(block["texts"], NEXT), F.lit(f"{END}\n")
        )

    def spans(block: Column, start: Column) -> Column:
        """The block's texts in the conversation; the block begins at ``start``."""
        head = start + F.length(block["role"]) + len(START) + 1
        gaps = _before(F.transform(block["texts"], lambda text: (F.length(text) + len(NEXT)).cast("bigint")))
        placed = F.zip_with(
            F.transform(block["texts"], lambda text, k: F.struct((block["first"] + k).alias("turn"), F.length(text).alias("length"))),
            gaps,
            lambda own, gap: F.struct(own["turn"].alias("turn"), (head + gap).alias("start"), own["length"].alias("length")),
        )
        return F.when(block["learned"], placed.cast(_SPANS)).otherwise(F.array().cast(_SPANS))

    def out(written: Column) -> Column:
        starts = _before(F.transform(written, lambda text: F.length(text).cast("bigint")))
        return F.struct(
            F.array_join(written, "").alias("formatted"),
            F.flatten(F.zip_with(blocks, starts, spans)).alias("loss"),
        )

    return _let(F.transform(blocks, text_of), out)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of ``role, text``."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda block: block != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        said = F.split(F.substr(block, F.length(role) + 2), r"<\|im_next\|>")
        name = _unescaped_role(F.substr(role, F.lit(len(START) + 1)))
        return _let(
            name, lambda name: F.transform(said, lambda text: F.struct(name.alias("role"), unescaped(text).alias("text")))
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, as an array.

    Each span is cut from what its own turn has written, so a long conversation isn't walked through for each span.
    """
    own = F.split(formatted, r"(?<=<\|im_end\|>\n)|(?<=<\|im_next\|>)")

    def cut(pieces: Column) -> Column:
        starts = _before(F.transform(pieces, lambda piece: F.length(piece).cast("bigint")))
        return _let(
            starts,
            lambda starts: F.transform(
                loss,
                lambda span: unescaped(
                    F.substr(
                        F.get(pieces, span["turn"]),
                        (span["start"] - F.get(starts, span["turn"]) + 1).cast("int"),
                        span["length"],
                    )
                ),
            ),
        )

    return _let(own, cut)
