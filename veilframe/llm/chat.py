r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and only
its own text may be trained on (``loss_start`` to ``loss_end``, code points of
``formatted``, end exclusive).  A conversation that does not end in an assistant turn
gets one more example over all its turns with nothing trainable, so that no turn is
lost.

A turn is written ``### role: text</turn>\n``.  In texts and roles a backslash is
doubled and one is put inside ``###`` and ``</turn>``, so neither can occur in what a
turn says; ``unescape`` drops the backslashes again.

* A null role or text is empty.  Turns are ordered by turn (null first), role, text;
  rows that repeat are turns of their own.  Rows of a null conv_id form one
  conversation.  An empty table gives no examples; other columns are ignored.
* Texts are read whole, whatever their length; a conversation with all its contexts has to
  fit a row of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, END = "### ", "</turn>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    hashes = F.regexp_replace(doubled, "#(?=##)", r"#\\")
    return F.replace(hashes, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, target (place of the last turn, from 0), context, formatted,
    loss_start, loss_end."""
    said = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    rows = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t.role), F.lit(": "))
    parts = F.transform(
        "said",
        lambda t: F.struct(
            F.concat(head(t), escape(t.text), F.lit(END)).alias("part"),
            F.length(head(t)).alias("head"),
            F.length(escape(t.text)).alias("size"),
            (t.role == TRAINED).alias("trained"),
        ),
    )
    last = F.size("parts") - 1
    shown = rows.select("conv_id", parts.alias("parts")).select(
        "conv_id",
        "parts",
        F.explode(
            F.filter(
                F.sequence(F.lit(0), last), lambda i: (i == last) | F.get("parts", i)["trained"]
            )
        ).alias("target"),
    )
    turn = F.get("parts", F.col("target"))
    context = F.array_join(F.slice(F.col("parts.part"), F.lit(1), F.col("target")), "")
    start = F.length("context") + F.col("own.head")
    return (
        shown.select("conv_id", "target", context.alias("context"), turn.alias("own"))
        .withColumn("loss_start", F.when(F.col("own.trained"), start))
        .select(
            "conv_id",
            "target",
            "context",
            F.concat("context", "own.part").alias("formatted"),
            "loss_start",
            (F.col("loss_start") + F.col("own.size")).alias("loss_end"),
        )
    )


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """What stands under the loss mask, unescaped; null where nothing is trained."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    role = r"(?s)^### ([^:\\]*+(?:\\.[^:\\]*+)*+): (.*)$"
    parts = F.split(formatted, END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, role, 1)).alias("role"),
            unescape(F.regexp_extract(p, role, 2)).alias("text"),
        ),
    )
