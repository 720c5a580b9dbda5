"""Chat formatting: every assistant turn becomes an example, with all turns before it as context and only its text trainable.

A turn's form doesn't depend on the turns behind it, so every example is a prefix of the conversation's own form: a
conversation is formatted once (`format_conversations`, with the places of the trainable texts), and `expand` cuts the
examples out of it, one row at a time. Turns behind the last reply are context of no reply; they are a last example
without trainable text, so that the output holds the whole conversation and `read_back` can return it.

The template: `<<SYS>>...<</SYS>>` for the system, `[INST] ... [/INST]` for the user, `<s> ... </s>` for the assistant, and
`[ROLE]name[/ROLE]...</s>` for any other role. In texts and names `~` becomes `~0`, and `~1` is put behind the first
character of a control string, so that none occurs inside a text; taking these out again restores it.

Examples repeat their context by definition: n turns make up to n * n / 2 turns of examples. They are made row by row
and never shuffled; what is shuffled is each conversation once, and on the way back each reply once. A conversation is
a row (2 GB at most), as its digest is over all of it.

Defined results. Order of rows: turn, nulls first, then role, then text; repeated rows are turns of their own. Null
text: empty. Null role: the empty role. Null conv_id: a conversation of its own. Texts of any length are formatted
whole. No assistant turn: the last example alone. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import pick

#: (role, before the text, behind it).
TEMPLATE = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>"))
OTHER = ("[ROLE]", "[/ROLE]", "</s>")
TRAINED = "assistant"
#: The first character of a control string, and the end of a turn.
_CONTROL = r"(\[(?=/?(?:INST|ROLE)\])|<(?=</?SYS>>|/?s>))"
_END = r"(?<=<</SYS>>|\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~0")), _CONTROL, "$1~1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def _lead(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    for name, before, _ in TEMPLATE:
        out = F.when(role == name, before).otherwise(out)
    return out


def _tail(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, _, behind in TEMPLATE:
        out = F.when(role == name, behind).otherwise(out)
    return out


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole conversation's text) and replies, in code points: a reply's text is [lo, hi), its example what precedes stop."""
    at = pick(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = at.select("*", _lead(F.col("role")).alias("lead"), escape(F.col("text")).alias("body"), _tail(F.col("role")).alias("tail"))
    sized = parts.select("conv_id", "turn", "role", "text", F.concat("lead", "body", "tail").alias("form"), F.length("lead").alias("lead"), F.length("body").alias("body"))
    ahead = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum(F.length("form").cast("long")).over(ahead), F.lit(0)))
    lo = F.col("at") + F.col("lead")
    reply = F.struct(lo.alias("lo"), (lo + F.col("body")).alias("hi"), (F.col("at") + F.length("form")).alias("stop"))
    turn = F.struct("at", "form", F.when(F.col("role") == TRAINED, reply).alias("reply"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["form"]), "")
    return turns.select("conv_id", text.alias("formatted"), F.array_compact(F.transform("turns", lambda t: t["reply"])).alias("replies"))


def expand(formatted: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, ...), text, lo, hi (the trainable part), last (holds the whole conversation): one row a reply."""
    n = F.length("formatted").cast("long")
    rest = F.struct(n.alias("lo"), n.alias("hi"), n.alias("stop"))
    ended = F.coalesce(F.get("replies", F.size("replies") - 1)["stop"], F.lit(-1)) == n
    spans = formatted.select("conv_id", "formatted", n.alias("n"), F.when(ended, F.col("replies")).otherwise(F.array_append("replies", rest)).alias("spans"))
    cut = spans.select("conv_id", "formatted", "n", F.posexplode("spans").alias("example", "span"))
    return cut.select("conv_id", "example", F.substr("formatted", F.lit(1), F.col("span.stop").cast("int")).alias("text"), "span.lo", "span.hi", (F.col("span.stop") == F.col("n")).alias("last"))


def parse(text: Column) -> Column:
    """Formatted text to an array of (role, text)."""

    def turn(x: Column) -> Column:
        after = F.locate(OTHER[1], x)
        out = F.struct(
            unescape(F.substr(x, F.lit(len(OTHER[0]) + 1), after - len(OTHER[0]) - 1)).alias("role"),
            unescape(F.substr(x, after + len(OTHER[1]), F.length(x) - after - len(OTHER[1]) - len(OTHER[2]) + 1)).alias("text"),
        )
        for name, before, behind in TEMPLATE:
            body = F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(behind))
            out = F.when(F.startswith(x, F.lit(before)), F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(F.split(text, _END, -1), lambda x: x != ""), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns, all that is trained, and how much text they are.

    Turns are read from the last example, trained text from every example's own mask.
    """
    trained = unescape(F.substr("text", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    each = examples.select("conv_id", F.struct("example", trained.alias("text")).alias("trained"), F.length("text").cast("long").alias("n"), F.when(F.col("last"), F.col("text")).alias("whole"))
    joined = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("trained")).alias("trained"), F.sum("n").alias("formatted_chars"), F.max("whole").alias("whole"), F.count("*").alias("n_examples"))
    told = joined.select("conv_id", "formatted_chars", "n_examples", F.array_join(F.transform("trained", lambda t: t["text"]), "").alias("loss"), parse(F.col("whole")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
