"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as <|turn|>role<|text|>text<|end|>; one repeated from before as <|past|>role<|text|>text<|end|>. In roles
and texts ~ becomes ~0 and <| becomes <~1|, so no text can hold a control string, and both are undone exactly.

Prefix sums of the turns' tokens choose spans: a window takes turns while the difference of two prefix sums stays in the
budget; a turn that is larger alone is a window of its own. Every later window of a conversation begins with its first
system turn, if that has been said, and with the last turns before the span that fit `history` tokens; both are repeated
as past. The loss mask holds the texts of assistant turns of the span only, so each is learned once.

No task needs a whole conversation. Turns are dealt by ranges of (conversation, turn, role, text), whatever the turn numbers
are; sums are made within a range, and as a range begins within one conversation at most, the sums before it are a row a
range. Spans are chosen within stretches of STRETCH budgets of these sums, so a window ends with its stretch, but history
and system turn cross over: a stretch also gets the turns of the one before that its first window may repeat.

Defined cases: null text or role is empty; turns are ordered by (turn, role, text), null first, and repeated rows are
turns of their own; a null conv_id is a conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_sized, written

TURN, PAST, TEXT, END = "<|turn|>", "<|past|>", "<|text|>", "<|end|>"
STRETCH = 32


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def n_tokens(text: Column) -> Column:
    """An estimate of a text's subword tokens: runs of up to 5 letters or digits, and single other characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,5}|[^\s\p{L}\p{N}]"))


def windows(turns: DataFrame, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, window, formatted, loss, n_new, n_past) of each window; windows are ordered by number, and loss has the
    code-point spans (start, end) of formatted that are learned."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.struct(F.col(conv_col).alias("conv")).alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # a prefix of the text is enough to deal rows by, and keeps long texts out of the sample that chooses the ranges
    rows = rows.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).withColumns({"block": F.spark_partition_id(), "cost": (n_tokens(F.col("text")) + 4).cast("long")})
    in_block = Window.partitionBy("key", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumn("pos", F.sum("cost").over(in_block) - F.col("cost")).drop("turn"))
    totals = rows.groupBy("key", "block").agg(F.sum("cost").alias("total"))
    offsets = totals.withColumn("offset", F.sum("total").over(Window.partitionBy("key").orderBy("block")) - F.col("total")).where("offset > 0").select("key", "block", "offset")
    rows = rows.join(F.broadcast(offsets), ["key", "block"], "left").withColumn("pos", F.col("pos") + F.coalesce("offset", F.lit(0)))  # a row a range at most

    size = STRETCH * budget
    stretch = F.floor(F.col("pos") / size)
    stretches = rows.groupBy("key", stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"))
    system = rows.where("role = 'system'").groupBy("key").agg(F.min(F.struct("pos", "cost", "role", "text")).alias("turn"))
    stretches = written(stretches.join(system.select("key"), "key", "left_semi").select("key", "stretch"))
    system = written(system.join(stretches.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"))
    systems = join_sized(stretches, system, ["key"], "n", stretches.count()).select("key", "stretch", F.lit(2).alias("kind"), "turn")
    near_end = F.col("pos") % size >= size - history
    places = F.when(near_end, F.array(F.struct(stretch.alias("stretch"), F.lit(0).alias("kind")), F.struct((stretch + 1).alias("stretch"), F.lit(1).alias("kind")))).otherwise(F.array(F.struct(stretch.alias("stretch"), F.lit(0).alias("kind"))))
    each = rows.select("key", F.explode(places).alias("place"), F.struct("pos", "cost", "role", "text").alias("turn")).select("key", "place.stretch", "place.kind", "turn")
    spans = each.unionByName(systems).groupBy("key", "stretch").agg(F.sort_array(F.collect_list(F.struct("turn.pos", "kind", "turn.cost", "turn.role", "turn.text"))).alias("all"))

    def of_kind(kind: int) -> Column:
        return F.filter("all", lambda x: x["kind"] == kind)

    spans = spans.select("key", of_kind(0).alias("t"), of_kind(1).alias("prior"), F.get(of_kind(2), F.lit(0)).alias("sys")).where(F.size("t") > 0)

    def led(start: Column) -> Column:
        return F.coalesce(start > F.col("sys.pos"), F.lit(False))

    # a fold over prefix sums: each turn's window begins at the prefix sum `start`
    fold_start = F.struct(F.lit(-1).cast("long").alias("start"), F.array().cast("array<long>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        again = F.greatest(F.lit(1), budget - history - F.when(led(a["start"]), F.col("sys.cost")).otherwise(0))
        room = F.when(a["start"] == 0, F.lit(budget)).otherwise(again)
        start = F.when((a["start"] < 0) | (x["pos"] + x["cost"] - a["start"] > room), x["pos"]).otherwise(a["start"])
        return F.struct(start.alias("start"), F.concat(a["starts"], F.array(start)).alias("starts"))

    spans = spans.withColumn("starts", F.aggregate("t", fold_start, step, lambda a: a["starts"]))
    spans = spans.withColumn("t", F.zip_with("t", "starts", lambda x, s: x.withField("start", s)))
    each = spans.select("key", "prior", "sys", "t", F.explode(F.array_distinct("starts")).alias("start"))
    own = F.filter("t", lambda x: x["start"] == F.col("start"))

    def past(turns: str) -> Column:
        kept = F.filter(turns, lambda x: (x["pos"] < F.col("start")) & (F.col("start") - x["pos"] <= history) & ~(led(F.col("start")) & (x["pos"] == F.col("sys.pos"))))
        return F.transform(kept, lambda x: F.struct(x["role"], x["text"]))

    first = F.when(led(F.col("start")), F.array(F.struct("sys.role", "sys.text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    each = each.select("key.conv", F.col("start").alias("window"), own.alias("new"), F.concat(first, past("prior"), past("t")).alias("past"))

    def shown(turns: str, mark: str) -> Column:
        return F.transform(turns, lambda x: F.struct(F.concat(F.lit(mark), escape(x["role"]), F.lit(TEXT)).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("learned")))

    def joined(turns: str) -> Column:
        return F.array_join(F.transform(turns, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")

    each = each.select("conv", "window", shown("new", TURN).alias("new"), shown("past", PAST).alias("past"))
    each = each.withColumn("lead", joined("past"))
    loss_start = F.struct(F.length("lead").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def mask(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        return F.struct((end + len(END)).alias("at"), F.when(x["learned"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["spans"]).alias("spans"))

    return each.select("conv", "window", F.concat("lead", joined("new")).alias("formatted"), F.aggregate("new", loss_start, mask, lambda a: a["spans"]).alias("loss"), F.size("new").alias("n_new"), F.size("past").alias("n_past"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Of each window of `windows`, from its text and mask alone: turns, an array of (role, text) of the span, and the learned
    text, both unescaped."""
    shown = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x.startswith(TURN))
    turns = F.transform(shown, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("conv", "window", turns.alias("turns"), learned.alias("learned"), F.length("formatted").alias("chars"))
