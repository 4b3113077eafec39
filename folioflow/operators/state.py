"""Assignment state as a fold over an append-only event log, with validation and stop rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import rules


def fold(events: DataFrame) -> DataFrame:
    """The last event of each (accession, item) wins; an unassign leaves nothing.  Negative places are null."""
    last = events.groupBy("accession", "item").agg(F.max_by(F.struct("action", "anchor_id", "o", "turn"), F.struct("turn", "ord")).alias("e"))
    kept = last.filter("e.action = 'assign'")
    return kept.select("accession", "item", "e.anchor_id", F.when(F.col("e.o") >= 0, F.col("e.o")).alias("o"), "e.turn")


def batch_events(batches: DataFrame) -> DataFrame:
    """One assign event for each entry of ``assignments`` (array of item, anchor_id, o) of a turn."""
    return batches.select("accession", "turn", F.posexplode("assignments").alias("ord", "a")).select("accession", "turn", "ord", F.lit("assign").alias("action"), "a.item", "a.anchor_id", "a.o")


def pre_populated(chosen: DataFrame) -> DataFrame:
    """The chosen chain as assign events of turn 0, in order of place; later events of an item win over them."""
    by = Window.partitionBy("accession").orderBy("o", rules.seq_of(F.col("item")))
    return chosen.select("accession", F.lit(0).alias("turn"), (F.row_number().over(by) - 1).alias("ord"), F.lit("assign").alias("action"), "item", "anchor_id", F.col("o").cast("long").alias("o"))


def listed(assignments: DataFrame) -> DataFrame:
    """Rows in order of place (null first), with their rank."""
    by = Window.partitionBy("accession").orderBy(F.coalesce("o", F.lit(-1)), "turn", "item")
    return assignments.withColumn("rank", F.row_number().over(by))


def issues(assignments: DataFrame, lengths: DataFrame, null_breaks_order: bool = True) -> DataFrame:
    """accession, type, item: duplicate, out_of_range, order_violation, non_monotonic and missing_expected.

    ``null_breaks_order``: rows without a place stand first and count as predecessors in the order check.
    """
    a = assignments.join(lengths, "accession").withColumn("seq", rules.seq_of(F.col("item")))
    order = Window.partitionBy("accession").orderBy(F.coalesce("o", F.lit(-1)), "seq")
    dup = a.groupBy("accession", "item").count().filter("count > 1").select("accession", F.lit("duplicate").alias("type"), "item")
    out = a.filter("o is not null and (o < 0 or o >= html_len)").select("accession", F.lit("out_of_range").alias("type"), "item")
    walk = a if null_breaks_order else a.filter("o is not null")
    walk = walk.withColumn("prev_seq", F.lag("seq").over(order)).withColumn("prev_o", F.last("o", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    bad = walk.filter("o is not null and prev_seq is not null and seq < 999 and prev_seq < 999 and seq < prev_seq").select("accession", F.lit("order_violation").alias("type"), "item")
    flat = walk.filter("o is not null and prev_o is not null and o <= prev_o").select("accession", F.lit("non_monotonic").alias("type"), "item")
    want = lengths.select("accession", F.explode(F.array(*map(F.lit, rules.EXPECTED))).alias("item"))
    gone = want.join(a, ["accession", "item"], "left_anti").select("accession", F.lit("missing_expected").alias("type"), "item")
    return dup.unionByName(out).unionByName(bad).unionByName(flat).unionByName(gone)


def spans(assignments: DataFrame, lengths: DataFrame) -> DataFrame:
    """accession, item, span_chars, span_pct, flag (large over 40 %, then small under 100 characters)."""
    by = Window.partitionBy("accession").orderBy("o", rules.seq_of(F.col("item")))
    s = assignments.filter("o is not null").join(lengths, "accession").withColumn("span_chars", F.coalesce(F.lead("o").over(by), F.col("html_len")) - F.col("o"))
    share = F.when(F.col("html_len") > 0, F.col("span_chars") / F.col("html_len")).otherwise(0.0)
    flag = F.when(share > 0.4, "large").when(F.col("span_chars") < 100, "small").otherwise("ok")
    return s.select("accession", "item", "span_chars", F.round(share, 4).alias("span_pct"), flag.alias("flag"))


def finalizable(lengths: DataFrame, found: DataFrame) -> DataFrame:
    n = found.groupBy("accession").agg(F.count("*").alias("n_issues"))
    return lengths.select("accession").join(n, "accession", "left").select("accession", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.col("n_issues").isNull().alias("is_valid"))


def stalls(turns: DataFrame, limit: int = 3) -> DataFrame:
    """accession, fired: turns at which the issue count has not fallen for ``limit`` turns in a row; firing starts anew.

    The reset makes it a fold; a conversation has some dozen turns.
    """
    seq = turns.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct("turn", "n_issues"))).alias("t"))
    start = F.struct(F.lit(None).cast("bigint").alias("prev"), F.lit(0).alias("run"), F.array().cast("array<bigint>").alias("fired"))

    def step(s, x):
        n = x.n_issues.cast("bigint")
        run = F.when((n > 0) & (n >= s.prev), s.run + 1).otherwise(F.lit(0))
        hit = run >= limit
        return F.struct(n.alias("prev"), F.when(hit, 0).otherwise(run).alias("run"), F.when(hit, F.concat(s.fired, F.array(x.turn.cast("bigint")))).otherwise(s.fired).alias("fired"))

    return seq.select("accession", F.aggregate("t", start, step, lambda s: s.fired).alias("fired"))


def message_sizes(messages: DataFrame) -> DataFrame:
    """Characters of each conversation's messages, with the arguments of tool calls (``tool_args``: array of texts) where there are any."""
    size = F.length(F.coalesce("text", F.lit("")))
    if "tool_args" in messages.columns:
        size = size + F.aggregate(F.coalesce("tool_args", F.array().cast("array<string>")), F.lit(0), lambda n, a: n + F.length(F.coalesce(a, F.lit(""))))
    return messages.groupBy("conv_id").agg(F.sum(size).alias("chars"), F.count("*").alias("messages"))


def compacted(messages: DataFrame, most_chars: int = 100_000, head: int = 2, tail: int = 10) -> DataFrame:
    """Conversations over ``most_chars`` keep their first ``head`` and last ``tail`` messages."""
    up = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("a", F.row_number().over(up)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).withColumn("chars", F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id")))
    return m.filter((F.col("chars") <= most_chars) | (F.col("a") <= head) | (F.col("a") > F.col("n") - tail)).drop("a", "n", "chars")
