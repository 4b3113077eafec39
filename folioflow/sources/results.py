"""Run results: one row for each filing, read from and written to JSON, and the report made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a result.
SCHEMA = (
    "accession string, model string, f1 double, doc_retrieved boolean, extraction_rate double, turns long, tokens long, latency_ms long, finalized boolean, error string, "
    "pred_items long, gt_items long, false_positives array<string>, failed_items map<string,struct<f1:double,pred_len:long,truth_len:long>>, candidates long"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of earlier runs: files with a JSON array or with lines of JSON; a missing path gives no rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    text = F.ltrim(F.col("value"))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, SCHEMA))
    rows = F.when(text.startswith("["), F.from_json(text, F.lit(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields())}>>"))).otherwise(lines)
    return spark.read.text(path, wholetext=True).select(F.explode(rows).alias("r")).select("r.*").filter("accession is not null")


def result_rows(items: DataFrame, docs: DataFrame, runs: DataFrame, least: float = 0.9) -> DataFrame:
    """One result for each filing of ``runs`` (accession, model, turns, tokens, latency_ms, finalized, error, pred_items, candidates).

    ``items``, ``docs``: the evaluation by item and by filing.  Items below ``least`` or not extracted are listed with their sizes.
    """
    failed = items.filter(~F.col("extracted") | (F.col("char_f1") < least)).groupBy("accession").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", F.struct(F.col("char_f1").alias("f1"), "pred_len", "truth_len"))))).alias("failed_items"))
    scored = docs.select("accession", F.round("mean_char_f1", 4).alias("f1"), "doc_retrieved", F.round("extraction_rate", 4).alias("extraction_rate"), F.col("truth_items").alias("gt_items"), "false_positives")
    out = runs.join(scored, "accession", "left").join(failed, "accession", "left")
    return out.select(*(F.col(c.split()[0]).cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in _fields()))


def _fields() -> list[str]:
    depth, out = 0, [""]
    for c in SCHEMA:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def write_results(results: DataFrame, path: str) -> None:
    """Lines of JSON, each file in accession order; appending keeps earlier results, so an interrupted run goes on from ``read_results``."""
    results.sortWithinPartitions("accession").write.mode("append").json(path)


def summary(results: DataFrame) -> DataFrame:
    """One row: filings, retrieved, rates, means and errors."""
    share = lambda n: F.when(F.count("*") > 0, n / F.count("*")).otherwise(0.0)
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0))
    found = F.count_if(F.coalesce("doc_retrieved", F.lit(False)))
    return results.agg(F.count("*").alias("filings"), found.alias("retrieved"), share(found).alias("retrieval_rate"), mean("f1").alias("mean_f1"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), mean("turns").alias("mean_turns"), mean("tokens").alias("mean_tokens"))


def report(results: DataFrame, title: str) -> DataFrame:
    """The lines of a Markdown report: part, accession, n, line.  Summary first, then a table of all filings, then those that failed."""
    percent = lambda c: F.format_string("%.1f%%", 100 * F.coalesce(c, F.lit(0.0)))
    s = summary(results)
    metric = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    head = F.array(
        F.lit(f"# {title}"), F.lit(""), F.lit("## Summary"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|"),
        metric("Document retrieval", F.format_string("%d/%d (%.1f%%)", "retrieved", "filings", 100 * F.col("retrieval_rate"))), metric("Mean character F1", percent(F.col("mean_f1"))),
        metric("Errors", F.col("errors").cast("string")), metric("Mean turns", F.format_string("%.1f", "mean_turns")), metric("Mean tokens", F.format_number("mean_tokens", 0)),
        F.lit(""), F.lit("## Filings"), F.lit(""), F.lit("| Accession | F1 | Retrieved | Turns | Tokens | Failed items |"), F.lit("|---|---|---|---|---|---|"),
    )
    first = s.select(F.lit(0).alias("part"), F.lit("").alias("accession"), F.posexplode(head).alias("n", "line"))
    entries = F.map_entries(F.coalesce("failed_items", F.create_map().cast("map<string,struct<f1:double,pred_len:long,truth_len:long>>")))
    fails = F.array_join(F.transform(entries, lambda e: F.format_string("%s (%.2f)", e.key, e.value.f1)), ", ")
    fails = F.when(fails != "", fails).otherwise(F.coalesce(F.concat(F.lit("error: "), F.left("error", F.lit(40))), F.lit("")))
    number = lambda c: F.coalesce(c, F.lit(0))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "accession", percent(F.col("f1")), F.when(F.coalesce("doc_retrieved", F.lit(False)), "yes").otherwise("no"), number("turns").cast("string"), F.format_number(number("tokens"), 0), fails), F.lit(" |"))
    table = results.select(F.lit(1).alias("part"), "accession", F.lit(0).alias("n"), row.alias("line"))
    detail = F.concat(
        F.array(F.concat(F.lit("### "), "accession"), F.concat(F.lit("- F1: "), percent(F.col("f1"))), F.format_string("- Turns: %d, tokens: %d", number("turns"), number("tokens"))),
        F.when(F.coalesce("error", F.lit("")) != "", F.array(F.concat(F.lit("- Error: "), "error"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("false_positives") > 0, F.array(F.concat(F.lit("- False positives: "), F.array_join("false_positives", ", ")))).otherwise(F.array().cast("array<string>")),
        F.transform(entries, lambda e: F.format_string("- %s: F1 %.3f (predicted %d, golden %d characters)", e.key, e.value.f1, e.value.pred_len, e.value.truth_len)),
    )
    failed = results.filter(~F.coalesce("doc_retrieved", F.lit(False))).select(F.lit(2).alias("part"), "accession", F.posexplode(detail).alias("n", "line"))
    return first.unionByName(table).unionByName(failed)


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text, in order (range-sorted, one file for each range)."""
    lines.orderBy("part", "accession", "n").select("line").write.mode("overwrite").text(path)

