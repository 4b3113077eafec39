"""Anchored filings made from the driver's ``pages``: contents links, anchors, part headings and text.

The k-th paragraph of a page becomes the section of the k-th label, and what is left over belongs to the last section; a page
without paragraphs is a filing without sections.  What a section's contents link and heading look like depends on
(page_id + k), so all rules of the classifiers are met.  In every seventh filing items 10 to 14 share one anchor id, every second one
ends with signatures, and every fifth names its third part as incorporated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import rules

SECTIONS = 22
OPENING = {0: "I", 6: "II", 15: "III", 20: "IV"}
SIGNED = "<p><b>SIGNATURES</b></p><p>Pursuant to the requirements the registrant has signed.</p>"
ELSEWHERE = "<p>Part III: items 10-14 are incorporated by reference to the proxy statement.</p>"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)).alias("ps"))
    extra = F.array(F.array_join(F.slice("ps", SECTIONS, F.greatest(F.size("ps"), F.lit(1))), "</p><p>"))
    texts = F.when(F.size("ps") >= SECTIONS, F.concat(F.slice("ps", 1, SECTIONS - 1), extra)).otherwise(F.coalesce("ps", F.array().cast("array<string>")))
    dim = rules.ITEMS[:SECTIONS]
    page = F.col("page_id")

    def of(values, k):
        return F.get(F.array(*map(F.lit, values)), k)

    def aid(k):
        named = F.concat(F.lit("item_"), of([x[3] + x[4].lower() for x in dim], k))
        return F.when((page % 7 == 0) & k.between(15, 19), "a19").when((page + k) % 5 == 3, named).otherwise(F.concat(F.lit("a"), k.cast("string")))

    def entry(k):
        v, name, title = (page + k) % 5, of([f"Item {x[3]}{x[4]}." for x in dim], k), of([x[5] for x in dim], k)
        link = lambda text: F.concat(F.lit('<a href="#'), aid(k), F.lit('">'), text, F.lit("</a>"))
        row = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>"), link((k + 3).cast("string")), F.lit("</td></tr>"))
        shown = F.when(v == 0, F.concat(name, F.lit(" "), title)).when(v == 2, title).when(v == 3, "see").otherwise("see here")
        return F.when(v == 1, row).otherwise(F.concat(F.lit("<p>"), link(shown), F.lit("</p>")))

    def section(t, k):
        head, name, title = (page + k) % 3, of([f"Item {x[3]}{x[4]}." for x in dim], k), of([x[5] for x in dim], k)
        opens = of([f"<p><b>PART {OPENING[j]}</b></p>" if j in OPENING else "" for j in range(SECTIONS)], k)
        heading = F.when(head == 0, F.concat(name, F.lit(" "), title, F.lit(". "))).when(head == 1, F.concat(title, F.lit(". "))).otherwise("")
        return F.concat(opens, F.lit('<div><a id="'), aid(k), F.lit('"></a></div><p>'), heading, F.lit("</p><p>"), t, F.lit("</p>"))

    made = pages.withColumn("t", texts)
    toc, body = F.array_join(F.transform("t", lambda t, k: entry(k)), ""), F.array_join(F.transform("t", section), "")
    tail = F.concat(F.when(page % 5 == 0, ELSEWHERE).otherwise(""), F.when(page % 2 == 0, SIGNED).otherwise(""))
    return made.select(F.format_string("%010d", "page_id").alias("accession"), F.concat(F.lit("<html><body><table>"), toc, F.lit("</table>"), body, tail, F.lit("</body></html>")).alias("html"))
