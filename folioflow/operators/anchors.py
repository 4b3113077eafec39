"""Table-of-contents links, anchor positions, part headings and other structure of a filing.

All operators take ``filings`` (accession, html) and return narrow tables keyed by accession.  Matches are found
where a text lies; only ``windows`` and the slices join offsets back to the texts, by accession.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.functions import text as T
from folioflow.operators.matches import find_all, groups_of, with_spots

#: What counts as a contents link, an anchor, a part heading, and as naming another document.
REFERENCE = r"""(?is)<a\s[^>]*href=["']#([^"'>\s]+)["']"""
LINK = REFERENCE + r"[^>]*>(.*?)</a>"
ANCHOR = r"""(?is)<(\w+)\s[^>]*?\b(id|name)=["']([^"']+)["'][^>]*>"""
PART = r"(?is)<(?:p|div|td|tr|h[1-6]|b|strong|span)[^>]*>\s*(?:<(?:b|strong|font|span)[^>]*>\s*)*PART\s+(I{1,3}V?|IV|[1-4])\b"
#: Numerals of the four parts.
NUMERALS = {"I": 1, "II": 2, "III": 3, "IV": 4, "1": 1, "2": 2, "3": 3, "4": 4}
INCORPORATED = r"\bincorporated?\s+by\s+reference\b|\bproxy\s+statement\b|\bitems?\s*10\s*[-–—]\s*14\b"


def structure(filings: DataFrame) -> DataFrame:
    """A narrow row for each filing: accession, n (length of the text), refs, links (o, m, before), marks (o, m), heads (o, m).

    A plan reads each text once for all of them.  ``links_of``, ``anchors_of``, ``parts_of``, ``records_of`` and ``ids_of`` take such rows,
    written or not; what they don't ask for is not computed.  A null text has null arrays and no rows in any of them.  They explode
    in the outer form: before an inner one the planner puts a filter that asks the patterns again.
    """
    html = F.col("html")
    found = with_spots(filings.select("accession", "html"), {"links": (html, LINK), "marks": (html, ANCHOR), "heads": (html, PART)})

    def behind(x):
        start = F.greatest(F.lit(0), x.o - 1000)
        return F.struct(x.o.alias("o"), x.m.alias("m"), F.substring(html, start + 1, x.o - start).alias("before"))

    refs = F.array_distinct(F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(1)))
    return found.select("accession", F.length("html").alias("n"), refs.alias("refs"), F.transform("links", behind).alias("links"), "marks", "heads")


def ids_of(rows: DataFrame) -> DataFrame:
    return rows.select("accession", F.explode_outer("refs").alias("anchor_id")).filter("anchor_id is not null").distinct()


def referenced_ids(filings: DataFrame) -> DataFrame:
    return ids_of(structure(filings))


def anchors_of(rows: DataFrame) -> DataFrame:
    """accession, anchor_id, o, tag, attr: referenced anchors only, the last occurrence of an id."""
    spots = rows.select("accession", F.explode_outer("marks").alias("x")).filter("x is not null").select("accession", "x.o", *groups_of(F.col("x.m"), ANCHOR, {"tag": 1, "attr": 2, "anchor_id": 3}))
    seen = spots.select("accession", "anchor_id", "o", F.lower("tag").alias("tag"), F.lower("attr").alias("attr"))
    mine = seen.join(ids_of(rows), ["accession", "anchor_id"], "left_semi")
    return mine.groupBy("accession", "anchor_id").agg(F.max("o").alias("o"), F.max_by(F.struct("tag", "attr"), "o").alias("t")).select("accession", "anchor_id", "o", "t.tag", "t.attr")


def anchors(filings: DataFrame) -> DataFrame:
    return anchors_of(structure(filings))


def _page_number_label(before: Column) -> Column:
    """The label of what stands before a page-number link: since its row began, else since the link before it."""
    row = F.when(F.instr(before, "<tr") > 0, rules.classify(T.normalize_text(F.substring_index(before, "<tr", -1))))
    link = rules.classify(T.normalize_text(F.try_element_at(F.split(before, "(?i)</a>"), F.lit(-1))))
    return F.coalesce(row, link)


def links_of(rows: DataFrame) -> DataFrame:
    """All links in order: accession, ord, o, anchor_id, link_text, item (null: none); page-number links look back."""
    found = rows.select("accession", F.posexplode_outer("links").alias("ord", "x")).filter("x is not null").select("accession", "ord", "x.o", "x.before", *groups_of(F.col("x.m"), LINK, {"anchor_id": 1, "inner": 2}))
    out = found.select("accession", "ord", "o", "anchor_id", T.strip_html(F.col("inner")).alias("link_text"), "before")
    own = rules.classify(F.lower("link_text"))
    page = (F.length("link_text") <= 6) & F.col("link_text").rlike(r"\A\d+\s*\z")
    long = F.length("link_text") >= 2
    return out.select("accession", "ord", "o", "anchor_id", "link_text", F.when(long, F.coalesce(own, F.when(page, _page_number_label(F.col("before"))))).alias("item"))


def toc_links(filings: DataFrame) -> DataFrame:
    return links_of(structure(filings))


def toc_first(links: DataFrame) -> DataFrame:
    """The first link of each item."""
    return links.filter("item is not null").groupBy("accession", "item").agg(F.min_by("anchor_id", "o").alias("anchor_id"))


def anchor_items(links: DataFrame) -> DataFrame:
    """accession, anchor_id, items (the labels of an anchor's links in order, without repeats next to each other) and firsts
    (those of them whose first link in the filing is one of these, in order)."""
    by = Window.partitionBy("accession", "anchor_id").orderBy("o")
    named = links.filter("item is not null")
    kept = named.withColumn("prev", F.lag("item").over(by)).filter("prev is null or prev <> item")
    rows = kept.groupBy("accession", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("o", "item"))).alias("r"))
    first = named.groupBy("accession", "item").agg(F.min_by(F.struct("anchor_id", "o"), "o").alias("f"))
    firsts = first.groupBy("accession", "f.anchor_id").agg(F.array_sort(F.collect_list(F.struct("f.o", "item"))).alias("f"))
    out = rows.join(firsts, ["accession", "anchor_id"], "left")
    return out.select("accession", "anchor_id", F.col("r.item").alias("items"), F.coalesce("f.item", F.array().cast("array<string>")).alias("firsts"))


def records_of(rows: DataFrame) -> DataFrame:
    """Distinct (anchor, text) links of two characters or more, without the page-number rule."""
    spots = rows.select("accession", F.explode_outer("links").alias("x")).filter("x is not null").select("accession", "x.o", *groups_of(F.col("x.m"), LINK, {"anchor_id": 1, "inner": 2}))
    found = spots.select("accession", "o", "anchor_id", T.normalize_text(F.col("inner")).alias("link_text"))
    first = found.groupBy("accession", "anchor_id", "link_text").agg(F.min("o").alias("o"))
    # The text is a group key here, so the label is read once from each.
    return first.filter(F.length("link_text") >= 2).select("accession", "o", "anchor_id", "link_text", rules.classify(F.col("link_text")).alias("item"))


def link_records(filings: DataFrame) -> DataFrame:
    return records_of(structure(filings))


def windows(filings: DataFrame, found: DataFrame) -> DataFrame:
    """Each anchor's text ahead (to the next anchor, 2000 at most) and behind (500 before it, its last 200); further columns of ``found`` stay."""
    more = [c for c in found.columns if c not in ("accession", "anchor_id", "o", "tag", "attr")]
    w = Window.partitionBy("accession").orderBy("o", "anchor_id")
    ends = found.withColumn("next_o", F.lead("o").over(w))
    size = F.least(F.lit(2000), F.coalesce(F.col("next_o") - F.col("o"), F.lit(2000)))
    # ``right`` would work its text out twice (once to see if it is null), so ``behind`` is cut by ``substring``.
    # A text is counted once for each filing and walked once for each anchor; the windows are cut from that piece.
    joined = ends.withColumns({"_size": size, "_lead": F.least(F.col("o"), F.lit(500))}).join(filings.select("accession", "html", F.length("html").alias("html_len")), "accession")
    piece = F.substring(F.col("html"), F.col("o") - F.col("_lead") + 1, F.col("_lead") + F.greatest(F.col("_size"), F.lit(300)))
    near = joined.select("accession", "anchor_id", "o", "tag", "next_o", "html_len", "_size", "_lead", *more, piece.alias("_piece"))
    near = near.select(*near.columns, F.substring(F.col("_piece"), F.col("_lead") + 1, F.greatest(F.col("_size"), F.lit(300))).alias("_on"))
    return near.select("accession", "anchor_id", "o", "tag", "next_o", T.normalize_text(F.left("_on", F.col("_size"))).alias("ahead"), F.substring(T.normalize_text(F.left("_piece", F.col("_lead"))), -200, 200).alias("behind"), F.left(T.normalize_text(F.left("_on", F.lit(300))), F.lit(200)).alias("nearby"), "html_len", *more)


def parts_of(rows: DataFrame) -> DataFrame:
    """accession, part, o, rel: the last heading past 5 % of the document, else the first at all."""
    spots = rows.select("accession", "n", F.explode_outer("heads").alias("x")).filter("x is not null").select("accession", "n", "x.o", *groups_of(F.col("x.m"), PART, {"numeral": 1}))
    found = spots.select("accession", rules.lookup(NUMERALS, F.upper("numeral")).alias("part"), "o", "n").filter("part is not null")
    late = F.max(F.when(F.col("o") >= 0.05 * F.col("n"), F.col("o")))
    out = found.groupBy("accession", "part").agg(F.coalesce(late, F.min("o")).alias("o"), F.max("n").alias("n"))
    return out.select("accession", "part", "o", T.relative_position(F.col("o"), F.col("n")).alias("rel"))


def part_boundaries(filings: DataFrame) -> DataFrame:
    return parts_of(structure(filings))


def part_three_incorporated(filings: DataFrame, found_items: DataFrame) -> DataFrame:
    """accession, incorporated: no item 10-14 found and a reference near the first "part iii" (else "part 3")."""
    low = F.lower("html")
    at = F.when(F.instr(low, "part iii") > 0, F.instr(low, "part iii")).otherwise(F.instr(low, "part 3"))
    near = F.when(at > 0, F.substring(low, at, F.lit(3000)).rlike(INCORPORATED)).otherwise(False)
    third = found_items.filter(F.col("item").isin(*rules.SHARED[0])).select("accession").distinct().withColumn("has", F.lit(True))
    return filings.select("accession", near.alias("near")).join(third, "accession", "left").select("accession", (F.col("near") & F.col("has").isNull()).alias("incorporated"))


#: What stands before a heading in bold, and at the start of a block.
BOLD_TAG = r"(?is)<(?:b|strong|h[1-6])[^>]*>\s*(?:<[^>]+>\s*)*\z"
BOLD_STYLE = r"(?i)font-weight\s*:\s*(?:bold|[6-9]\d{2})\b"
BLOCK_START = r"(?is)<(?:div|p|tr|td|h[1-6])[^>]*>\s*(?:<[^>]+>\s*)*\z"


def signature_fallback(filings: DataFrame, chosen: DataFrame) -> DataFrame:
    """accession, o: the first SIGNATURE(S) in bold or heading context from the last chosen place on, moved to its block's start within 200."""
    last = chosen.groupBy("accession").agg(F.max("o").cast("int").alias("last"))
    tail = filings.select("accession", "html").join(last, "accession").select("accession", "last", F.expr("substring(html, greatest(0, last - 500) + 1, last - greatest(0, last - 500))").alias("lead"), F.expr("substring(html, last + 1)").alias("tail"))
    hits = find_all(tail, F.col("tail"), r"(?U)\bSIGNATURES?\b")
    back = F.right(F.concat("lead", F.left("tail", F.col("o"))), F.lit(500))
    hits = hits.select("accession", (F.col("o") + F.col("last")).alias("at"), back.alias("back"))
    bold = F.col("back").rlike(BOLD_TAG) | F.right("back", F.lit(300)).rlike(BOLD_STYLE) | F.right("back", F.lit(200)).rlike(r"(?i)<h[1-6][^>]*>")
    near = F.right("back", F.lit(200))
    block = F.regexp_instr(near, F.lit(BLOCK_START))
    moved = F.when(block > 0, F.col("at") - (F.length(near) - (block - 1))).otherwise(F.col("at"))
    return hits.filter(bold).groupBy("accession").agg(F.min_by(moved, "at").alias("o"))


def item_mentions(text: Column) -> Column:
    """Distinct labels of "item N" mentions."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?Ui)item\s*\d+\s*[.\-–—]?\s*[a-c]?\b"), F.lit(0)), lambda m: rules.heading_label(F.lower(m))), lambda x: x.isNotNull()))


def toc_like(anchor_id: Column, tag: Column, text: Column) -> Column:
    n = F.size(item_mentions(F.left(text, F.lit(1400))))
    return (anchor_id.rlike(r"(?Ui)(?<![a-z])toc[a-z\d_]*\b") & (n >= 2)) | (tag.isin("td", "tr") & (n >= 3)) | (n >= 5)


def heading_scan(filings: DataFrame, label: str, found: DataFrame, start: int = 0, end: int | None = None, most: int = 5) -> DataFrame:
    """Places of one label's heading in the stripped text of a region, mapped back to the html, with the nearest anchor."""
    return scan_region(stripped_region(filings, start, end), label, found, start, most)


def stripped_region(filings: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """accession, size (of the html region) and t, its stripped text."""
    region = F.substring(F.col("html"), F.lit(start + 1), F.least(F.lit(end if end is not None else 1 << 30), F.length("html")) - start)
    return filings.select("accession", F.length(region).alias("size"), T.strip_html(region).alias("t"))


def scan_region(region: DataFrame, label: str, found: DataFrame, start: int = 0, most: int = 5) -> DataFrame:
    """``context``: the text from 50 characters before a heading's start to 150 behind it."""
    hits = find_all(region, F.col("t"), rules.HEADINGS[label]).filter(F.col("ord") < most)
    at = (F.lit(start) + F.floor(F.col("o") / F.length("t") * F.col("size"))).cast("int")
    shown = hits.select("accession", "ord", at.alias("o"), F.trim(F.expr("substring(t, greatest(0, o - 50) + 1, o + 150 - greatest(0, o - 50))")).alias("context"))
    return nearest(shown, found, 2000, ["accession", "ord"])


#: What every heading of ``rules.HEADINGS`` begins with.
MENTION = r"(?Ui)item(?=\s*[0-9])"


def places(region: DataFrame, labels: dict[str, str], start: int = 0, most: int = 5) -> DataFrame:
    """accession, item, ord, o: what ``scan_region`` finds for all labels (their patterns by label) together; a text is read once for all of them.

    The patterns begin like ``MENTION`` and hold no second one, so a label's matches are the mentions that its pattern fits.  It is
    asked of the text from a mention to behind the start of the next.
    """
    spots = with_spots(region.withColumn("_gaps", F.split("t", MENTION, -1)), {"_at": (F.col("t"), MENTION)})
    behind = F.transform("_at", lambda x, k: F.struct(x.o.alias("o"), F.concat(x.m, F.get("_gaps", k + 1), F.coalesce(F.get("_at", k + 1).m, F.lit(""))).alias("text")))
    read = spots.select("accession", "size", F.length("t").alias("n"), behind.alias("_at"))
    fits = lambda p: F.slice(F.filter("_at", lambda x: x.text.rlike(rf"\A{p}")), 1, most)
    of = lambda label, p: F.transform(fits(p), lambda x, k: F.struct(F.lit(label).alias("item"), k.alias("ord"), x.o.alias("o")))
    hits = read.select("accession", "size", "n", F.explode_outer(F.concat(*(of(label, p) for label, p in labels.items()))).alias("x")).filter("x is not null")
    at = (F.lit(start) + F.floor(F.col("x.o") / F.col("n") * F.col("size"))).cast("int")
    return hits.select("accession", "x.item", "x.ord", at.alias("o"))


def nearest(points: DataFrame, found: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """``points`` with the closest anchor less than ``radius`` away; ties go to the first in the text.

    Points look only at the anchors of their own and the two neighbouring stretches of ``radius``.
    """
    a = found.select("accession", F.col("anchor_id").alias("near_id"), F.col("o").alias("near_o"), F.floor(F.col("o") / radius).alias("cell"))
    p = points.withColumn("cell", F.explode(F.array(*(F.floor(F.col("o") / radius) + d for d in (-1, 0, 1)))))
    best = p.join(a, ["accession", "cell"]).withColumn("d", F.abs(F.col("near_o") - F.col("o"))).filter(F.col("d") < radius).groupBy(*keys).agg(F.min_by(F.struct("near_id", "near_o", "d"), F.struct("d", "near_o")).alias("n"))
    return points.join(best, keys, "left").select(*points.columns, "n.near_id", "n.near_o", F.col("n.d").alias("distance"))


def within(points: DataFrame, found: DataFrame, radius: int = 5000) -> DataFrame:
    """All anchors at most ``radius`` (20,000 at most) from each point (accession, item, o).

    Like ``nearest``, a point meets only the anchors of its own and the two neighbouring stretches of the radius.
    """
    r = min(radius, 20_000)
    size = max(1, r)
    near = found.select("accession", "anchor_id", F.col("o").alias("anchor_o"), F.floor(F.col("o") / size).alias("_cell"))
    asked = points.withColumn("_cell", F.explode(F.array(*(F.floor(F.col("o") / size) + d for d in (-1, 0, 1)))))
    return asked.join(near, ["accession", "_cell"]).withColumn("delta", F.col("anchor_o") - F.col("o")).filter(F.abs("delta") <= r).select(*points.columns, "anchor_id", "anchor_o", "delta")
