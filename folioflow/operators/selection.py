"""Order-consistent selection of boundaries and the slices between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.functions.text import bound, normalize_text

#: Fixed value: what one step of confidence is worth against position.
STEP = 1_000_000


def select_ordered(candidates: DataFrame) -> DataFrame:
    """The heaviest chain of candidates that rises strictly in offset and canonical order.

    A candidate weighs ``confidence * 10^6 + (largest offset - offset)``.  One fold over each filing's sorted candidates
    keeps for each of the 24 labels the heaviest chain that ends in it (``held``), so a candidate looks at the labels
    before its own and not at all candidates before it.  Chains that end at the present offset wait in ``here`` until the offset rises: candidates
    at one place never follow one another.  Of equally heavy chains the one that ends in the first candidate stays.  A chain is as long as there are
    labels at most.  Candidates with unknown labels take no part in the chain and are appended.
    """
    c = candidates.withColumn("x", rules.seq_of(F.col("item")))
    known, rest = c.filter("x < 999"), c.filter("x >= 999")
    rows = known.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct(F.col("o").cast("long").alias("o"), "x", (-F.col("confidence")).alias("k"), "anchor_id", "item"))).alias("rows"), F.max("o").cast("long").alias("top"))
    chain, labels = "struct<s:bigint,i:int,path:array<int>>", len(rules.LABELS)
    none = F.array_repeat(F.lit(None).cast(chain), labels)
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("o"), none.alias("held"), none.alias("here"))

    def step(state, row):
        on = state.o == row.o
        held = F.when(on, state.held).otherwise(F.zip_with(state.held, state.here, lambda a, b: F.greatest(a, b)))
        here = F.when(on, state.here).otherwise(none)

        def placed(held):
            best = F.array_max(F.slice(held, F.lit(1), row.x))
            weight = -row.k.cast("long") * STEP + (F.col("top") - row.o) + F.coalesce(best.s, F.lit(0).cast("long"))
            new = F.struct(weight.alias("s"), (-state.n).alias("i"), F.concat(F.coalesce(best.path, F.array().cast("array<int>")), F.array(state.n)).alias("path"))
            after = F.transform(here, lambda v, x: F.when(x == row.x, F.greatest(v, new)).otherwise(v))
            return F.struct((state.n + 1).alias("n"), row.o.alias("o"), held.alias("held"), after.alias("here"))

        return bound(held, placed)

    last = F.aggregate("rows", start, step, lambda s: F.array_max(F.concat(s.held, s.here)).path)
    picked = rows.select("accession", "rows", last.alias("path")).select("accession", F.explode(F.transform("path", lambda i: F.get("rows", i))).alias("r"))
    out = picked.select("accession", "r.item", "r.anchor_id", "r.o", (-F.col("r.k")).alias("confidence"))
    return out.unionByName(rest.select("accession", "item", "anchor_id", F.col("o").cast("long").alias("o"), "confidence"))


def select_greedy(candidates: DataFrame) -> DataFrame:
    """The surest candidate of each item; ties go to the latest."""
    best = candidates.groupBy("accession", "item").agg(F.max(F.struct("confidence", "o", "anchor_id")).alias("b"))
    return best.select("accession", "item", "b.anchor_id", "b.o", "b.confidence")


def heading_fallback(filings: DataFrame, chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items of ``wanted`` (accession, item) that were not chosen, looked for by heading between their chosen neighbours.

    The heading is searched in the region's stripped text, past its first 20 characters, and its place carried over to the html in
    proportion.  Each find narrows the region of the later ones, so one fold takes a filing's items in the order of their names.
    A place with an unknown label bounds all regions from below.  Filings without a chosen place have no regions; only
    filings with such items are read.
    """
    order = F.when(rules.seq_of(F.col("item")) < 999, rules.seq_of(F.col("item"))).otherwise(-1).alias("x")
    place = F.struct("item", order, F.col("o").cast("long").alias("o"), F.lit(False).alias("new"))
    c = chosen.groupBy("accession").agg(F.collect_list(place).alias("have"))
    pattern = F.coalesce(*(F.when(F.col("item") == k, F.lit(v)) for k, v in rules.HEADINGS.items())).alias("p")
    open_items = wanted.join(chosen, ["accession", "item"], "left_anti").select("accession", F.struct("item", order, pattern).alias("w"))
    w = open_items.filter("w.p is not null").groupBy("accession").agg(F.sort_array(F.collect_set("w")).alias("want"))
    rows = filings.select("accession", "html").join(w, "accession").join(c, "accession")

    def step(at, w):
        lo = F.greatest(F.lit(0).cast("long"), F.array_max(F.transform(F.filter(at, lambda a: a.x < w.x), lambda a: a.o)))
        hi = F.least(F.length("html").cast("long"), F.array_min(F.transform(F.filter(at, lambda a: a.x > w.x), lambda a: a.o)))

        def found(region):
            text = normalize_text(F.substring(F.col("html"), (region.lo + 1).cast("int"), F.greatest(F.lit(0), (region.hi - region.lo).cast("int"))))
            return bound(text, lambda t: bound(F.split(t, w.p, 2), lambda cut: carried(region, t, cut)))

        def carried(region, t, cut):
            before = F.length(F.get(cut, F.lit(0)))
            o = region.lo + F.floor(before / F.length(t) * (region.hi - region.lo))
            return F.when((F.size(cut) > 1) & (before > 20), F.concat(at, F.array(F.struct(w["item"].alias("item"), w.x.alias("x"), o.alias("o"), F.lit(True).alias("new"))))).otherwise(at)

        return bound(F.struct(lo.alias("lo"), hi.alias("hi")), found)

    made = rows.select("accession", F.explode(F.filter(F.aggregate("want", F.col("have"), step), lambda a: a.new)).alias("r"))
    return made.select("accession", "r.item", "r.o")


def slices(filings: DataFrame, chosen: DataFrame) -> DataFrame:
    """accession, item, html: from each place to the next one or the end; null places give the empty text."""
    docs = filings.select("accession", "html", F.length("html").alias("n"))
    # Offsets are settled before the texts come in, and ``chosen`` is read once.
    first = Window.partitionBy("accession", "item").orderBy(F.asc_nulls_last("o"))
    c = chosen.filter("o is null or o >= 0").join(docs.select("accession", "n"), "accession").filter("o is null or o < n")
    c = c.withColumn("r", F.row_number().over(first)).filter("r = 1")
    once = Window.partitionBy("accession", "o").orderBy(rules.seq_of(F.col("item")), "item")
    c = c.withColumn("r", F.row_number().over(once)).filter("o is null or r = 1")
    ends = c.withColumn("stop", F.coalesce(F.lead("o").over(Window.partitionBy("accession").orderBy(F.asc_nulls_last("o"))), F.col("n")))
    cut = F.when(F.col("o").isNull(), "").otherwise(F.expr("substring(html, cast(o as int) + 1, cast(stop - o as int))"))
    return ends.select("accession", "item", "o", "stop").join(docs.drop("n"), "accession").select("accession", "item", cut.alias("html"))


#: An anchor element without content, alone in a division, at either end of a slice.
_EMPTY = r"""<a\s[^>]*\b(?:id|name)=["'][^"']+["'][^>]*>\s*</a>"""
LEADING = rf"(?i)\A({_EMPTY})\s*</div>"
TRAILING = rf"(?i)(<div>\s*){_EMPTY}(\s*</div>)\s*\z"


def wrapper_end(html, o):
    """Where the slice before an anchor at ``o`` ends: behind the division that wraps the anchor, or at the anchor."""
    before = F.substring(html, F.greatest(F.lit(1), o - 29), F.least(o, F.lit(30)))
    closed = F.regexp_extract(F.substring(html, o + 1, F.lit(200)), r"(?is)\A.*?</a>\s*</div>", 0)
    return F.when(before.rlike(r"(?i)<div>\s*\z") & (closed != ""), o + F.length(closed)).otherwise(o)


def rule_slices(filings: DataFrame, chosen: DataFrame, to_end_of_file: bool = False) -> DataFrame:
    """Slices between the chosen places: accession, item, html.

    A slice ends behind the division that wraps the next anchor, without that anchor, and loses the end tag left over behind its own
    anchor.  The last ends at the last ``</body>`` behind its start or with the text; with ``to_end_of_file``, and where ``filings`` has
    ``content`` and ``text_start``, with the whole submission.  Of several slices of one item the longest stays, of equal ones the first.
    """
    whole = to_end_of_file and "content" in filings.columns
    docs = filings.select("accession", "html", *(["content", "text_start"] if whole else []))
    ends = chosen.select("accession", "item", F.col("o").cast("int").alias("o"))
    ends = ends.withColumn("next", F.lead("o").over(Window.partitionBy("accession").orderBy("o", rules.seq_of(F.col("item")))))
    html, o, n = F.col("html"), F.col("o"), F.length("html")
    body = n - F.instr(F.reverse(html), "</body>"[::-1]) - len("</body>") + 1
    last = F.when(F.contains(html, F.lit("</body>")) & (body > o), body).otherwise(n)
    stop = F.coalesce(wrapper_end(html, F.col("next")), last)
    cut = F.substring(html, o + 1, F.greatest(F.lit(0), stop - o))
    if whole:
        cut = F.when(F.col("next").isNull() & (F.col("content") != html), F.expr("substring(content, cast(text_start as int) + o + 1)")).otherwise(cut)
    raw = ends.join(docs, "accession").select("accession", "item", "o", cut.alias("html"))
    mended = F.regexp_replace(F.regexp_replace("html", LEADING, "$1"), TRAILING, "$1$2")
    return raw.select("accession", "item", "o", mended.alias("html")).groupBy("accession", "item").agg(F.max_by("html", F.struct(F.length("html"), -F.col("o"))).alias("html"))


def placeholders(items: DataFrame, made: DataFrame) -> DataFrame:
    """Empty slices for the labels that share an anchor with the one that carries the content."""
    shared = items.withColumn("main", rules.shared_label(F.col("items"))).filter("main is not null")
    rows = shared.select("accession", "main", F.explode("items").alias("item")).filter("item <> main")
    rows = rows.join(made.select("accession", F.col("item").alias("main")), ["accession", "main"], "left_semi")
    return rows.select("accession", "item", F.lit("").alias("html")).distinct().join(made, ["accession", "item"], "left_anti")


#: How item 16 is headed, what stands for "nothing here", and what the first phrase ends at.
HEADER16 = r"(?:item\s*16[.\s]*(?:form\s+10-k\s+summary)?|form\s+10-k\s+summary)"
NOTHING = r"(?:none|not\s+applicable|n/?a|omitted)"
PHRASE_END = r"(?:\.\s|\bexhibit|\bindex|\bpart\b|\bitem\b|\z)"
#: Furniture of a page: it may stand anywhere in the phrase.
FURNITURE = r"\b\d+\b|\btable\s+of\s+contents\b|\(optional\)|\s"
#: A phrase of nothing but furniture, at most one word for "nothing here", and marks behind it.
ONLY_NOTHING = rf"(?i)\A(?:{FURNITURE})*+(?:{NOTHING}(?![\w/]))?(?:{FURNITURE}|[.:])*{PHRASE_END}"


def is_placeholder_item16(html):
    """The first phrase after the heading says nothing: one expression over the 300 characters behind the heading decides.

    A text without a heading has to be shorter than 50 characters, its numbers and marks not counted.
    """
    from folioflow.functions import text as T

    text = T.strip_html(F.left(html, F.lit(5000)))
    headed = rf"(?is)\A.*?{HEADER16}(.{{0,300}})"
    counted = F.regexp_replace(F.regexp_replace(text, r"\b\d+\b", ""), r"[.:\s]+", " ")
    return F.when(text.rlike(f"(?i){HEADER16}"), F.regexp_extract(text, headed, 1).rlike(ONLY_NOTHING)).otherwise(F.length(F.trim(counted)) < 50)


def policy(made: DataFrame, signed: DataFrame) -> DataFrame:
    """Signatures that neither a contents link nor an anchor names go; in such filings a long placeholder item 16 is blanked.

    ``signed``: accessions with a link or an anchor of the signatures.
    """
    m = made.join(signed.select("accession").distinct().withColumn("named", F.lit(True)), "accession", "left").filter("item <> 'signatures' or named")
    blank = (F.col("item") == "item16") & F.col("named").isNull() & (F.length("html") > 10_000) & is_placeholder_item16(F.col("html"))
    return m.select("accession", "item", F.when(blank, "").otherwise(F.col("html")).alias("html"))


def part_three_placeholders(made: DataFrame, incorporated: DataFrame) -> DataFrame:
    """Empty slices of items 10 to 14 for filings with slices that take their third part from another document."""
    third = incorporated.filter("incorporated").join(made.select("accession").distinct(), "accession", "left_semi")
    return third.select("accession", F.explode(F.array(*map(F.lit, rules.SHARED[0]))).alias("item"), F.lit("").alias("html")).join(made, ["accession", "item"], "left_anti")


#: The grammar of what may be left over at the end of a slice: rules, blocks without a word, and a part's or the contents' heading in its tags.
_TAG, _END_TAG, _GAP = r"<[a-z][^>]*>", r"</[^>]+>", r"(?:&nbsp;|\u00a0|\s)*+"
_RULE = r"<hr\b[^>]*>"
_BARE = rf"(?:{_TAG}{_GAP})++(?:{_END_TAG}{_GAP})++"
_HEADED = rf"(?:{_TAG}{_GAP})++(?:part\s+[iv]+\b|table\s+of\s+contents){_GAP}(?:{_END_TAG}{_GAP})*+"
TRAILING_MARKS = f"{_RULE}|{_HEADED}|{_BARE}"


def without_trailing_marks(html):
    """A slice without the marks at its end, however many follow one another.  Not part of the rule engine: there it costs more than it gives."""
    return F.regexp_replace(html, rf"(?i)(?:(?:{TRAILING_MARKS})\s*)+\z", "")


#: A section that swallowed the next one: (section, next, start of the next one's heading).
_OPENS = r"(?i)<(?:div|p|h[1-6]|b|strong|span|td)[^>]*>\s*(?:<[^>]+>\s*)*"
SWAPS = (("item6", "item7", _OPENS + r"item\s*7\b(?!\s*[0-9a])"), ("item7", "item7a", _OPENS + r"item\s*7\s*[.\-–—]?\s*a\b"), ("item7a", "item8", _OPENS + r"item\s*8\b"))


def unswapped(made: DataFrame, ratio: int = 5, least: int = 200_000) -> DataFrame:
    """Sections (accession, item, html) in which one over ``least`` characters and ``ratio`` times the next is cut at the next one's heading
    (past its first tenth), the rest going to the next.  Not part of the rule engine either.
    """
    items = ("item6", "item7", "item7a", "item8")
    rows = made.filter(F.col("item").isin(*items)).groupBy("accession").agg(*(F.max(F.when(F.col("item") == i, F.col("html"))).alias(i) for i in items))
    for first, second, heading in SWAPS:
        a, b = F.col(first), F.col(second)
        skip = F.floor(F.length(a) / 10).cast("int")
        at = F.regexp_instr(F.substring(a, skip + 1, F.length(a)), F.lit(heading))
        cut = F.coalesce((F.length(a) > ratio * F.length(b)) & (F.length(a) > least) & (at > 0), F.lit(False))
        rows = rows.withColumns({first: F.when(cut, F.left(a, skip + at - 1)).otherwise(a), second: F.when(cut, F.concat(F.substring(a, skip + at, F.length(a)), b)).otherwise(b)})
    back = rows.select("accession", F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.col(i).alias("html")) for i in items))).alias("x")).select("accession", "x.item", "x.html").filter("html is not null")
    return made.filter(~F.col("item").isin(*items)).unionByName(back)
