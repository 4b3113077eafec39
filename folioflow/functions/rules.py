"""The label vocabulary and the rules that read labels off headings, link texts and anchor ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical labels in order, with part, expected flag, number, letter and usual title.
ITEMS = (
    ("item1", 1, True, "1", "", "Business"),
    ("item1a", 1, True, "1", "A", "Risk Factors"),
    ("item1b", 1, False, "1", "B", "Unresolved Staff Comments"),
    ("item2", 1, False, "2", "", "Properties"),
    ("item3", 1, False, "3", "", "Legal Proceedings"),
    ("item4", 1, False, "4", "", "Mine Safety Disclosures"),
    ("item5", 2, False, "5", "", "Market for the Registrant"),
    ("item6", 2, False, "6", "", "Selected Financial Data"),
    ("item7", 2, True, "7", "", "Managements Discussion and Analysis"),
    ("item7a", 2, False, "7", "A", "Quantitative and Qualitative Disclosures about Market Risk"),
    ("item8", 2, True, "8", "", "Financial Statements and Supplementary Data"),
    ("item9", 2, False, "9", "", "Changes in and Disagreements"),
    ("item9a", 2, False, "9", "A", "Controls and Procedures"),
    ("item9b", 2, False, "9", "B", "Other Information"),
    ("item9c", 2, False, "9", "C", "Disclosure Regarding Foreign Jurisdictions in Iran"),
    ("item10", 3, False, "10", "", "Directors and Executive Officers"),
    ("item11", 3, False, "11", "", "Executive Compensation"),
    ("item12", 3, False, "12", "", "Security Ownership"),
    ("item13", 3, False, "13", "", "Certain Relationships"),
    ("item14", 3, False, "14", "", "Principal Accountant Fees"),
    ("item15", 4, True, "15", "", "Exhibits and Financial Statement Schedules"),
    ("item16", 4, False, "16", "", "Form 10-K Summary"),
    ("crossReference", 4, False, "", "", "Cross-Reference Index"),
    ("signatures", 4, False, "", "", "Signatures"),
)
LABELS = [x[0] for x in ITEMS]
SEQ = {label: k for k, label in enumerate(LABELS)}
PART = {x[0]: x[1] for x in ITEMS}
EXPECTED = [x[0] for x in ITEMS if x[2]]
#: Labels that may share one anchor; the last carries the content.
SHARED = (("item10", "item11", "item12", "item13", "item14"), ("item9", "item9a", "item9b"), ("item1", "item1a"), ("item7", "item7a"))

_LETTERS = {"1": "ab", "7": "a", "9": "abc"}
_DASH = r"[.\-–—]?"


def _item_rule(blank: str, dash: str, after_letter: str, after_number: str, apart: str) -> str:
    """One alternation for all item labels.

    A regular expression finds the leftmost match and, at one place, the first alternative.  Lettered labels stand first, so they
    win ties, and a number with letters of its own is plain only if none of them follows.
    """
    lettered = [rf"{n}{apart}{dash}{apart}[{c}]{after_letter}" for n, c in _LETTERS.items()]
    plain = [rf"{n}{after_number}(?!{blank}[0-9{c}])" for n, c in _LETTERS.items()]
    return rf"item{apart}(?:" + "|".join([*lettered, *plain, rf"[234568]{after_number}(?!{blank}[0-9])", rf"1[0-6]{after_number}"]) + ")"


#: Headings in running text, in lower case.
HEADING = "(?U)" + _item_rule(r"\s*", _DASH, r"\b", r"\b", r"\s*") + r"|\bsignatures?\s*\z"
#: Headings that a scan for one label looks for, in any case.
HEADINGS = {}
for _label, _, _, _n, _c, _ in ITEMS:
    if _n and _c:
        HEADINGS[_label] = rf"(?Ui)item\s*{_n}\s*{_DASH}\s*{_c.lower()}\b"
    elif _n:
        HEADINGS[_label] = rf"(?Ui)item\s*{_n}\b" + (rf"(?!\s*[0-9{_LETTERS.get(_n, '')}])" if len(_n) == 1 else "")
#: Labels in anchor ids, in any case.  Ids run words together, so only a letter directly behind decides.
ID = "(?Ui)" + _item_rule("", "", "(?![a-z])", "", r"[_\s]*").replace("1[0-6]", "1[0-6](?![0-9])") + r"|\bsignature|cross[_\s]*ref"

#: Patterns of the titles in the public form, in lower case, and their labels.  A word boundary stands before each.
TITLES = (
    (r"risk\s+factors?\b", "item1a"),
    (r"unresolved\s+staff\s+comments?\b", "item1b"),
    (r"properties\b", "item2"),
    (r"legal\s+proceedings?\b", "item3"),
    (r"mine\s+safety\b", "item4"),
    (r"market\s+(?:for\s+)?(?:the\s+)?registrant", "item5"),
    (r"stock\s+performance\b", "item5"),
    (r"selected\s+(?:consolidated\s+)?financial\s+data\b", "item6"),
    (r"management'?s?\s+discussion\s+and\s+analysis\b", "item7"),
    (r"quantitative\s+and\s+qualitative\s+disclosures?\s+about\s+market\s+risk", "item7a"),
    (r"financial\s+statements?\s+and\s+supplementary\s+data\b", "item8"),
    (r"changes?\s+in\s+and\s+disagreements?\b", "item9"),
    (r"controls?\s+and\s+procedures?\b", "item9a"),
    (r"other\s+information\b", "item9b"),
    (r"disclosure\s+regarding\b.*\biran\b", "item9c"),
    (r"disclosure\s+pursuant\b.*\biran\b", "item9c"),
    (r"directors?\b.*\bexecutive\s+officers?\b", "item10"),
    (r"directors?\b.*\bcorporate\s+governance\b", "item10"),
    (r"corporate\s+governance\b.*\bdirectors?\b", "item10"),
    (r"executive\s+compensation\b", "item11"),
    (r"security\s+ownership\b", "item12"),
    (r"certain\s+relationships?\b", "item13"),
    (r"principal\s+account", "item14"),
    (r"exhibits?\b.*\bfinancial\s+statement\s+schedules?\b", "item15"),
    (r"financial\s+statement\s+schedules?\b.*\bexhibits?\b", "item15"),
    (r"exhibits?\s+and\s+financial\s+statements?\b", "item15"),
    (r"form\s+10-k\s+summary\b", "item16"),
    (r"10-k\s+summary\b", "item16"),
    (r"cross[\s-]*reference\s+index\b", "crossReference"),
)
#: Two titles that no word boundary opens.  "business" stands between blanks or ends, which belong to the match; the
#: bracket of "[reserved]" is no word character, so the boundary before it asks for a word character right before the bracket.
_SPECIAL = ((r"(?:\A|\s)business\s*(?:summary)?(?:\s|\z)", "item1"), (r"\b\[reserved\]", "item6"))
#: The first letters are asked before anything else: a long alternation is tried at few places only.
TITLE = rf"(?Us)(?=[{''.join(sorted({p[0] for p, _ in TITLES} | {'s'}))}])\b(?:" + "|".join([*(p for p, _ in TITLES), r"signatures?\s*\z"]) + ")|" + "|".join(p for p, _ in _SPECIAL)
#: The label by the first word of a match; "financial" is settled by what follows.
FIRST_WORD = {
    "business": "item1", "risk": "item1a", "unresolved": "item1b", "properties": "item2", "legal": "item3", "mine": "item4", "market": "item5", "stock": "item5",
    "reserved": "item6", "selected": "item6", "management": "item7", "managements": "item7", "quantitative": "item7a", "change": "item9", "changes": "item9",
    "control": "item9a", "controls": "item9a", "other": "item9b", "disclosure": "item9c", "corporate": "item10", "director": "item10", "directors": "item10",
    "executive": "item11", "security": "item12", "certain": "item13", "principal": "item14", "exhibit": "item15", "exhibits": "item15", "10": "item16", "form": "item16",
    "cross": "crossReference", "signature": "signatures", "signatures": "signatures",
}
#: The order in which ids are tried.
ID_ORDER = ("item1a", "item1b", "item1", "item7a", "item9a", "item9b", "item9c", "item9", "item7", "item2", "item3", "item4", "item5", "item6", "item8", *(f"item{n}" for n in range(10, 17)), "signatures", "crossReference")


def item_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x[0], k, x[1], x[2], x[3], x[4], x[5]) for k, x in enumerate(ITEMS)], "item string, seq int, part int, expected boolean, num string, letter string, title string")


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v))), key)


def seq_of(item: Column) -> Column:
    return F.coalesce(lookup(SEQ, item), F.lit(999))


def _item(match: Column) -> Column:
    """The label of a match of ``HEADING`` or ``ID``, in lower case."""
    return F.when(match.startswith("item"), F.concat(F.lit("item"), F.regexp_replace(F.substring(match, 5, 99), "[^0-9a-c]", ""))).when(match.startswith("cross"), "crossReference").otherwise("signatures")


def _title(match: Column) -> Column:
    word = F.regexp_extract(match, r"[a-z]+|10", 0)
    return F.when(word != "financial", lookup(FIRST_WORD, word)).when(match.rlike(r"(?U)\Afinancial\s+statements?\s+and"), "item8").otherwise("item15")


def _found(text: Column, pattern: str, label) -> Column:
    """struct(pos, label) of the leftmost match in a lower-case text, null without one."""
    match = F.regexp_extract(text, pattern, 0)
    return F.when(match != "", F.struct((F.regexp_instr(text, F.lit(pattern)) - 1).alias("pos"), label(match).alias("label")))


def heading(text: Column) -> Column:
    return _found(text, HEADING, _item)


def title(text: Column) -> Column:
    return _found(text, TITLE, _title)


def _label(text: Column, pattern: str, label) -> Column:
    """The label alone: its place is not looked for."""
    match = F.regexp_extract(text, pattern, 0)
    return F.when(match != "", label(match))


def heading_label(text: Column) -> Column:
    return _label(text, HEADING, _item)


def title_label(text: Column) -> Column:
    return _label(text, TITLE, _title)


def classify(text: Column) -> Column:
    return F.coalesce(heading_label(text), title_label(text))


def id_label(anchor_id: Column) -> Column:
    """Of all labels in the id the one that stands first in ``ID_ORDER``."""
    tries = F.transform(F.regexp_extract_all(anchor_id, F.lit(ID), F.lit(0)), lambda m: F.struct(lookup({k: j for j, k in enumerate(ID_ORDER)}, _item(F.lower(m))).alias("r"), _item(F.lower(m)).alias("label")))
    return F.array_min(tries).label


def shared_label(items: Column) -> Column:
    """At least two labels of one group on an anchor: the last in order."""
    seq = F.transform(items, lambda i: F.struct(seq_of(i).alias("s"), i.alias("i")))
    last = F.array_max(seq).i
    inside = [F.size(F.array_except(items, F.array(*map(F.lit, g)))) == 0 for g in SHARED]
    fits = inside[0]
    for x in inside[1:]:
        fits = fits | x
    return F.when((F.size(F.array_distinct(items)) >= 2) & fits, last)
