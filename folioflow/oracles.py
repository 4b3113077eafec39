"""SQL forms of the registered queries, for checking them against another engine."""

from __future__ import annotations

from folioflow.functions import rules
from folioflow.plans.synthetic import ELSEWHERE, SECTIONS, SIGNED

REFERENCE = r"""(?is)<a\s[^>]*href=["'']#([^"''>\s]+)["'']"""
LINK = REFERENCE + r"[^>]*>(.*?)</a>"
ANCHOR = r"""(?is)<(\w+)\s[^>]*?\b(id|name)=["'']([^"'']+)["''][^>]*>"""
PART = r"(?is)<(?:p|div|td|tr|h[1-6]|b|strong|span)[^>]*>\s*(?:<(?:b|strong|font|span)[^>]*>\s*)*PART\s+(I{1,3}V?|IV|[1-4])\b"
BLOCK = r"(?i)<(h1|p|li|b)\b[^>]*>"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"regexp_replace({out}, {q(name + '?')}, {q(char)}, 'g')"  # a window may cut the semicolon off
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def find_all(source: str, text: str, pattern: str, groups: dict[str, int] | None = None) -> str:
    more = "".join(f", regexp_extract_all({text}, '{pattern}', {k})[i] AS {n}" for n, k in (groups or {}).items())
    return f"""(SELECT * EXCLUDE (g_, m_, i), i - 1 AS ord, CAST(list_sum(list_transform(g_[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(m_[1:i-1], lambda e: length(e))), 0) AS BIGINT) AS o, m_[i] AS m{more}
      FROM (SELECT *, unnest(generate_series(1, len(m_))) AS i FROM (SELECT *, string_split_regex({text}, '{pattern}') AS g_, regexp_extract_all({text}, '{pattern}') AS m_ FROM {source})))"""


DIM = "dim(item, seq, part, expected, num, letter, title) AS (VALUES " + ", ".join(f"({q(x[0])}, {k}, {x[1]}, {str(x[2]).lower()}, {q(x[3])}, {q(x[4])}, {q(x[5])})" for k, x in enumerate(rules.ITEMS)) + ")"

FILINGS = f"""{DIM},
para AS (SELECT page_id, CASE WHEN len(ps) >= {SECTIONS} THEN list_append(ps[1:{SECTIONS - 1}], array_to_string(ps[{SECTIONS}:], '</p><p>')) ELSE ps END AS ps FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages)),
sect AS (SELECT page_id, i - 1 AS k, ps[i] AS t FROM (SELECT page_id, ps, unnest(generate_series(1, len(ps))) AS i FROM para)),
made AS (SELECT page_id, k, t, part, (page_id + k) % 5 AS v, (page_id + k) % 3 AS h, 'Item ' || num || letter || '.' AS name, title,
  CASE WHEN page_id % 7 = 0 AND k BETWEEN 15 AND 19 THEN 'a19' WHEN (page_id + k) % 5 = 3 THEN 'item_' || num || lower(letter) ELSE 'a' || k END AS aid FROM sect JOIN dim ON k = seq),
piece AS (SELECT page_id, k,
  CASE v WHEN 0 THEN '<p><a href="#' || aid || '">' || name || ' ' || title || '</a></p>'
         WHEN 1 THEN '<tr><td>' || name || '</td><td><a href="#' || aid || '">' || (k + 3) || '</a></td></tr>'
         WHEN 2 THEN '<p><a href="#' || aid || '">' || title || '</a></p>'
         WHEN 3 THEN '<p><a href="#' || aid || '">see</a></p>'
         ELSE '<p><a href="#' || aid || '">see here</a></p>' END AS toc,
  CASE WHEN k IN (0, 6, 15, 20) THEN '<p><b>PART ' || ['I', 'II', 'III', 'IV'][part] || '</b></p>' ELSE '' END || '<div><a id="' || aid || '"></a></div><p>' ||
  CASE h WHEN 0 THEN name || ' ' || title || '. ' WHEN 1 THEN title || '. ' ELSE '' END || '</p><p>' || t || '</p>' AS body FROM made),
filings AS MATERIALIZED (SELECT printf('%010d', page_id) AS accession, '<html><body><table>' || coalesce(string_agg(toc, '' ORDER BY k), '') || '</table>' || coalesce(string_agg(body, '' ORDER BY k), '') ||
  CASE WHEN page_id % 5 = 0 THEN {q(ELSEWHERE)} ELSE '' END || CASE WHEN page_id % 2 = 0 THEN {q(SIGNED)} ELSE '' END || '</body></html>' AS html FROM para LEFT JOIN piece USING (page_id) GROUP BY page_id)"""


def label(m: str) -> str:
    """The label of one mention: "item", a number and what may forbid or refine it."""
    num, rest = f"regexp_extract({m}, 'item\\s*(\\d+)', 1)", f"regexp_extract({m}, 'item\\s*\\d+(.*)$', 1)"
    letter = f"regexp_extract({m}, '^item\\s*\\d+\\s*[.\\-–—]?\\s*([abc])$', 1)"
    return f"""(CASE WHEN {num} || {letter} IN ('1a', '1b', '7a', '9a', '9b', '9c') THEN 'item' || {num} || {letter}
      WHEN regexp_matches({rest}, '^[a-z0-9_]') OR length({num}) = 1 AND regexp_matches({rest}, '^\\s*[0-9]') OR {num} = '1' AND regexp_matches({rest}, '^\\s*[ab]') OR {num} = '7' AND regexp_matches({rest}, '^\\s*a') OR {num} = '9' AND regexp_matches({rest}, '^\\s*[abc]') THEN NULL
      WHEN {num} IN ({', '.join(q(str(n)) for n in range(1, 17))}) THEN 'item' || {num} END)"""


def mentions(t: str) -> str:
    """Labels and places (from 0) of all "item N" mentions of a lower-case text that have a label."""
    return f"list_filter(list_transform(regexp_extract_all({t}, 'item\\s*\\d+(?:\\s*[.\\-–—]?\\s*[abc]\\b|\\s*[0-9abc]|[a-z_])?'), lambda m: {{'l': {label('m')}, 'p': strpos({t}, m) - 1}}), lambda x: x.l IS NOT NULL)"


def heading(t: str) -> str:
    """The label of the first "item N" mention of a lower-case text, or of signatures at its end."""
    return f"coalesce(({mentions(t)})[1].l, CASE WHEN regexp_matches({t}, '\\bsignatures?\\s*$') THEN 'signatures' END)"


PHRASES = {"item1a": "risk factors", "item1b": "unresolved staff comments", "item2": "properties", "item3": "legal proceedings", "item4": "mine safety", "item5": "market for the registrant", "item6": "selected financial data", "item7": "managements discussion and analysis", "item7a": "quantitative and qualitative disclosures about market risk", "item8": "financial statements and supplementary data", "item9": "changes in and disagreements", "item9a": "controls and procedures", "item9b": "other information", "item10": "directors and executive officers", "item11": "executive compensation", "item12": "security ownership", "item13": "certain relationships", "item14": "principal account", "item15": "exhibits and financial statement", "item16": "form 10-k summary"}


def titles(t: str) -> str:
    """Labels and places (from 0) of the title phrases of a text, the first one first."""
    tries = [f"CASE WHEN strpos({t}, {q(p)}) > 0 THEN {{'p': strpos({t}, {q(p)}) - 1, 'l': {q(k)}}} END" for k, p in PHRASES.items()]
    tries.append(f"CASE WHEN regexp_matches({t}, '\\bdisclosure regarding\\b.*\\biran\\b') THEN {{'p': strpos({t}, 'disclosure regarding') - 1, 'l': 'item9c'}} END")
    tries.append(f"CASE WHEN strpos(' ' || {t} || ' ', ' business ') > 0 THEN {{'p': greatest(strpos(' ' || {t} || ' ', ' business ') - 2, 0), 'l': 'item1'}} END")
    tries.append(f"CASE WHEN regexp_matches({t}, '\\bsignatures?\\s*$') THEN {{'p': length({t}) - length(regexp_extract({t}, '\\bsignatures?\\s*$')), 'l': 'signatures'}} END")
    return f"list_sort(list_filter([{', '.join(tries)}], lambda x: x IS NOT NULL))"


def title(t: str) -> str:
    """The label of the title phrase that comes first."""
    return f"({titles(t)}[1]).l"


LINKS = f"""{FILINGS},
link0 AS (SELECT accession, ord, o, anchor_id, {strip('inner_')} AS link_text, substr(html, greatest(0, o - 1000) + 1, o - greatest(0, o - 1000)) AS before FROM {find_all('filings', 'html', LINK, {'anchor_id': 1, 'inner_': 2})}),
link1 AS (SELECT *, lower(link_text) AS low, CASE WHEN contains(before, '<tr') THEN lower({strip("string_split(before, '<tr')[-1]")}) END AS in_row, lower({strip("string_split_regex(before, '(?i)</a>')[-1]")}) AS in_cell FROM link0),
links AS MATERIALIZED (SELECT accession, ord, o, anchor_id, link_text, CASE WHEN length(link_text) >= 2 THEN coalesce({heading('low')}, {title('low')}, CASE WHEN length(link_text) <= 6 AND regexp_matches(link_text, '^\\d+\\s*$') THEN coalesce({heading('in_row')}, {title('in_row')}, {heading('in_cell')}, {title('in_cell')}) END) END AS item FROM link1)"""

ANCHORS = f"""{LINKS},
anchors AS MATERIALIZED (SELECT accession, anchor_id, max(o) AS o, arg_max(lower(tag_), o) AS tag, arg_max(lower(attr_), o) AS attr FROM {find_all('filings', 'html', ANCHOR, {'tag_': 1, 'attr_': 2, 'anchor_id': 3})} SEMI JOIN (SELECT DISTINCT accession, anchor_id FROM links) USING (accession, anchor_id) GROUP BY ALL)"""

WINDOWS = f"""{ANCHORS},
win0 AS (SELECT accession, anchor_id, o, tag, lead(o) OVER (PARTITION BY accession ORDER BY o, anchor_id) AS next_o FROM anchors),
windows AS MATERIALIZED (SELECT accession, anchor_id, o, tag, next_o, lower({strip('substr(html, o + 1, least(2000, coalesce(next_o - o, 2000)))')}) AS ahead, right(lower({strip('substr(html, greatest(0, o - 500) + 1, o - greatest(0, o - 500))')}), 200) AS behind, left(lower({strip('substr(html, o + 1, 300)')}), 200) AS nearby, length(html) AS html_len FROM win0 JOIN filings USING (accession)),
first_ AS (SELECT accession, anchor_id, list(item ORDER BY o) AS firsts FROM (SELECT accession, item, arg_min(anchor_id, o) AS anchor_id, min(o) AS o FROM links WHERE item IS NOT NULL GROUP BY accession, item) GROUP BY ALL),
items AS MATERIALIZED (SELECT accession, anchor_id, items, coalesce(firsts, []) AS firsts FROM (SELECT accession, anchor_id, list(item ORDER BY o) AS items FROM (SELECT *, lag(item) OVER (PARTITION BY accession, anchor_id ORDER BY o) AS prev FROM links WHERE item IS NOT NULL) WHERE prev IS DISTINCT FROM item GROUP BY ALL) LEFT JOIN first_ USING (accession, anchor_id))"""

ID = "(CASE WHEN regexp_matches(anchor_id, '^item_\\d+[abc]?$') THEN replace(anchor_id, '_', '') END)"
GROUPS = "[" + ", ".join("[" + ", ".join(q(x) for x in g) + "]" for g in rules.SHARED) + "]"

LABELS = f"""{WINDOWS},
lab0 AS (SELECT * EXCLUDE (items, firsts), coalesce(items, []) AS items, coalesce(firsts, []) AS firsts, left(ahead, 150) AS head, behind || ' ' || left(ahead, 500) AS both_ FROM windows LEFT JOIN items USING (accession, anchor_id)),
labels_ AS MATERIALIZED (SELECT *, {ID} AS by_id, {heading('head')} AS h150, {title('head')} AS t150, {heading('ahead')} AS hfull, {title('ahead')} AS tfull, {heading('both_')} AS hboth, {title('both_')} AS tboth,
  ({mentions('head')})[1].p AS hpos, ({titles('head')}[1]).p AS tpos,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(left(ahead, 1400), 'item\\s*\\d+\\s*[.\\-–—]?\\s*[a-c]?\\b'), lambda m: {label('trim(m)')}), lambda x: x IS NOT NULL))) >= 5 AS toc,
  CASE WHEN len(list_distinct(items)) >= 2 AND len(list_filter({GROUPS}, lambda g: list_has_all(g, items))) > 0 THEN 'item' || list_max(list_transform(items, lambda x: CASE WHEN regexp_matches(x, '^item\\d+$') THEN CAST(substr(x, 5) AS INTEGER) END)) END AS shared FROM lab0)"""

CANDS = f"""{LABELS},
raw AS (
  SELECT accession, by_id AS item, anchor_id, o, 9 AS confidence, 'anchor_id' AS source, nearby, tag, html_len FROM labels_
  UNION ALL SELECT accession, h150, anchor_id, o, 6, 'tier1', nearby, tag, html_len FROM labels_
  UNION ALL SELECT accession, hfull, anchor_id, o, 5, 'tier1', nearby, tag, html_len FROM labels_ WHERE h150 IS NULL
  UNION ALL SELECT accession, t150, anchor_id, o, 3, 'tier2', nearby, tag, html_len FROM labels_
  UNION ALL SELECT accession, tboth, anchor_id, o, 1, 'title_keyword', nearby, tag, html_len FROM labels_ WHERE tboth IS DISTINCT FROM t150
  UNION ALL SELECT accession, unnest(firsts), anchor_id, o, 8, 'toc_text', nearby, tag, html_len FROM labels_),
cands AS MATERIALIZED (SELECT DISTINCT accession, item, anchor_id, o, o / html_len AS rel, confidence, source, nearby AS nearby_text, tag FROM raw WHERE item IS NOT NULL)"""

PARTS = f"""parts AS MATERIALIZED (SELECT accession, part, coalesce(max(o) FILTER (o >= 0.05 * n), min(o)) AS o, coalesce(max(o) FILTER (o >= 0.05 * n), min(o)) / max(n) AS rel FROM (SELECT accession, o, length(html) AS n, CASE upper(num_) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 END AS part FROM {find_all('filings', 'html', PART, {'num_': 1})}) WHERE part IS NOT NULL GROUP BY accession, part)"""

RESCORED = f"""{CANDS}, {PARTS},
region AS (SELECT accession, part, o AS lo, coalesce(lead(o) OVER (PARTITION BY accession ORDER BY o), 1000000000) AS hi FROM parts),
rescored AS MATERIALIZED (SELECT c.accession, c.item, c.anchor_id, c.o, c.rel, CAST(CASE WHEN confidence >= 9 OR lo IS NULL THEN confidence WHEN c.o >= lo AND c.o < hi THEN least(confidence + 1, 8) ELSE greatest(confidence - 2, 0) END AS INTEGER) AS confidence, source, nearby_text, tag
  FROM cands c JOIN dim USING (item) LEFT JOIN region r ON r.accession = c.accession AND r.part = dim.part)"""

CASCADE = f"""{LABELS},
cascade AS MATERIALIZED (SELECT accession, anchor_id, o, b.i AS item, CAST(b.c AS INTEGER) AS confidence FROM (SELECT *, coalesce(
  CASE WHEN shared IS NOT NULL THEN {{'i': shared, 'c': 10}} END, CASE WHEN by_id IS NOT NULL THEN {{'i': by_id, 'c': 9}} END, CASE WHEN len(firsts) > 0 THEN {{'i': firsts[1], 'c': 8}} END,
  CASE WHEN NOT toc THEN coalesce(CASE WHEN t150 IS NOT NULL AND h150 IS NOT NULL AND tpos < hpos AND hpos > 50 THEN {{'i': t150, 'c': 6}} END, CASE WHEN h150 IS NOT NULL THEN {{'i': h150, 'c': 6}} END,
    CASE WHEN t150 IS NOT NULL THEN {{'i': t150, 'c': 3}} END, CASE WHEN hfull IS NOT NULL THEN {{'i': hfull, 'c': 5}} END, CASE WHEN tfull IS NOT NULL THEN {{'i': tfull, 'c': 2}} END,
    CASE WHEN hboth IS NOT NULL THEN {{'i': hboth, 'c': 4}} END, CASE WHEN tboth IS NOT NULL THEN {{'i': tboth, 'c': 1}} END) END) AS b FROM labels_) WHERE b IS NOT NULL)"""

CHOSEN = f"""{CASCADE},
cc AS (SELECT accession, o, seq, confidence, anchor_id, item, row_number() OVER (PARTITION BY accession ORDER BY o, seq, confidence DESC, anchor_id) AS i, max(o) OVER (PARTITION BY accession) AS top FROM cascade JOIN dim USING (item)),
walk AS (
  SELECT accession, i, [{{'o': o, 'x': seq, 's': confidence * 1000000 + (top - o), 'i': i, 'p': [i]}}] AS acc FROM cc WHERE i = 1
  UNION ALL
  SELECT c.accession, c.i, list_append(w.acc, {{'o': c.o, 'x': c.seq, 's': c.confidence * 1000000 + (c.top - c.o) + coalesce((list_sort(list_transform(list_filter(w.acc, lambda a: a.o < c.o AND a.x < c.seq), lambda a: {{'s': a.s, 'n': -a.i, 'p': a.p}}), 'DESC')[1]).s, 0), 'i': c.i,
    'p': list_append(coalesce((list_sort(list_transform(list_filter(w.acc, lambda a: a.o < c.o AND a.x < c.seq), lambda a: {{'s': a.s, 'n': -a.i, 'p': a.p}}), 'DESC')[1]).p, []), c.i)}})
  FROM walk w JOIN cc c ON c.accession = w.accession AND c.i = w.i + 1),
best AS (SELECT accession, unnest((list_sort(list_transform(acc, lambda a: {{'s': a.s, 'n': -a.i, 'p': a.p}}), 'DESC')[1]).p) AS i FROM walk w WHERE i = (SELECT max(i) FROM cc WHERE cc.accession = w.accession)),
chosen AS MATERIALIZED (SELECT accession, item, anchor_id, o, confidence FROM best JOIN cc USING (accession, i))"""

BOLD = "(?i)font-weight\\s*:\\s*(?:bold|[6-9]\\d{2})"
FEATURES = f"""{LABELS},
feat0 AS (SELECT l.*, a.attr, substr(html, greatest(0, l.o - 300) + 1, l.o + 300 - greatest(0, l.o - 300)) AS ctx, lower({strip('substr(html, greatest(0, l.o - 500) + 1, l.o - greatest(0, l.o - 500))')}) AS back FROM labels_ l JOIN anchors a USING (accession, anchor_id) JOIN filings USING (accession)),
features AS (SELECT accession, anchor_id, o, round(o / html_len, 6) AS rel_position, CAST(o AS DOUBLE) AS abs_offset, {', '.join(f"CAST(tag = '{t}' AS DOUBLE) AS tag_is_{t}" for t in ('a', 'div', 'p', 'span', 'td'))}, CAST(attr = 'id' AS DOUBLE) AS attr_is_id,
  CAST(length(anchor_id) AS DOUBLE) AS id_len, {', '.join(f"CAST(contains(lower(anchor_id), '{t}') AS DOUBLE) AS id_has_{t}" for t in ('item', 'toc', 'sig'))}, CAST(by_id IS NOT NULL AS DOUBLE) AS tier0_match, CAST(len(firsts) > 0 AS DOUBLE) AS in_toc_mapping, CAST(len(items) AS DOUBLE) AS n_toc_items,
  CAST(length(ahead) AS DOUBLE) AS forward_text_len, CAST(length(back) AS DOUBLE) AS back_text_len,
  CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(left(ahead, 500), 'item\\s*\\d+'), lambda m: {label('m')}), lambda x: x IS NOT NULL))) AS DOUBLE) AS n_item_mentions_fwd,
  CAST(h150 IS NOT NULL AS DOUBLE) AS tier1_match_150, CAST(t150 IS NOT NULL AS DOUBLE) AS tier2_match_150, CAST(hfull IS NOT NULL AS DOUBLE) AS tier1_match_full, CAST(tfull IS NOT NULL AS DOUBLE) AS tier2_match_full,
  CAST(regexp_matches(ctx, '{BOLD}') AS DOUBLE) AS has_bold, CAST(regexp_matches(ctx, '(?i)<h[1-6][^>]*>') AS DOUBLE) AS has_heading, CAST(coalesce(list_max(list_transform(regexp_extract_all(ctx, '(?i)font-size\\s*:\\s*(\\d+)', 1), lambda x: CAST(x AS INTEGER))), 0) AS DOUBLE) AS max_font_size,
  CAST(regexp_matches(ahead, '^item\\s*\\d') AS DOUBLE) AS starts_with_item, CAST(regexp_matches(left(ahead, 200), '\\bpart\\s+[iv]+\\b') AS DOUBLE) AS has_part_header FROM feat0)"""
PLACES = f"""{CHOSEN},
golden AS (SELECT accession, item, html AS doc, substr(html, o + 1, coalesce(lead(o) OVER (PARTITION BY accession ORDER BY o), length(html)) - o) AS part FROM chosen JOIN filings USING (accession)),
place AS (SELECT accession, item, CASE WHEN strpos(doc, left(part, 200)) > 0 THEN strpos(doc, left(part, 200)) ELSE strpos(doc, left(part, 50)) END - 1 AS at FROM golden WHERE length(part) >= 10),
near_ AS MATERIALIZED (SELECT p.accession, p.item, a.anchor_id, a.o, abs(a.o - p.at) AS d FROM place p JOIN anchors a ON a.accession = p.accession AND abs(a.o - p.at) < 500 WHERE p.at >= 0)"""
#: Pages as ``page_text_entities`` reads them, its entities already decoded (none of these characters is one of ``strip``).
DECODED = "replace(replace(replace(html, ' the ', ' ’– '), ' of ', ' ’É '), 'and', '&amp;lt;¬it;')"
PART_THREE = """SELECT accession, strpos(low, 'part iii') > 0 AND regexp_matches(substr(low, strpos(low, 'part iii'), 3000), '\\bincorporated?\\s+by\\s+reference\\b|\\bproxy\\s+statement\\b|\\bitems?\\s*10\\s*[-–—]\\s*14\\b')
  AND NOT EXISTS (SELECT 1 FROM rescored r WHERE r.accession = f.accession AND r.confidence >= 5 AND r.item IN ('item10', 'item11', 'item12', 'item13', 'item14')) AS incorporated FROM (SELECT accession, lower(html) AS low FROM filings) f"""
PROMPTS = f"""SELECT accession, 'Extract all item sections of filing ' || accession || '.' || chr(10) || 'Document: ' || printf('%.1f', length(html) / 1e6) || ' MB, ' || coalesce(n_links, 0) || ' contents links, ' || coalesce(n_cands, 0) || ' candidates, difficulty ' || CASE WHEN n_links IS NULL THEN 'unknown' WHEN coalesce(n_cands, 0) > 100 THEN 'hard' WHEN coalesce(n_cands, 0) > 50 THEN 'medium' ELSE 'easy' END || '.' ||
  coalesce(chr(10) || 'Part headings: ' || heads, '') || CASE WHEN incorporated THEN chr(10) || 'Items 10 to 14 are incorporated by reference: assign them with position -1.' ELSE '' END || chr(10) || chr(10) || 'Begin with get_all_top_candidates, then assign all sure items with one batch_assign.' AS prompt
  FROM filings LEFT JOIN (SELECT accession, count(*) AS n_links FROM links GROUP BY accession) USING (accession) LEFT JOIN (SELECT accession, count(*) AS n_cands FROM rescored GROUP BY accession) USING (accession)
  LEFT JOIN (SELECT accession, string_agg('Part ' || part || ' at ' || printf('%.1f%%', 100 * rel), ', ' ORDER BY part) AS heads FROM parts GROUP BY accession) USING (accession) LEFT JOIN ({PART_THREE}) USING (accession)"""
#: The only bold SIGNATURES of a filing stand in a paragraph of their own.
SIGNATURE_PLACES = """SELECT accession, CAST(strpos(html, '<p><b>SIGNATURES') - 1 AS BIGINT) AS o FROM filings WHERE strpos(html, '<p><b>SIGNATURES') > 0 AND accession IN (SELECT accession FROM chosen)"""
#: The chosen chain with the signatures found behind it, and the rescored candidates.
BOTH = f"""{CHOSEN}{RESCORED[len(LABELS):]},
sure AS (SELECT accession, item, anchor_id, o FROM chosen WHERE confidence >= 7),
placed AS MATERIALIZED (SELECT accession, item, o FROM chosen UNION ALL SELECT accession, 'signatures', o FROM ({SIGNATURE_PLACES})),
spanned AS (SELECT accession, item, length(html) AS n, coalesce(lead(o) OVER (PARTITION BY accession ORDER BY o), length(html)) - o AS span FROM placed JOIN filings USING (accession)),
best_ AS (SELECT accession, item, max(confidence) AS top FROM rescored GROUP BY ALL),
spread_ AS (SELECT accession, item, any_value(top) AS top, max(o) - min(o) AS spread, count(DISTINCT o) AS places FROM rescored JOIN best_ USING (accession, item) WHERE confidence = top GROUP BY ALL)"""
#: The scripted conversation: every item gets its surest candidate, what then breaks the order goes, and so on until nothing changes.
AGENT = f"""{BOTH},
filled AS (SELECT accession, item, anchor_id, CAST(o AS BIGINT) AS o FROM (SELECT *, row_number() OVER (PARTITION BY accession, item ORDER BY confidence DESC, o, anchor_id, source) AS r FROM rescored) WHERE r = 1 AND confidence >= 5),
round0 AS (SELECT * FROM filled)"""
_ROUNDS = 8
for _k in range(_ROUNDS):
    AGENT += f""",
judged{_k} AS (SELECT r.accession, item, anchor_id, o, coalesce(seq < lag(seq) OVER w OR o <= lag(o) OVER w, false) AS bad FROM round{_k} r JOIN dim USING (item) WINDOW w AS (PARTITION BY accession ORDER BY o, seq)),
round{_k + 1} AS MATERIALIZED (SELECT accession, item, anchor_id, o FROM judged{_k} WHERE NOT bad)"""

#: Headings of every label in the stripped texts.  RE2 can't look ahead: what may not follow a number is matched with it, and such matches go.
_FOLLOWS = {"1": "0-9ab", "7": "0-9a", "9": "0-9abc"}


def scans() -> str:
    made = []
    for name, _, _, n, c, _ in rules.ITEMS:
        if n:
            tail = rf"\s*[.\-–—]?\s*{c.lower()}\b" if c else r"\b" + (rf"\s*[{_FOLLOWS.get(n, '0-9')}]?" if len(n) == 1 else "")
            only = "true" if c else rf"regexp_matches(m, '(?i)^item\s*{n}\s*$')"
            made.append(f"SELECT accession, size, n_text, {q(name)} AS item, o FROM {find_all('region', 't', rf'(?i)item\s*{n}{tail}')} WHERE {only}")
    return " UNION ALL ".join(made)


SCAN = f"""{ANCHORS},
region AS MATERIALIZED (SELECT accession, length(html) AS size, {strip('html')} AS t, length({strip('html')}) AS n_text FROM filings),
hits AS (SELECT accession, item, CAST(row_number() OVER (PARTITION BY accession, item ORDER BY o) - 1 AS INTEGER) AS ord, CAST(floor(o / n_text * size) AS BIGINT) AS o FROM ({scans()}))"""

EVENTS = """ev AS (SELECT CAST(user_id % 97 AS VARCHAR) AS accession, CAST(event_id AS INTEGER) AS turn, 0 AS ord, CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN 'unassign' ELSE 'assign' END AS action,
  (['item1', 'item1a', 'item7', 'item8', 'item15', 'item2', 'item3', 'item10'])[CAST(event_id % 8 AS INTEGER) + 1] AS item, 'a' || (event_id % 5) AS anchor_id, CAST(event_id * 37 % 1300 - 60 AS BIGINT) AS o FROM events),
len_ AS (SELECT DISTINCT accession, 1200 AS html_len FROM ev),
folded AS MATERIALIZED (SELECT accession, item, anchor_id, CASE WHEN o >= 0 THEN o END AS o, turn FROM (SELECT *, row_number() OVER (PARTITION BY accession, item ORDER BY turn DESC) AS r FROM ev) WHERE r = 1 AND action = 'assign')"""

ISSUES = f"""{DIM}, {EVENTS},
walk AS (SELECT *, lag(seq) OVER w AS prev_seq, last_value(o IGNORE NULLS) OVER (PARTITION BY accession ORDER BY coalesce(o, -1), seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_o FROM folded JOIN dim USING (item) JOIN len_ USING (accession) WINDOW w AS (PARTITION BY accession ORDER BY coalesce(o, -1), seq)),
issues AS MATERIALIZED (
  SELECT accession, 'out_of_range' AS type, item FROM walk WHERE o < 0 OR o >= html_len
  UNION ALL SELECT accession, 'order_violation', item FROM walk WHERE o IS NOT NULL AND seq < prev_seq
  UNION ALL SELECT accession, 'non_monotonic', item FROM walk WHERE o <= prev_o
  UNION ALL SELECT l.accession, 'missing_expected', d.item FROM len_ l, dim d WHERE d.expected AND NOT EXISTS (SELECT 1 FROM folded f WHERE f.accession = l.accession AND f.item = d.item))"""

PAIRS = """gold AS (SELECT CAST(item_id % 13 AS VARCHAR) AS accession, 'item' || item_id AS item, text AS html FROM benchmark ),
pred AS (SELECT CAST(item_id % 13 AS VARCHAR) AS accession, 'item' || (item_id + CASE WHEN item_id % 11 = 0 THEN 1000 ELSE 0 END) AS item, CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN substr(text, 1, CAST(length(text) - 15 AS INTEGER)) ELSE replace(text, 'e', 'E') END AS html FROM benchmark WHERE item_id % 7 <> 3)"""


def f1_sql(pairs: str) -> str:
    """Rows of ``pairs`` (accession, item, p, g), texts as they are after stripping."""
    return f"""ch AS (SELECT accession, item, c, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (SELECT accession, item, 0 AS side, unnest(string_split(p, '')) AS c FROM {pairs} UNION ALL SELECT accession, item, 1, unnest(string_split(g, '')) FROM {pairs}) WHERE c <> '' GROUP BY ALL),
ov AS (SELECT accession, item, CAST(sum(least(a, b)) AS BIGINT) AS overlap FROM ch GROUP BY ALL),
f1 AS MATERIALIZED (SELECT accession, item, length(p) AS pred_len, length(g) AS truth_len, p = g AS exact_match, coalesce(overlap, 0) AS overlap, CASE WHEN length(p) = 0 AND length(g) = 0 THEN 1.0 WHEN length(p) = 0 OR length(g) = 0 THEN 0.0 ELSE 2 * coalesce(overlap, 0) / CAST(length(p) + length(g) AS DOUBLE) END AS f1 FROM {pairs} LEFT JOIN ov USING (accession, item))"""


EVAL = f"""{PAIRS}, prs AS (SELECT gold.accession, gold.item, {strip("coalesce(pred.html, '')")} AS p, {strip('gold.html')} AS g, pred.item IS NOT NULL AS extracted FROM gold LEFT JOIN pred ON gold.accession = pred.accession AND gold.item = pred.item),
{f1_sql('prs')},
ei AS MATERIALIZED (SELECT f1.*, extracted, round(f1, 4) AS char_f1 FROM f1 JOIN prs USING (accession, item)),
fp AS (SELECT accession, item FROM pred WHERE NOT EXISTS (SELECT 1 FROM gold WHERE gold.accession = pred.accession AND gold.item = pred.item)),
ed AS MATERIALIZED (SELECT accession, count(*) AS truth_items, avg(CAST(extracted AS DOUBLE)) AS extraction_rate, avg(CAST(exact_match AS DOUBLE)) AS exact_match_rate, avg(f1) AS mean_char_f1, coalesce((SELECT string_agg(item, ',' ORDER BY item) FROM fp WHERE fp.accession = ei.accession), '') AS false_positives,
  bool_and(extracted AND char_f1 >= 0.9) AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.accession = ei.accession) AS doc_retrieved, bool_and(extracted AND exact_match) AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.accession = ei.accession) AS doc_retrieved_strict FROM ei GROUP BY accession)"""


NOISE = """fails AS (SELECT CAST(item_id % 11 AS VARCHAR) AS accession, ['signatures', 'item16', 'item7'][item_id // 3 % 3 + 1] AS item, ['missing', 'FP', 'boundary'][item_id % 3 + 1] AS kind,
  CASE item_id // 9 % 4 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN repeat(text, 40) ELSE repeat(text, 1000000 // length(text) + 1) END AS truth,
  CASE (item_id // 9 + 1) % 4 WHEN 0 THEN text WHEN 1 THEN 'Item 16. Form 10-K Summary None. ' || repeat(text, 40) WHEN 2 THEN repeat(text, 40) ELSE 'x' END AS pred, item_id * 1000 AS file_size, item_id % 2 = 0 AS detected FROM benchmark),
judged AS (SELECT accession, kind || ' ' || item || CASE WHEN kind = 'boundary' THEN ' (' ELSE '' END AS reason,
  CASE item || kind WHEN 'signaturesmissing' THEN length(truth) < 100 OR length(truth) > 0.3 * file_size OR detected WHEN 'signaturesFP' THEN true WHEN 'signaturesboundary' THEN length(truth) > 1000000
       WHEN 'item16missing' THEN length(trim(truth)) < 100 WHEN 'item16FP' THEN pred LIKE 'Item 16. Form 10-K Summary None.%' OR length(pred) < 3000 WHEN 'item16boundary' THEN length(trim(truth)) < 100 AND length(trim(pred)) < 100 OR length(truth) > 1000000 ELSE false END AS noisy FROM fails)"""


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, body, rec="": f"WITH {rec}{ctes} {body}"
    r4 = lambda c: f"round({c}, 6) AS {c}"
    made = {
        "page_sections": f"WITH t AS (SELECT page_id, ord, o, m, html FROM {find_all('pages', 'html', BLOCK)}) SELECT page_id, CAST(ord AS INTEGER) AS ord, o, length({strip('substr(html, o + 1, coalesce(lead(o) OVER (PARTITION BY page_id ORDER BY o), length(html)) - o)')}) AS chars FROM t",
        "tag_offsets": f"SELECT page_id, CAST(ord AS INTEGER) AS ord, o, m FROM {find_all('pages', 'html', '<[a-z][^>]*>')}",
        "page_text": f"SELECT page_id, {strip('html')} AS text FROM pages",
        "filings": w(FILINGS, "SELECT accession, length(html) AS chars, md5(html) AS digest FROM filings"),
        "main_document": w(FILINGS, "SELECT accession, CASE WHEN CAST(accession AS INTEGER) % 3 = 0 THEN html ELSE chr(10) || html || chr(10) || '</TEXT>' || chr(10) END AS main FROM filings"),
        "difficulty": w(FILINGS, "SELECT accession, CASE WHEN n >= 10 THEN 'easy' WHEN n >= 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM (SELECT accession, len(regexp_extract_all(substr(h, 1, CAST(floor(length(h) / 3) AS INTEGER)), '(?i)font-weight:\\s*(?:bold|700)[^>]*>\\s*item\\s*\\d')) AS n FROM (SELECT accession, replace(html, '<td>', '<td style=\"font-weight: bold\">') AS h FROM filings))"),
        "submission_blocks": w(FILINGS, "SELECT accession, length(body) AS chars, md5(body) AS digest, at_ AS text_start FROM (SELECT accession, CASE WHEN k THEN html || chr(10) ELSE chr(10) || html || chr(10) || '</TEXT>' || chr(10) END AS body, CASE WHEN k THEN 0 ELSE length('<SEC-HEADER>x.<DOCUMENT>.<TYPE>EX-1.<TEXT>no</TEXT>.</DOCUMENT>.<DOCUMENT>.<TYPE>10-K.<TEXT>') END AS at_ FROM (SELECT *, CAST(accession AS INTEGER) % 3 = 0 AS k FROM filings))"),
        "toc_ids": w(LINKS, "SELECT DISTINCT accession, anchor_id FROM links"),
        "toc_links": w(LINKS, "SELECT accession, CAST(ord AS INTEGER) AS ord, o, anchor_id, link_text, item FROM links"),
        "toc_first": w(LINKS, "SELECT accession, item, arg_min(anchor_id, o) AS anchor_id FROM links WHERE item IS NOT NULL GROUP BY ALL"),
        "toc_link_records": w(LINKS, f"SELECT accession, min(o) AS o, anchor_id, low AS link_text, any_value(coalesce({heading('low')}, {title('low')})) AS item FROM link1 WHERE length(low) >= 2 GROUP BY accession, anchor_id, low"),
        "page_text_entities": f"SELECT page_id, {strip(DECODED)} AS text FROM pages",
        "part_three": w(RESCORED, PART_THREE),
        "signature_fallback": w(CHOSEN, SIGNATURE_PLACES, "RECURSIVE "),
        "anchors_last": w(ANCHORS, "SELECT * FROM anchors"),
        "anchor_items": w(WINDOWS, "SELECT accession, anchor_id, array_to_string(items, ',') AS items, array_to_string(firsts, ',') AS firsts FROM items"),
        "anchor_windows": w(WINDOWS, "SELECT accession, anchor_id, o, next_o, ahead, behind FROM windows"),
        "part_boundaries": w(f"{FILINGS}, {PARTS}", "SELECT accession, part, o, round(rel, 6) AS rel FROM parts"),
        "tier_cascade": w(CASCADE, "SELECT * FROM cascade"),
        "candidates_all": w(CANDS, "SELECT * REPLACE (round(rel, 6) AS rel) FROM cands"),
        "candidates_rescored": w(RESCORED, "SELECT accession, item, anchor_id, o, confidence, source FROM rescored"),
        "candidates_top3": w(RESCORED, "SELECT accession, item, anchor_id, confidence, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY accession, item ORDER BY confidence DESC, o, anchor_id, source) AS rank FROM rescored) WHERE rank <= 3"),
        "found_items": w(RESCORED, "SELECT accession, item, max(confidence) AS best FROM rescored GROUP BY ALL HAVING max(confidence) >= 5"),
        "filing_overview": w(RESCORED, "SELECT accession, links, classified, coalesce(candidates, 0) AS candidates, coalesce(items, 0) AS items, CASE WHEN candidates > 100 THEN 'hard' WHEN candidates > 50 THEN 'medium' ELSE 'easy' END AS difficulty FROM (SELECT accession, count(*) AS links, count(item) AS classified FROM links GROUP BY ALL) LEFT JOIN (SELECT accession, count(*) AS candidates, count(DISTINCT item) AS items FROM rescored GROUP BY ALL) USING (accession)"),
        "dp_select": w(CHOSEN, "SELECT accession, item, anchor_id, o, confidence FROM chosen", "RECURSIVE "),
        "greedy_select": w(CASCADE, "SELECT accession, item, anchor_id, o, confidence FROM (SELECT *, row_number() OVER (PARTITION BY accession, item ORDER BY confidence DESC, o DESC, anchor_id DESC) AS r FROM cascade) WHERE r = 1"),
        "agent_slices": w(CHOSEN, "SELECT accession, item, length(html_) AS chars, md5(html_) AS digest FROM (SELECT accession, item, substr(html, o + 1, coalesce(lead(o) OVER (PARTITION BY accession ORDER BY o), length(html)) - o) AS html_ FROM chosen JOIN filings USING (accession))", "RECURSIVE "),
        "boundary_features": w(FEATURES, "SELECT * FROM features"),
        "boundary_labels": w(PLACES, f"SELECT accession, anchor_id, arg_max(item, seq) AS item FROM (SELECT accession, item, arg_min(anchor_id, d * 10000000 + o) AS anchor_id FROM near_ GROUP BY accession, item) JOIN dim USING (item) GROUP BY accession, anchor_id", "RECURSIVE "),
        "anchor_classes": w(PLACES, "SELECT coalesce(item, 'none') AS item, count(*) AS n FROM (SELECT a.accession, a.anchor_id, arg_min(n.item, n.d * 100 + dim.seq) AS item FROM anchors a LEFT JOIN near_ n ON n.accession = a.accession AND n.anchor_id = a.anchor_id LEFT JOIN dim ON dim.item = n.item GROUP BY ALL) GROUP BY 1", "RECURSIVE "),
        "pre_populated": w(CHOSEN, "SELECT accession, 0 AS turn, CAST(row_number() OVER (PARTITION BY accession ORDER BY o, seq) - 1 AS INTEGER) AS ord, 'assign' AS action, item, anchor_id, o FROM chosen JOIN dim USING (item)", "RECURSIVE "),
        "task_prompts": w(RESCORED, PROMPTS),
        "run_report": "SELECT CAST(doc_id AS VARCHAR) AS accession, '| ' || doc_id || ' | ' || printf('%.1f%%', 100 * (quality / 2.0 + 0.25)) || ' | ' || CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' ELSE 'no' END || ' | 1 | 1 |  |' AS line FROM labels JOIN documents USING (doc_id)",
        "policy_assignments": w(BOTH, f"""SELECT accession, item, anchor_id, o FROM sure UNION ALL
          SELECT p.accession, t.item, NULL, NULL FROM ({PART_THREE}) p, (VALUES ('item10'), ('item11'), ('item12'), ('item13'), ('item14')) t(item) WHERE p.incorporated AND NOT EXISTS (SELECT 1 FROM sure WHERE sure.accession = p.accession AND sure.item = t.item)""", "RECURSIVE "),
        "ambiguous_items": w(BOTH, """SELECT accession, item, reasons FROM (SELECT accession, item, concat_ws('; ', CASE WHEN coalesce(top, 0) < 7 THEN 'low confidence' END, CASE WHEN places > 1 AND spread > 0.05 * n THEN 'scattered' END,
            CASE WHEN span / n > 0.4 THEN CASE WHEN item <> 'item8' THEN 'span large' END WHEN span < 100 THEN 'span small' END) AS reasons FROM spanned LEFT JOIN spread_ USING (accession, item)) WHERE reasons <> ''
          UNION ALL SELECT accession, item, 'missing' FROM filings, dim WHERE expected AND NOT EXISTS (SELECT 1 FROM placed WHERE placed.accession = filings.accession AND placed.item = dim.item)""", "RECURSIVE "),
        "agent_assignments": w(AGENT, f"SELECT * FROM round{_ROUNDS}", "RECURSIVE "),
        "agent_runs": w(AGENT, f"""SELECT accession, n = 0 AS finalized, n AS issues, coalesce(f, 0) + coalesce(g, 0) AS events FROM
          (SELECT accession, (SELECT count(*) FROM dim WHERE expected AND NOT EXISTS (SELECT 1 FROM round{_ROUNDS} r WHERE r.accession = filings.accession AND r.item = dim.item)) AS n FROM filings)
          LEFT JOIN (SELECT accession, count(*) AS f FROM filled GROUP BY ALL) USING (accession) LEFT JOIN (SELECT accession, count(*) AS g FROM ({' UNION ALL '.join(f'SELECT accession FROM judged{k} WHERE bad' for k in range(_ROUNDS))}) GROUP BY ALL) USING (accession)""", "RECURSIVE "),
        "anchors_in_radius": w(CHOSEN, "SELECT c.accession, c.item, a.anchor_id, a.o - c.o AS delta FROM chosen c JOIN anchors a ON a.accession = c.accession AND a.o BETWEEN c.o - 700 AND c.o + 700", "RECURSIVE "),
        "heading_scan": w(SCAN, "SELECT h.accession, h.item, h.ord, h.o, arg_min(a.anchor_id, abs(a.o - h.o) * 10000000 + a.o) AS near_id, min(abs(a.o - h.o)) AS distance FROM hits h LEFT JOIN anchors a ON a.accession = h.accession AND abs(a.o - h.o) < 2000 WHERE h.ord < 5 GROUP BY ALL"),
        "nearest_anchor": w(ANCHORS, "SELECT p.accession, p.k, arg_min(a.anchor_id, abs(a.o - p.o) * 10000000 + a.o) AS near_id, min(abs(a.o - p.o)) AS distance FROM (SELECT accession, k, k * 611 AS o FROM filings, generate_series(0, 9) t(k)) p LEFT JOIN anchors a ON a.accession = p.accession AND abs(a.o - p.o) < 500 GROUP BY ALL"),
        "live_assignments": w(EVENTS, "SELECT * FROM folded"),
        "state_fold": w(EVENTS, "SELECT * FROM folded"),
        "state_listed": w(EVENTS, "SELECT accession, item, CAST(row_number() OVER (PARTITION BY accession ORDER BY coalesce(o, -1), turn, item) AS INTEGER) AS rank FROM folded"),
        "validate_issues": w(ISSUES, "SELECT * FROM issues"),
        "finalize_gate": w(ISSUES, "SELECT accession, count(i.type) AS n_issues, count(i.type) = 0 AS is_valid FROM len_ LEFT JOIN issues i USING (accession) GROUP BY accession"),
        "span_sizes": w(f"{DIM}, {EVENTS}", "SELECT accession, item, n AS span_chars, round(n / 1200, 4) AS span_pct, CASE WHEN n / 1200 > 0.4 THEN 'large' WHEN n < 100 THEN 'small' ELSE 'ok' END AS flag FROM (SELECT accession, item, coalesce(lead(o) OVER (PARTITION BY accession ORDER BY o, seq), 1200) - o AS n FROM folded JOIN dim USING (item) WHERE o IS NOT NULL)"),
        "stall_runs": "WITH RECURSIVE t AS (SELECT conv_id AS c, turn, length(text) % 4 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), w AS (SELECT c, i, n, 0 AS run, false AS hit, turn FROM t WHERE i = 1 UNION ALL SELECT t.c, t.i, t.n, CASE WHEN x >= 3 THEN 0 ELSE x END, x >= 3, t.turn FROM (SELECT t.*, CASE WHEN t.n > 0 AND t.n >= w.n THEN w.run + 1 ELSE 0 END AS x FROM w JOIN t ON t.c = w.c AND t.i = w.i + 1) t) SELECT CAST(c AS VARCHAR) AS accession, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (hit), '') AS fired FROM w GROUP BY c",
        "message_sizes": "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS messages FROM conversations GROUP BY conv_id",
        "compaction_view": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS chars FROM conversations) WHERE chars <= 600 OR a <= 2 OR a > n - 2",
        "eval_item": w(EVAL, f"SELECT accession, item, extracted, exact_match, char_f1, pred_len, truth_len, overlap FROM ei"),
        "eval_doc": w(EVAL, f"SELECT accession, truth_items, {r4('extraction_rate')}, {r4('exact_match_rate')}, {r4('mean_char_f1')}, false_positives, doc_retrieved, doc_retrieved_strict FROM ed"),
        "eval_corpus": w(EVAL, f"SELECT item, CAST(GROUPING(item) AS INTEGER) AS overall, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg(CAST(extracted AS DOUBLE)), 6) AS extraction_rate, count(*) FILTER (char_f1 < 0.9) AS failures FROM ei GROUP BY GROUPING SETS ((item), ())"),
        "false_positives": w(EVAL, "SELECT * FROM fp"),
        "missing_items": w(EVAL, "SELECT accession, item FROM ei WHERE NOT extracted"),
        "worst_k": w(EVAL, "SELECT accession, item, char_f1 FROM ei ORDER BY char_f1, accession, item LIMIT 10"),
        "failure_types": w(EVAL, "SELECT CASE WHEN pred_len = 0 THEN 'missing' WHEN truth_len > 1000000 THEN 'gt_noise' WHEN f1 < 0.5 THEN 'severe' ELSE 'near_miss' END AS type, count(*) AS n FROM ei WHERE char_f1 < 0.9 GROUP BY ALL"),
        "char_f1_docs": w(f"prs AS (SELECT CAST(d.doc_id AS VARCHAR) AS accession, CAST(b.item_id AS VARCHAR) AS item, {strip('d.text')} AS p, {strip('b.text')} AS g FROM documents d JOIN benchmark b ON d.doc_id % (SELECT greatest(1, count(*)) FROM benchmark) = b.item_id), {f1_sql('prs')}", "SELECT accession, item, overlap, round(f1, 6) AS f1 FROM f1"),
        "failure_rows": w(EVAL, "SELECT accession, item, CASE WHEN extracted THEN 'boundary' ELSE 'missing' END AS kind, CASE WHEN extracted THEN round(f1, 6) END AS f1 FROM ei WHERE NOT extracted OR f1 < 0.9 UNION ALL SELECT accession, item, 'fp', NULL FROM fp"),
        "noise_reasons": w(NOISE, "SELECT trim(string_split(reason, '(')[1]) AS reason, count(*) AS n FROM judged GROUP BY 1"),
        "noise_rates": w(NOISE, """SELECT total, pass, noise, mixed, "real", round(pass / total, 6) AS raw_rate, round((pass + noise) / total, 6) AS adjusted_rate, CASE WHEN total > noise + mixed THEN round(pass / (total - noise - mixed), 6) ELSE 0.0 END AS clean_rate
          FROM (SELECT count(*) AS total, count(*) FILTER (kind = 'pass') AS pass, count(*) FILTER (kind = 'noise') AS noise, count(*) FILTER (kind = 'mixed') AS mixed, count(*) FILTER (kind = 'real') AS "real"
          FROM (SELECT CASE WHEN CAST(accession AS INTEGER) > 10 THEN 'pass' WHEN all_noise THEN 'noise' WHEN some_noise THEN 'mixed' ELSE 'real' END AS kind FROM (SELECT DISTINCT CAST(item_id % 13 AS VARCHAR) AS accession FROM benchmark) LEFT JOIN (SELECT accession, bool_and(noisy) AS all_noise, bool_or(noisy) AS some_noise FROM judged GROUP BY accession) USING (accession)))"""),
        "resume_anti": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
        "set_intersect": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
        "set_diff": "SELECT doc_id FROM documents WHERE n_chars > 1000 EXCEPT SELECT doc_id FROM labels WHERE quality = 1",
        "hist_values": "SELECT CAST(least(floor(value / 5), 39) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY ALL",
        "median_value": "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY ALL",
        "run_summary": "SELECT set, count(*) AS n, count(*) FILTER (ok) AS retrieved, round(avg(f1), 6) AS mean_f1, count(*) FILTER (NOT ok AND fin) AS finalized_fail, count(*) FILTER (NOT ok AND NOT fin) AS stalled FROM (SELECT source AS set, quality / 2.0 + 0.25 AS f1, quality = 1 AND toxic = 0 AS ok, toxic = 1 AS fin FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (set)",
    }
    return made | {"live_stalls": made["stall_runs"]}
