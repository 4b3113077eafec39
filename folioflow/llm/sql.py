"""DuckDB SQL of the operators that SQL can express, written from their definitions and not from the Spark code."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes.  The table of 256 entries follows from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    hexed = f"hex(encode({text}))"
    byte = f"(instr('0123456789ABCDEF', substr({hexed}, 2 * k + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({hexed}, 2 * k + 2, 1)) - 1"
    each = f"list_transform(range(strlen({text})), lambda k: ({byte})::BIGINT)"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])::BIGINT"
    return f"xor(list_reduce({each}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: A conversation's rows one after the other; z, s, u, a are the best (cost, audit, lines) that end with nothing, a system, a user, an assistant turn.
DIALOGUE_REPAIR = (
    r"""
with recursive said as (
  select conv_id, turn, coalesce(role, ' ') role0, coalesce(text, ' ') text0, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') mark from conversations),
hit as (select *, @CRC % 20 h from said),
damaged as (
  select conv_id, turn, role0, text0, copy, case when h = 4 then 'user' else role0 end as role,
    case h when 1 then '' when 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end as text
  from hit, unnest(case when h = 3 then [0, 1] else [0] end) t(copy) where h <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role0, sha256(text0), copy) k, row_number() over (partition by conv_id, role, text order by turn nulls first, role0, sha256(text0), copy) again,
    rtrim(text, e' \t\n\x0b\x0c\r') ink, left(role, 1) i from damaged),
judged as (
  select *, ink = '' as blank, ink <> '' and again > 1 as dup, ink <> '' and again = 1 and right(ink, 1) not in ('.', '!', '?') as trunc,
    lag(i) over (partition by conv_id order by k) || i as pair from placed),
facts as (
  select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(blank) blank, count_if(dup) as duplicate, count_if(trunc) truncated,
    count_if(pair not in ('su', 'ua', 'au')) illegal from judged group by conv_id),
steps as (
  select conv_id, 0::bigint k, @START from facts
  union all
  select conv_id, k, @CLOSED from (
    select p.conv_id, j.k, @AFTER from steps p join judged j on j.conv_id is not distinct from p.conv_id and j.k = p.k + 1)),
done as (select s.conv_id, least(z, a) best from steps s join facts f on f.conv_id is not distinct from s.conv_id and f.n = s.k)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.p, '') audit, sha256(coalesce(array_to_string(best.r, e'\n'), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id
"""
)


def dialogue_repair() -> str:
    kind = "struct(c bigint, p varchar, r varchar[])"
    none = f"null::{kind}"

    def plus(x: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"list_append({x}.r, {line})" if line else f"{x}.r"
        return f"case when {x} is not null then {{'c': {x}.c + {cost}, 'p': {x}.p || '{letter}', 'r': {lines}}}::{kind} end"

    user, assistant, own = "'user:'", "'assistant:'", "role || ':' || text"
    more, stays = "trunc::int", "not blank and not dup"
    kept = lambda x, i: f"case when {stays} and i = '{i}' then {plus(x, more, 'K', own)} end"
    recast = lambda x, line: f"case when {stays} then {plus(x, f'2 + {more}', 'R', f'{line} || text')} end"
    gone = lambda x: plus(x, "3", "D", None)
    added = lambda x, line: plus(x, "2", "I", line)
    to_user = ", ".join(f(x) for x in "zsa" for f in (lambda x: kept(x, "u"), lambda x: recast(x, user)))
    behind = f"{gone('z')} z, least({gone('s')}, {kept('z', 's')}) s, least({gone('u')}, {to_user}) u, least({gone('a')}, {kept('u', 'a')}, {recast('u', assistant)}) a"
    # an insertion leads to u or a only: one of each before and behind the other covers all that can be cheapest
    u1 = f"least(u, {added('z', user)}, {added('s', user)}, {added('a', user)})"
    closed = f"z, s, u1 u, least(a, {added('u1', assistant)}) a"
    start = f"{{'c': 0, 'p': '', 'r': []}}::{kind} z, {none} s, {{'c': 2, 'p': 'I', 'r': [{user}]}}::{kind} u, {{'c': 4, 'p': 'II', 'r': [{user}, {assistant}]}}::{kind} a"
    text = DIALOGUE_REPAIR.replace("@CRC", crc32("mark")).replace("@START", start)
    return text.replace("select conv_id, k, @CLOSED from (", f"select conv_id, k, {closed} from (select *, {u1} u1 from (").replace("@AFTER", behind).replace("j.k = p.k + 1))", "j.k = p.k + 1)))")


def importance(percent: int = 25, buckets: int = 10_000, least_words: int = 20, seed: int = 7) -> str:
    """Every feature is hashed once, then looked up."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with said as (
  select 0 as kind, row_number() over () id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{abc.upper()}', '{abc}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all
  select 1, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), '{abc.upper()}', '{abc}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
features as (
  select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) f from said),
hashed as (select f, ({crc32('f')} % {buckets}) as bucket from (select distinct f from features)),
counted as (select kind, id, bucket, count(*) n from features join hashed using (f) group by all),
gain as (
  select bucket, floor(1000 * ln(((t + 1) * (tt_s + {buckets})) / ((s + 1) * (tt_t + {buckets}))))::bigint g
  from (select b.bucket, coalesce(sum(n) filter (kind = 0), 0)::double s, coalesce(sum(n) filter (kind = 1), 0)::double t from range({buckets}) b(bucket) left join counted c on c.bucket = b.bucket group by 1),
    (select coalesce(sum(n) filter (kind = 0), 0)::double tt_s, coalesce(sum(n) filter (kind = 1), 0)::double tt_t from counted)),
weighed as (select id, sum(n)::bigint n_features, floor(sum(n * g)::double / sum(n))::bigint weight from counted join gain using (bucket) where kind = 0 group by 1),
scored as (
  select doc_id, id, len(w) words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5) / 4294967296::double)))::bigint score
  from said left join weighed using (id) where kind = 0),
placed as (select *, case when words >= {least_words} then row_number() over (partition by words >= {least_words} order by score desc, doc_id nulls first) end r, count_if(words >= {least_words}) over () able from scored)
select doc_id, n_features::bigint n_features, weight::bigint weight, score::bigint score, case when r <= {percent} * able // 100 then r end::bigint rank from placed
"""
