"""Conversation structure repair: cheapest edits to legal turn orders, by a dynamic program over a trie of signatures.

A conversation's rows become one character each (role initial, and whether the row must go or ends
without a full stop).  Runs of at most ``1 << PIECE`` neighbouring rows are *pieces*; nearly all
conversations are one.  Distinct signatures are sorted by range over the cluster and walked as a prefix
trie: a task keeps the dynamic program's layers of the current path only, so a layer is computed once for
each shared prefix, and answers are emitted where a signature ends.  The pieces of long conversations get
4 x 4 matrices (state before, state after) instead, which are multiplied level by level, so no task gets
an unbounded conversation.  The repaired text is hashed in one sorted pass that holds one row at a time;
only this pass needs a conversation's rows in one task, for SHA-256 is a chain.

Legal orders are ``(s?(ua)+)?`` over role initials.  Keep costs 0, rerole to user or assistant 2, delete 3
(required for blank and duplicate rows), insert an empty user or assistant turn 2; each row that stays
without ``.!?`` at its end adds 1.  Of the cheapest edits the audit that is least in ASCII holds.

Defined cases: nulls in role or text count as one space, a null conversation id is a conversation of its
own, null turns come first.  Rows of the same turn are ordered by role and the text's SHA-256 before the
damage; a repeated row stands behind its original, and exact copies are duplicates.  Roles that begin with
none of s, u, a can't be kept as they are.  Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts, small_batches, tidy, with_group

PIECE = 8
#: Blank characters of the contract: 0x20 and 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state, by role initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only state that a rerole or insertion leads to.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the contract's damage: conv_id, turn, role, text, and role0, digest0, copy, which order rows of a turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", said("role").alias("role0"), said("text").alias("text0"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role0")).alias("role"), text.alias("text"), "role0", F.sha2(F.col("text0").cast("binary"), 256).alias("digest0"), F.explode(copies).alias("copy"))


def ordered(rows: DataFrame, hold: Scratch) -> DataFrame:
    """``rows`` sorted over the whole cluster and written, with ``ord``, which rises in that order, and each row's faults but duplicates."""
    order = ["conv_id", "turn", "role0", "digest0", "copy"]
    ends = F.rtrim("text", F.lit(BLANK))
    faults = {"initial": F.substring("role", 1, 1), "blank": ends == "", "truncated": ~F.right(ends, F.lit(1)).isin(".", "!", "?"), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256))}
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return hold.keep(dealt.select("conv_id", "turn", "role", "text", *(v.alias(k) for k, v in faults.items()), F.monotonically_increasing_id().alias("ord")), "rows")


def pieces(rows: DataFrame, hold: Scratch) -> DataFrame:
    """One row for each run of up to ``1 << PIECE`` neighbouring rows of a conversation: its signature and counts.

    A row is a duplicate unless it is the first of its conversation, role and text; the first ones are
    found by a grouping and joined by ``ord``, which is unique, so one much repeated text loads no task.
    """
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    marked = rows.select("conv_id", "ord", "initial", "blank", "truncated").join(first, "ord", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(role)).otherwise(role)
    cut = marked.withColumns({"role": role, "sign": sign}).groupBy("conv_id", F.shiftright("ord", PIECE).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "sign", "role"))).alias("l"), F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"),
        F.count_if(F.col("truncated") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"))
    size = F.size("l")
    pairs = F.zip_with(F.slice("l", F.lit(1), size - 1), F.slice("l", F.lit(2), size - 1), lambda a, b: F.concat(a.role, b.role))
    made = cut.select("conv_id", "block", "blank", "duplicate", "truncated", F.array_join(F.transform("l", lambda x: x.sign), "").alias("signs"), F.get("l", F.lit(0)).role.alias("opens"), F.element_at("l", -1).role.alias("closes"), F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"))
    by = Window.partitionBy("conv_id")
    seam = F.concat(F.lag("closes").over(by.orderBy("block")), F.col("opens"))
    made = made.select("conv_id", "block", "blank", "duplicate", "truncated", F.count("*").over(by).alias("n"), "signs", (F.col("illegal") + F.coalesce((~seam.isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("illegal"))
    key = F.concat(F.when(F.col("n") == 1, "0").otherwise("1"), "signs")
    return hold.keep(made.withColumn("key", key).drop("signs"), "pieces")


def least(a, b):
    """The better of two (cost, audit) pairs, either of which may be None."""
    return b if a is None else a if b is None or a <= b else b


def with_insertions(states: list) -> list:
    """The layer after any number of insertions."""
    for _ in range(3):
        for k, best in enumerate(list(states)):
            if best:
                states[MADE[k]] = least(states[MADE[k]], (best[0] + 2, best[1] + "I"))
    return states


def opening(start: int) -> list:
    return with_insertions([(0, "") if k == start else None for k in range(4)])


def after(states: list, sign: str) -> list:
    """The layer (best cost and audit by state) behind one more row.

    Two audits of one cost never begin one another: they have as many letters K, R and D, and each I costs
    2.  So the least audit of a state stays the least whatever follows.
    """
    new, more, role = [None] * 4, int(sign.isupper()), sign.lower()
    for k, best in enumerate(states):
        if best is None:
            continue
        cost, audit = best
        new[k] = least(new[k], (cost + 3, audit + "D"))
        if sign == "x":
            continue
        if (k, role) in NEXT:
            to = NEXT[k, role]
            new[to] = least(new[to], (cost + more, audit + "K"))
        new[MADE[k]] = least(new[MADE[k]], (cost + more + 2, audit + "R"))
    return with_insertions(new)


def finished(states: list):
    return least(states[START], states[ASSISTANT])


ANSWERS = "key string, size long, cost long, audit string, matrix array<struct<cost: long, audit: string>>"


def walk(batches):
    """Answers to sorted keys.  A key begins with 0 (a whole conversation) or 1 (a piece), its signature follows.

    ``layers[d]`` holds the layers behind the first d + 1 characters of the last key, one for each state to
    start from: a depth-first walk of the trie of which only the path to the root is kept.
    """
    import pyarrow as pa

    path, layers = "", []
    for batch in batches:
        out = []
        for key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shared = next((k for k, (a, b) in enumerate(zip(path, key, strict=False)) if a != b), min(len(path), len(key)))
            del layers[shared:]
            for d in range(shared, len(key)):
                layers.append([after(states, key[d]) for states in layers[-1]] if d else [opening(k) for k in ((START,) if key[0] == "0" else range(4))])
            path, last = key, layers[-1]
            whole = finished(last[0]) if key[0] == "0" else (None, None)
            out.append((key, size, *whole, None if key[0] == "0" else cells(last)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))])], ["key", "size", "cost", "audit", "matrix"])


def cells(rows: list) -> list:
    return [best and {"cost": best[0], "audit": best[1]} for states in rows for best in states]


def product(matrices: list) -> list:
    """The matrix of several pieces one behind the other."""
    total = None
    for m in matrices:
        now = [[(c["cost"], c["audit"]) if (c := m[4 * a + b]) else None for b in range(4)] for a in range(4)]
        if total is None:
            total = now
            continue
        new = [[None] * 4 for _ in range(4)]
        for a in range(4):
            for k in range(4):
                if head := total[a][k]:
                    for b in range(4):
                        if tail := now[k][b]:
                            new[a][b] = least(new[a][b], (head[0] + tail[0], head[1] + tail[1]))
        total = new
    return cells(total)


def multiplied(groups: DataFrame) -> DataFrame:
    """(conv_id, block, l: sorted matrices) to (conv_id, block, matrix)."""
    import pyarrow as pa

    def run(batches):
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            made = [product([x["matrix"] for x in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], ["conv_id", "block", "matrix"])

    return groups.mapInArrow(run, f"conv_id {groups.schema['conv_id'].dataType.simpleString()}, block long, matrix array<struct<cost: long, audit: string>>")


def long_ones(parts: DataFrame, hold: Scratch) -> DataFrame:
    """(conv_id, cost, audit) of conversations of several pieces (conv_id, block, n, matrix).

    Each level multiplies at most ``1 << PIECE`` matrices of neighbours; levels grow with the logarithm of the longest conversation.
    """
    level = hold.keep(parts, "level0")
    turn = 0
    while level.filter("n > 1").limit(1).count():
        group = F.when(F.col("n") <= 1 << PIECE, 0).otherwise(F.shiftright("block", PIECE))
        listed = level.groupBy("conv_id", group.cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("l"))
        turn += 1
        level = hold.keep(multiplied(listed).withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))), f"level{turn}")
        hold.drop(f"level{turn - 1}")
    of = lambda k: F.get("matrix", F.lit(k))
    best = F.array_min(F.filter(F.array(of(START), of(ASSISTANT)), lambda x: x.isNotNull()))
    return level.select("conv_id", best.cost.alias("cost"), best.audit.alias("audit"))


def answered(parts: DataFrame, hold: Scratch) -> DataFrame:
    """(conv_id, cost, audit) of every conversation that has rows.  ``parts``: ``pieces``, a written table."""
    distinct = parts.groupBy("key").agg(F.count("*").alias("size"))
    dealt = distinct.repartitionByRange(shuffle_parts(parts.sparkSession), "key").sortWithinPartitions("key")
    found = hold.keep(dealt.mapInArrow(walk, ANSWERS), "answers")
    known = with_group(parts.select("conv_id", "block", "n", "key"), found, "key", "size", parts.count())
    many = known.filter("n > 1").select("conv_id", "block", "n", "matrix")
    return known.filter("n = 1").select("conv_id", "cost", "audit").unionByName(long_ones(many, hold))


HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``heads`` (conv_id, counts, audit) with ``repaired_sha256``: the rows' edits are read off the audit, row by row."""
    import hashlib

    import pyarrow as pa

    spark, kind = heads.sparkSession, heads.schema["conv_id"].dataType.simpleString()
    mixed = heads.withColumns({"ord": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}).unionByName(rows.select("conv_id", "ord", "role", "text"), allowMissingColumns=True)
    dealt = mixed.select("conv_id", "ord", "role", "text", "audit", *HEAD).repartition(shuffle_parts(spark), "conv_id").sortWithinPartitions("conv_id", "ord")
    small_batches(spark)

    def run(batches):
        head, audit, at, last, hashed = None, "", 0, None, None

        def put(role: str, text: str) -> None:
            nonlocal last, hashed
            line = f"{role}:{text}" if hashed is None else f"\n{role}:{text}"
            hashed = hashed or hashlib.sha256()
            hashed.update(line.encode("utf-8", "surrogatepass"))
            last = role[:1]

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("assistant" if last == "u" else "user", "")
                at += 1

        def closed() -> dict:
            inserted()
            return head | {"audit": audit, "repaired_sha256": (hashed or hashlib.sha256()).hexdigest()}

        names, schema = ["conv_id", *HEAD, "audit", "repaired_sha256"], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field("conv_id"), *((c, pa.int64()) for c in HEAD), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for row in batch.to_pylist():
                if row["ord"] < 0:
                    if head is not None:
                        out.append(closed())
                    head, audit, at, last, hashed = {c: row[c] for c in ("conv_id", *HEAD)}, row["audit"], 0, None, None
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(row["role"] if edit == "K" else "assistant" if last == "u" else "user", row["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)
        tidy()

    shape = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in HEAD) + ", audit string, repaired_sha256 string"
    return dealt.mapInArrow(run, shape)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, its faults after the damage, the cost and audit of the cheapest repair and its hash."""
    hold = Scratch(conversations.sparkSession, "dialogue")
    conversations = conversations.select("conv_id", "turn", "role", "text")
    rows = ordered(damaged(conversations), hold)
    parts = pieces(rows, hold)
    best = answered(parts, hold)
    turns = rows.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # the facts of a conversation meet in one grouping, which also takes null ids together
    facts = conversations.select("conv_id").distinct()
    for more in (turns, parts.select("conv_id", "blank", "duplicate", "truncated", "illegal"), best):
        facts = facts.unionByName(more, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in HEAD]
    heads = facts.groupBy("conv_id").agg(*sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return repaired(heads, rows)
