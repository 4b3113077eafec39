"""Operator 1: surrogate generation for personal data.

Entities are found by patterns: e-mail addresses, telephone numbers, IPv4 addresses, card numbers,
social security numbers, secrets behind a ``token/key/secret/password =``, listed first names wherever they stand
capitalised, and capitalised surnames behind a title or a listed name.  Each is
replaced by a *keyed* surrogate of its own type and format:

* digits and letters go through keyed permutations of the entity's own space (separators, length and letter case stay);
* a telephone number keeps its country code, which its digits alone decide, however they are separated;
* a card number keeps whether its check digit is right;
* an e-mail address keeps its shape: every letter run and digit run of the local part and of the
  domain's labels is permuted within its length and alphabet, the public suffix stays;
* a name becomes another name of the same gender and script by a keyed permutation of that list;
  the case is kept.  Surnames, and names behind a title but in no list, are permuted letter by letter,
  and past the listed names.

A permutation maps distinct originals to distinct surrogates and one original to one surrogate
everywhere, and no original to itself: it is a keyed Feistel network, then a keyed shift, then the network backwards.  So distinctness and
coreference hold across the corpus without a shared table.
``surrogates`` checks it on the data: a surrogate that is an original of the corpus, or that another entity has already, is drawn again
from the next of a row of permutations, until none is left; a mention still open after ``turns`` draws is an error.  ``collisions`` lists
surrogates that stand for two entities.

Names are only as good as their lists (``NAMES``, a parameter of the module): unlisted names without a title and inflected
forms are not found.

Defined cases: a null text stays null and has no entities; overlapping matches go to the earlier
start, then the longer; null ids and repeated rows are like any others and give equal results; an empty table gives an empty table;
all other columns are kept as they are, but those named ``n_entities`` and ``n_distinct`` are replaced.  A very long text is searched as a whole, in
time and memory in proportion to its length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, one_by_one, tidy

#: Common first names by gender and script, for recognition and replacement.
NAMES = {
    ("female", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy Angela Shirley Anna Brenda Emma Pamela Nicole Helen Samantha Katherine Christine Debra Rachel Carolyn Janet Catherine Maria Heather Diane Olivia Julie Joyce Victoria Ruth Virginia Lauren Kelly Christina Joan Evelyn Judith Andrea Hannah Megan Cheryl Jacqueline Martha Claudia Sabine Petra Ursula Monique Isabelle Sophie Camille".split(),
    ("male", "latin"): "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Andrew Paul Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Henry Zachary Douglas Peter Kyle Noah Ethan Jeremy Walter Keith Stefan Hans Klaus Jürgen Pierre François Luc Antoine".split(),
    ("female", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Алина Ксения Полина Людмила Галина Марина Валентина".split(),
    ("male", "cyrillic"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел Максим Артём Егор Никита Роман Виктор Игорь Константин".split(),
}
LISTED = {n.lower(): (group, k) for group, names in NAMES.items() for k, n in enumerate(names)}
KINDS = ("email", "secret", "phone", "ip", "card", "ssn", "name", "surname")
UPPER, SMALL = "[A-ZÀ-ÖØ-ÞА-ЯЁ]", "[a-zß-öø-ÿа-яё]"
#: A capitalised word, as Smith, O'Brien, McDonald or Jones-Lee.
CAPITAL = rf"{UPPER}(?:{SMALL}+|['’]{UPPER}{SMALL}+)(?:['’-]?{UPPER}{SMALL}+)*\b"
FAMILY = rf"(?: {UPPER}\.)? (?P<last%d>{CAPITAL})(?: (?P<more%d>{CAPITAL}))?"
#: Country codes of one and two digits in the international numbering plan; all others have three.
CODES = re.compile("[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|...")
#: The listed names by their first letter, so that other words are passed over quickly.
FIRST = "(?:" + "|".join(f"{c}(?:{'|'.join(sorted((n[1:] for names in NAMES.values() for n in names if n[0] == c), reverse=True))})" for c in sorted({n[0] for names in NAMES.values() for n in names})) + ")"
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9À-ÖØ-öø-ÿ][\w.+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?i:\b(?:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_+/\-]{16,})"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\w.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<card>(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d))"
    r"|(?P<ssn>(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))"
    rf"|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? (?P<titled>{CAPITAL})(?:{FAMILY % (1, 1)})?"
    rf"|\b(?P<first>{FIRST})\b(?:{FAMILY % (2, 2)})?"
)
#: Texts without these have none of the patterned entities.
HINT = re.compile(r"[@\d]|(?:M[rs]|Mrs|Dr|Herr|Frau|Mme|Sra?)\.? [A-ZÀ-ÖØ-ÞА-Я]|[=:]\s*[\"']?[A-Za-z0-9_+/\-]{16}|\b" + FIRST + r"\b")


class Keyed:
    """Keyed permutations of integers below a bound, by a four-round Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, label: bytes, r: int, value: int, size: int) -> int:
        import hashlib

        raw = hashlib.blake2b(b"%b|%d|%d" % (label, r, value), key=self.key, digest_size=(size.bit_length() + 7) // 8 + 8).digest()
        return int.from_bytes(raw, "little") % size

    def _network(self, label: bytes, x: int, half: int, back: bool) -> int:
        a, b = divmod(x, half)
        for r in (3, 2, 1, 0) if back else range(4):
            a, b = ((b - self._round(label, r, a, half)) % half, a) if back else (b, (a + self._round(label, r, b, half)) % half)
        return a * half + b

    def permute(self, label: bytes, x: int, bound: int) -> int:
        """The image of ``x`` below ``bound``: one to one for a label and bound, and never ``x`` itself (a bound of 1 has no other)."""
        if bound < 2:
            return x
        half = math.isqrt(bound - 1) + 1

        def walk(y: int, back: bool) -> int:
            while (y := self._network(label, y, half, back)) >= bound:
                pass
            return y

        shift = 1 + self._round(label + b"|shift", 0, bound, bound - 1)
        return walk((walk(x, False) + shift) % bound, True)

    def run(self, label: bytes, text: str, alphabet: str) -> str:
        base, x = len(alphabet), 0
        for c in text:
            x = x * base + alphabet.index(c)
        x, out = self.permute(label + b"|%d" % len(text), x, base ** len(text)), []
        for _ in text:
            x, d = divmod(x, base)
            out.append(alphabet[d])
        return "".join(reversed(out))


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def shaped(keyed: Keyed, label: bytes, text: str) -> str:
    """Digits to digits and letters to letters of the same script and case, all runs of a class permuted as one number."""
    out = list(text)
    for name, alphabet in ((b"d", DIGITS), (b"l", LOWER), (b"c", CYRILLIC)):
        at = [k for k, c in enumerate(text) if c.lower() in alphabet and len(c.lower()) == 1]
        if at:
            new = keyed.run(label + b"|" + name + b"|" + str(len(at)).encode(), "".join(text[k].lower() for k in at), alphabet)
            for k, c in zip(at, new):
                out[k] = c.upper() if text[k].isupper() else c
    return "".join(out)


def filled(text: str, digits: str) -> str:
    """The text with its digits replaced one by one."""
    new = iter(digits)
    return re.sub(r"\d", lambda _: next(new), text)


def check_digit(digits: str) -> int:
    """What the last digit of a card number must be (doubling every second digit from the right)."""
    total = sum(d if k % 2 else d // 5 + 2 * d % 10 for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity: case and separators aside."""
    return re.sub(r"\D", "", text) if kind in ("phone", "card", "ssn") else text if kind == "secret" else text.lower()


#: Draws in an entity's own length; each one after makes a name, local part or secret a letter longer, for short ones may all be taken.
ROOMY = 3


def surrogate(keyed: Keyed, kind: str, text: str, turn: int = 0) -> str:
    """The replacement of one mention.  ``turn``: which of the row of permutations."""
    label = (b"%d|" % turn if turn else b"") + kind.encode()
    if turn > ROOMY and kind in ("email", "surname", "secret"):
        local, at, domain = text.partition("@") if kind == "email" else (text, "", "")
        text = local + ("а" if local[-1:].lower() in CYRILLIC else "a") * (turn - ROOMY) + at + domain
    if kind == "email":
        local, _, domain = text.rpartition("@")
        head, _, suffix = domain.rpartition(".")
        return f"{shaped(keyed, label + b'-local', local)}@{shaped(keyed, label + b'-domain', head)}.{suffix}"
    if kind == "ip":
        parts = text.split(".")
        if all(len(p) <= 3 and int(p) < 256 for p in parts):
            x = 0
            for p in parts:
                x = x * 256 + int(p)
            x = keyed.permute(label, x, 1 << 32)
            return ".".join(str((x >> s) & 255) for s in (24, 16, 8, 0))
        return shaped(keyed, label, text)
    if kind == "phone" and text.startswith("+"):
        digits = re.sub(r"\D", "", text)
        code = CODES.match(digits)[0]
        return filled(text, code + keyed.run(label + code.encode(), digits[len(code) :], DIGITS))
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        off = (int(digits[-1]) - check_digit(digits[:-1])) % 10
        head = keyed.run(label, digits[:-1], DIGITS)
        return filled(text, head + str((check_digit(head) + off) % 10))
    if kind == "name" and text.lower() in LISTED:
        group, k = LISTED[text.lower()]
        new = NAMES[group][keyed.permute(label + repr(group).encode(), k, len(NAMES[group]))]
        return new.upper() if text.isupper() else new.lower() if text.islower() else new
    if kind == "surname":
        # Walks past the listed names: a surname never takes the surrogate of a first name.
        while (text := shaped(keyed, label, text)).lower() in LISTED:
            pass
        return text
    if kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
        new = keyed.run(label + b"-hex", text.lower(), DIGITS + LOWER[:6])
        return new.upper() if text != text.lower() else new
    return shaped(keyed, label, text)


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and without overlap."""
    if not text or not HINT.search(text):
        return []
    found = []
    for m in PATTERN.finditer(text):
        if m.lastgroup in KINDS:
            found.append((*m.span(m.lastgroup), m.lastgroup))
        else:
            words = [k for k, w in m.groupdict().items() if w]
            found += [(*m.span(k), "name" if m[k].lower() in LISTED else "surname") for k in words]
    return found


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, canonical form and number of mentions."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, t in zip(batch.column("k").to_pylist(), one_by_one(batch.column("t"))):
                found = Counter((kind, canonical(kind, t[a:b]), t[a:b]) for a, b, kind in mentions(t))
                rows += [(k, *name, n) for name, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["doc_id", "kind", "canonical", "mention", "n"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, kind string, canonical string, mention string, n long")


def surrogates(docs: DataFrame, secret_key: bytes, key: str = "doc_id", text: str = "text", hold: Scratch | None = None, turns: int = 64) -> DataFrame:
    """kind, canonical, mention, surrogate, canonical_s, turn: one row for each distinct mention.

    No surrogate is an original of the corpus (names apart: their lists are closed under the permutation), and no two entities
    have the same one.  All mentions of an entity are drawn in the same turn, as their canonical forms decide.
    """
    hold = hold or Scratch(docs.sparkSession, "pii")
    left = hold.keep(entities(docs, key, text).select("kind", "canonical", "mention").distinct(), "mentions")
    taken = left.filter("kind <> 'name'").select("kind", F.col("canonical").alias("canonical_s")).distinct()
    done = None

    def drawn(turn: int):
        def step(batches):
            import pyarrow as pa

            keyed = Keyed(secret_key)
            for batch in batches:
                kinds = batch.column("kind").to_pylist()
                made = [surrogate(keyed, kind, m, turn) for kind, m in zip(kinds, batch.column("mention").to_pylist())]
                forms = [canonical(kind, m) for kind, m in zip(kinds, made)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canonical"), batch.column("mention"), pa.array(made, pa.string()), pa.array(forms, pa.string()), pa.array([turn] * len(made), pa.int32())], names=["kind", "canonical", "mention", "surrogate", "canonical_s", "turn"])
            tidy()

        return step

    for turn in range(turns):
        made = hold.keep(left.mapInArrow(drawn(turn), "kind string, canonical string, mention string, surrogate string, canonical_s string, turn int"), f"turn{turn}")
        free = made.select("kind", "canonical", "canonical_s").filter("kind <> 'name'").join(taken, ["kind", "canonical_s"], "left_anti")
        first = free.groupBy("kind", "canonical_s").agg(F.min("canonical").alias("canonical"))
        ok = made.join(first, ["kind", "canonical_s", "canonical"], "left_semi").unionByName(made.filter("kind = 'name'"))
        ok = hold.keep(ok, f"ok{turn}")
        done = ok if done is None else done.unionByName(ok)
        left = hold.keep(made.select("kind", "canonical", "mention").join(ok, ["kind", "canonical", "mention"], "left_anti"), f"left{turn}")
        if not left.limit(1).count():
            return done
        taken = taken.unionByName(ok.filter("kind <> 'name'").select("kind", "canonical_s"))
    raise ValueError(f"mentions without a free surrogate after {turns} draws: {left.limit(5).collect()}")


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity."""
    return table.groupBy("kind", "canonical_s").agg(F.count_distinct("canonical").alias("entities")).filter("entities > 1")


def pseudonymised(docs: DataFrame, secret_key: bytes, key: str = "doc_id", text: str = "text", walk_rows: int = 200_000) -> DataFrame:
    """``docs`` with every entity replaced in ``text``, plus ``n_entities`` and ``n_distinct``.

    The surrogate of a mention is computed where it stands.  Only mentions that had to be drawn again
    (their first surrogate is taken) are looked up: in a broadcast table of up to ``walk_rows`` rows; of more,
    each row gets those of its own text by a join.
    """
    spark = docs.sparkSession
    hold = Scratch(spark, "pii")
    table = surrogates(docs, secret_key, key, text, hold)
    if clash := collisions(table).limit(5).collect():
        raise ValueError(f"surrogates that stand for two entities: {clash}")
    walked = table.filter("turn > 0").select("kind", "mention", "turn")
    few = walked.limit(walk_rows + 1).count() <= walk_rows
    more = spark.sparkContext.broadcast({(r["kind"], r["mention"]): r["turn"] for r in walked.collect()} if few else {})
    if few:
        hold.drop(*hold.paths)
    rows = docs.drop("n_entities", "n_distinct").withColumn(text, F.col(text).cast("string"))
    names = rows.columns
    if few:
        rows = rows.withColumn("_walked", F.lit(None).cast("array<struct<kind:string,mention:string,turn:int>>"))
    else:
        found = entities(docs, key, text).select("doc_id", "kind", "mention").distinct().join(walked, ["kind", "mention"])
        mine = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("kind", "mention", "turn")).alias("_walked"))
        rows = rows.join(mine, F.col(key).cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")

    def run(batches):
        import pyarrow as pa

        keyed, known = Keyed(secret_key), {}
        for batch in batches:
            texts, count, distinct = [], [], []
            for t, own in zip(one_by_one(batch.column(text)), one_by_one(batch.column("_walked"))):
                found = mentions(t)
                own = {(w["kind"], w["mention"]): w["turn"] for w in own or ()}
                parts, at = [], 0
                for a, b, kind in found:
                    name = kind, t[a:b]
                    turn = own.get(name) or more.value.get(name, 0)
                    if (name, turn) not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[name, turn] = surrogate(keyed, *name, turn)
                    parts += [t[at:a], known[name, turn]]
                    at = b
                texts.append("".join([*parts, t[at:]]) if found else t)
                count.append(len(found))
                distinct.append(len({(kind, canonical(kind, t[a:b])) for a, b, kind in found}))
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(distinct, pa.int64())], names=[*names, "n_entities", "n_distinct"])
        tidy()

    schema = rows.drop("_walked").withColumns({"n_entities": F.lit(0).cast("long"), "n_distinct": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(run, schema)
