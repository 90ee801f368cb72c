"""Personal data replaced by keyed surrogates.

Detected entities are e-mail addresses, telephone, card, social security and long
identity numbers, IBANs, IPv4 addresses, secrets, and names that follow a form of
address.  A surrogate is drawn from a keyed hash of the entity's kind and
canonical value, so one entity has one surrogate wherever and however it is
written, and takes the shape of the original: punctuation, length and case,
check digits, the script of a name and the gender its form of address tells.
Given and family names are mapped each on their own, so ``Ms Ada Long`` and
``Ms Long`` stay the same person, and a name found once is replaced wherever its text
mentions it.  The gender of a given name is the one that most forms of address in all
texts tell, so ``Dr Ada Long`` is the same person too.

Draws may meet.  The distinct values are compared with each other's surrogates
and with all originals; all but one of the values that share a surrogate, and
those whose surrogate is somebody's original, draw again until none is left.  The
pool that a value draws from grows with its attempts, so each finds a surrogate
however crowded the values of its shape are.
Texts are not shuffled: the few values that had to draw again are sent to the
tasks that rewrite the texts, or, where they are many, joined to the documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tapeworks.llm.common import lean, query, store, table

# Forms of address by gender.
MALE = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "г-н", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña", "Signora", "г-жа", "госпожа")
NEUTRAL = ("Dr", "Prof", "Professor")
GENDER = {**dict.fromkeys(MALE, "m"), **dict.fromkeys(FEMALE, "f"), **dict.fromkeys(NEUTRAL, "n")}
#: Consonants and vowels of the scripts names are drawn in.
SCRIPTS = {"LATIN": ("bdfgklmnprstvz", "aeiou"), "CYRILLIC": ("бвгдзклмнпрст", "аеиоу"), "GREEK": ("βγδζκλμνπρστ", "αειου")}

EMAIL = re.compile(r"[A-Za-z0-9](?:[\w.+%-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b")
NUMBER = re.compile(r"(?<![\w.])(?:\+ ?)?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ .()/-]{0,2}\d){6,24}(?![\w])")
QUAD = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)")
SOLID = re.compile(r"(?<![\w.+])\d{13,19}(?!\w)")
PHONE = re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}")
#: Numbers that are no telephone numbers: dates, and decimals without grouping.
DATE = re.compile(r"\d{1,2}([./-])\d{1,2}\1\d{2,4}|\d{4}([./-])\d{1,2}\2\d{1,2}")
DECIMAL = re.compile(r"(?:0|[1-9]\d*)\.\d+")
#: Words before a number in groups that make it a telephone number.
CALLED = re.compile(r"(?i)\b(?:tele?(?:phone|fon|fono|fonnummer)?|phone|cell|mobile?|handy|fax|call|ring|dial|ruf(?:en)?|rufnummer|appele[rz]|tél(?:éphone)?|llam(?:e|ar|a))\b[^\w\n]{0,6}(?:\w{1,6}[^\w\n]{1,3}){0,2}$")
GROUPS = re.compile(r"\d{2,4}(?:[ .-]\d{2,4}){2,4}")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SECRETS = [
    re.compile(r"\b(?:AKIA|ASIA)([A-Z0-9]{16})\b"),
    re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9_+/.~-]{6,200})"),
    re.compile(r"\b(?:ghp_|sk-|xox[abp]-)([A-Za-z0-9-]{16,200})\b"),
]
SECRET_HINTS = ("AKIA", "ASIA", "ghp_", "sk-", "xox", "assw", "ASSW", "pwd", "PWD", "ecret", "ECRET", "oken", "OKEN", "key", "KEY", "Key")
WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_])){1,40}"
NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, GENDER), key=len, reverse=True))})\.? ({WORD}(?: {WORD}){{0,2}})")
KEY = b"tapeworks surrogates"


class Draws:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *what):
        self.key, self.seed, self.block, self.left = key[:64], "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left = hashlib.blake2b(self.seed + b"\0%d" % self.block, key=self.key).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % n

    def like(self, text: str) -> str:
        """Letters and digits replaced by others of their class."""
        out = []
        hexadecimal = len(text) >= 12 and all(c in "0123456789abcdef" for c in text)
        for c in text:
            if hexadecimal:
                out.append("0123456789abcdef"[self.below(16)])
            elif "0" <= c <= "9":
                out.append(str(self.below(10)))
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                out.append(chr(ord("a" if c >= "a" else "A") + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def luhn(digits: str) -> bool:
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 * (d > 9) for d in double)) % 10 == 0


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _script(word: str) -> str | None:
    name = unicodedata.name(word[0], "")
    return next((s for s in SCRIPTS if name.startswith(s)), None)


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names behind a form of address, and every later or earlier mention of them in the text."""
    called: list[tuple[str, str, bool]] = []
    for m in NAME.finditer(text):
        words = m[2].split()
        words = words[: next((i for i, w in enumerate(words) if not w[0].isupper() or not _script(w)), len(words))]
        called += [(w, GENDER[m[1]], i < len(words) - 1) for i, w in enumerate(words)]
    kinds: dict[str, str] = {}
    for w, gender, given in called:  # a name that is a given one once is one; the first telling gender counts
        if given and kinds.get(w.casefold(), "given_n") == "given_n":
            kinds[w.casefold()] = f"given_{gender}"
    for w, _, _ in called:
        kinds.setdefault(w.casefold(), "family")
    if not kinds:
        return []
    forms = {x for w, _, _ in called for x in (w, w.upper())}
    mention = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, forms), key=len, reverse=True))})(?!\w)")
    return [(m.start(), m.end(), kinds[m[0].casefold()], m[0].casefold()) for m in mention.finditer(text)]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text as (start, end, kind, canonical value), in order and disjoint."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if any(h in text for h in SECRET_HINTS):
        for pattern in SECRETS:
            # one separator over and over is a blank to fill in or a masked value
            found += [(m.start(1), m.end(1), "secret", m[1]) for m in pattern.finditer(text) if m[1][0].isalnum() or len(set(m[1])) > 1]
    rest = text  # with what is found blanked out, so that neighbours do not run together
    for m in QUAD.finditer(text):
        if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m[0].split(".")):
            found.append((m.start(), m.end(), "ip", m[0]))
    for m in SOLID.finditer(text):
        found.append((m.start(), m.end(), "card" if luhn(m[0]) else "number", m[0]))
    for start, stop, _, _ in found:
        rest = rest[:start] + "_" * (stop - start) + rest[stop:]
    for m in NUMBER.finditer(rest):
        digits = re.sub(r"\D", "", m[0])
        if SSN.fullmatch(m[0]):
            kind = "ssn"
        elif m[0][0] != "+" and 13 <= len(digits) <= 19 and luhn(digits):
            kind = "card"
        elif DATE.fullmatch(m[0]) or DECIMAL.fullmatch(m[0]):
            continue
        elif m[0][0] in "+(" or m[0][0] == "0" or PHONE.search(m[0]):
            kind = "phone"
        elif GROUPS.fullmatch(m[0]) and CALLED.search(rest[max(0, m.start() - 40) : m.start()]):
            kind = "phone"
        elif len(digits) >= 9 and digits == m[0]:
            kind = "number"
        else:
            continue
        found.append((m.start(), m.end(), kind, ("+" if m[0][0] == "+" else "") + digits))
    for m in IBAN.finditer(text):
        if _iban_rest(m[0].replace(" ", "")) == 1:
            found.append((m.start(), m.end(), "iban", m[0].replace(" ", "")))
    if any(t in text for t in GENDER):
        found += _names(text)
    rank = {"email": 0, "secret": 1, "iban": 2, "ip": 3, "card": 4}
    taken: list[tuple[int, int, str, str]] = []
    for e in sorted(found, key=lambda e: (e[0], rank.get(e[2], 5), -e[1])):
        while taken and rank.get(e[2], 5) < rank.get(taken[-1][2], 5) and e[0] < taken[-1][1]:
            taken.pop()
        if not taken or e[0] >= taken[-1][1]:
            taken.append(e)
    return taken


def draw(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a canonical value; every eighth attempt widens the pool, for most kinds by a digit."""
    d, wider = Draws(key, kind, value, attempt), attempt // 8

    def digits(n: int) -> str:
        return "".join(str(d.below(10)) for _ in range(n))

    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{d.like(local)}{digits(wider)}@{Draws(key, 'domain', domain).like(host)}.{top}"
    if kind == "secret":
        return d.like(value if any(c.isalnum() for c in value) else "a" * len(value)) + digits(wider)
    if kind == "ip" and wider:
        return ".".join(str(d.below(256)) for _ in range(4))
    if kind == "ip":
        low = {1: (1, 9), 2: (10, 90), 3: (100, 156)}
        return ".".join(str(low[len(x)][0] + d.below(low[len(x)][1])) for x in value.split("."))
    if kind == "iban":
        body = value[:2] + "00" + "".join(str(d.below(10)) if c.isdigit() else chr(65 + d.below(26)) for c in value[4:]) + digits(wider)
        return f"{value[:2]}{98 - _iban_rest(body):02d}{body[4:]}"
    if kind == "card":
        body = value[0] + digits(len(value) - 2 + wider)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind in ("phone", "number", "ssn"):
        if kind == "ssn":  # nine digits as long as there are any left
            kept, wider = "" if wider else re.match("0{0,2}", value)[0], wider // 8
        else:
            kept = re.match(r"\+1|\+\d\d|0{0,2}", value)[0]
        return kept + str(1 + d.below(9)) + digits(len(value) - len(kept) - 1 + wider)
    consonants, vowels = SCRIPTS[_script(value)]
    syllables = max(2, min(4, len(value) // 2)) + wider
    name = "".join(consonants[d.below(len(consonants))] + vowels[d.below(len(vowels))] for _ in range(syllables))
    if kind == "given_f":
        return name[:-1] + vowels[0]
    return name + consonants[d.below(len(consonants))] if kind == "given_m" else name


def dress(raw: str, drawn: str) -> str:
    """A canonical surrogate in the format of the original."""
    if drawn.lstrip("+").isdigit():
        digits = iter(drawn.lstrip("+"))
        return "".join([*(next(digits) if c.isdigit() else c for c in raw), *digits])
    if " " in raw:  # an IBAN in groups
        plain = iter(drawn)
        return "".join([*(c if c == " " else next(plain) for c in raw), *plain])
    if len(raw) == len(drawn):
        return "".join(y.upper() if x.isupper() else y for x, y in zip(raw, drawn))
    return drawn.upper() if raw.isupper() else drawn[0].upper() + drawn[1:] if raw[0].isupper() else drawn


def entities(docs: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys``, kind and value of every entity of every text."""
    keys = keys or []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, values = [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1)):
                for _, _, kind, value in find(t.as_py() or ""):
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(kinds, pa.string()), pa.array(values, pa.string())], [*b.schema.names[:-1], "kind", "value"])

    given = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    return given.mapInArrow(lean(rows), StructType([*given.schema.fields[:-1], StructField("kind", StringType()), StructField("value", StringType())]))


def with_gender(found: DataFrame) -> DataFrame:
    """``kind, value, as_kind`` of counted entities: a given name takes the gender that most texts tell, if any does."""
    told = found.where(F.col("kind").isin("given_f", "given_m"))
    most = told.groupBy("value").agg(F.max_by("kind", F.struct("count", "kind")).alias("most"))
    given = F.col("kind").startswith("given_")
    return found.join(most, "value", "left").select("kind", "value", F.when(given, F.coalesce("most", "kind")).otherwise(F.col("kind")).alias("as_kind"))


def settled(values: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind``, ``value``, ``attempt`` and ``drawn`` of distinct values; no two values of a kind share ``drawn``, and none is a value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [draw(k, v, n, key) for k, v, n in zip(*[c.to_pylist() for c in b.columns])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.string())], ["kind", "value", "attempt", "drawn"])

    def drawing(df: DataFrame) -> DataFrame:
        return df.select("kind", "value", "attempt").mapInArrow(lean(rows), "kind string, value string, attempt int, drawn string")

    known = values.select("kind", F.col("value").alias("drawn"), F.lit(True).alias("real"))
    now = store(drawing(values.withColumn("attempt", F.lit(0))), "drawn")
    while True:
        first = F.min(F.struct("attempt", F.xxhash64("value").alias("h"), "value"))
        winners = now.groupBy("kind", "drawn").agg(first.alias("w"), F.count(F.lit(1)).alias("n"))
        meet = winners.join(known, ["kind", "drawn"], "left").where("n > 1 or real")
        checked = now.join(meet, ["kind", "drawn"], "left").withColumn(
            "again", F.col("n").isNotNull() & (F.col("real").isNotNull() | (F.col("value") != F.col("w.value")))
        )
        checked = store(checked.select("kind", "value", "attempt", "drawn", "again"), "drawn")
        if not checked.where("again").take(1):
            return checked.drop("again")
        redrawn = drawing(checked.where("again").withColumn("attempt", F.col("attempt") + 1))
        now = store(checked.where("not again").drop("again").unionByName(redrawn), "drawn")


def replace_private(docs: DataFrame, text: str = "text", key: bytes = KEY, small: int = 200_000) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``.

    Null and empty texts stay as they are with 0 entities; equal rows stay equal; all
    other columns are kept, but an ``n_entities`` column is replaced.  At most ``small``
    values that drew again, or names that take another gender, are broadcast; more are
    joined to the documents.
    """
    docs = docs.drop("n_entities")
    found = store(with_gender(entities(docs, text).groupBy("kind", "value").count()), "entities")
    values = store(found.select(F.col("as_kind").alias("kind"), "value").distinct(), "values")
    drawn = settled(values, key).where("attempt > 0").select(F.col("kind").alias("as_kind"), "value", "attempt")
    again = found.join(drawn, ["as_kind", "value"], "left").where("attempt > 0 or kind <> as_kind")
    again = store(again.select("kind", "value", "as_kind", F.coalesce("attempt", F.lit(0)).alias("attempt")), "again")
    few = again.count() <= small
    sent = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): (r.as_kind, r.attempt) for r in again.collect()} if few else {})
    given = docs.withColumn("_text", F.col(text).cast("string"))
    if few:
        given = given.withColumn("_again", F.lit(None).cast("array<struct<kind:string,value:string,as_kind:string,attempt:int>>"))
    else:
        own = F.xxhash64(F.col(text))
        rows = entities(docs.where(F.col(text).isNotNull()).withColumn("_h", own), text, ["_h"]).distinct()
        lists = rows.join(again, ["kind", "value"]).groupBy("_h").agg(F.collect_list(F.struct("kind", "value", "as_kind", "attempt")).alias("_again"))
        given = given.withColumn("_h", own).join(lists, "_h", "left").drop("_h")
    names, at = [*docs.columns, "n_entities"], docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[tuple[str, str, int], str] = {}
        for b in batches:
            texts, counts = [], []
            for t, more in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                t = t.as_py()
                spans = find(t) if t else []
                if spans:
                    attempts = {(x["kind"], x["value"]): (x["as_kind"], x["attempt"]) for x in more.as_py() or ()} or sent.value
                    parts, end = [], 0
                    for start, stop, kind, value in spans:
                        as_kind, attempt = attempts.get((kind, value), (kind, 0))
                        name = (as_kind, value, attempt)
                        if name not in drawn:
                            if len(drawn) > 100_000:
                                drawn.clear()
                            drawn[name] = draw(*name, key)
                        parts += [t[end:start], dress(t[start:stop], drawn[name])]
                        end = stop
                    t = "".join([*parts, t[end:]])
                texts.append(t)
                counts.append(len(spans))
            columns = b.columns[: b.num_columns - 2]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names)

    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]
    return given.select(*docs.columns, "_text", "_again").mapInArrow(lean(rewrite), StructType([*fields, StructField("n_entities", LongType())]))


@query("op3_surrogates")
def op3(spark, d):
    return replace_private(table(spark, d, "documents").select("doc_id", "text"))


def replace_stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """Pipeline stage: the documents with surrogates for personal data; ``n_chars`` follows the text."""
    clean = replace_private(docs).drop("n_entities")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
