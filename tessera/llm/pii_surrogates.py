"""PII surrogates: keyed, type-consistent, distinct and coreferent.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards
(Luhn), IBANs (mod 97), US social security numbers, and names after a title.
An entity's canonical form (digits of a number, lower-case address or name)
is keyed with HMAC-SHA256 and gives the surrogate's canonical form, which is
written in the format of each mention: digits go to the places of digits,
punctuation and capitals stay, a card keeps its first digit and a valid
check digit, an IBAN its country and valid check digits, a phone number its
country code, an address its top-level domain, a name its script and the
gender of its title. All mentions of an entity, in all documents, get the
same surrogate.

Distinctness is checked over the whole corpus: the distinct entities are
collected as a table, and in rounds every entity whose surrogate another
entity has too (the smallest keeps it), or that is itself an entity of the
corpus, takes its next candidate, until no entity collides. Only the few
that needed a later candidate travel back to the documents that mention them.

Defined cases: null texts stay null; empty texts have no entities; repeated
rows each get their row; of overlapping matches the kind listed first wins,
then the earlier one.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, slices, table

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "person")
MAX_ROUNDS = 50
#: Mentions at most so many are joined by a broadcast; more by a shuffle.
BROADCAST_ROWS = 200_000

#: Titles and the gender they state.
TITLES = {
    "Mr": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Prof": "n",
}
_WORD = r"[^\W\d_a-zа-яα-ωß-öø-ÿ][^\W\d_]+"
PATTERNS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w|[.-]\d)|(?<![\w.+-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\w|[.-]\d)"),
    "ssn": re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?!\w|[.-]\d)"),
    "ip": re.compile(r"(?<![\w.+-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    "phone": re.compile(r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
                        r"|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"),
    "person": re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ]+({_WORD}(?:[ -]{_WORD}){{0,2}})"),
}
_DIGIT = re.compile(r"\d")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def entities(text: str):
    """(start, end, kind, canonical form) of the entities, not overlapping, in order."""
    found = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            found.append((local.start(), domain.end(), "email", text[local.start(): domain.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for kind in ("iban", "card", "ssn", "ip", "phone"):
            for m in PATTERNS[kind].finditer(text):
                canon = re.sub(r"[^A-Z0-9]" if kind == "iban" else r"\D", "", m[0]) if kind != "ip" else m[0]
                if kind == "card" and not (13 <= len(canon) <= 19 and int(canon[-1]) == luhn(canon[:-1])):
                    continue
                if kind == "iban" and iban_check(canon[:2], canon[4:]) != canon[2:4]:
                    continue
                if kind == "phone" and m[0][0] == "+":
                    canon = "+" + canon
                found.append((m.start(), m.end(), kind, canon))
    for m in PATTERNS["person"].finditer(text):
        found.append((m.start(2), m.end(2), "person", TITLES[m[1]] + ":" + m[2].lower()))
    found.sort(key=lambda e: (KINDS.index(e[2]), e[0]))
    out: list = []
    for e in found:
        if all(e[1] <= o[0] or o[1] <= e[0] for o in out):
            out.append(e)
    return sorted(out)


class _Stream:
    """Keyed pseudo-random choices for one entity."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canon}\0{attempt}".encode(), hashlib.sha256).digest()
        self.value, self.n = int.from_bytes(self.seed, "big"), 0

    def pick(self, n: int) -> int:
        if self.value < n << 64:
            self.n += 1
            self.value = int.from_bytes(hashlib.sha512(self.seed + bytes([self.n % 256])).digest(), "big")
        self.value, r = divmod(self.value, n)
        return r


#: Syllables and gendered endings of invented names, by script.
NAMES = {
    "latin": (("al", "be", "co", "da", "el", "fi", "ga", "ha", "jo", "ka", "le", "mi", "no", "or", "pe", "ra", "sa", "to", "ul", "vi"),
              {"m": ("n", "rd", "s", "k"), "f": ("a", "ia", "ne", "lla"), "n": ("r", "l", "en", "in")}),
    "cyrillic": (("ал", "бо", "ви", "га", "да", "ел", "жа", "за", "ив", "ка", "ле", "ми", "но", "ор", "па", "ру"),
                 {"m": ("н", "в", "р", "й"), "f": ("а", "ия", "на", "я"), "n": ("ко", "ых", "их", "о")}),
    "greek": (("αλ", "βα", "γι", "δη", "ελ", "ζω", "θε", "κα", "λε", "μα", "νι", "πε"),
              {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "n": ("ου", "ων", "ις")}),
}


def _script(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate."""
    s = _Stream(key, kind, canon, attempt)
    digits = "0123456789"

    def like(text: str) -> str:
        return "".join(digits[s.pick(10)] if c.isdigit() else chr(97 + s.pick(26)) if c.isalpha() else c for c in text)

    if kind == "email":
        local, _, domain = canon.rpartition("@")
        name, _, top = domain.rpartition(".")
        who = like(local)
        # the domain is an entity of its own: equal domains stay equal
        d = _Stream(key, "domain", domain, 0)
        return who + "@" + "".join(digits[d.pick(10)] if c.isdigit() else chr(97 + d.pick(26)) if c.isalpha() else c for c in name) + "." + top
    if kind == "ip":
        return f"{1 + s.pick(223)}.{s.pick(256)}.{s.pick(256)}.{1 + s.pick(254)}"
    if kind == "card":
        body = canon[0] + like(canon[1:-1])
        return body + str(luhn(body))
    if kind == "iban":
        account = "".join(digits[s.pick(10)] if c.isdigit() else chr(65 + s.pick(26)) for c in canon[4:])
        return canon[:2] + iban_check(canon[:2], account) + account
    if kind == "ssn":
        return f"9{s.pick(100):02d}{s.pick(100):02d}{s.pick(10000):04d}"  # 9xx is never issued
    if kind == "phone":
        keep = 0 if canon[0] != "+" else 2 if canon[1] in "17" else 3
        return canon[:keep] + str(2 + s.pick(8)) + like(canon[keep + 1:])
    gender, _, name = canon.partition(":")
    syllables, endings = NAMES[_script(name)]
    words = ["".join(syllables[s.pick(len(syllables))] for _ in range(2 + s.pick(2))) + endings[gender][s.pick(len(endings[gender]))]
             for _ in re.split(r"[ -]", name)]
    return gender + ":" + " ".join(words)


def written(kind: str, mention: str, canon: str) -> str:
    """The surrogate's canonical form in the format of a mention."""
    if kind == "person":
        words, out = iter(canon.partition(":")[2].split(" ")), []
        for part in re.split(r"([ -])", mention):
            if part in (" ", "-"):
                out.append(part)
            else:
                w = next(words)
                out.append(w.upper() if part.isupper() and len(part) > 1 else w.capitalize())
        return "".join(out)
    if kind == "ip":
        return canon
    if kind == "email":
        return "".join(c.upper() if m.isupper() else c for c, m in zip(canon, mention, strict=True))
    marks = iter(canon.lstrip("+"))
    return "".join(next(marks) if c.isalnum() else c for c in mention)


def _mentions():
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows = [(k, *e) for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True) if t
                        for e in {e[2:] for e in entities(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["key", "kind", "canon"])
    return run


def _candidates(key: bytes):
    def run(batches):
        for b in batches:
            got = [surrogate(key, k, c, a) for k, c, a in zip(*(b.column(x).to_pylist() for x in ("kind", "canon", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canon"), b.column("attempt"), pa.array(got, pa.string())],
                                             ["kind", "canon", "attempt", "sur"])
    return run


def assign(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, sur) for the distinct entities ``known`` (kind,
    canon), all ``sur`` distinct by kind and no entity of the corpus."""
    fields = "kind string, canon string, attempt int, sur string"
    held = materialize(known.withColumn("attempt", F.lit(0)).mapInArrow(_candidates(key), fields), "surrogates")
    for _ in range(MAX_ROUNDS):
        twice = held.groupBy("kind", "sur").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("keeps")).where("n > 1")
        lost = held.join(twice, ["kind", "sur"]).where("canon <> keeps").select("kind", "canon")
        taken = held.join(known.select("kind", F.col("canon").alias("sur")), ["kind", "sur"], "left_semi").select("kind", "canon")
        lost = materialize(lost.union(taken).distinct(), "collisions")
        if lost.isEmpty():
            return held
        again = held.join(lost, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        held = materialize(held.join(lost, ["kind", "canon"], "left_anti").union(
            again.select("kind", "canon", "attempt").mapInArrow(_candidates(key), fields)), "surrogates")
    raise RuntimeError("surrogates still collide; the formats leave too few values")


def with_surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = b"corpus") -> DataFrame:
    """``docs`` with the text rewritten and ``n_<kind>`` mentions per kind."""
    text = F.col(text_col).cast("string")
    mark, known = free_name(docs, "_key"), free_name(docs, "_later")
    counted = {k: free_name(docs, f"n_{k}") for k in KINDS}
    keyed = docs.withColumn(mark, F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000")), text), 256))
    said = materialize(keyed.select(F.col(mark).alias("key"), text.alias("text")).mapInArrow(
        _mentions(), "key string, kind string, canon string"), "mentions")
    assigned = assign(said.select("kind", "canon").distinct(), key)
    later = assigned.where("attempt > 0").select("kind", "canon", "attempt")
    extra = materialize(said.join(later, ["kind", "canon"]).groupBy("key").agg(
        F.collect_set(F.struct("kind", "canon", "attempt")).alias(known)).withColumnRenamed("key", mark), "later")
    n = extra.count()
    if n == 0:
        keyed = keyed.withColumn(known, F.lit(None).cast(dict(extra.dtypes)[known]))
    else:
        keyed = keyed.join(F.broadcast(extra) if n <= BROADCAST_ROWS else extra, mark, "left")
    own = docs.columns
    names = [*own, *counted.values()]
    schema = docs.withColumn(text_col, text)
    for k in KINDS:
        schema = schema.withColumn(counted[k], F.lit(0).cast("long"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                out, counts = [], {k: [] for k in KINDS}
                for t, later_ in zip(b.column(text_col).to_pylist(), b.column(known).to_pylist(), strict=True):
                    attempts = {(x["kind"], x["canon"]): x["attempt"] for x in later_ or ()}
                    parts, at, seen = [], 0, dict.fromkeys(KINDS, 0)
                    for s, e, kind, canon in entities(t) if t else ():
                        parts += [t[at:s], written(kind, t[s:e], surrogate(key, kind, canon, attempts.get((kind, canon), 0)))]
                        at = e
                        seen[kind] += 1
                    out.append(t if not parts else "".join(parts) + t[at:])
                    for k in KINDS:
                        counts[k].append(seen[k])
                columns = [pa.array(out, pa.string()) if c == text_col else b.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int64()) for k in KINDS)], names)
    return keyed.withColumn(text_col, text).select(*own, known).mapInArrow(run, schema.schema)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
