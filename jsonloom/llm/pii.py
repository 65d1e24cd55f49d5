"""Personal data: detected entities get keyed surrogates of their own type, the same for the same entity everywhere.

An entity is found by pattern and check (Luhn, octets, IBAN remainder), brought to a normal form (an e-mail in lower case, a
phone's digits), and the form's surrogate is drawn with a keyed hash. The surrogate is poured into the shape of the
occurrence: digits stay digits, letters stay letters of their case and script, separators and lengths stay. So
`+1 (269) 555-1234` and `+1-269-555-1234` stay one number, each in its form.

A person's name behind a title is two entities, given name and surname, each with a surrogate of its own: so `Mr. John Smith`,
`Mr. Smith` and `Dr. Smith` keep one surname. The gender of a given name is the title's, else that of a known name. Surrogate
names are made of a list or of syllables, with the endings of their gender and script.

Distinctness is checked over the whole table: of entities that drew one surrogate all but the first draw again, as does one
that drew what is an entity elsewhere in the table, until none is left. Later draws come from larger spaces (more syllables or
digits; after WIDE draws, with a hexadecimal tail), so this ends however many entities there are. Only entities that drew again
are looked up while texts are rewritten: by a broadcast table of at most EXCEPTIONS rows, beyond that by a join on the document.

The key is an argument, else spark.jsonloom.pii.key of the session; without either the session gets a random one, so that
surrogates can't be searched back, but differ from session to session.

Defined results: a null text stays null and has no entities; where entities overlap the first found in KINDS wins; repeated
rows are rewritten alike; texts without entities stay as they are; an empty table gives no rows; a column named as `spans` gives
way to it. A text must fit in one task's memory; entities of a text take time in proportion to their number.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.common import blocks, written

EXCEPTIONS = 200_000
#: Draws after which a surrogate gets a tail out of its format.
WIDE = 24

#: Titles by gender, and given names to draw from by gender and script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Don", "г-н"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "г-жа"), "n": ("Dr", "Prof")}
GIVEN = {
    ("m", "latin"): "Adam Anton Bruno Carl Daniel David Emil Felix Georg Henry Ivan James John Jonas Juan Karl Leo Martin Michael Nils Oscar Paul Peter Pierre Ralph Robert Simon Thomas William".split(),
    ("f", "latin"): "Alice Anna Berta Clara Diana Elizabeth Emma Flora Greta Helen Irene Jane Julia Karin Laura Marie Maria Mary Nora Olga Patricia Paula Rosa Sarah Sofia Susan Teresa".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София".split(),
}
#: What made names consist of: consonants, vowels, endings of surnames by gender and of given names by gender.
SOUNDS = {"latin": ("bdfghklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}
SURNAMES = {("n", "latin"): ("son", "ner", "man", "ley", "berg", "dez", "er", "ov"), ("m", "cyrillic"): ("ов", "ин", "ский"), ("f", "cyrillic"): ("ова", "ина", "ская"), ("n", "cyrillic"): ("енко", "ук")}
ENDS = {("m", "latin"): "nrsk", ("f", "latin"): "a", ("m", "cyrillic"): "нрс", ("f", "cyrillic"): "а"}
LUHN_TWICE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    return sum(LUHN_TWICE[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _card(m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    return digits if 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits) else None


def _address(m: re.Match) -> str | None:
    return m[0] if all(int(x) < 256 for x in m[0].split(".")) else None


def _phone(m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    return digits if 8 <= len(digits) <= 15 else None


def _iban(m: re.Match) -> str | None:
    code = m[0].replace(" ", "")
    return code if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def _name(m: re.Match) -> str | None:
    return m["name"] if all(x[0].isupper() for x in m["name"].split(" ")) else None


def gender(title: str) -> str:
    return next((g for g, titles in TITLES.items() if title.rstrip(".") in titles), "n")


def script(text: str) -> str:
    """The script of a name that names can be made in, else `other`."""
    return "cyrillic" if all("Ѐ" <= c <= "ӿ" for c in text if c.isalpha()) else "latin" if all(c < "ɐ" for c in text if c.isalpha()) else "other"


def persons(title: str, name: str, at: int) -> list[tuple[int, int, str, str]]:
    """The entities of a name behind a title: given name, if there is one, and surname."""
    *given, last = name.split(" ")
    out = [(at + len(name) - len(last), at + len(name), "surname", last)]
    if given:
        sex = gender(title)
        if sex == "n":
            sex = next((g for (g, _), names in GIVEN.items() if given[0] in names), "n")
        out.insert(0, (at, at + len(given[0]), "given", f"{sex} {given[0]}"))
    return out


_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: (kind, bytes that a text must hold, pattern, normal form or None if it is no entity, the group that is replaced).
KINDS = [
    ("email", "@", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), lambda m: m[0].lower(), 0),
    ("secret", "", re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9+/_.-]{8,})"), lambda m: m[1], 1),
    ("access key", "A", re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"), lambda m: m[0], 0),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban, 0),
    ("card", "", re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"), _card, 0),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), lambda m: m[0].replace("-", ""), 0),
    ("address", ".", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), _address, 0),
    ("phone", "", re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d)"), _phone, 0),
    ("name", "", re.compile(rf"\b(?P<title>{_TITLE})\b\.? (?P<name>[^\W\d_a-zа-я][^\W\d_]+(?: [^\W\d_a-zа-я][^\W\d_]+)?)"), _name, "name"),
]
_DIGIT, _TITLED, _ASSIGNED = re.compile(r"\d"), re.compile(rf"\b(?:{_TITLE})\b\.? "), re.compile("[=:]")
_NEEDS = {"iban": _DIGIT, "card": _DIGIT, "ssn": _DIGIT, "address": _DIGIT, "phone": _DIGIT, "secret": _ASSIGNED}


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order."""
    found: list[tuple[int, int, str, str]] = []
    for kind, mark, pattern, normal, group in KINDS:
        if mark not in text or (kind in _NEEDS and not _NEEDS[kind].search(text)):
            continue
        # matches come in order and don't overlap, and so do those found before: one step through both
        at, new = 0, []
        for m in pattern.finditer(text):
            start, end = m.span(group)
            while at < len(found) and found[at][1] <= start:
                at += 1
            if (at == len(found) or found[at][0] >= end) and (form := normal(m)) is not None:
                new += persons(m["title"], form, start) if kind == "name" else [(start, end, kind, form)]
        found = sorted(found + new)
    return found


class Draw:
    """An endless supply of keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.seed, self.count, self.left = f"{kind}\n{attempt}\n{form}".encode(), 0, b""
        self.key = hashlib.blake2b(key).digest()

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.count.to_bytes(4), key=self.key).digest()
            self.count += 1
        value, self.left = int.from_bytes(self.left[:4]), self.left[4:]
        return value * n >> 32


def _letters(text: str, draw: Draw, low: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """The same shape: digits for digits, letters for letters of their case and script."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            if c < "ɐ":
                new = low[draw.below(len(low))]
                out.append(new.upper() if c.isupper() else new)
            else:
                # of the 32 code points around it, the letters of its case
                near = [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x.isalpha() and x.isupper() == c.isupper()]
                out.append(near[draw.below(len(near))])
        else:
            out.append(c)
    return "".join(out)


def _made(draw: Draw, sounds: str, syllables: int, end: str) -> str:
    hard, soft = SOUNDS[sounds]
    return ("".join(hard[draw.below(len(hard))] + soft[draw.below(len(soft))] for _ in range(syllables)) + end).capitalize()


def _surname(form: str, draw: Draw, attempt: int) -> str:
    kind = script(form)
    if kind == "other":
        return _letters(form + form[-1] * (attempt // 2), draw)
    sex = "n"
    if kind == "cyrillic":
        sex = "f" if form.endswith(("ова", "ева", "ина", "ая")) else "m" if form.endswith(("ов", "ев", "ин", "ий", "ой")) else "n"
    ends = SURNAMES[sex, kind]
    return _made(draw, kind, max(2, min(4, len(form) // 2 - 1)) + attempt // 2, ends[draw.below(len(ends))])


def _given(form: str, draw: Draw, attempt: int) -> str:
    sex, name = form.split(" ", 1)
    kind = script(name)
    if kind == "other":
        return _letters(name + name[-1] * (attempt // 2), draw)
    sex = "mf"[draw.below(2)] if sex == "n" else sex
    if attempt < 2:
        names = GIVEN[sex, kind]
        return names[draw.below(len(names))]
    ends = ENDS[sex, kind]
    return _made(draw, kind, 2 + attempt // 2, ends[draw.below(len(ends))])


def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The normal form of an entity's surrogate."""
    draw = Draw(key, kind, form, attempt)
    new = _surrogate(kind, form, draw, attempt)
    return new + _letters("a" * (attempt - WIDE + 8), draw, "abcdef") if attempt >= WIDE else new


def _surrogate(kind: str, form: str, draw: Draw, attempt: int) -> str:
    if kind == "email":
        local, _, _ = form.partition("@")
        return f"{_letters(local + 'a' * (attempt // 2), draw)}@{_letters('aaaaaa', draw)}.example.org"
    if kind == "secret":
        hexadecimal = not re.search("[^0-9a-fA-F]", form)
        return _letters(form, draw, "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz")
    if kind == "access key":
        return form[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in form[4:])
    if kind == "iban":
        rest = _letters(form[4:], draw)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + form[:2] + "00")) % 97
        return f"{form[:2]}{check:02d}{rest}"
    if kind == "card":
        head = form[0] + _letters(form[1:-1], draw)
        return next(head + d for d in "0123456789" if luhn(head + d))
    if kind == "address":
        return ".".join(str(draw.below(n)) for n in (223, 256, 256, 254))
    if kind == "phone":
        # the country's part and the first digit stay
        keep = max(1, len(form) - 10)
        return form[:keep] + _letters(form[keep:], draw)
    if kind == "surname":
        return _surname(form, draw, attempt)
    if kind == "given":
        return _given(form, draw, attempt)
    return _letters(form, draw)


def poured(new: str, kind: str, occurrence: str) -> str:
    """A surrogate in the shape of an occurrence: its separators, and its letter case where the normal form drops it."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in occurrence) + "".join(left)
    return new.upper() if kind == "email" and occurrence.isupper() else new


def rewritten(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, length) of each in it."""
    out, at, spans, length = [], 0, [], 0
    for start, end, kind, form in entities(text):
        new = poured(surrogate(kind, form, key, attempts.get((kind, form), 0)), kind, text[start:end])
        out += [text[at:start], new]
        length += start - at
        spans.append((kind, length, len(new)))
        length += len(new)
        at = end
    return "".join([*out, text[at:]]) if out else text, spans


ENTITY = "kind string, form string"


def entity_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities (kind, form) of all texts."""

    def find(batches):
        for rows in blocks(batches):
            found = sorted({(k, f) for t in rows.column("text").to_pylist() if t for _, _, k, f in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], names=["kind", "form"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(find, ENTITY).distinct()


def key_of(spark: SparkSession) -> bytes:
    """The session's key, a random one if none has been set."""
    key = spark.conf.get("spark.jsonloom.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.jsonloom.pii.key", key)
    return key.encode()


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt) of the entities that had to draw again; `found` is read often and must be a written table."""

    def draw(batches):
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("form").to_pylist(), batch.column("attempt").to_pylist(), strict=True)
            # a given name's gender is no part of what is replaced
            yield batch.append_column("new", pa.array([surrogate(k, f, key, a) for k, f, a in rows], pa.string()))

    drawn = f"{ENTITY}, attempt int, new string"
    first = written(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, drawn), "surrogates")
    again = first.limit(0)
    plain = F.when(F.col("kind") == "given", F.substring_index("form", " ", -1)).otherwise(F.col("form"))
    real = found.select("kind", plain.alias("new"), F.lit(True).alias("real")).distinct()
    while True:
        now = first.join(again.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again)
        # who keeps a surrogate: the smallest of those that drew it, unless it is real
        keeps = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "form")).alias("m"), F.count(F.lit(1)).alias("n")).join(real, ["kind", "new"], "left").where("n > 1 or real")
        clash = written(now.join(keeps, ["kind", "new"]).where("real or form <> m.form").select("kind", "form", "attempt"), "clashes")
        if clash.isEmpty():
            return again.select("kind", "form", "attempt")
        more = clash.withColumn("attempt", (F.col("attempt") + 1).cast("int")).mapInArrow(draw, drawn)
        # only what has been drawn again is written anew
        again = written(again.join(clash.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(more), "again")


SPANS = "array<struct<kind:string,start:int,length:int>>"


def anonymised(docs: DataFrame, text: str = "text", key: bytes | None = None, spans: str | None = None, limit: int = EXCEPTIONS) -> DataFrame:
    """docs with surrogates in the text column; in the column `spans`, if named, what they are and where they now stand."""
    key = key or key_of(docs.sparkSession)
    docs = docs.drop(spans) if spans else docs
    found = written(entity_table(docs, text), "entities")
    again = exceptions(found, key)
    schema = type(docs.schema)([*docs.schema.fields])
    few = again.limit(limit + 1).collect()
    many = len(few) > limit
    known = docs.sparkSession.sparkContext.broadcast({} if many else {(r.kind, r.form): r.attempt for r in few})
    if many:
        docs = _with_attempts(docs, text, again)
    extra = [f for f in docs.schema.fieldNames() if f not in schema.fieldNames()]

    def rewrite(batches):
        for rows in blocks(batches, text):
            attempts = [{(x["kind"], x["form"]): x["attempt"] for x in own or ()} for own in rows.column(extra[0]).to_pylist()] if extra else [known.value] * len(rows)
            made = [rewritten(t, key, a) if t else (t, []) for t, a in zip(rows.column(text).to_pylist(), attempts, strict=True)]
            out = rows.drop_columns(extra)
            at = out.schema.get_field_index(text)
            out = out.set_column(at, text, pa.array([t for t, _ in made], pa.string()))
            if spans:
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
                out = out.append_column(spans, pa.array([[{"kind": k, "start": s, "length": n} for k, s, n in own] for _, own in made], kind))
            yield from out.combine_chunks().to_batches()

    result = type(schema)([*schema.fields])
    if spans:
        result = result.add(spans, docs.sparkSession.createDataFrame([], f"x {SPANS}").schema["x"].dataType)
    return docs.mapInArrow(rewrite, result)


def _with_attempts(docs: DataFrame, text: str, again: DataFrame) -> DataFrame:
    """docs and a column of each text's own exceptions; texts are joined by their hash, so equal texts share a row."""

    def find(batches):
        for batch in batches:
            for rows in blocks(iter([batch])):
                hits = [(h, k, f) for h, t in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist(), strict=True) if t for k, f in {(k, f) for _, _, k, f in entities(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in hits], pa.string()) for i in range(3)], names=["key", "kind", "form"])

    key, own = "__pii_key", "__pii_again"
    keyed = docs.withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    uses = keyed.select(F.col(key).alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(find, f"key string, {ENTITY}").distinct()
    mine = uses.join(again, ["kind", "form"]).groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(own))
    return keyed.join(mine, key, "left").drop(key)


# ---- query ----


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, the number of entities, their kinds, and the rewritten text."""
    done = anonymised(documents.select("doc_id", "text"), spans="entities")
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"), "text")
