"""Personal data replaced by keyed surrogates of the same kind and form.

An entity is found by pattern and named by its type and normal form (an address in lower case,
the digits of a phone number, a surname alone). Its surrogate is a keyed function of that name,
so all mentions of an entity, in any writing and any document, get the same surrogate. A
surrogate keeps the form: digits for digits, letters for letters of the same case and script,
punctuation as it stands, check digits that hold if they held before, given names of the same
gender and script.

Two entities must not become one, nor may a surrogate be another entity of the corpus. All
distinct entities are checked together: of those that share a surrogate one keeps it, the
others and those that hit an existing entity take their next one, until none is left. Only
these few exceptions travel back to the documents.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.session import cut_lineage

# Given names by script and gender, titles by gender, endings of surnames.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Grace Helen Ida Julia Laura Lena Maria Marta Nora Olga Paula Rosa Sara Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Bruno Carl Daniel David Erik Felix Hugo Ivan James John Lucas Marco Martin Oscar Paul Peter Simon Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Софья Татьяна Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Кирилл Максим Николай Олег Павел Сергей".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Г-жа г-жа".split(),
    "m": "Mr Herr Monsieur Señor Sr Г-н г-н".split(),
    "": "Dr Prof".split(),
}
SYLLABLES = {"latin": "ba da fe ga hol ka len mar nor pel rin sor tam vel win".split(),
             "cyrillic": "ба ва го да за ка ле ми но пе ра со та фи хо".split()}
ENDINGS = {"latin": {"": "berg dal feld mann sen ton".split()},
           "cyrillic": {"m": "ов ин ев".split(), "f": "ова ина ева".split(), "": "енко ко ук".split()}}
SECRET_WORDS = "password passwd pwd secret token api_key apikey access_key".split()

_title_gender = {t: g for g, titles in TITLES.items() for t in titles}
_given = {n: (script, gender) for (script, gender), names in GIVEN.items() for n in names}
_name = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)*"
_alt = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))

#: Patterns in order of precedence; the group ``x`` is the entity.
PATTERNS = [
    ("email", re.compile(r"(?P<x>[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})")),
    ("secret", re.compile(rf"(?i:(?<![A-Za-z])(?:{_alt(SECRET_WORDS)})\s{{0,3}}[=:]\s{{0,3}}[\"']?(?P<x>[A-Za-z0-9+/_\-]{{6,}}))")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<x>AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\d.])(?P<x>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])(?P<x>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![\d.+])(?P<x>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{13,19})(?![\d])")),
    ("ssn", re.compile(r"(?<![\d-])(?P<x>\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?P<x>\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}"
                         r"|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)")),
    ("person", re.compile(rf"(?<!\w)(?P<x>(?:(?:{_alt(_title_gender)})\.? )(?:{_name})(?: {_name})?|(?:{_alt(_given)}) {_name})")),
]
#: For each pattern a sign, or texts, of which a match holds one.
NEEDS = ["@", "=", ["AKIA", "ghp_", "sk-"], "1", "1", "1", "1", "1",
         [x for t in _title_gender for x in (t + " ", t + ". ")] + [n + " " for n in _given]]
_digit = re.compile(r"\d")


def _luhn(digits: str) -> int:
    """Check digit that completes ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _mod97(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", word) else "latin"


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, none overlapping."""
    found: list[tuple[int, int, int, str]] = []
    signs = {"@": "@" in text, "=": "=" in text or ":" in text, "1": _digit.search(text) is not None}
    for rank, (kind, pattern) in enumerate(PATTERNS):
        # what every match of the pattern holds is looked for first, which is much cheaper
        needs = NEEDS[rank]
        if not (signs[needs] if isinstance(needs, str) else any(x in text for x in needs)):
            continue
        for m in pattern.finditer(text):
            found.append((m.start("x"), rank, m.end("x"), kind))
    found.sort()  # by place, then by precedence
    out, done = [], 0
    for start, _, end, kind in found:
        if start < done:
            continue
        done = end
        value = text[start:end]
        if kind == "person":
            out += _person(start, value)
        else:
            out.append((start, end, kind, normal(kind, value)))
    # A surname that the text names with a title or a given name is the same person alone.
    again = {text[a:b]: (kind, name) for a, b, kind, name in out if kind.startswith("surname_")}
    for word, (kind, name) in again.items():
        for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b, _, _ in out):
                out.append((m.start(), m.end(), kind, name))
    return sorted(out)


def _person(start: int, value: str) -> list[tuple[int, int, str, str]]:
    """Given name and surname of a mention as entities of their own; the title stays."""
    out, gender, spots = [], "", [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", value)]
    if spots[0][2].rstrip(".") in _title_gender:
        gender = _title_gender[spots[0][2].rstrip(".")]
        spots = spots[1:]
    for i, (a, b, word) in enumerate(spots):
        if i < len(spots) - 1 or (len(spots) == 1 and word in _given):
            known = _given.get(word, (script_of(word), gender))
            gender = gender or known[1]
            out.append((start + a, start + b, f"given_{known[0]}_{known[1] or gender}", word.lower()))
        else:
            script = script_of(word)
            stem, ending = _stem(word.lower(), script)
            out.append((start + a, start + b, f"surname_{script}", stem if ending else word.lower()))
    return out


def _stem(word: str, script: str) -> tuple[str, str]:
    """Surname without its gendered ending, so both forms of a family name are one entity."""
    if script == "cyrillic":
        for gender in ("f", "m"):
            for e in ENDINGS[script][gender]:
                if word.endswith(e) and len(word) > len(e) + 1:
                    return word[: len(word) - len(e)], e
    return word, ""


def normal(kind: str, value: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


class Keyed:
    """Endless keyed numbers of one entity and attempt."""

    def __init__(self, key: bytes, kind: str, name: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{name}\0{attempt}".encode(), hashlib.sha256).digest()
        self.n, self.pool = 0, b""

    def below(self, m: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % m

    def same_kind(self, text: str) -> str:
        """A digit for a digit, a letter for a letter of its case; hexadecimal stays so."""
        hexa = len(text) > 7 and re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", text) and re.search(r"\d", text)
        out = []
        for c in text:
            if hexa:
                out.append("0123456789abcdef"[self.below(16)])
            elif "0" <= c <= "9":
                out.append(str(self.below(10)))
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                out.append(chr((ord("a") if c >= "a" else ord("A")) + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, name: str, attempt: int) -> str:
    """Normal form of the entity's surrogate."""
    k = Keyed(key, kind, name, attempt)
    if kind == "email":
        local, _, domain = name.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{k.same_kind(local)}@{k.same_kind(host)}.{top}"
    if kind == "ip":
        octets = name.split(".")
        inside = 1 if octets[0] == "10" else 2 if ".".join(octets[:2]) == "192.168" else 0
        return ".".join(octets[:inside] + [str(1 + k.below(254)) for _ in octets[inside:]])
    if kind == "card":
        body = name[0] + k.same_kind(name[1:-1])
        valid = int(name[-1]) == _luhn(name[:-1])
        return body + (str(_luhn(body)) if valid else str(k.below(10)))
    if kind == "iban":
        body = k.same_kind(name[4:])
        if _mod97(name) == 1:
            return name[:2] + f"{98 - _mod97(name[:2] + '00' + body):02d}" + body
        return name[:2] + k.same_kind(name[2:])
    if kind == "phone":
        return name[:1] + k.same_kind(name[1:])
    if kind.startswith("given_"):
        _, script, gender = kind.split("_")
        pool = GIVEN[script, gender or ("f", "m")[k.below(2)]]
        first = pool[k.below(len(pool))].lower()
        return first if attempt < 2 else "-".join([first] + [pool[k.below(len(pool))].lower() for _ in range(1 + attempt // 8)])
    if kind.startswith("surname_"):
        script = kind.split("_")[1]
        parts = [SYLLABLES[script][k.below(15)] for _ in range(3 + attempt // 4)]
        ending = "" if script == "cyrillic" else ENDINGS[script][""][k.below(6)]
        return "".join(parts) + ending
    return k.same_kind(name)


def written(kind: str, value: str, new: str) -> str:
    """``new`` in the form of the mention ``value``."""
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(new)
        return "".join(next(it, "") if c.isalnum() else c for c in value)
    if kind.startswith("surname_cyrillic"):
        _, ending = _stem(value.lower(), "cyrillic")
        new += ending
    if kind.startswith(("given_", "surname_")):
        return "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    if kind == "email":
        return new.upper() if value.isupper() else new
    return new


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name) of the distinct entities of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict = {}
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                if t.is_valid:
                    for _, _, kind, name in mentions(t.as_py()):
                        rows[i.as_py(), kind, name] = None
            if rows:
                ids, kinds, names = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(names)],
                                                 ["doc_id", "kind", "name"])

    return docs.mapInArrow(run, "doc_id long, kind string, name string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, name, attempt, new) of distinct entities (kind, name): distinct surrogates, none
    of which is an entity. Where two meet, the one with fewer attempts stays, then the first by
    name, so nothing that was settled moves again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, attempts = (batch.column(c).to_pylist() for c in ("kind", "name", "attempt"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("name"), batch.column("attempt"),
                 pa.array([surrogate(key, *x) for x in zip(kinds, names, attempts)], pa.string())],
                ["kind", "name", "attempt", "new"])

    schema = "kind string, name string, attempt int, new string"
    state = cut_lineage(entities.select("kind", "name", F.lit(0).alias("attempt")).mapInArrow(run, schema), "surrogates")
    taken = entities.select("kind", F.col("name").alias("new"), F.lit(True).alias("real"))
    while True:
        stays = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "name")).alias("first"))
        judged = (state.join(stays, ["kind", "new"]).join(taken, ["kind", "new"], "left")
                  .withColumn("moves", (F.col("first.name") != F.col("name")) | F.coalesce("real", F.lit(False))))
        judged = cut_lineage(judged.select("kind", "name", "attempt", "new", "moves"), "surrogates")
        again = judged.filter("moves")
        if again.isEmpty():
            return judged.select("kind", "name", "attempt", "new")
        again = again.select("kind", "name", (F.col("attempt") + 1).alias("attempt")).mapInArrow(run, schema)
        state = cut_lineage(judged.filter("not moves").select("kind", "name", "attempt", "new").union(again), "surrogates")


def replace_personal(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_entities, text) of every row of ``docs`` (doc_id, text), entities replaced.

    ``n_entities`` counts replaced mentions. A null text stays null with 0 mentions, an empty
    one empty. Rows may share ids and repeat; an entity has one surrogate in the whole table.
    An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut_lineage(_found(rows), "entities")
    new = assign(found.select("kind", "name").distinct(), key)
    # A first attempt can be computed again where it is needed; later ones are sent.
    late = new.filter("attempt > 0").select("kind", "name", "attempt")
    sent = cut_lineage(found.join(late, ["kind", "name"]).distinct().groupBy("doc_id").agg(
        F.collect_list(F.struct("kind", "name", "attempt")).alias("late")).withColumnRenamed("doc_id", "late_id"), "late")
    full = rows.join(sent, rows["doc_id"].eqNullSafe(sent["late_id"]), "left").select("doc_id", "text", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for t, late in zip(batch.column("text"), batch.column("late")):
                text = t.as_py()
                attempts = {(x["kind"], x["name"]): x["attempt"] for x in late.as_py() or ()}
                out, at, n = [], 0, 0
                for start, end, kind, name in mentions(text) if text else ():
                    out += [text[at:start], written(kind, text[start:end], surrogate(key, kind, name, attempts.get((kind, name), 0)))]
                    at, n = end, n + 1
                counts.append(n)
                texts.append("".join(out) + text[at:] if n else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_entities", "text"])

    return full.mapInArrow(run, "doc_id long, n_entities long, text string")
