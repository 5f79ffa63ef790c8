"""Personal data: every detected entity is replaced by a keyed surrogate of its own kind.

Detection finds e-mail addresses, IPv4 addresses, telephone numbers, account numbers, IBANs, secrets and personal names: words after a title or after
words like "my name is", given names of a list followed by another name, and in the same text every later or earlier use of a part of a name so found.

A surrogate is derived from a keyed hash of the kind and the canonical form, so one entity has one surrogate in all documents (coreference). It keeps the
format: digits stay digits and letters letters of the same case and script, a check digit stays right or wrong, a private address private, a
given name keeps gender and script, a family name keeps script and its masculine or feminine form (both forms are one entity). Surrogates are checked over the
whole corpus: two entities never share one and none equals an entity that occurs; who loses such a clash derives another, until there is none (distinctness).
Where a format is too crowded for that (MAX_TURNS draws clash), private addresses move to 10.0.0.0/8 and e-mail addresses grow by letters; after WIDE_TURNS more every
kind leaves its format by growing, addresses by moving to the reserved 240.0.0.0/4, so that the draws come to an end.

Defined results: null texts stay null; texts without entities are unchanged; repeated rows change alike; null ids are ids like any other; an empty
table gives an empty result; every column of the input is kept, but one named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlpit.llm.common import free_names, heavy_safe_join, map_arrow, materialize

#: Given names by script and gender, fixed values.
GIVEN = {
    ("latin", "f"): "anna maria laura julia sophie emma clara marta elena lucia ingrid alice mary jennifer linda susan sarah karen lisa sandra carmen rosa isabel claire camille manon greta heike sabine monika".split(),
    ("latin", "m"): "john peter thomas paul martin david daniel carlos pierre hans oliver victor james robert michael william richard joseph juan jose luis miguel jean jacques antoine klaus jürgen stefan wolfgang george".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина татьяна светлана екатерина юлия людмила галина".split(),
    ("cyrillic", "m"): "иван пётр сергей алексей дмитрий михаил александр андрей владимир николай павел юрий".split(),
}
#: Endings of made-up given names by script and gender, fixed values.
GIVEN_ENDINGS = {
    ("latin", "f"): "ia ina ella".split(), ("latin", "m"): "an us ert".split(), ("latin", "n"): "el is".split(),
    ("cyrillic", "f"): "ия ина ана".split(), ("cyrillic", "m"): "ан ей ислав".split(), ("cyrillic", "n"): "ли".split(),
}
#: Titles by gender, fixed values.
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Mlle Madame Señora Sra Doña Lady Г-жа Госпожа".split(), "m": "Mr Herr Monsieur Señor Sr Don Sir Г-н Господин".split(), "n": "Dr Prof".split(),
}
#: What comes before a name, fixed values.
CUES = ["my name is", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "меня зовут"]
#: Feminine endings of family names and the masculine ones that they stand for, fixed values.
FEMININE = {
    "cyrillic": {"ская": "ский", "цкая": "цкий", "ова": "ов", "ева": "ев", "ёва": "ёв", "ина": "ин", "ына": "ын"}, "latin": {"skaya": "skiy", "ova": "ov", "eva": "ev"},
}
GENDER_OF = {name: key for key, names in GIVEN.items() for name in names}
_title = "|".join(t for ts in TITLES.values() for t in ts)
_given = "|".join(sorted(n.capitalize() for n in GENDER_OF))
_cue = "|".join(CUES)
_word = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]{1,}"
#: Kinds in the order in which they claim text.
ENTITY = re.compile(
    rf"""(?P<email>[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})
    |(?P<secret>(?<=["'=:\s])(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})(?![0-9A-Za-z]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d))
    |(?P<account>(?<![\d-])\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}(?!\d|-\d))
    |(?P<phone>(?<![\w.])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}(?!\w|[.-]\d)|(?<![\w.])\+\d{{8,14}}(?!\w))
    |(?:\b(?P<title>{_title})\.?[ ](?P<first>{_word})(?:[ ](?P<last>{_word}))?)
    |(?:\b(?i:{_cue.replace(" ", "[ ]")})[ ](?P<own>{_word})(?:[ ](?P<ownlast>{_word}))?)
    |(?:\b(?P<given>{_given})[ ](?P<family>{_word}))""",
    re.VERBOSE,
)
#: A text in which this finds nothing has no entity.
MAYBE = rf"[0-9@]|(?=[A-ZÀ-ÞА-ЯЁ])(?:(?:{_title})\.? |(?:{_given}) )|(?=[mijeMIJEмМ])(?iu:{_cue}) "
KINDS = ("email", "secret", "iban", "ip", "account", "phone")
#: Draws within an entity's own format, and then within a wider one.
MAX_TURNS, WIDE_TURNS = 30, 60
#: Turns after which what is settled becomes one table.
GATHER = 8


def script_of(word: str) -> str:
    return "cyrillic" if re.match("[а-яё]", word.lower()) else "latin"


def family_kind(word: str) -> tuple[str, str]:
    """(kind, canonical) of a family name: with a feminine form it is known by the masculine one."""
    low, script = word.lower(), script_of(word)
    for feminine, masculine in FEMININE[script].items():
        if low.endswith(feminine) and len(low) > len(feminine) + 1:
            return f"family:{script}:two", low[: -len(feminine)] + masculine
        if low.endswith(masculine) and len(low) > len(masculine) + 1:
            return f"family:{script}:two", low
    return f"family:{script}:one", low


def given_kind(word: str, gender: str) -> tuple[str, str]:
    low = word.lower()
    script, known = GENDER_OF.get(low, (script_of(word), gender))
    return f"given:{script}:{known}", low


def name_parts(m: re.Match) -> list[tuple[int, int, str, str]]:
    """The parts of a name as entities: of one word after a title it is the family name unless it is a given name of the list."""
    gender = next((g for g, ts in TITLES.items() if m["title"] in ts), "n") if m["title"] else "n"
    out = []
    for first, last in (("first", "last"), ("own", "ownlast"), ("given", "family")):
        if m[first]:
            alone = first == "first" and not m[last] and m[first].lower() not in GENDER_OF
            out.append((*m.span(first), *(family_kind(m[first]) if alone else given_kind(m[first], gender))))
            if m[last]:
                out.append((*m.span(last), *family_kind(m[last])))
    return out


def canonical(kind: str, text: str) -> str:
    if kind in ("account", "phone"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower()


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity in order; parts of names are entities of their own, wherever they stand in the text."""
    found, names = [], {}
    for m in ENTITY.finditer(text):
        if m.lastgroup in KINDS:
            found.append((*m.span(), m.lastgroup, canonical(m.lastgroup, m[0])))
        else:
            parts = name_parts(m)
            found += parts
            names |= {text[a:b]: x for a, b, *x in parts}
    if not names:
        return found
    for word, (kind, form) in list(names.items()):  # both forms of a family name
        if kind.endswith(":two"):
            for w in (form, feminine_form(form)):
                names.setdefault(w[:1].upper() + w[1:], (kind, form))
    known = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b")
    out, at = [], 0
    for span in [*found, (len(text), len(text), None, None)]:
        out += [(*m.span(), *names[m[0]]) for m in known.finditer(text, at, span[0])]
        out.append(span)
        at = span[1]
    return out[:-1]


class Stream:
    """Keyed pseudo-random numbers."""

    def __init__(self, key: bytes, *parts: str):
        self.state, self.number = hashlib.blake2b("\0".join(parts).encode(), key=key, digest_size=32).digest(), 0

    def below(self, n: int) -> int:
        self.number += 1
        return int.from_bytes(hashlib.blake2b(self.state + self.number.to_bytes(4, "big"), digest_size=8).digest(), "big") % n


def luhn(digits: str) -> int:
    """0 if the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def redrawn(text: str, stream: Stream, keep: int = 0) -> str:
    """Other characters of the same classes, the first ``keep`` left as they are."""
    out = list(text[:keep])
    for c in text[keep:]:
        if c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            base = "абвгдежзиклмнопрстуфхцчшэюя" if re.match("[а-яё]", c.lower()) else "abcdefghijklmnopqrstuvwxyz"
            new = base[stream.below(len(base))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def feminine_form(name: str) -> str:
    """The feminine form of a masculine family name."""
    for feminine, masculine in FEMININE[script_of(name)].items():
        if name.endswith(masculine):
            return name[: -len(masculine)] + feminine
    return name


def made_up(stream: Stream, script: str, endings: list[str], longer: int) -> str:
    parts = "ка ло ми ре ту ва но се ди пу".split() if script == "cyrillic" else "ka lo mi re tu va no se di pu bra kel".split()
    return "".join(parts[stream.below(len(parts))] for _ in range(2 + longer + stream.below(2))) + endings[stream.below(len(endings))]


def surrogate(kind: str, form: str, turn: int, key: bytes, own: int = MAX_TURNS) -> str:
    """The turn'th candidate for an entity, in canonical form; from turn own on in a wider format, from WIDE_TURNS later in a longer one."""
    stream, wide, long = Stream(key, kind, form, str(turn)), max(0, turn - own + 1), max(0, turn - own - WIDE_TURNS + 1)
    if kind == "email":
        local, _, domain = form.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{redrawn(local + 'x' * wide, stream)}@{redrawn(host, stream)}.{top}"
    if kind == "secret":
        return "".join("0123456789abcdef"[stream.below(16)] for _ in range(len(form) + long))
    if kind == "ip":
        a, b, *_ = map(int, form.split("."))
        private = a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)
        if long:
            head = [240 + stream.below(15), stream.below(256)]
        elif a == 10 or (wide and private):
            head = [10, stream.below(256)]
        elif (a, b) == (192, 168):
            head = [192, 168]
        elif private:
            head = [172, 16 + stream.below(16)]
        else:
            head = [11 + stream.below(110), stream.below(256)]
        return ".".join(map(str, [*head, stream.below(256), 1 + stream.below(254)]))
    if kind == "account":
        new = redrawn(form + "0" * long, stream)
        if luhn(form) == 0:
            new = next(x for d in "0123456789" if luhn(x := new[:-1] + d) == 0)
        return new
    if kind == "iban":
        return redrawn(form + "0" * long, stream, 2)
    if kind == "phone":
        return redrawn(form + "0" * long, stream, 1 if len(form) > 10 else 0)
    _, script, more = kind.split(":")
    if kind.startswith("given:"):
        names = GIVEN.get((script, more), ()) if turn < 6 else ()
        return names[stream.below(len(names))] if names else made_up(stream, script, GIVEN_ENDINGS[script, more], turn // 10)
    endings = list(FEMININE[script].values())[-3:] if more == "two" else ("енко ук ко".split() if script == "cyrillic" else "son ner ton mann ard".split())
    return made_up(stream, script, endings, turn // 5)


def rendered(kind: str, original: str, new: str) -> str:
    """A surrogate in canonical form, written as the original is."""
    if kind in ("account", "phone", "iban"):
        chars = iter(new)
        return "".join(next(chars) if c.isalnum() else c for c in original) + "".join(chars)
    if kind.endswith(":two") and original.lower() != family_kind(original)[1]:
        new = feminine_form(new)
    if original.isupper():
        return new.upper()
    if kind.startswith(("given:", "family:")) or (kind == "email" and original[:1].isupper()):
        return new[:1].upper() + new[1:]
    return new


def occurrences(texts: DataFrame) -> DataFrame:
    """row, kind, form: each entity of each text once. texts: row (unique), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *e) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in sorted({x[2:] for x in entities(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["row", "kind", "form"])

    return map_arrow(texts, run, "row long, kind string, form string")


def surrogate_table(found: DataFrame, key: bytes, own: int = MAX_TURNS) -> DataFrame:
    """kind, form, new, n: the surrogate of each entity of found (kind, form), and in how many rows it occurs. Clashes are settled in turns, each over all entities that have none yet."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, forms, turns = (c.to_pylist() for c in batch.columns[:3])
            new = [surrogate(*x, key, own) for x in zip(kinds, forms, turns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "new"])

    known = materialize(found.groupBy("kind", "form").agg(F.count("*").alias("n")), "entities")
    real = known.select(F.split("kind", ":")[0].alias("sort"), F.col("form").alias("new")).distinct()
    schema = "kind string, form string, turn int, n long, new string"
    todo, settled = known.select("kind", "form", F.lit(0).alias("turn"), "n"), None
    for turn in count():  # formats grow without end, so every entity finds a surrogate
        offered = map_arrow(todo, propose, schema).withColumn("sort", F.split("kind", ":")[0])
        taken = offered.join(real, ["sort", "new"], "left_semi").select("kind", "form").withColumn("clash", F.lit(True))
        if settled is not None:
            gone = offered.join(settled.select("sort", "new"), ["sort", "new"], "left_semi").select("kind", "form").withColumn("clash", F.lit(True))
            taken = taken.unionByName(gone).distinct()
        first = offered.groupBy("sort", "new").agg(F.min(F.struct("kind", "form")).alias("first"))
        judged = offered.join(first, ["sort", "new"]).join(taken, ["kind", "form"], "left")
        judged = materialize(judged.withColumn("won", F.col("clash").isNull() & (F.col("first") == F.struct("kind", "form"))), "judged")
        won = judged.filter("won").select("kind", "form", "n", "new", "sort")
        settled = won if settled is None else settled.unionByName(won)
        todo = judged.filter("NOT won").select("kind", "form", (F.col("turn") + 1).cast("int").alias("turn"), "n")
        if todo.isEmpty():
            return settled.drop("sort")
        if turn % GATHER == GATHER - 1:
            settled = materialize(settled, "settled")


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", prefix: str = "_") -> DataFrame:
    """docs, every column kept, the text with surrogates in place of entities, plus n_replaced after the prefix."""
    added = f"{prefix}n_replaced"
    docs = docs.drop(added)
    flag, row, new_names = free_names(docs, "_flag", "_row", "_new")
    maybe = F.coalesce(F.col(text_col).rlike(MAYBE), F.lit(False))
    marked = materialize(docs.withColumn(flag, maybe).withColumn(row, F.monotonically_increasing_id()), "marked")
    some = marked.filter(flag).drop(flag)
    found = materialize(occurrences(some.select(F.col(row).alias("row"), F.col(text_col).alias("text"))), "found").withColumn("e", F.concat_ws("\0", "kind", "form"))
    table = materialize(surrogate_table(found, key).select(F.concat_ws("\0", "kind", "form").alias("e"), "new", "n"), "surrogates")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_row = heavy_safe_join(found.select("row", "e"), table, "e", total, "n").groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("e", "new")).alias(new_names))
    joined = some.join(by_row, row, "left").drop(row)
    schema = StructType([*docs.schema.fields]).add(added, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(text_col)
            texts, counts = [], []
            for text, pairs in zip(batch.column(where), batch.columns[-1], strict=True):
                text, new, out, at = text.as_py(), {p["e"]: p["new"] for p in pairs.as_py() or ()}, [], 0
                spans = entities(text) if new else []
                for a, b, kind, form in spans:
                    out += [text[at:a], rendered(kind, text[a:b], new[f"{kind}\0{form}"])]
                    at = b
                texts.append("".join(out) + text[at:])
                counts.append(len(spans))
            columns = [pa.array(texts, batch.schema.types[where]) if i == where else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*batch.schema.names[:-1], added])

    changed = map_arrow(joined, run, schema)
    return changed.unionByName(marked.filter(~F.col(flag)).drop(flag, row).withColumn(added, F.lit(0).cast("long")))
