"""PII surrogates: keyed, type-consistent, format-preserving replacements.

Detected entities are replaced by a keyed permutation of all strings of their own format: digits
stay digits, letters stay letters of their case, card and account numbers keep their checksums,
country codes and domain endings stay. A permutation cannot merge two entities nor map one to itself,
and depends on the key alone, so the same entity gets the same surrogate in every document and every
run. Names become pronounceable names of the same script, given names with an ending for the gender
that a title in the document shows (none: a neutral ending); a surname keeps one surrogate with or
without title or given name.

A collision check then runs over all distinct entities: should two of a kind share a surrogate, or a
surrogate be another original of its kind in the corpus, it is drawn anew, until none is left; an
entity that cannot be settled in ATTEMPTS draws fails the job rather than pass. Draws are kept as a
table and meet the documents that hold such an entity in a join.

Defined results: null text stays null, empty stays empty; a text without entities is returned
unchanged; repeated rows are replaced alike; an empty table gives no rows; other columns are kept
by `surrogates`, but for one named `entities`.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmap
from .common import blocks, released, staged

#: Titles before a name, by the gender they show (fixed values).
TITLES = {
    "m": "Mr Mister Sir Lord Herr Monsieur Señor Sr Don Signor господин г-н κύριος".split(),
    "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Srta Doña Signora госпожа г-жа κυρία".split(),
    "u": "Dr Prof Professor Doctor Mx доктор".split(),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
#: A capitalised word of any script (the fixed class excludes digits and the underscore).
_CAP = r"[^\W\d_][^\W\d_]+(?:['’-][^\W\d_]+)*"
_PERSON = re.compile(rf"(?<!\w)({_TITLE})(\.?[  ]+)({_CAP})(?:([  ]+)({_CAP}))?")
_NAMED = re.compile(rf"(?<!\w)((?:[Nn]ame|[Ff]ull [Nn]ame|[Nn]om|[Nn]ombre)\s*[:=]\s*)()({_CAP})(?:([  ]+)({_CAP}))?")
#: Patterns of the other kinds, most telling first; group 1, where there is one, is the entity.
PATTERNS = [
    ("EMAIL", re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")),
    ("KEY", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("KEY", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")),
    ("SECRET", re.compile(r"(?i)(?<![a-z0-9])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\s*[=:]\s*[\"']?((?=[^\s\"']*\d)[A-Za-z0-9_\-+/.=]{6,})")),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("CARD", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)")),
    ("SSN", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("IP", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")),
    ("PHONE", re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)")),
]
#: What every match of PATTERNS holds: a digit, an @, or a part of a key's beginning.
_HINT = re.compile(r"[0-9@]")
_KEY_PARTS = ("AKIA", "ASIA", "_", "sk-", "xox")
#: Words that a name can be, and what joins their parts.
_NAME = re.compile(rf"(?<!\w){_CAP}(?!\w)")
_JOIN = re.compile(r"['’-]")

KINDS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"

#: Syllables of surrogate names by script, and their endings for women, men and others (fixed values).
SYLLABLES = {
    "ascii": ("bcdfghjklmnprstvwyz", "aeiou", {"f": "na", "m": "ro", "u": "le", "": ""}),
    "latin": ("bcdfghjklmnprstvwyz", "áéíóú", {"f": "ná", "m": "ró", "u": "lé", "": ""}),
    "cyrillic": ("бвгджзклмнпрстфхчш", "аеиоу", {"f": "на", "m": "ро", "u": "ле", "": ""}),
    "greek": ("βγδζθκλμνξπρστφχψ", "αειου", {"f": "να", "m": "ρος", "u": "λε", "": ""}),
}
#: The letters that a script's names are read in: first and last code points (fixed values).
RANGES = {"ascii": ((0x61, 0x7A),), "latin": ((0x61, 0x7A), (0xDF, 0xF6), (0xF8, 0x24F)), "cyrillic": ((0x430, 0x45F),), "greek": ((0x3AC, 0x3CE),), "han": ((0x4E00, 0x9FFF),), "kana": ((0x3041, 0x30FE),), "hangul": ((0xAC00, 0xD7A3),), "hebrew": ((0x5D0, 0x5EA),), "arabic": ((0x620, 0x64A),), "any": ((0x21, 0x2FFFF),)}


class Permutation:
    """A keyed permutation of 0..size-1 without fixed points: hide, step, unhide.

    hide is a Feistel network over the next even number of bits, walked until it lands inside.
    """

    def __init__(self, key: bytes, size: int):
        self.size, self.half = size, max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
        self.mac = hmac.new(key, str(size).encode(), hashlib.sha256)
        self.step = 1 + self._f(99, 0, 256) % (size - 1) if size > 1 else 0

    def _f(self, turn: int, x: int, bits: int) -> int:
        out, k = 0, 0
        while 256 * k < bits:
            m = self.mac.copy()
            m.update(b"%d,%d,%d" % (turn, k, x))
            out = out << 256 | int.from_bytes(m.digest(), "big")
            k += 1
        return out & (1 << bits) - 1

    def _walk(self, x: int, turns) -> int:
        h = self.half
        while True:
            left, right = x >> h, x & (1 << h) - 1
            for t in turns:
                left, right = right, left ^ self._f(t, right, h)
            x = right << h | left  # the halves swap, so the reversed turns undo it
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        y = (self._walk(x, range(8)) + self.step) % self.size
        return self._walk(y, range(7, -1, -1))


@lru_cache(maxsize=4096)
def _permutation(key: bytes, kind: str, form: str, size: int) -> Permutation:
    return Permutation(key + b"|" + kind.encode() + b"|" + form.encode(), size)


def _radix(c: str) -> tuple[int, int]:
    """(letters in the character's class, first code point), or (1, itself)."""
    if "0" <= c <= "9":
        return 10, 48
    if "a" <= c <= "z":
        return 26, 97
    if "A" <= c <= "Z":
        return 26, 65
    return 1, ord(c)


def same_form(text: str, key: bytes, kind: str) -> str:
    """Another string of the same shape: digits for digits, letters for letters of that case."""
    hexadecimal = kind == "SECRET" and re.fullmatch(r"(?=.*[a-f])[0-9a-f]{8,}", text)
    if hexadecimal:
        return f"{_permutation(key, kind, 'hex', 16 ** len(text))(int(text, 16)):0{len(text)}x}"
    classes = [_radix(c) for c in text]
    number, size = 0, 1
    for c, (n, first) in zip(text, classes, strict=True):
        number, size = number * n + ord(c) - first, size * n
    form = "".join({10: "9", 26: "a" if f == 97 else "A"}.get(n, chr(f)) for n, f in classes)
    number = _permutation(key, kind, form, size)(number)
    out = []
    for n, first in reversed(classes):
        number, d = divmod(number, n)
        out.append(chr(first + d))
    return "".join(reversed(out))


def refill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def checksum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def remainder(account: str) -> int:
    """An account number modulo 97, its first four characters last, letters as 10 to 35."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def name_part(word: str, key: bytes, kind: str, gender: str) -> str:
    """A pronounceable word of the same script; distinct words give distinct results."""
    low = word.lower()
    script = next((s for s, spans in RANGES.items() if all(any(a <= ord(c) <= b for a, b in spans) for c in low if c.isalpha())), "any")
    letters = [c for c in low if c.isalpha()]
    alphabet = RANGES[script]
    width = sum(b - a + 1 for a, b in alphabet)

    def number(c: str) -> int:
        at = 0
        for a, b in alphabet:
            if a <= ord(c) <= b:
                return at + ord(c) - a
            at += b - a + 1
        return 0

    n = len(letters)
    value = 0
    for c in letters:
        value = value * width + number(c)
    value = _permutation(key, kind, f"{script}{n}", width**n)(value)
    if script not in SYLLABLES:
        out = []
        for _ in range(n):
            value, d = divmod(value, width)
            for a, b in alphabet:
                if d <= b - a:
                    out.append(chr(a + d))
                    break
                d -= b - a + 1
        return "".join(reversed(out))
    consonants, vowels, endings = SYLLABLES[script]
    base = len(consonants) * len(vowels)
    value += sum(width**k for k in range(1, n)) + 1  # numbers of all shorter words come first
    out = []
    while value:
        value, d = divmod(value - 1, base)  # bijective numeration: no two numbers share a spelling
        out.append(consonants[d // len(vowels)] + vowels[d % len(vowels)])
    new = "".join(reversed(out)) + endings[gender]
    return new.upper() if word.isupper() and len(word) > 1 else new.capitalize()


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of one entity; its normal form alone decides, its spelling is kept in form."""
    if attempt:
        key = key + b"#%d" % attempt
    if kind == "EMAIL":
        body, _, ending = text.rpartition(".")
        new = same_form(body.lower(), key, kind)
        return "".join(b.upper() if a.isupper() else b for a, b in zip(body, new, strict=True)) + "." + ending
    digits = re.sub(r"\D", "", text)
    if kind == "CARD":
        head = digits[:-1]
        if checksum(head) == int(digits[-1]):
            new = digits[0] + same_form(head[1:], key, kind)
            return refill(text, new + str(checksum(new)))
        new = digits
        while True:  # stay among the numbers whose check digit is wrong
            new = new[0] + same_form(new[1:], key, "NUMBER")
            if checksum(new[:-1]) != int(new[-1]):
                return refill(text, new)
    if kind == "IP":
        number = 0
        for part in text.split("."):
            number = number << 8 | int(part)
        number = _permutation(key, kind, "", 1 << 32)(number)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "PHONE":
        code = re.match(r"\+(\d{1,3})(?=\D)", text)
        first = len(code[1]) if code else 0
        return refill(text, digits[:first] + same_form(digits[first:], key, kind + (code[1] if code else "")))
    if kind == "SSN":
        return refill(text, same_form(digits, key, kind))
    if kind == "IBAN":
        if remainder(text) == 1:
            body = same_form(text[4:], key, kind)
            return f"{text[:2]}{98 - remainder(text[:2] + '00' + body):02d}{body}"
        new = text
        while True:  # stay among the numbers whose check digits are wrong
            new = text[:2] + same_form(new[2:], key, "NUMBER" + text[:2])
            if remainder(new) != 1:
                return new
    if kind == "KEY":
        lead = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", text)[0]
        return lead + same_form(text[len(lead) :], key, kind + lead)
    if kind.startswith(("GIVEN", "SURNAME")):
        return name_part(text, key, kind[:5], kind.partition(":")[2])
    return same_form(text, key, kind)


def mentions(text: str, known: dict[str, str]):
    """(start, end, kind) of the known names, as words or as parts of joined words, the longest first."""
    for m in _NAME.finditer(text):
        edges = [m.start(), *(m.start() + j.end() for j in _JOIN.finditer(m[0])), m.end() + 1]
        i = 0
        while i < len(edges) - 1:
            for j in range(len(edges) - 1, i, -1):
                kind = known.get(text[edges[i] : edges[j] - 1])
                if kind:
                    yield edges[i], edges[j] - 1, kind
                    i = j
                    break
            else:
                i += 1


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    if _HINT.search(text) or any(part in text for part in _KEY_PARTS):
        taken = bytearray(len(text))
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                a, b = m.span(m.lastindex or 0)
                if kind == "IP" and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    found.append((a, b, kind))
    known: dict[str, str] = {}
    for pattern in (_PERSON, _NAMED):
        for m in pattern.finditer(text):
            if not m[3][0].isupper() and m[3][0].lower() != m[3][0].upper():
                continue
            gender = _GENDER.get(m[1], "u")
            two = m[5] and m[5] not in _GENDER and (m[5][0].isupper() or m[5][0].lower() == m[5][0].upper())
            parts = [(3, f"GIVEN:{gender}"), (5, "SURNAME")] if two else [(3, "SURNAME")]
            for g, kind in parts:
                if known.setdefault(m[g], kind).endswith(":u"):
                    known[m[g]] = kind  # a title elsewhere in the text tells the gender
                found.append((*m.span(g), kind))
    if known:
        found = [(a, b, known.get(text[a:b], kind) if kind.startswith("GIVEN") else kind) for a, b, kind in found]
        found += mentions(text, known)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def normal(kind: str, text: str) -> str:
    """What two mentions of one entity share."""
    if kind in ("EMAIL",) or kind.startswith(("GIVEN", "SURNAME")):
        return text.lower()
    return re.sub(r"\D", "", text) if kind in ("CARD", "PHONE", "SSN") else text


def entity_key(kind: str, original: str) -> int:
    """64 bits that name an entity in bitmaps."""
    return int.from_bytes(hashlib.md5(f"{kind}\0{original}".encode()).digest()[:8], "big")


def replace(text: str, key: bytes, redrawn: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple]]:
    """The text with surrogates, and (kind, start, end, surrogate) with places in the new text."""
    parts, spans, at, size = [], [], 0, 0
    for a, b, kind in detect(text):
        new = surrogate(kind, text[a:b], key, redrawn.get((kind, normal(kind, text[a:b])), 0) if redrawn else 0)
        parts += [text[at:a], new]
        size += a - at
        spans.append((kind, size, size + len(new), new))
        size += len(new)
        at = b
    return ("".join(parts) + text[at:], spans) if spans else (text, spans)


ENTITY = "kind string, original string, mention string, attempt int, surrogate string"


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """All distinct entities by kind and normal form: one mention, and its surrogate's normal form at the first draw."""

    def run(batches):
        for batch in blocks(batches, "text"):
            have = {}
            for text in batch.column("text").to_pylist():
                for a, b, kind in detect(text or ""):
                    mention = text[a:b]
                    name = kind, normal(kind, mention)
                    have[name] = min(mention, have.get(name, mention))
            rows = [(kind, old, m, 0, normal(kind, surrogate(kind, m, key))) for (kind, old), m in sorted(have.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 3 else pa.string()) for i in range(5)], names=["kind", "original", "mention", "attempt", "surrogate"])

    found = docs.select("text").mapInArrow(released(run), ENTITY)
    return found.groupBy("kind", "original").agg(F.min(F.struct("mention", "attempt", "surrogate")).alias("x")).select("kind", "original", "x.*")


#: Draws of an entity before the job fails.
ATTEMPTS = 32


def collisions(found: DataFrame) -> DataFrame:
    """(kind, original) to draw anew: those that share their surrogate with a lesser original of their
    kind, or whose surrogate is an original of their kind."""
    shared = found.groupBy("kind", "surrogate").agg(F.min("original").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = found.join(shared, ["kind", "surrogate"]).filter(F.col("original") != F.col("first")).select("kind", "original")
    taken = found.join(found.select("kind", F.col("original").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "original")
    return later.unionByName(taken).distinct()


def settled(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, original, attempt) of the entities that had to be drawn anew; staged."""
    found = staged(entities(docs, key), "entities")

    def again(batches):
        for batch in batches:
            rows = batch.to_pylist()
            new = [normal(r["kind"], surrogate(r["kind"], r["mention"], key, r["attempt"] + 1)) for r in rows]
            tries = [r["attempt"] + 1 for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tries, pa.int32()), pa.array(new, pa.string())], names=batch.schema.names)

    for _ in range(ATTEMPTS):
        clash = staged(collisions(found), "collisions")
        if clash.isEmpty():
            return staged(found.filter("attempt > 0").select("kind", "original", "attempt"), "redrawn")
        names = ["kind", "original", "mention", "attempt", "surrogate"]
        moved = found.join(clash, ["kind", "original"], "left_semi").select(*names).mapInArrow(again, ENTITY)
        found = staged(found.join(clash, ["kind", "original"], "left_anti").select(*names).unionByName(moved), "entities")
    raise ValueError(f"surrogates still collide after {ATTEMPTS} draws")


def surrogates(docs: DataFrame, key: bytes, check: bool = True) -> DataFrame:
    """docs with surrogates in `text`, + entities (KINDS). check: look for collisions first, and redraw."""
    keep = [c for c in docs.columns if c != "entities"]
    plain = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index("text")
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
    few = None
    if check:
        moved = settled(docs, key)
        if not moved.isEmpty():
            h = F.expr("cast(conv(substring(md5(concat(kind, '\\0', original)), 1, 16), 16, -10) as long)")
            few = docs.sparkSession.sparkContext.broadcast(bitmap.build(moved.select(h.alias("h")), "h"))

    def hit(text: str | None) -> bool:
        """Whether the text may hold an entity that was drawn anew."""
        names = [entity_key(kind, normal(kind, text[a:b])) for a, b, kind in detect(text or "")]
        return bool(names) and bool(bitmap.passes(np.array(names, np.uint64), few.value).any())

    def put(batch, redrawn):
        texts, spans = [], []
        for text, drawn in zip(batch.column(at).to_pylist(), redrawn, strict=True):
            new, found = replace(text, key, drawn) if text else (text, [])
            texts.append(new)
            spans.append([dict(zip(("kind", "start", "end", "surrogate"), s, strict=True)) for s in found])
        columns = list(batch.columns[: len(keep)])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], names=[*keep, "entities"])

    def run(batches):
        for batch in blocks(batches, "text"):
            if few is not None:
                batch = batch.filter(pa.array([not hit(t) for t in batch.column("text").to_pylist()], pa.bool_()))
            yield put(batch, [None] * batch.num_rows)

    schema = T.StructType([*plain.schema, T.StructField("entities", T._parse_datatype_string(KINDS))])
    out = plain.mapInArrow(released(run), schema)
    if few is None:
        return out

    def names(batches):
        for batch in blocks(batches, "text"):
            some = batch.filter(pa.array([hit(t) for t in batch.column("text").to_pylist()], pa.bool_()))
            found = [sorted({(kind, normal(kind, t[a:b])) for a, b, kind in detect(t)}) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([[{"kind": k, "original": o} for k, o in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string())])))], names=[*keep, "_names"])

    def late(batches):
        for batch in blocks(batches, "text"):
            drawn = [{(x["kind"], x["original"]): x["attempt"] for x in row} for row in batch.column(len(keep)).to_pylist()]
            yield put(batch, drawn)

    # Staged, so that a row's number holds, and keyed by it: rows may be equal.
    touched = plain.mapInArrow(released(names), T.StructType([*plain.schema, T.StructField("_names", T._parse_datatype_string("array<struct<kind:string,original:string>>"))])).withColumn("_row", F.monotonically_increasing_id())
    touched = staged(touched.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), "_names", "_row"), "touched")
    draws = touched.select("_row", F.explode("_names").alias("n")).select("_row", "n.*").join(moved, ["kind", "original"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "original", "attempt")).alias("_draws"))
    whole = touched.join(draws, "_row", "left").select("_doc.*", F.coalesce("_draws", F.array().cast("array<struct<kind:string,original:string,attempt:int>>")).alias("_draws"))
    return out.unionByName(whole.mapInArrow(released(late), schema))


def op7_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, entities (places in the new text)."""
    return surrogates(docs.select("doc_id", "text"), key).select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in `text` and, where there is such a column, n_chars of the new text."""
    # One struct column carries the other columns, whatever their names.
    own = surrogates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), key)
    out = own.select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return out


def session_key(spark) -> bytes:
    """The key of the registered queries: spark.spanwright.pii.key, or else a public one that protects nothing."""
    return spark.conf.get("spark.spanwright.pii.key", "public key of the test tables").encode()
