"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, URL schemes and words that announce an identifier. At each
anchor a small parser expands to the boundaries and checks the value; nothing
else of the text is looked at again. The base kinds give, span for span, what
leftmost non-overlapping patterns give:

  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
  card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits that pass Luhn's check
  phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

Added kinds: login (scheme://user:password@host), iban (right after its cue but
for marks and small words, with its check digits) and account (6 to 17 digits
after a word such as "account no.").

Defined results: a null text is an empty one and has no spans; repeated rows
each give a row; null keys are carried, keys may have any type; texts and values
of any length are read whole; where spans of two kinds overlap, both are given;
an empty table gives an empty result; other columns, whatever their names, are
ignored; offsets count code points, ends excluded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account")
Span = tuple[str, int, int]

#: Words that announce an account number, in the corpus' languages. Fixed values.
CUES = ("account", "acct", "a/c", "konto", "compte", "cuenta", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+")
_LOGIN = re.compile(r"[^\s/@:?#]++:[^\s/@?#]++@[A-Za-z0-9.-]+")
_SCHEME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_BEFORE_IBAN = re.compile(r"(?:[^A-Za-z0-9]++|(?:is|ist|est|es|no|nr|number|nummer|code)(?![A-Za-z0-9]))*+", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\s|[:#.=-]|no\b|nr\b|number\b|nummer\b|num\b|numéro\b|número\b)*?([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_checks(text: str) -> bool:
    plain = re.sub("[ -]", "", text)
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("digit", list("0123456789")), ("scheme", ["://"]), ("cue", [w for c in CUES for w in {c, c.upper(), c.capitalize()}])):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_anchors = None


def spans(text: str) -> list[Span]:
    """All spans of a text, by kind and start."""
    global _anchors
    if _anchors is None:
        _anchors = _automaton()
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, dropped or not
    digits_end = -1  # of the run of digits that was last met

    def take(kind: str, start: int, stop: int, good: bool) -> None:
        end[kind] = stop
        if good:
            out[kind].append((start, stop))

    for last, (kind, length) in _anchors.iter(text):
        if kind == "digit":
            if last >= end["card"] and (m := _RUN.match(text, last)):
                digits = re.sub("[ -]", "", m[0])
                take("card", last, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
            if last >= digits_end or last == end["ip"]:
                digits_end = _DIGIT_RUN.match(text, last).end()
                if last >= end["ip"] and digits_end < len(text) and text[digits_end] == "." and (m := _IP.match(text, last)):
                    take("ip", last, m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()))
        elif kind == "@":
            start = last
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                take("email", start, m.end(), True)
        elif kind == "+":
            if last >= end["phone"] and (m := _PHONE.match(text, last)):
                take("phone", last, m.end(), 9 <= sum(c in "0123456789" for c in m[0]) <= 15)
        elif kind == "scheme":
            at = last + 1
            if at >= end["login"] and (m := _LOGIN.match(text, at)):
                start = at - 3
                while start > end["login"] and text[start - 1] in _SCHEME_LETTERS:
                    start -= 1
                while start < at - 3 and not text[start].isalpha():
                    start += 1
                if start < at - 3:
                    take("login", start, m.end(), True)
        else:
            at = last + 1
            if text[at - length : at].lower() == "iban" and (m := _IBAN.match(text, _BEFORE_IBAN.match(text, at).end())) and m.start() >= end["iban"]:
                take("iban", m.start(), m.end(), iban_checks(m[0]))
            elif (at == length or not text[at - length - 1].isalnum()) and (m := _NUMBER.match(text, at)) and m.start(1) >= end["account"] and m.start(1) > at:
                take("account", m.start(1), m.end(1), True)
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and an array of (kind, start, end, value) for each row."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for whole in batches:
            for batch in small_batches(whole, "text"):
                rows = []
                for t in batch.column("text").to_pylist():
                    t = t or ""
                    rows.append([{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in spans(t)])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, shape)], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return rows.mapInArrow(search, schema).withColumnRenamed("key", key)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the text with each span replaced by its kind in brackets; of
    overlapping spans the first, then the longest, is replaced."""
    ship(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                parts, at = [], 0
                for kind, a, b in sorted(spans(t), key=lambda s: (s[1], -s[2])) if t else ():
                    if a >= at:
                        parts += [t[at:a], f"[{kind}]"]
                        at = b
                out.append(t if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], ["key", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(clean, f"key {dict(docs.dtypes)[key]}, text string").toDF(key, text)


def span_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        key, *(count(k) for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )
