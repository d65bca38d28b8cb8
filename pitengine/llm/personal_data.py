"""Personal data: patterns propose spans, checksums confirm them, context words nearby adjust the score.

Four base kinds have fixed rules (email, ip, card, phone): matches are leftmost and do not overlap within a kind; a
match that fails its check (octets, digits and Luhn, digits) goes, and no shorter part of it is tried. Base spans
always stay. On top of them the method proposes further kinds, each with a score of its own:

    kind   proposal                                                     confirmed by
    iban   country code, check digits, groups of capitals and digits    ISO 7064 mod 97
    nir    French social security number, 13 digits and a key           key = 97 - number mod 97
    dni    Spanish identity number, 8 digits and a letter               letter = number mod 23
    ssn    ddd-dd-dddd                                                  number ranges; needs context
    ip6    IPv6 address                                                 the address parses, with 3 groups or more
    pan    groups inside a chain of digits that is no base card         issuer prefix, length and Luhn
    tel    national phone number in two groups or more                  9 to 12 digits; needs context

A score starts at the kind's prior, gains by a passed checksum, gains by context words of its kind within ``BEFORE``
code points before and ``AFTER`` behind, and loses by words that speak against personal data (isbn, invoice, version).
From ``ACCEPT`` up the span is added, unless it overlaps a base span that it does not hold whole or a span added
before it (in the order of the table).

Texts are read whole, in one pass over the rows, without a shuffle; every pattern takes time in proportion to the text
(the e-mail rule goes from each @ outward, the digit rules are possessive), so very long texts and runs are no hazard.
Offsets count code points. Defined cases: null and empty texts have no spans. Null ids, repeated rows and ids are
answered row by row. Empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.llm._shared import table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "nir", "dni", "ssn", "ip6", "pan", "tel")
KINDS = BASE_KINDS + ADDED_KINDS
ACCEPT = 0.6
BEFORE, AFTER = 60, 30
#: Score of a proposal, and what a passed checksum adds to it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "nir": 0.25, "dni": 0.25, "ssn": 0.45, "ip6": 0.6, "pan": 0.2, "tel": 0.4}
CHECKSUM = {"card": 0.4, "iban": 0.5, "nir": 0.35, "dni": 0.2, "pan": 0.25}
CONTEXT, AGAINST = 0.25, -0.25
#: Words that speak for a kind, in the corpus's languages, and words that speak against any.
WORDS = {
    "email": "email e-mail mail correo courriel contact kontakt",
    "ip": "ip host server address adresse client",
    "card": "card visa mastercard amex credit debit karte kreditkarte tarjeta carte payment",
    "phone": "phone tel telephone mobile cell call fax telefon handy anruf teléfono móvil téléphone portable",
    "iban": "iban account konto kontonummer cuenta compte bank banque banco bic swift",
    "nir": "nir sécu sécurité sociale insee numéro",
    "dni": "dni nif documento identidad",
    "ssn": "ssn social security number",
    "ip6": "ip ipv6 host server address adresse client",
}
WORDS |= {"pan": WORDS["card"], "tel": WORDS["phone"]}
WORDS_AGAINST = "isbn issn invoice order version serial rechnung factura facture bestellung pedido commande sku"
CONTEXT_WORDS = {kind: frozenset(words.split()) for kind, words in WORDS.items()}
AGAINST_WORDS = frozenset(WORDS_AGAINST.split())
#: Issuer prefixes of payment cards with the lengths they come in (fixed values).
ISSUERS = (("4", (13, 16, 19)), ("51", (16,)), ("52", (16,)), ("53", (16,)), ("54", (16,)), ("55", (16,)), ("34", (15,)), ("37", (15,)), ("36", (14,)), ("38", (14,)), ("6011", (16, 19)), ("65", (16, 19)), ("35", (16, 19)))
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
TEL = re.compile(r"(?<![\w+.])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![\w.])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
GROUP = re.compile(r"[0-9]+")

SPAN = "struct<kind: string, start: long, end: long, score: double, base: boolean, value: string>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 over an account number without separators: the first four signs go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def octets(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in address.split("."))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The four base kinds by their fixed rules."""
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # an address starts as far left of its @ as the signs of a local part reach, but not inside the one before
        start = m.start()
        while start > end and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            end = m.end()
    for m in IP.finditer(text):
        if octets(m[0]):
            yield "ip", *m.span()
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(digits_of(m[0])) <= 15:
            yield "phone", *m.span()


LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def context(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(text, max(0, start - BEFORE), start)} | {w.lower() for w in WORD.findall(text, end, end + AFTER)}
    return CONTEXT * bool(near & CONTEXT_WORDS[kind]) + AGAINST * bool(near & AGAINST_WORDS)


def account_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers with right check digits; of a match the longest part that ends with a group."""
    for m in IBAN.finditer(text):
        ends = [m.end(), *(m.start() + k.start() for k in reversed([*re.finditer(r"[ -]", m[0])]))]
        for end in ends:
            bare = re.sub(r"[ -]", "", text[m.start() : end])
            if 15 <= len(bare) <= 34 and mod97(bare):
                yield m.start(), end
                break


def card_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Groups of digits in a row that make a card number of an issuer, inside chains that are no base card."""
    for m in CHAIN.finditer(text):
        whole = digits_of(m[0]) if m.end() - m.start() >= 13 else ""
        if len(whole) < 13 or 14 <= len(whole) <= 19 and luhn(whole):
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m[0])]
        first = 0
        while first < len(groups):
            number, found = "", 0
            for last in range(first, len(groups)):
                number += text[slice(*groups[last])]
                if len(number) > 19:
                    break
                if any(number.startswith(p) and len(number) in lengths for p, lengths in ISSUERS) and luhn(number):
                    found = last + 1
            if found:
                yield groups[first][0], groups[found - 1][1]
            first = max(found, first + 1)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the added kinds whose checksum or form holds, in the order of the kinds."""
    yield from (("iban", *s) for s in account_numbers(text))
    for m in NIR.finditer(text):
        d = digits_of(m[0])
        if int(d[13:]) == 97 - int(d[:13]) % 97:
            yield "nir", *m.span()
    for m in DNI.finditer(text):
        if DNI_LETTERS[int(m[0][:8]) % 23] == m[0][-1]:
            yield "dni", *m.span()
    yield from (("ssn", *m.span()) for m in SSN.finditer(text))
    for m in IP6.finditer(text) if "::" in text or text.count(":") >= 7 else ():
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if len([g for g in m[0].split(":") if g]) >= 3:
            yield "ip6", *m.span()
    yield from (("pan", *s) for s in card_numbers(text))
    for m in TEL.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 12:
            yield "tel", *m.span()


def spans_of(text: str | None) -> list[Span]:
    """All spans by start, then kind."""
    if not text:
        return []
    score = lambda k, s, e: round(min(max(PRIOR[k] + CHECKSUM.get(k, 0) + context(text, k, s, e), 0), 1), 4)
    found = [Span(k, s, e, score(k, s, e), True) for k, s, e in base_spans(text)]
    held = sorted((s.start, s.end) for s in found)
    added: list[Span] = []
    for kind, start, end in proposals(text) if any(map(text.__contains__, "0123456789")) else ():
        if any(s < end and start < e and not (start <= s and e <= end) for s, e in overlapping(held, start, end)):
            continue
        if kind not in ("iban", "nir") and any(True for _ in overlapping(held, start, end)):
            continue
        if any(s.start < end and start < s.end for s in added) or (p := score(kind, start, end)) < ACCEPT:
            continue
        added.append(Span(kind, start, end, p, False))
    return sorted(found + added, key=lambda s: (s.start, KINDS.index(s.kind)))


def overlapping(held: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    return (x for x in held if x[0] < end and start < x[1])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score, whether a base kind, value) of each row, by start, then kind."""

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_()), ("value", pa.string())])
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                rows.append([s._asdict() | {"value": text[s.start : s.end]} for s in spans_of(text)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, with ``<KIND>`` for each span; of overlapping spans the first by start and kind stands for the others."""

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                parts, at = [], 0
                for s in spans_of(text):
                    if s.start >= at:
                        parts += [text[at : s.start], f"<{s.kind.upper()}>"]
                    at = max(at, s.end)
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
