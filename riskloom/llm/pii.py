"""PII spans: patterns propose, checksums confirm, context words adjust the score.

Nulls and empty texts have no spans. Texts are read whole, each on its own, in time linear in their
length; repeated rows give repeated results. Other columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import slices, table

#: In the order that breaks ties between spans of equal start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
#: A proposal's score before its checks; what a passed checksum and a context word near it add.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "secret": 0.3}
CHECKED, NEAR, THRESHOLD, WINDOW = 0.4, 0.3, 0.5, 40
#: Words near a span that speak for it. They stand alone: "hotel" says nothing of a telephone, "company" nothing of a payment.
CONTEXT = {
    "card": ("card", "cards", "visa", "mastercard", "credit", "pay", "paid", "payment"),
    "phone": ("phone", "telephone", "mobile", "tel", "call", "fax"),
    "ip": ("address", "host", "server", "ip"),
    "email": ("mail", "email", "e-mail", "contact"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "credential", "credentials"),
}
#: A word may be a part of a name_like_this or a name-like-this, whose parts it then is.
_CONTEXT = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, w)) + r")(?![^\W_])") for k, w in CONTEXT.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Length of each country's IBAN (ISO 13616): tried first where a proposal runs on into the words after it.
_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 "
    "RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}  # fmt: skip
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters last, letters as 10 to 35, remainder 1."""
    text = iban.replace(" ", "")
    return _remainder(text[4:] + text[:4]) == 1


def _remainder(text: str, rest: int = 0) -> int:
    """The remainder of ``text``'s digits and letters (10 to 35) by 97, after characters that left ``rest``."""
    for c in text:
        n = int(c, 36)
        rest = (rest * (10 if n < 10 else 100) + n) % 97
    return rest


def _emails(text: str):
    """Each @ with the longest run of local-part characters before it: the leftmost matches, without retries."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def _ibans(text: str):
    """Where mod-97 holds: from each possible start the end at the country's length, else the last end of a word that passes.

    A proposal's remainder is carried on from character to character, and the four first characters are added at each end of a word.
    """
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 2
        usual, first, rest, size, good = _LENGTHS.get(m[0][:2]), m[0][:4], 0, 4, {}
        for e in range(start + 5, m.end() + 1):
            c = text[e - 1]
            if c == " ":
                continue
            size, rest = size + 1, _remainder(c, rest)
            after = text[e : e + 1]
            if size >= 15 and not (after.isascii() and after.isalnum()) and _remainder(first, rest) == 1:
                good[size] = e
        if good:
            at = good[min(good, key=lambda n: (n != usual, -n))]
            yield start, at
        m = _IBAN.search(text, at)


def _proposals(text: str, lower: str):
    """(kind, start, end, checked): checked is None where the kind has no checksum."""
    for s, e in _emails(text):
        yield "email", s, e, None
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span(), None
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19:
            yield "card", *m.span(), luhn(digits)
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", *m.span(), None
    for s, e in _ibans(text):
        yield "iban", s, e, True
    if _CONTEXT["ssn"].search(lower):  # without context such a span never reaches the threshold
        for m in _SSN.finditer(text):
            yield "ssn", *m.span(), None
    if _CONTEXT["secret"].search(lower):
        for m in _SECRET.finditer(text):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                yield "secret", *m.span(), None


def _near(kind: str, text: str, low: int, high: int) -> bool:
    """Whether a context word lies as a whole between two places of ``text``."""
    return any(m.start() >= low and m.end() <= high for m in _CONTEXT[kind].finditer(text))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, by start and kind."""
    text = text or ""
    lower, out = text.lower(), []
    if len(lower) != len(text):  # a letter whose lower form is longer: keep places
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for kind, s, e, checked in _proposals(text, lower):
        if checked is False:
            continue
        # a letter more on either side, so that a word that the window cuts is not taken for a whole one
        before, after = lower[max(0, s - WINDOW - 1) : s], lower[e : e + WINDOW + 1]
        near = _near(kind, before, max(0, len(before) - WINDOW), len(before)) or _near(kind, after, 0, WINDOW)
        score = SCORES[kind] + CHECKED * bool(checked) + NEAR * near
        if score >= THRESHOLD:
            out.append((kind, s, e, min(1.0, score)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, and an array of spans (kind, start, end, score) for each row; no shuffle."""

    def task(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in slices(batches):
            got = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each span replaced by its kind in brackets, n_chars counted again if there.

    Overlapping spans become one, named after the first. Text without spans stays as it is, null too.
    """

    def task(batches):
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                parts, at = [], 0
                for kind, s, e, _ in spans(t):
                    if s >= at:
                        parts += [t[at:s], f"[{kind.upper()}]"]
                    at = max(at, e)
                out.append("".join(parts) + t[at:] if parts else t)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    out = docs.mapInArrow(task, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_pii(spark, sf_dir):
    base = ["email", "ip", "card", "phone"]

    def joined(chosen):
        return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    found = find(table(spark, sf_dir, "documents"))
    first = F.filter("spans", lambda x: x["kind"].isin(base))

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in base]
    scores = F.array_join(F.transform("spans", lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores")
    return found.select("doc_id", *count, F.sha2(joined(first), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores)


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
__all__ = ["KINDS", "find", "luhn", "mask", "mod97", "spans"]
