"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The base kinds (email, ip, card, phone) are proposed leftmost and without overlaps, and stay if their check
holds. Further kinds (iban, ssn, local phone, birth date) start from a prior, gain by a checksum or plausible digits, gain or lose by words nearby, and
stay from THRESHOLD on. Every pattern is tried only where it can start, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.frames import arrow_map, bounded_batches
from talkloom.llm.words import chunks, sums_by_text

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "local_phone", "birth_date")
THRESHOLD = 0.6
NEAR = 48  # characters on either side of a span in which words count

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_FOR = {
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "telefono"},
    "birth_date": {"born", "birth", "birthday", "dob", "geboren", "nacido"},
}
_AGAINST = {"example", "version", "order", "invoice", "ticket", "page", "isbn", "model", "part"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """A local part cannot hold an @, so each @ is looked at once: the run before it, the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield Span("email", start, domain.end(), 0.9)
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[Span]:
    """A match can only start where a run of digits does; a run that fails at its start fails everywhere."""
    done = 0
    for run in _DIGITS.finditer(text):
        if run.start() >= done and (m := _IP.match(text, run.start())):
            done = m.end()
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
                yield Span("ip", m.start(), m.end(), 0.8)


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text)) + list(_ips(text))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", m.start(), m.end(), 0.9))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(Span("phone", m.start(), m.end(), 0.8))
    return out


def _context(text: str, start: int, end: int, kind: str) -> float:
    """Words for a kind count on both sides; words against it name what follows and count before the span only."""
    before = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start])}
    behind = {w.lower() for w in _WORD.findall(text[end:end + NEAR])}
    return 0.35 * bool((before | behind) & _FOR[kind]) - 0.3 * bool(before & _AGAINST)


def _ibans(text: str) -> Iterator[Span]:
    """The pattern may take in a short word behind, so ends at its spaces are tried as well, longest first.

    The search goes on behind an IBAN, and inside a match that holds none at its start.
    """
    m = _IBAN.search(text)
    while m:
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
        end = next((e for e in ends if _IBAN.fullmatch(text, m.start(), e) and mod97(text[m.start():e].replace(" ", ""))), None)
        if end:
            yield Span("iban", m.start(), end, 0.8)
        m = _IBAN.search(text, end or m.start() + 1)


def _proposals(text: str) -> Iterator[Span]:
    yield from _ibans(text)
    for m in _SSN.finditer(text):
        plausible = m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
        yield Span("ssn", m.start(), m.end(), 0.3 + 0.2 * plausible)
    for m in _LOCAL_PHONE.finditer(text):
        yield Span("local_phone", m.start(), m.end(), 0.35 + 0.1 * (m[0][0] == "("))
    for m in _DATE.finditer(text):
        yield Span("birth_date", m.start(), m.end(), 0.3)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the method adds); an added span never lies inside a base span."""
    base, added = base_spans(text), []
    for p in _proposals(text):
        score = round(p.score + _context(text, p.start, p.end, p.kind), 2)
        if score >= THRESHOLD and not any(b.start <= p.start and p.end <= b.end for b in base):
            added.append(p._replace(score=score))
    return base, added


def listed(spans: list[Span]) -> str:
    place = {kind: i for i, kind in enumerate(BASE + MORE)}
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (place[s.kind], s.start)))


_SPAN = "array<struct<kind:string,start:long,end:long,score:double,value:string,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string()), ("base", pa.bool_())]))


def _found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column(1)
    for chunk in chunks(texts):
        # Every kind needs a digit or an @: other texts are not even decoded.
        hit = sums_by_text((chunk.data == 64) | ((chunk.data >= 48) & (chunk.data <= 57)), chunk.bounds) > 0
        out = []
        for t in range(chunk.texts):
            spans: list[dict] = []
            if hit[t]:
                text = texts[chunk.first + t].as_py()
                base, added = all_spans(text)
                spans = [{**s._asdict(), "value": text[s.start:s.end], "base": own} for own, some in ((True, base), (False, added)) for s in some]
            out.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.texts), pa.array(out, _SPAN_TYPE)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of docs(doc_id, text); spans(kind, start, end, score, value, base) in code points.

    Null and empty texts have no spans. Rows with one id, or none, are looked at each. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _found, f"doc_id long, spans {_SPAN}")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and digests of personal_data()'s rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(BASE), batch.num_rows), np.int64)
        hashes, names = [], []
        for i, spans in enumerate(batch.column(1).to_pylist()):
            found = [(s["base"], Span(s["kind"], s["start"], s["end"], s["score"])) for s in spans]
            base = [s for own, s in found if own]
            for s in base:
                counts[BASE.index(s.kind), i] += 1
            hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
            names.append(listed([s for _, s in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(hashes, pa.string()), pa.array(names, pa.string())],
                                         names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return arrow_map(rows, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")
