"""Secret scan: pattern spans, and spans confirmed by their inner structure.

Three plain patterns give the base spans.  The method adds spans only after it
has decoded a candidate and understood what is inside:

* ``jwt``: a dotted token whose first part decodes to a JSON object that names
  an algorithm, and whose second decodes to a JSON object; it may follow other
  token characters directly;
* ``key``: base64 (with or without PEM lines) or hex that decodes to a private
  key: ASN.1 DER whose nested lengths add up exactly and whose integers start
  as PKCS#1, PKCS#8 or SEC 1 say, or an OpenSSH key with consistent length
  prefixes.

A run of base64 or hex that decodes to anything else is not reported.

All steps take time in proportion to the text, whatever it holds: a token's
header is found from its end, and of a key's candidate only the bytes that hold
nested lengths are decoded.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import table

KINDS = ("assign", "access", "hex", "jwt", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: how the base64 of { and a quote or white space starts; and runs of token characters
TOKEN_START = re.compile(r"ey[ABIJ]|ew[klop01]")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]+", re.A)
#: between the lines of a key: a line break, as such or as in a JSON string, and indentation
BREAK = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t]*", re.A)
#: base64 on one line or folded as in PEM files; a DER sequence starts with M, an OpenSSH key with b3BlbnNzaC1rZXktdjE
HEAD = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA", re.A)
BASE64 = re.compile(rf"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?:{HEAD.pattern})[A-Za-z0-9+/]+(?:{BREAK.pattern}[A-Za-z0-9+/]+)*={{0,2}}", re.A)
OPENSSH = b"openssh-key-v1\0"
LEAST_KEY = 40  # bytes
MOST_FIELDS = 12  # no private key has more fields side by side
#: hex that starts as a DER sequence or an OpenSSH key
HEX_KEY = re.compile(rf"(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]{{{2 * LEAST_KEY}}})(?:30|6f70656e7373682d6b65792d7631|6F70656E7373682D6B65792D7631)[0-9A-Fa-f]+", re.A)


class Base64:
    """Bytes of base64 text from ``start`` on, decoded where they are asked for."""

    def __init__(self, text: str, start: int):
        self.text, self.start = text, start
        n = len(text) - start
        self.size = n // 4 * 3 + max(0, n % 4 - 1)
        self.whole = n % 4 != 1

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self[at : at + 1][0]
        a, b, _ = at.indices(self.size)
        if a >= b:
            return b""
        lo = self.start + a // 3 * 4
        return (_decode(self.text[lo : self.start + min(-(-b // 3) * 4, len(self.text) - self.start - (not self.whole))]) or b"")[a % 3 : a % 3 + b - a]


Data = bytes | Base64


def _header(data: Data, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at ``at``; None unless it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if n < 0x80 or n >> (8 * (width - 1)) == 0:
            return None  # DER uses the shortest form
    return (tag, at, at + n) if at + n <= end else None


def _children(data: Data, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if len(out) == MOST_FIELDS or (h := _header(data, at, end)) is None:
            return None
        out.append(h)
        at = h[2]
    return out


def is_der_key(data: Data, end: int) -> bool:
    """A DER sequence that ends at ``end`` and has the fields of a private key."""
    top = _header(data, 0, end)
    if top is None or top[0] != 0x30 or top[2] != end:
        return False
    parts = _children(data, top[1], top[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags, version = [p[0] for p in parts], data[parts[0][1]]
    if version == 0 and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1: version, modulus, exponents, primes, ...
    if version == 0 and tags == [0x02] * 6:
        return True  # DSA: version, p, q, g, public and private number
    if version in (0, 1) and len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06  # PKCS#8: algorithm id, octets
    if version == 1 and tags[1] == 0x04:
        return all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1: octets, curve, point
    return False


def openssh_end(data: Data) -> int | None:
    """Where an OpenSSH private key ends: magic, names, count, that many public
    keys and the private part, each under its length.  None for anything else."""
    if data[: len(OPENSSH)] != OPENSSH:
        return None
    at = len(OPENSSH)

    def field() -> int | None:
        """Length of the next field."""
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return n

    names = [field(), field(), field()]  # cipher, derivation, its options
    if None in names or not names[0]:
        return None
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return None
    return None if None in [field() for _ in range(count + 1)] else at


def key_end(data: Data) -> int | None:
    """Length of the private key at the start of ``data``."""
    if len(data) < LEAST_KEY:
        return None
    if (end := openssh_end(data)) is not None:
        return end
    top = _header(data, 0, len(data))
    return top[2] if top is not None and top[2] >= LEAST_KEY and is_der_key(data, top[2]) else None


def _decode(part: str, urlsafe: bool = False) -> bytes | None:
    part = part.rstrip("=")
    if len(part) % 4 == 1:
        return None
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except binascii.Error:
        return None


def _object(data: bytes | None) -> dict | None:
    try:
        out = json.loads(data or b"")
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _opening(data: bytes) -> int | None:
    """Place of the brace that the last one closes, found from the end."""
    depth, at = 0, len(data.rstrip()) - 1
    if at < 0 or data[at] != 0x7D:
        return None
    while at >= 0:
        c = data[at]
        if c == 0x7D:
            depth += 1
        elif c == 0x7B:
            depth -= 1
            if not depth:
                return at
        elif c == 0x22:  # back to the quote that opens the string
            while True:
                at = data.rfind(b'"', 0, at)
                if at < 0:
                    return None
                escapes = at
                while escapes and data[escapes - 1] == 0x5C:
                    escapes -= 1
                if (at - escapes) % 2 == 0:
                    break
                at = escapes
        at -= 1
    return None


def header_start(part: str) -> int | None:
    """Where in a part without dots the header of a signed token starts that ends
    with it: base64 of a JSON object that names an algorithm.  The object's last
    brace tells where it opens, so there is one candidate for each of four phases."""
    for phase in range(4):
        data = _decode(part[phase:], urlsafe=True)
        if data and (at := _opening(data)) is not None and at % 3 == 0 and (head := _object(data[at:])) and isinstance(head.get("alg"), str):
            return phase + at // 3 * 4
    return None


def _token_spans(text: str) -> Iterator[tuple[int, int]]:
    if not TOKEN_START.search(text):
        return
    for run in TOKEN_RUN.finditer(text):
        parts = run[0].split(".")
        if len(parts) < 2 or not TOKEN_START.search(run[0]):
            continue
        at, k = run.start(), 0
        while k < len(parts) - 1:
            start = header_start(parts[k]) if TOKEN_START.search(parts[k]) else None
            if start is not None and _object(_decode(parts[k + 1], urlsafe=True)) is not None:
                n = min(3, len(parts) - k)
                end = at + sum(map(len, parts[k : k + n])) + n - 1
                yield at + start, end
            else:
                n = 1
            at += sum(map(len, parts[k : k + n])) + n
            k += n


def _run_spans(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Keys in one run of base64 lines; each may start at any line."""
    lines, at = [], lo
    for b in BREAK.finditer(text, lo, hi):
        lines.append((at, b.start()))
        at = b.end()
    lines.append((at, hi))
    whole = "".join(text[a:b] for a, b in lines).rstrip("=")
    first, done = 0, lo  # where the line begins in ``whole``
    for k, (a, b) in enumerate(lines):
        rest, first = first, first + b - a
        if a < done or not HEAD.match(text, a):
            continue
        data = Base64(whole, rest)
        end = key_end(data)
        if end is None:
            continue
        if end == len(data) and data.whole:
            yield a, hi
            return
        # text follows on further lines: the span ends where the lengths inside say
        need, j = -(-end * 4 // 3), k
        while need > lines[j][1] - lines[j][0]:
            need -= lines[j][1] - lines[j][0]
            j += 1
        done = lines[j][0] + need
        yield a, done


def _key_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in BASE64.finditer(text):
        if len(m[0]) >= LEAST_KEY:
            yield from _run_spans(text, *m.span())
    for m in HEX_KEY.finditer(text):
        end = key_end(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))
        if end is not None:
            yield m.start(), m.start() + 2 * end


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as in ``KINDS``.

    Null and empty texts have none.
    """
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(a, 3, b) for a, b in _token_spans(text)]
    found += [(a, 4, b) for a, b in _key_spans(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every maximal run of spans replaced by ``mark``."""
    out, at, run_end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= run_end:
            out += [text[at:a], mark]
        run_end = max(run_end, b)
        at = run_end
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``doc_id, spans``; one row per row.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows are
    scanned one by one; an empty table gives none.  Texts are scanned whole, however
    long.  Spans of different kinds may overlap; of equal starts the kind listed
    first in ``KINDS`` comes first.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in K.slices(whole, "text"):
                spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = [(s["kind"], s["start"], s["end"]) for s in found]
            base = [s for s in spans if s[0] in KINDS[:3]]
            n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((doc, *n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ``find_secrets`` over the whole documents table; nulls,
    ties and repeated rows as there."""
    return find_secrets(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in ``text`` replaced and
    ``n_chars`` (where there is such a column) counted anew in the texts that changed.

    Null and empty texts stay as they are, repeated rows change alike, and overlapping
    spans become one mark.  Columns of other names pass through.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                clean = [redact(t, s) if (s := scan(t)) else t for t in texts]
                columns = {n: batch.column(n) for n in names}
                columns["text"] = pa.array(clean, pa.string())
                if "n_chars" in columns:
                    counts = zip(columns["n_chars"].to_pylist(), texts, clean, strict=True)
                    columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in counts], columns["n_chars"].type)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)
