"""Secret scan with structural confirmation.

Two layers of spans. The base layer is three patterns (assignments, access
keys, hex runs). The structural layer looks at base64 (either alphabet) and hex
candidates, on one line or wrapped over lines of equal length, and reports one
only when its content parses:

* ``token``: three base64url parts whose first two decode to JSON objects, the
  first with an ``alg`` or ``typ`` member (a signed-token header);
* ``der``: base64 or hex that decodes to a SEQUENCE whose nested lengths fill it
  exactly and that has the members of a private key: a version and the numbers
  of an RSA or DSA key, a version and the octets of an elliptic-curve key, a
  version, an algorithm and octets, or an encryption header and octets;
* ``pem``: an armoured private key block whose body is such a SEQUENCE, or is
  encrypted as its header lines say;
* ``openssh``: base64 that decodes to an OpenSSH private key, its
  length-prefixed fields in place.

What decodes to text that is itself such a candidate is decoded again, ``NESTED``
times at most. Public keys and certificates are no secrets and are not reported.

Spans are code point offsets, end exclusive. Defined results: a null text is
empty and has no span; repeated rows are scanned one by one; other columns are
ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", "token", "der", "pem", "openssh"))}
MIN_ASSIGN, MIN_ACCESS, MIN_RUN = 8, 16, 32

SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{40,}|[A-Za-z0-9_-]{40,})={0,2}(?![A-Za-z0-9+/_-])")
ANYHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
#: A line that holds nothing but a candidate, possibly indented or quoted.
BODY = re.compile(r"^[ \t>]*([A-Za-z0-9+/]+={0,2})[ \t\r]*$", re.M)
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*((?:[A-Za-z][A-Za-z0-9-]*: [^\n]*\n)*)"
                 r"([A-Za-z0-9+/=\s]+)-----END \1-----")
OPENSSH = b"openssh-key-v1\0"
NESTED = 3

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that reach its length."""
    low = text.lower()
    out: list[Span] = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if long_run(text):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def long_run(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= MIN_RUN


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at:at + k], "big")
        at += k
        if n < 0x80:
            return None  # not the shortest form
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill the range exactly, else None."""
    out = []
    while begin < end:
        e = element(data, begin, end)
        if e is None:
            return None
        out.append(e)
        begin = e[2]
    return out


def is_key(data: bytes) -> bool:
    """A SEQUENCE over all of ``data`` with the members of a private key."""
    top = element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts or len(parts) < 2 or any(
            t == 0x30 and children(data, a, b) is None for t, a, b in parts):
        return False
    kinds, (tag, lo, hi) = [t for t, _, _ in parts], parts[0]
    if tag == 0x02 and hi - lo == 1 and data[lo] <= 3:  # a version
        numbers = len(parts) >= 6 and all(t == 0x02 for t in kinds[:6])
        octets = kinds[1] == 0x04 or kinds[1:3] == [0x30, 0x04]
        return numbers or octets
    if kinds == [0x30, 0x04]:  # an encryption header, then octets
        inner = children(data, lo, hi)
        return bool(inner) and inner[0][0] == 0x06
    return False


def is_openssh(data: bytes) -> bool:
    """The fixed opening, then cipher, derivation, options, and as many public
    keys as it says, each with its length."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        if at + 4 > len(data):
            return False
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    return 1 <= keys <= 16 and at + 4 + int.from_bytes(data[at:at + 4], "big") <= len(data)


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unhex(text: str) -> bytes | None:
    try:
        return bytes.fromhex(text)
    except ValueError:
        return None


def json_part(part: str) -> dict | None:
    data = unbase64(part)
    try:
        value = json.loads(data) if data and data[:1] == b"{" else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def armoured(text: str) -> Iterator[Span]:
    for m in PEM.finditer(text):
        data = unbase64("".join(m[3].split()))
        if data and (is_key(data) or is_openssh(data) or ("ENCRYPTED" in m[2] and len(data) % 8 == 0)):
            yield m.start(), "pem", m.end()


def kind_of(data: bytes | None, depth: int = 1) -> str | None:
    """What decoded bytes are: a key, an armoured key, or text to decode again."""
    if not data:
        return None
    if is_key(data):
        return "der"
    if is_openssh(data):
        return "openssh"
    if depth < NESTED and data.isascii():
        text = data.decode()
        if any(True for _ in armoured(text)):
            return "pem"
        inner = "".join(text.split())
        if len(inner) >= MIN_RUN:
            return kind_of(unbase64(inner), depth + 1) or kind_of(unhex(inner), depth + 1)
    return None


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and joined content of runs of lines that hold nothing else: all
    as long as the first but the last, which may be shorter."""
    run: list[re.Match] = []

    def whole() -> Iterator[tuple[int, int, str]]:
        if len(run) > 1:
            yield run[0].start(1), run[-1].end(1), "".join(m[1] for m in run)

    for m in BODY.finditer(text):
        follows = bool(run) and m.start() == run[-1].end() + 1 and len(run[-1][1]) == len(run[0][1])
        if not follows or len(m[1]) > len(run[0][1]):
            yield from whole()
            run = []
        if run or len(m[1]) >= MIN_RUN:
            run.append(m)
    yield from whole()


def structural_spans(text: str) -> list[Span]:
    out: list[Span] = list(armoured(text)) if "-----BEGIN " in text else []
    if not long_run(text):
        return out
    for m in SIGNED.finditer(text):
        head = json_part(m[1])
        if head is not None and ("alg" in head or "typ" in head) and json_part(m[2]) is not None:
            out.append((m.start(), "token", m.end()))

    def add(start: int, end: int, content: str) -> None:
        if not any(a < end and start < b for a, k, b in out if k != "token"):
            kind = kind_of(unbase64(content)) or kind_of(unhex(content))
            if kind:
                out.append((start, kind, end))

    for start, end, content in wrapped(text):
        add(start, end, content)
    for pattern in (BASE64, ANYHEX):
        for m in pattern.finditer(text):
            add(m.start(), m.end(), m[0])
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], ORDER[s[1]], s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, number of all spans, the
    digest of the base spans and all spans as text. A map over rows: no
    shuffle, and memory is one batch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b.text:
                t = t or ""
                base = base_spans(t)
                kinds = [k for _, k, _ in base]
                spans = base + structural_spans(t)
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(spans),
                            hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            f = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_spans", "base_sha256", "spans"])
            f.insert(0, "doc_id", b.doc_id.to_numpy())
            yield f

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInPandas(rows, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, "
                                         "n_spans long, base_sha256 string, spans string")
