"""Secret scans with structural confirmation.

Patterns find three base kinds. Beyond them, every long run of base64, base64url
or hex is decoded, also over line breaks, and only reported when the bytes parse:
DER private keys whose nested lengths add up, OpenSSH keys whose length-prefixed
fields do, PEM text that holds a key, and signed tokens whose header and payload
are JSON objects with an algorithm. PEM text and tokens are also found as they are.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import operator_conf, scratch

ship_by_value(__name__)

#: Kinds in report order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "pem")
BASE = KINDS[:3]
# Patterns run on UTF-8 bytes: all classes are ASCII, so other characters end a match as they do in text.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
ASSIGN_WORDS = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)
DER64 = re.compile(rb"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/]{40,}={0,2}")
DER_HEX = re.compile(rb"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{60,}")
OPENSSH64 = re.compile(rb"b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]{40,}={0,2}")
OPENSSH_HEX = re.compile(rb"6f70656e7373682d6b65792d763100[0-9A-Fa-f]{60,}", re.IGNORECASE)
# a match starts at every part, as the parts before a token's header may look like it
TOKEN = re.compile(rb"[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*")
JWT = re.compile(rb"(?<![A-Za-z0-9_-])(?=(%b))" % TOKEN.pattern)
#: First characters of an encoded ``{``.
OBJECT64 = (b"ew", b"ex", b"ey", b"ez")
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
#: Line breaks inside a run, also written as escapes, with the next line's indent.
BREAK = re.compile(rb"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
RUN64 = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?+([A-Za-z0-9+/_-]{16,}+(?:%b+[A-Za-z0-9+/_-]++)*+={0,2})" % BREAK.pattern)
RUN_HEX = re.compile(rb"(?<![0-9A-Fa-f])([0-9A-Fa-f]{16,}+(?:%b+[0-9A-Fa-f]++)*+)" % BREAK.pattern)
#: Characters of the shortest run that can hold a key.
LEAST_64, LEAST_HEX = 40, 60
OPENSSH_MAGIC = b"openssh-key-v1\x00"


def _decode64(run: bytes, url: bool = False) -> bytes | None:
    run = run.rstrip(b"=")
    if len(run) % 4 == 1:
        return None
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(run + b"=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _decode_hex(run: bytes) -> bytes | None:
    return binascii.unhexlify(run) if len(run) % 2 == 0 else None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the elements that fill ``data`` exactly, None if lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            n = int.from_bytes(data[at:at + wide], "big")
            at += wide
        if at + n > len(data):
            return None
        out.append((tag, data[at:at + n]))
        at += n
    return out


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, DSA or SEC1: one SEQUENCE whose nested lengths add up."""
    top = der_fields(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = der_fields(top[0][1])
    if not fields or len(fields) < 2 or fields[0][0] != 0x02 or fields[0][1] not in (b"\x00", b"\x01"):
        return False
    tags = [t for t, _ in fields]
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: algorithm identifier, then the key
        algorithm = der_fields(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm[0][1]) >= 3 and len(fields[2][1]) >= 16
    if len(tags) in (6, 9, 10) and set(tags[:9]) == {0x02}:  # PKCS#1 or DSA: whole numbers only
        return all(v for _, v in fields) and len(fields[1][1]) >= 32
    return tags[:2] == [0x02, 0x04] and 16 <= len(fields[1][1]) <= 66 and set(tags[2:]) <= {0xA0, 0xA1}  # SEC1


def is_openssh_key(data: bytes) -> bool:
    """openssh-key-v1: cipher, kdf and options, a key count, then as many public keys and the private part."""
    return _openssh_end(data) is not None


def _openssh_end(data: bytes) -> int | None:
    if not data.startswith(OPENSSH_MAGIC):
        return None
    at = len(OPENSSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n:at]

    head = [field() for _ in range(3)]
    if None in head or not head[0]:
        return None
    count = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return at if 1 <= count <= 16 and all(field() for _ in range(count)) and field() else None


def is_signed_token(run: bytes) -> bool:
    header, payload, signature = run.split(b".")
    try:
        head, body = (json.loads(_decode64(x, url=True) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return (isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)
            and (bool(signature) or head["alg"].lower() == "none") and len(signature) % 4 != 1)


def _pem_holds_key(kind: bytes, body: bytes) -> bool:
    lines = body.replace(b"\\n", b"\n").replace(b"\\r", b"").split()
    data = _decode64(re.sub(rb"[^A-Za-z0-9+/=]", b"", b"".join(x for x in lines if b":" not in x and b"," not in x)))
    if data is None:
        return False
    if b"ENCRYPTED" in kind or b"ENCRYPTED" in body:
        return len(data) >= 32
    return is_openssh_key(data) if b"OPENSSH" in kind else is_der_private_key(data)


def _der_end(data: bytes, at: int) -> int | None:
    """End of the DER private key that starts at ``at``."""
    head = data[at:at + 6]
    if len(head) < 6 or head[0] != 0x30:
        return None
    wide = head[1] & 0x7F if head[1] & 0x80 else 0
    if wide > 4:
        return None
    end = at + 2 + wide + (int.from_bytes(head[2:2 + wide], "big") if wide else head[1])
    return end if end <= len(data) and data[at + 2 + wide:at + 3 + wide] == b"\x02" and is_der_private_key(data[at:end]) else None


def _text_secrets(data: bytes) -> list[tuple[int, int, int]]:
    """Spans of PEM keys and signed tokens in plain bytes."""
    out = []
    if b"-----BEGIN " in data:
        out += [(m.start(), 6, m.end()) for m in PEM.finditer(data) if _pem_holds_key(m[1], m[2])]
    if data.count(b".") >= 2:
        out += [(m.start(1), 5, m.end(1)) for m in JWT.finditer(data) if is_signed_token(m[1])]
    return out


def _run_spans(text: bytes, pattern: re.Pattern, least: int, chars: int, size: int, decode: Callable[[bytes], bytes | None]) -> list[tuple[int, int, int]]:
    """Keys in the decoded runs of ``pattern``, ``chars`` characters for ``size`` bytes.

    A key starts with any line of a run and may end before the last one: lines
    around it can look like it. Each place in a unit is decoded once, so the
    work is in proportion to the run.
    """
    out = []
    for m in pattern.finditer(text):
        if m.end(1) - m.start(1) < least:
            continue
        begin, stop = m.start(1), m.start(1) + len(m[1].rstrip(b"="))
        breaks = [x.span() for x in BREAK.finditer(text, begin, stop)]
        starts, ends = [begin] + [e for _, e in breaks], [s for s, _ in breaks] + [stop]
        joined = b"".join(text[s:e] for s, e in zip(starts, ends, strict=True))
        upto = list(accumulate(e - s for s, e in zip(starts, ends, strict=True)))
        first = [0, *upto[:-1]]
        ends[-1] = m.end(1)
        decoded: dict[int, bytes] = {}
        for line, c in enumerate(first):
            r = c % chars
            if r not in decoded:
                whole = len(joined) - r
                decoded[r] = decode(joined[r:len(joined) - (whole % chars == 1)]) or b""
                for s, kind, e in _text_secrets(decoded[r]):
                    out.append((starts[bisect_right(first, r + s * chars // size) - 1], kind,
                                ends[bisect_left(upto, r - (-e * chars // size))]))
            data, at = decoded[r], (c - r) // chars * size
            if (e := _der_end(data, at)) is not None:
                n = r - (-e * chars // size)
                if upto[i := bisect_left(upto, n)] == n:
                    out.append((starts[line], 3, ends[i]))
            elif data.startswith(OBJECT64, at) and (t := TOKEN.match(data, at)) and is_signed_token(t[0]):  # behind bytes of another line
                out.append((starts[line], 5, ends[bisect_left(upto, r - (-t.end() * chars // size))]))
            elif data.startswith(OPENSSH_MAGIC, at) and (e := _openssh_end(data[at:])) is not None:
                out.append((starts[line], 4, ends[bisect_left(upto, r - (-(at + e) * chars // size))]))
    return out


def byte_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, index of kind, end)`` in bytes, sorted."""
    found = []
    if ASSIGN_WORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    checks: list[tuple[int, re.Pattern, Callable[[re.Match], bool]]] = []
    checks.append((3, DER64, lambda m: is_der_private_key(_decode64(m[0]) or b"")))
    checks.append((3, DER_HEX, lambda m: is_der_private_key(_decode_hex(m[0]) or b"")))
    if b"b3BlbnNzaC1rZXktdjEA" in text:
        checks.append((4, OPENSSH64, lambda m: is_openssh_key(_decode64(m[0]) or b"")))
    checks.append((4, OPENSSH_HEX, lambda m: is_openssh_key(_decode_hex(m[0]) or b"")))
    plain = _text_secrets(text)
    bodies = [(s, e) for s, kind, e in plain if kind == 6]
    encoded = plain + [(m.start(), kind, m.end()) for kind, pattern, holds in checks for m in pattern.finditer(text) if holds(m)]
    runs = _run_spans(text, RUN64, LEAST_64, 4, 3, lambda x: _decode64(x.replace(b"-", b"+").replace(b"_", b"/")))
    runs += _run_spans(text, RUN_HEX, LEAST_HEX, 2, 1, binascii.unhexlify)
    encoded += [x for x in runs if not any(s <= x[0] and x[2] <= e for s, e in bodies)]
    return sorted(found + list(set(encoded)))


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as in ``KINDS``."""
    raw = (text or "").encode()
    spans = byte_spans(raw)
    if raw.isascii():
        return [(KINDS[k], s, e) for s, k, e in spans]
    places = sorted({x for s, _, e in spans for x in (s, e)})
    point, at, chars = {}, 0, 0
    for x in places:
        chars += len(raw[at:x].decode())
        point[x] = chars
        at = x
    return [(KINDS[k], point[s], point[e]) for s, k, e in spans]


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [find_secrets(t) for t in b.column("text").to_pylist()]
        base = [[x for x in found if x[0] in BASE] for found in spans]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id")] + [pa.array([sum(x[0] == k for x in found) for found in base], pa.int64()) for k in BASE]
            + [pa.array([hashlib.sha256(_written(x).encode()).hexdigest() for x in base]),
               pa.array([_written(x) for x in spans], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per row of ``docs``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) of base and
    confirmed kinds; the digest covers the base kinds only. Null text counts as
    empty; repeated and null ids keep their own rows; other columns are not read.
    """
    spark = docs.sparkSession
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    with scratch(spark, "secrets") as s, operator_conf(spark):
        return s.table(light.mapInArrow(_scan_batches, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
                                                       "base_sha256 string, spans string"), "result", keep=True)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every found span, overlapping ones joined, replaced by ``mark``."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    joined: list[list[int]] = []
    for _, s, e in spans:
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in joined:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def _redact_batches(at: int, count_at: int | None, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = b.column(at).to_pylist()
            after = [redact(t, mark) for t in before]
            cols = list(b.columns)
            cols[at] = pa.array(after, b.schema.field(at).type)
            if count_at is not None:
                kept = b.column(count_at).to_pylist()
                cols[count_at] = pa.array([n if x is y or x == y else len(y) for n, x, y in zip(kept, before, after, strict=True)],
                                          b.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with found secrets replaced by ``mark``; all rows and columns stay.

    ``count_col``, if present, becomes the new length of changed texts.
    """
    names = docs.columns
    counts = names.index(count_col) if count_col in names else None
    return docs.mapInArrow(_redact_batches(names.index(text_col), counts, mark), docs.schema)
