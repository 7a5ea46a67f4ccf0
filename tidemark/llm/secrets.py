"""Secret scans with structural confirmation.

Base spans come from three fixed patterns (assign, access, hex). The method adds spans of candidates that
decode: base64 (also wrapped over lines) or hex runs are decoded and accepted only if the bytes parse as a key: DER whose lengths nest
exactly and whose elements have the shape of a key or certificate (a signature's two numbers have not), SSH wire format with
the fields of its algorithm, an OpenSSH private key field by field, a PEM block (header lines and escaped line breaks
allowed) around one of these or, with an encryption header, around whole cipher blocks, or a dotted triple with a
signed-token header. A run that merely looks random is not reported. Public keys and certificates are key encodings too.

Defined results: a null text counts as empty; empty texts have no spans; repeated rows give repeated results;
spans are offsets in code points, end exclusive. An empty table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, arrow_rows, keyed_text

# The three base patterns, ASCII letters in either case for the first.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_ASSIGN = 6

#: Runs that can hold an encoded key or a signed token; shorter ones can't hold any of the structures below.
TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{32,}={0,2}")
HEX_ANY = re.compile(rb"(?:[0-9a-fA-F]{2}){24,}")
#: Lines of base64 under one another, the last one perhaps shorter or padded.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}+\r?\n)++(?:[A-Za-z0-9+/]++={0,2})?")
PEM_BEGIN = re.compile(rb"-----BEGIN ([A-Z0-9 ]*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE))-----")
PEM_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9-]*:[^\n]*\n")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "ssh", "pem")
_RANK = {k: i for i, k in enumerate(KINDS)}
# SSH algorithms with the number of fields of a public key, the name included.
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3}
_OPENSSH_MAGIC = b"openssh-key-v1\0"
_TOKEN_ALGS = re.compile(r"(?:HS|RS|ES|PS)(?:256|384|512)|ES256K|EdDSA|none", re.ASCII)


def unbase64(run: bytes) -> bytes | None:
    """Either alphabet, padding optional; None if the length or the alphabet mix can't be base64."""
    body = run.rstrip(b"=")
    if len(body) % 4 == 1 or (b"+" in body or b"/" in body) and (b"-" in body or b"_" in body):
        return None
    try:
        return base64.b64decode(body.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the element at `at`; None unless its definite length fits in `end`."""
    if at + 2 > end:
        return None
    tag, first, body = data[at], data[at + 1], at + 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or body + n > end or data[body] == 0:
            return None
        size, body = int.from_bytes(data[body : body + n], "big"), body + n
        if size < 0x80:
            return None  # not the shortest form
    return (tag, body, body + size) if body + size <= end else None


def der_tree(data: bytes, at: int, end: int) -> list[tuple[int, int, list, int]] | None:
    """(tag, length, elements within, start of content) of the elements that fill at..end exactly, however deep; None if any length doesn't fit."""
    top: list[tuple[int, int, list, int]] = []
    open_parts = [(at, end, top)]
    while open_parts:
        at, end, out = open_parts.pop()
        while at < end:
            e = der_element(data, at, end)
            if e is None:
                return None
            within: list = []
            out.append((e[0], e[2] - e[1], within, e[1]))
            if e[0] & 0x20:
                open_parts.append((e[1], e[2], within))
            at = e[2]
    return top


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE whose lengths add up and whose elements are those of a private or public key or a certificate."""
    top = der_tree(data, 0, len(data)) if len(data) >= 24 and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    parts = top[0][2]
    tags = [x[0] for x in parts]
    algorithm = lambda k: len(tags) > k and tags[k] == 0x30 and bool(parts[k][2]) and parts[k][2][0][0] == 0x06
    if tags[:1] == [0x02] and parts[0][1] <= 1:  # a version first
        version = data[parts[0][3]] if parts[0][1] else 99
        numbers = set(tags) == {0x02} and version <= 1 and len(tags) in (6, 9) and parts[1][1] >= 32
        return numbers or algorithm(1) and tags[2:3] == [0x04] or tags[1:2] == [0x04] and parts[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1} or version == 3 and algorithm(1)
    if tags == [0x02, 0x02]:  # modulus and exponent; a signature's numbers are of one size
        return parts[0][1] >= 64 and parts[1][1] <= 8
    # An encrypted key, a public key, a certificate.
    return algorithm(0) and tags[1:] in ([0x04], [0x03]) or tags == [0x30, 0x30, 0x03] and algorithm(1)


def ssh_strings(data: bytes, at: int = 0) -> list[bytes] | None:
    """The length-prefixed fields that fill data from at exactly; None if they don't."""
    fields = []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields if at == len(data) else None


def is_ssh_key(data: bytes) -> bool:
    """A public key with the fields of its algorithm, or an OpenSSH private key whose header, public and private parts parse."""
    if not data.startswith(_OPENSSH_MAGIC):
        fields = ssh_strings(data)
        return bool(fields) and _SSH_FIELDS.get(fields[0]) == len(fields) and all(fields[1:])
    head, at = [], len(_OPENSSH_MAGIC)
    for _ in range(3):  # cipher, derivation, its options
        n = int.from_bytes(data[at : at + 4], "big")
        head.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    keys, rest = int.from_bytes(data[at : at + 4], "big"), ssh_strings(data, at + 4)
    if not rest or keys < 1 or len(rest) != keys + 1 or not all(map(is_ssh_key, rest[:-1])) or not rest[-1] or len(rest[-1]) % 8:
        return False
    return head[0] != b"none" or rest[-1][:4] == rest[-1][4:8]  # an open private part begins with a number twice


def pem_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """PEM blocks that hold a key, or are encrypted; a block has no dashes between its lines of dashes."""
    found = []
    for m in PEM_BEGIN.finditer(raw):
        at, tail = raw.find(b"-----", m.end()), b"-----END " + m[1] + b"-----"
        if at < 0 or not raw.startswith(tail, at):
            continue
        body = raw[m.end() : at].replace(b"\\r", b"").replace(b"\\n", b"\n").lstrip()
        headers = b""
        while h := PEM_HEADER.match(body, len(headers)):
            headers = body[: h.end()]
        data = unbase64(re.sub(rb"\s", b"", body[len(headers) :]))
        if data and (key_kind(data) or b"ENCRYPTED" in headers and b"DEK-Info:" in headers and len(data) % 8 == 0 and m[1].endswith(b"PRIVATE KEY")):
            found.append((m.start(), at + len(tail), "pem"))
    return found


def is_signed_token(run: bytes) -> bool:
    """Three dotted parts, the first two of which decode to JSON objects, the first with a known algorithm."""
    head, body, signature = run.split(b".", 2)
    try:
        header, claims = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not _TOKEN_ALGS.fullmatch(str(header.get("alg"))):
        return False
    return header["alg"] == "none" or len(signature) >= 16


def key_kind(data: bytes | None) -> str | None:
    return None if not data else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the base patterns."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(raw.lower()) if len(m[1]) >= MIN_ASSIGN] if b":" in raw or b"=" in raw else []
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(raw)]
    return found + [(*m.span(), "hex") for m in HEX.finditer(raw)]


class Taken:
    """Spans already found, merged and in order, so that whether another one overlaps them is a bisection."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k == 0 or self.ends[k - 1] <= start


def wrapped_runs(raw: bytes) -> Iterator[tuple[int, list[int]]]:
    """(start, ends to try) of base64 wrapped at any width: lines of equal length, with and without the line after them, which may be the rest or another text."""
    for m in WRAPPED.finditer(raw):
        lines, at = [], m.start()
        for line in m[0].split(b"\n"):
            if body := line.rstrip(b"\r"):
                lines.append((at, at + len(body)))
            at += len(line) + 1
        k = 0
        while k < len(lines):
            size, first = lines[k][1] - lines[k][0], k
            while k < len(lines) and lines[k][1] - lines[k][0] == size:
                k += 1
            rest = [lines[k][1]] if k < len(lines) and lines[k][1] - lines[k][0] < size else []
            if rest or k - first > 1:
                yield lines[first][0], [*rest, lines[k - 1][1]]


def confirmed_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of candidates whose decoded structure parses; base64 inside a token or PEM block isn't reported again."""
    found = []
    if b"eyJ" in raw:
        found += [(*m.span(), "jwt") for m in TOKEN.finditer(raw) if is_signed_token(m[0])]
    if b"-----BEGIN " in raw:
        found += pem_spans(raw)
    taken = Taken(found)
    found += [(*m.span(), kind) for m in HEX_ANY.finditer(raw) if taken.free(*m.span()) and (kind := key_kind(bytes.fromhex(m[0].decode())))]
    taken = Taken(found)
    for start, ends in wrapped_runs(raw) if b"\n" in raw else ():
        for end in ends:
            if taken.free(start, end) and (kind := key_kind(unbase64(raw[start:end].replace(b"\r", b"").replace(b"\n", b"")))):
                found.append((start, end, kind))
                break
    taken = Taken(found)
    found += [(*m.span(), kind) for m in BASE64.finditer(raw) if taken.free(*m.span()) and (kind := key_kind(unbase64(m[0])))]
    return found


def places(raw: bytes, at: list[int]) -> dict[int, int]:
    """Code points before each of the byte places, in one pass over the text."""
    out, last, count = {}, 0, 0
    for place in sorted(set(at)):
        count += len(raw[last:place].decode("utf-8", "surrogatepass"))
        out[place] = count
        last = place
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text in code points, ordered by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    found = base_spans(raw) + confirmed_spans(raw)
    if not text.isascii():
        point = places(raw, [x for s, e, _ in found for x in (s, e)])
        found = [(point[s], point[e], k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], _RANK[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of struct(start, end, kind)) for every row of docs; narrow, one pass, no shuffle."""

    def work(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t)] for t in c["text"]]}

    return arrow_rows(keyed_text(docs, id_col, text_col), work, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask; overlapping spans are merged first. All rows and columns are kept."""

    def masked(t: str | None) -> str | None:
        out, at = [], 0
        for start, end, _ in scan(t) if t else ():
            if start >= at:
                out += [t[at:start], mask]
            at = max(at, end)
        return "".join(out) + t[at:] if out else t

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        field = batch.schema.field(at)
        return batch.set_column(at, field, pa.array([masked(t) for t in batch.column(at).to_pylist()], field.type))

    return arrow_batches(docs, work)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from scan_secrets."""
    found = scan_secrets(docs)
    token = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, token), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", token), ",").alias("spans"),
    )


def brute_base(text: str) -> str:
    """The contract's base spans, pattern by pattern as it states them; for tests."""
    found = []
    letters = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for kind, pattern, group, least in (
        ("assign", rf"({letters})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        found += [(*m.span(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return joined(sorted(found, key=lambda x: (x[0], _RANK[x[2]])))


def digest_of(text: str) -> str:
    return hashlib.sha256(brute_base(text).encode()).hexdigest()
