"""Secret scans with structural confirmation.

Base spans come from three patterns. Beside them a candidate is reported only
if it decodes into the structure that it claims: a signed token whose header
and payload are JSON with an algorithm; a private key in PEM, base64 (on one
line or wrapped) or hex whose DER lengths nest exactly and whose elements are
those of a private key; an encrypted PEM body; an OpenSSH private key whose
length-prefixed fields fill it. Certificates and public keys aren't secrets.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from namewarden.llm.common import map_texts, quoted

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: A run of the class is one match, so a least length in the pattern drops what is too short.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Hex of either case that may be a DER sequence.
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}")
#: A run that may hold signed tokens; its parts lie between dots.
JWT_RUN = re.compile(r"[A-Za-z0-9_.-]+")
#: Label, header lines (folded ones begin with a space) and body; possessive, so that no place is tried twice.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----\s*+((?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+\r?\n(?:[ \t]++[^\s][^\r\n]*+\r?\n)*+)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")
#: Strings, brackets, what lies between them, and what can't stand there.
JSON_PIECE = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]]|[^"{}\[\]\\]++|["\\]', re.DOTALL)
ENCRYPTED = re.compile(r"^(?:Proc-Type:.*ENCRYPTED|DEK-Info:)", re.MULTILINE)
#: How base64 of a DER sequence and of the OpenSSH magic begins.
BLOB = re.compile(r"(?:M[A-I]|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{20,}={0,2}")
#: A line of base64, and what is between it and the next.
LINE, BREAK = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[ \t]*\r?\n[ \t]*")
MAGIC = b"openssh-key-v1\0"
#: Most base64 characters of an OpenSSH key.
SSH_CHARS = 1 << 16


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    text = re.sub(r"\s", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_nests(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> bool:
    """Whether the bytes are DER elements whose lengths, nested ones included, fill them exactly."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 2 or depth > 12:
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return False
        if at + size > end or (tag & 0x20 and not der_nests(data, at, at + size, depth + 1)):
            return False
        at += size
    return True


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that nested DER bytes consist of."""
    out, at = [], 0
    while at < len(data):
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_key(data: bytes | None) -> bool:
    """One DER sequence of the elements of a private key: PKCS #8, plain or encrypted, RSA, DSA or EC."""
    if not data or len(data) < 16 or data[0] != 0x30 or not der_nests(data) or len(set(data)) <= 8:
        return False
    (_, inner), *more = elements(data)
    if more:
        return False
    parts = elements(inner)
    tags = [t for t, _ in parts]
    algorithm = next((c for t, c in parts[:2] if t == 0x30), b"")
    version = bool(tags) and tags[0] == 0x02 and len(parts[0][1]) == 1 and parts[0][1][0] <= 1
    names_one = algorithm[:1] == b"\x06"
    return (version and (tags[:3] == [0x02, 0x30, 0x04] and names_one or tags[:2] == [0x02, 0x04] or len(tags) >= 6 and set(tags[:6]) == {0x02})) or (tags == [0x30, 0x04] and names_one)


def pem_key(headers: str, body: str) -> bool:
    """Whether a PEM body is a private key; an encrypted one, as its headers tell, is any base64 of 16 bytes or more."""
    data = unbase64(body)
    if ENCRYPTED.search(headers):
        return data is not None and len(data) >= 16
    return der_key(data) or ssh_key(data)


def wrapped(text: str, start: int) -> int | None:
    """The end of a private key in base64 over several lines, whose first bytes tell its length; None if it isn't one.

    DER whose length takes over two bytes is too long for a key.
    """
    head = unbase64(text[start : start + 8])
    if not head or len(head) < 6:
        return None
    if head[0] == 0x30:
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        if n > 2:
            return None
        left = -(-(2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])) * 4 // 3)
    else:
        left = SSH_CHARS
    at, lines = start, []
    while (m := LINE.match(text, at)) and len(m[0]) <= left:
        lines.append(m[0])
        left, at = left - len(m[0]), m.end()
        gap = BREAK.match(text, at)
        if not left or not gap or not LINE.match(text, gap.end()):
            break
        at = gap.end()
    if len(lines) < 2 or (head[0] == 0x30 and left):
        return None
    data = unbase64("".join(lines))
    pads = len(text[at : at + 2]) - len(text[at : at + 2].lstrip("="))
    return at + pads if der_key(data) or ssh_key(data) else None


def ssh_key(data: bytes | None) -> bool:
    """An OpenSSH private key: magic, three fields, the number of keys and so many public ones and the private part, which fill the bytes."""
    if not data or not data.startswith(MAGIC):
        return False

    def field(at: int) -> int:
        return at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1

    at = field(field(field(len(MAGIC))))
    keys = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
    if not 1 <= keys <= 16:
        return False
    at += 4
    for _ in range(keys + 1):
        at = field(at)
    return at == len(data)


def token_start(part: str) -> int | None:
    """Where in a part before a dot the header of a signed token begins: base64url of a JSON object that names an algorithm.

    A base64 text's end decodes alike from each fourth place, so four decodings show all places where an object may begin.
    """
    for skip in range(4):
        data = unbase64(part[skip:]) if (len(part) - skip) % 4 != 1 else None
        if not data:
            continue
        shown = data.decode("latin-1").rstrip()
        if not shown.endswith("}"):
            continue
        for at in last_objects(shown):
            if at % 3 == 0 and _header(shown, at):
                return skip + at // 3 * 4
    return None


def last_objects(text: str) -> list[int]:
    """Where an object may begin whose braces close at the text's very end, in order.

    A brace met outside strings on the way from an earlier place closes where
    that way closes it, so none starts there; two readings of a quote are left,
    and each place is looked at a few times.
    """
    met: set[int] = set()
    found = []
    at = text.find('{"')
    while at >= 0:
        if at not in met:
            opened: list[int] = []
            for m in JSON_PIECE.finditer(text, at):
                piece = m[0]
                if piece == "{" or piece == "[":
                    opened.append(m.start())
                    met.add(m.start())
                elif piece == "}" or piece == "]":
                    start = opened.pop()
                    if m.end() == len(text) and text.startswith('{"', start):
                        found.append(start)
                    if not opened:
                        break
                elif piece == "\\" or piece == '"':  # a backslash outside strings, a string without an end
                    break
        at = text.find('{"', at + 1)
    return sorted(found)


def _header(shown: str, at: int) -> bool:
    try:
        found, end = json.JSONDecoder().raw_decode(shown, at)
    except (ValueError, RecursionError):
        return False
    return end == len(shown) and isinstance(found, dict) and isinstance(found.get("alg"), str)


def _object(text: str) -> bool:
    try:
        return isinstance(json.loads(unbase64(text) or b""), dict)
    except (ValueError, RecursionError):
        return False


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of header, payload and signature between dots, each character looked at a few times."""
    out = []
    for m in JWT_RUN.finditer(text):
        if "eyJ" not in m[0] or m[0].count(".") < 2:
            continue
        parts, at, k = m[0].split("."), m.start(), 0
        starts = [at]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        while k + 2 < len(parts):
            head = token_start(parts[k]) if "eyJ" in parts[k] and parts[k + 1] else None
            if head is not None and _object(parts[k + 1]):
                out.append((starts[k] + head, starts[k + 2] + len(parts[k + 2])))
                k += 2
            k += 1
    return out


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, ends exclusive, sorted."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0])):
            found.append((m.start(), 5, m.end()))
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0])):
            found.append((m.start(), 5, m.end()))
    if "eyJ" in text:
        found += [(a, 3, b) for a, b in signed_tokens(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), 4, m.end()) for m in PEM.finditer(text) if pem_key(m[2], m[3])]
    for m in BLOB.finditer(text):
        data = unbase64(m[0])
        if der_key(data):
            found.append((m.start(), 5, m.end()))
        elif ssh_key(data):
            found.append((m.start(), 6, m.end()))
        elif end := wrapped(text, m.start()):
            found.append((m.start(), 5 if m[0][0] == "M" else 6, end))
    return sorted(set(found))


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed, max_entropy) for every row's whole text.

    spans: kind:start:end by start, then kind, comma-joined. n_confirmed: those
    that a structure confirms. max_entropy: of any span, bits per character.
    Null and empty texts have none. Rows keep their number; other columns are
    left out.
    """

    def run(texts: list[str]) -> dict:
        all_spans = [scan(t) for t in texts]
        base = [[s for s in x if s[1] < 3] for x in all_spans]
        return {f"n_{KINDS[k]}": [sum(s[1] == k for s in x) for x in base] for k in range(3)} | {
            "base_sha256": [hashlib.sha256(shown(x).encode()).hexdigest() for x in base],
            "spans": [shown(x) for x in all_spans],
            "n_confirmed": [sum(s[1] >= 3 for s in x) for x in all_spans],
            "max_entropy": [max((entropy(t[a:b]) for a, _, b in x), default=0.0) for t, x in zip(texts, all_spans)],
        }

    return map_texts(docs, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long, max_entropy double", text_col, (id_col,))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover written as ``mark``."""
    out, at = [], 0
    for a, _, b in scan(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with its columns in place, secrets in the text marked and its length counted anew.

    A null text stays null with its length as it was; every row is kept.
    """
    from pyspark.sql import functions as F

    columns = docs.columns
    clean = map_texts(docs, lambda texts: {"__clean": [redact(t) for t in texts]}, "__clean string", text_col, tuple(columns))
    text = F.when(F.col(text_col).isNull(), None).otherwise(F.col("__clean")).alias(text_col)
    length = F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length("__clean").cast("long")).alias(length_col)
    return clean.select(*(text if c == text_col else length if c == length_col else q for c, q in zip(columns, quoted(columns))))
