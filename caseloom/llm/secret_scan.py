"""Secret scan with structural confirmation.

Patterns find what looks like a secret: values assigned to secret-sounding names, access key ids, long runs of hex
digits.  Beyond those, nothing is reported on its looks.  Runs of base64 and hex digits are decoded and
must prove to be what they seem:

* private keys: DER sequences whose nested lengths fill each other to the byte and whose members are those of PKCS#1,
  PKCS#8 (plain or encrypted), SEC 1 or DSA keys, or the length-prefixed fields of an OpenSSH key;
* signed tokens: three base64url segments, a JSON header that names a known algorithm, and a signature as long as that
  algorithm makes it;
* text that was encoded as a whole and holds one of these, at any depth.

Base64 may be plain or URL-safe, wrapped into lines (also as a written ``\\n``), and glued to what stands before
it: all four alignments are decoded, and the key's own length says where it ends.  A span covers the encoded text.

Offsets are code points, ends exclusive.  A row is read on its own, in one pass of each pattern, so cost is linear
in a text's length, however long it is.

Defined cases: null and empty texts have no span.  Repeated rows, null ids and other columns change nothing.  Spans of
different kinds may overlap; ties of a start are in the order of ``KINDS``, then by end.  An empty table gives an
empty table.
"""

from __future__ import annotations

import binascii
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import read_table, text_bytes
from caseloom.llm.registry import query

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "signed_token")
# On bytes with small ASCII letters, so that only those count in either case.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # the runs [0-9a-f]+ of 16 and more
ASSIGNED, ACCESS = 12, 18

_BASE64 = re.compile(
    rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?:(?:\r?\n[ \t]*|\\r\\n|\\n)[A-Za-z0-9+/_-]+)*={0,2}"
)
_BREAK = re.compile(rb"\r?\n[ \t]*|\\r\\n|\\n|=")
_HEX_RUN = re.compile(rb"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
_SEGMENTS = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
_FLAT_OBJECT = re.compile(rb"\{[^{}]*\}\s*\Z")
_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]+\Z")
_URL_SAFE = bytes.maketrans(b"-_", b"+/")
# A sequence that begins with a version or with another sequence, or the OpenSSH magic.
_KEY_START = re.compile(
    rb"\x30(?:[\x00-\x7f]|\x81.|\x82..)(?=\x02\x01[\x00\x01]|\x30)|openssh-key-v1\x00", re.DOTALL
)
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
# Bytes of a signature by algorithm; RSA signatures are as long as their modulus.
SIGNATURES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114),
} | {f"{kind}{bits}": range(128, 2049) for kind in ("RS", "PS") for bits in (256, 384, 512)}

Found = tuple[int, int, str, str]  # start, end, kind, detail


def der_value(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte, one past the last) of the DER value at ``at``, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        wide = size & 0x7F
        if not 1 <= wide <= 4 or start + wide > end:
            return None
        size = int.from_bytes(data[start : start + wide], "big")
        if size < 0x80 or size >> 8 * (wide - 1) == 0:  # not the shortest form
            return None
        start += wide
    return (tag, start, start + size) if start + size <= end else None


def der_members(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``start .. end`` without a gap."""
    out = []
    while start < end:
        value = der_value(data, start, end)
        if value is None or len(out) == 16:  # no key has so many
            return None
        out.append(value)
        start = value[2]
    return out


def _algorithm(data: bytes, value: tuple[int, int, int]) -> bool:
    tag, start, end = value
    members = der_members(data, start, end) if tag == _SEQUENCE else None
    return bool(members) and members[0][0] == _OID and members[0][2] > members[0][1]


def _number(data: bytes, value: tuple[int, int, int]) -> int:
    return int.from_bytes(data[value[1] : value[2]], "big")


def der_key(data: bytes, at: int) -> tuple[str, int] | None:
    """(kind, end) of the private key that is encoded at ``at``."""
    outer = der_value(data, at, len(data))
    if outer is None or outer[0] != _SEQUENCE:
        return None
    members = der_members(data, outer[1], outer[2])
    if not members or len(members) < 2:
        return None
    tags, end = [m[0] for m in members], outer[2]
    if tags == [_SEQUENCE, _OCTETS]:
        long_enough = members[1][2] - members[1][1] >= 16
        return ("encrypted_pkcs8", end) if long_enough and _algorithm(data, members[0]) else None
    if tags[0] != _INTEGER or members[0][2] - members[0][1] != 1:
        return None
    version = _number(data, members[0])
    if version in (0, 1) and len(tags) in (9, 10) and tags[1:9] == [_INTEGER] * 8:
        big = members[1][2] - members[1][1] >= 32 and _number(data, members[1]) & 1
        return ("pkcs1_rsa", end) if big else None
    if version == 0 and tags[1:] == [_INTEGER] * 5:
        return ("dsa", end) if members[1][2] - members[1][1] >= 32 else None
    if version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        if not _algorithm(data, members[1]):
            return None
        inner = der_value(data, members[2][1], members[2][2])
        return ("pkcs8", end) if inner and inner[2] == members[2][2] and inner[2] - inner[1] >= 16 else None
    if version == 1 and tags[1] == _OCTETS and all(t in (0xA0, 0xA1) for t in tags[2:]):
        if members[1][2] - members[1][1] not in range(14, 67):
            return None
        nested = [der_value(data, m[1], m[2]) for m in members[2:]]
        fits = all(n and n[2] == m[2] for n, m in zip(nested, members[2:]))
        return ("sec1_ec", end) if fits else None
    return None


def _ssh_string(data: bytes, at: int) -> tuple[int, int] | None:
    if at + 4 > len(data):
        return None
    (size,) = struct.unpack_from(">I", data, at)
    return (at + 4, at + 4 + size) if at + 4 + size <= len(data) else None


def openssh_key(data: bytes, at: int) -> tuple[str, int] | None:
    """(kind, end) of the OpenSSH private key whose magic stands at ``at``."""
    at += len(b"openssh-key-v1\0")
    for _ in range(3):  # cipher, key derivation and its options
        field = _ssh_string(data, at)
        if field is None:
            return None
        at = field[1]
    if at + 4 > len(data):
        return None
    (keys,) = struct.unpack_from(">I", data, at)
    at += 4
    if not 1 <= keys <= 16:
        return None
    for n in range(keys + 1):  # public keys, then the private part
        field = _ssh_string(data, at)
        if field is None or (n < keys and not _ssh_names(data, *field)):
            return None
        at = field[1]
    return "openssh", at


def _ssh_names(data: bytes, start: int, end: int) -> bool:
    name = _ssh_string(data, start)
    return name is not None and start < name[1] <= end and data[name[0] : name[1]].isascii()


def keys_in(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the private keys encoded in some bytes, none inside another."""
    at = 0
    while match := _KEY_START.search(data, at):
        at = match.start()
        key = der_key(data, at) if data[at] == _SEQUENCE else openssh_key(data, at)
        if key:
            yield at, key[1], key[0]
        at = key[1] if key else at + 1


def _decoded(digits: bytes) -> bytes:
    """Bytes of base64 digits without their padding; what does not fill a byte is left out."""
    digits = digits[: len(digits) - (len(digits) % 4 == 1)]
    return binascii.a2b_base64(digits.translate(_URL_SAFE) + b"=" * (-len(digits) % 4))


def _inside(said: bytes, depth: int) -> str | None:
    """What a decoded text holds, if it is one."""
    if depth < 32 and _TEXT.match(said):
        first = next(iter(structures(said, depth + 1)), None)
        return first and f"{first[2]} {first[3]}"
    return None


def base64_keys(raw: bytes, depth: int = 0) -> Iterator[Found]:
    for match in _BASE64.finditer(raw):
        run, start = match.group(), match.start()
        breaks = [m.span() for m in _BREAK.finditer(run)]
        digits = _BREAK.sub(b"", run)

        def place(n: int) -> int:
            """Where the run's digit number ``n`` stands."""
            for a, b in breaks:
                if a > n:
                    break
                n += b - a
            return start + n

        found = []
        for shift in range(4):
            for a, b, kind in keys_in(_decoded(digits[shift:])):
                if a % 3 == 0:  # an encoder begins with whole groups
                    found.append((shift + a // 3 * 4, shift + -(-b * 4 // 3), kind))
        last = 0
        for a, b, kind in sorted(found):
            if a >= last:
                last = b
                stop = place(b - 1) + 1
                padding = len(re.match(rb"={0,2}", raw[stop : stop + 2]).group())
                yield place(a), stop + padding, "private_key", f"base64 {kind}"
        if not found and (what := _inside(_decoded(digits), depth)):
            yield start, match.end(), what.split(" ")[0], f"base64 {what.split(' ', 1)[1]}"


def hex_keys(raw: bytes, depth: int = 0) -> Iterator[Found]:
    for match in _HEX_RUN.finditer(raw):
        run, start, last = match.group(), match.start(), 0
        found = []
        for shift in range(2):
            half = run[shift:]
            data = bytes.fromhex(half[: len(half) // 2 * 2].decode())
            found += [(shift + 2 * a, shift + 2 * b, kind) for a, b, kind in keys_in(data)]
            if shift == 0 and (what := _inside(data, depth)):
                yield start, start + 2 * len(data), what.split(" ")[0], f"hex {what.split(' ', 1)[1]}"
        for a, b, kind in sorted(found):
            if a >= last:
                last = b
                yield start + a, start + b, "private_key", f"hex {kind}"


def _header(segment: bytes) -> tuple[int, str] | None:
    """Where in a segment a token's header starts, and the algorithm that it names."""
    for shift in range(4):
        said = _decoded(segment[shift:])
        whole = shift == 0 and said[:1] == b"{"
        match = None if whole else _FLAT_OBJECT.search(said)
        if not whole and (match is None or match.start() % 3):
            continue
        try:
            header = json.loads(said if whole else match.group())
        except (ValueError, RecursionError):
            continue
        if isinstance(header, dict) and isinstance(header.get("alg"), str):
            return shift + (0 if whole else match.start() // 3 * 4), header["alg"]
    return None


def signed_tokens(raw: bytes) -> Iterator[Found]:
    for match in _SEGMENTS.finditer(raw):
        segments, at = match.group().split(b"."), match.start()
        begins = []
        for segment in segments:
            begins.append(at)
            at += len(segment) + 1
        n = 0
        while n + 2 < len(segments):
            head, body, signature = segments[n : n + 3]
            header = _header(head) if len(head) >= 16 and len(signature) >= 43 and len(body) % 4 != 1 else None
            if header and len(signature) % 4 != 1 and len(signature) * 3 // 4 in SIGNATURES.get(header[1], ()):
                yield begins[n] + header[0], begins[n + 2] + len(signature), "signed_token", header[1]
                n += 3
            else:
                n += 1


def structures(raw: bytes, depth: int = 0) -> Iterator[Found]:
    """Confirmed spans of a text, in bytes."""
    yield from signed_tokens(raw)
    yield from base64_keys(raw, depth)
    yield from hex_keys(raw, depth)


def patterns(raw: bytes) -> Iterator[Found]:
    """Spans that the base patterns find, in bytes."""
    for match in _ASSIGN.finditer(raw.lower()):
        if match.end(1) - match.start(1) >= ASSIGNED:
            yield *match.span(), "assign", ""
    for match in _ACCESS.finditer(raw):
        if match.end() - match.start() >= ACCESS:
            yield *match.span(), "access", ""
    for match in _HEX.finditer(raw):
        yield *match.span(), "hex", ""


def code_points(raw: bytes, places: set[int]) -> dict[int, int]:
    """Code points before each of some byte offsets."""
    if raw.isascii():
        return {p: p for p in places}
    out, at, n = {}, 0, 0
    for place in sorted(places):
        n += len(raw[at:place].decode("utf-8", "replace"))
        out[place], at = n, place
    return out


def spans_of(raw: bytes | None) -> list[tuple[str, int, int, str]]:
    """All spans of a text: (kind, start, end, detail) in code points, by start, then kind."""
    if not raw:
        return []
    found = {f[:3]: f for f in (*patterns(raw), *structures(raw))}.values()
    if not found:
        return []
    place = code_points(raw, {p for f in found for p in f[:2]})
    out = [(kind, place[a], place[b], detail) for a, b, kind, detail in found]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("detail", T.StringType()),
        ]
    )
)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans`` of every row: kind, start, end and, of confirmed ones, the encoding and structure."""
    schema = T.StructType([df.schema[key], T.StructField("spans", SPANS)])
    names, kinds = [f.name for f in SPANS.elementType], [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            flat, offsets = [], [0]
            for raw in text_bytes(batch.column(1)):
                flat += spans_of(raw)
                offsets.append(len(flat))
            columns = zip(*flat) if flat else ((),) * len(names)
            spans = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=schema.fieldNames())

    return df.select(key, text).mapInArrow(run, schema)


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: counts and digest of the base patterns' spans, and all spans."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(told(of(*BASE_KINDS)), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
