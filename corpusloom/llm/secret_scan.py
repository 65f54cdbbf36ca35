"""Secret scans that report only what decodes to the structure of a secret.

Runs of base64 or hexadecimal characters are found first. Each is decoded and must
parse: a DER key whose nested lengths fill it, an OpenSSH key whose length-prefixed
fields do, a signed token whose header is a JSON object with an algorithm, an access
key id whose base32 part is 10 bytes, or raw key bytes that are assigned to a
credential's name.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text

MASK = "[SECRET]"
#: A run of fewer characters holds no key.
LEAST = 20
_CHARS = "A-Za-z0-9+/_-"
#: Java and Python agree on it; only texts that match are sent to Python. Armour may be wrapped at any width.
CANDIDATE = f"[{_CHARS}]{{{LEAST}}}|-----BEGIN "

_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
_HEADER = re.compile(r"\s*+[A-Za-z-]++:[^\n]*+\n")
_TOKEN = re.compile(rf"(?<![\w.-])([A-Za-z0-9_-]{{8,}}+)\.([A-Za-z0-9_-]{{2,}}+)\.([A-Za-z0-9_-]{{8,}}+)(?![\w-])")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[{_CHARS}]{{{LEAST},}}={{0,2}}")
_NAMED = re.compile(
    r"(?i)(?:api|access|auth|secret|private|client|session|encryption|signing|master)?[ _-]?"
    r"(?:token|key|secret|passw(?:or)?d|pwd|credential|bearer|signature)[\w-]{0,20}\"?'?\s{0,3}(?:[:=]{1,2}>?|\bis\b)\s{0,3}[\"'`]?$"
)
_ACCESS = re.compile(r"(?:AKIA|ASIA)[A-Z2-7]{16}")
_HEX = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")


def unbase64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None) -> list | None:
    """The (tag, value) nodes that fill ``data[at:end]`` exactly; values of constructed nodes are lists."""
    end, nodes = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 128:
            k = size & 127
            if not 1 <= k <= 4 or at + k > end or data[at] == 0 or (k == 1 and data[at] < 128):
                return None
            size, at = int.from_bytes(data[at : at + k]), at + k
        if at + size > end:
            return None
        if tag & 32:
            inner = der(data, at, at + size)
            if inner is None:
                return None
            nodes.append((tag, inner))
        else:
            nodes.append((tag, data[at : at + size]))
        at += size
    return nodes


def der_key(data: bytes) -> str | None:
    """Kind of the private key that the DER bytes hold."""
    if len(data) < 24 or data[0] != 0x30:
        return None
    try:
        nodes = der(data)
    except RecursionError:
        return None
    if not nodes or len(nodes) != 1:
        return None
    parts = nodes[0][1]
    tags = [t for t, _ in parts]
    if len(tags) >= 9 and set(tags[:9]) == {2} and len(parts[1][1]) >= 32:
        return "rsa_private_key"
    if tags[:2] == [2, 4] and len(parts[0][1]) == 1 and parts[0][1][0] == 1 and len(parts[1][1]) in range(20, 67):
        return "ec_private_key"
    if tags[:3] == [2, 0x30, 4] and parts[1][1] and parts[1][1][0][0] == 6:
        return "pkcs8_private_key"
    if tags[:2] == [0x30, 4] and parts[0][1] and parts[0][1][0][0] == 6 and len(parts[1][1]) >= 16:
        return "encrypted_private_key"
    if len(tags) == 6 and set(tags) == {2} and len(parts[1][1]) >= 32:
        return "dsa_private_key"
    return None


def ssh_key(data: bytes) -> str | None:
    """A private OpenSSH key: its magic, then length-prefixed fields that fill the bytes."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else -1
        if size < 0 or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):  # cipher, derivation, its options
        if (x := field()) is None:
            return None
        fields.append(x)
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if keys < 1:
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        if (x := field()) is None:
            return None
        fields.append(x)
    return "openssh_private_key" if at == len(data) and len(fields[-1]) % 8 == 0 else None


def signed_token(header: str, body: str, signature: str) -> str | None:
    """A signed token: JSON header with an algorithm, JSON body, signature bytes of a fitting length."""
    raw, claims, mark = unbase64(header), unbase64(body), unbase64(signature)
    if raw is None or claims is None or mark is None or raw[:1] != b"{":
        return None
    try:
        head = json.loads(raw)
        json.loads(claims)
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return None
    return "signed_token" if len(mark) >= 16 else None


def varied(data: bytes) -> bool:
    """Whether bytes look drawn at random: most differ, and they aren't text or a count up or down."""
    n = len(data)
    if len(set(data)) < min(n, 32) * 0.55:
        return False
    steps = {(b - a) & 255 for a, b in zip(data, data[1:])}
    return len(steps) > min(n, 256) // 4 and sum(32 <= b < 127 for b in data) < 0.9 * n


def confirm(run: str, before: str) -> str | None:
    """Kind of the secret that a run of base64 or hex characters is, given the text in front of it."""
    plain = run.rstrip("=")
    if _ACCESS.fullmatch(plain) and len(base64.b32decode(plain[4:])) == 10:
        return "access_key_id"
    if _HEX.fullmatch(plain):
        data = bytes.fromhex(plain)
        if kind := der_key(data) or ssh_key(data):
            return kind
        return "hex_key" if len(data) >= 16 and varied(data) and _NAMED.search(before) else None
    data = unbase64(run)
    if data is None:
        return None
    if kind := der_key(data) or ssh_key(data):
        return kind
    mixed = any(c.isdigit() for c in plain) and any(c.islower() for c in plain) and any(c.isupper() for c in plain)
    return "base64_key" if mixed and len(data) >= 15 and varied(data) and _NAMED.search(before) else None


def armoured(text: str):
    """(start, end, body) of each armoured private key, headers left out, in linear time.

    No armour holds five dashes, so the ones behind a beginning must be its end.
    """
    for m in _BEGIN.finditer(text):
        if not m[1].endswith("PRIVATE KEY"):
            continue
        stop, end = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if stop >= 0 and text.startswith(end, stop):
            at = m.end()
            while h := _HEADER.match(text, at, stop):
                at = h.end()
            yield m.start(), stop + len(end), "".join(text[at:stop].split())


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each confirmed secret of the whole text, in order, without overlap."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    for start, end, body in armoured(text):
        data = unbase64(body)
        if data is not None and (kind := der_key(data) or ssh_key(data)):
            found.append((start, end, kind))
    for m in _TOKEN.finditer(text):
        if kind := signed_token(*m.groups()):
            found.append((m.start(), m.end(), kind))
    for m in _RUN.finditer(text):
        if kind := confirm(m[0], text[max(0, m.start() - 64) : m.start()]):
            found.append((m.start(), m.end(), kind))
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def masked(text: str | None, mask: str = MASK) -> str | None:
    spans = scan(text)
    if not spans:
        return text
    parts, at = [], 0
    for start, end, _ in spans:
        parts += [text[at:start], mask]
        at = end
    return "".join([*parts, text[at:]])


_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("kind", T.StringType()),
        ]
    )
)


@F.arrow_udf(_FOUND)
def _scan(texts: pa.Array) -> pa.Array:
    form = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    return pa.array([[dict(zip(("start", "end", "kind"), s)) for s in scan(t)] for t in each_text(texts)], form)


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array) -> pa.Array:
    return pa.array((masked(t) for t in each_text(texts)), pa.string())


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end, sha256``, a row for each secret confirmed in a whole text.

    Offsets count characters, end excluded; the secret itself is given as its hash
    only. Null and empty texts have none. Repeated rows are reported again; a null
    id stays null; other columns are dropped. Of overlapping finds the first and
    longest is reported. Texts without a long enough run of base64 characters are
    filtered in the JVM; there is no shuffle.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(CANDIDATE))
    found = rows.withColumn("_s", F.explode(_scan("text")))
    return found.select(
        "doc_id",
        F.col("_s.kind").alias("kind"),
        F.col("_s.start").alias("start"),
        F.col("_s.end").alias("end"),
        F.sha2(F.expr("substring(text, CAST(_s.start AS INT) + 1, CAST(_s.end - _s.start AS INT))"), 256).alias("sha256"),
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each confirmed secret of ``text`` replaced by ``[SECRET]``.

    All rows and columns stay, repeated rows and null ids too; null and empty texts
    stay as they are, an empty table stays empty. Of overlapping finds the first and
    longest is masked. ``text`` comes back as a string; where it changes and there is
    a column ``n_chars``, that is counted anew. Only texts with a candidate visit Python.
    """
    text = F.col("text").cast("string")
    out = docs.withColumn("text", F.coalesce(_masked(F.when(text.rlike(CANDIDATE), text)), text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(F.contains("text", F.lit(MASK)), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return out
