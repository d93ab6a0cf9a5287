"""Text and frame codecs for opaque bytes: base64, unpadded base64url, hex, and length-prefixed blobs."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_base64url(x: Column) -> Column:
    """Unpadded base64url of bytes."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(x), "[\r\n]", ""), "+/=", "-_ "))


def from_base64url(x: Column) -> Column:
    plain = F.translate(x, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="))


def to_base64(x: Column) -> Column:
    """Padded base64 of bytes, on one line."""
    return F.regexp_replace(F.base64(x), "[\r\n]", "")


def from_base64(x: Column) -> Column:
    return F.unbase64(x)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def encode_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def decode_base64(text: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except binascii.Error as e:
        raise ValueError("not base64") from e


def encode_base64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def decode_base64url(text: str) -> bytes:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except binascii.Error as e:
        raise ValueError("not base64url") from e


def encode_frame(payload: bytes) -> bytes:
    """The length as a base-128 varint, least group first, and the payload."""
    n, head = len(payload), bytearray()
    while n >= 0x80:
        head.append(n & 0x7F | 0x80)
        n >>= 7
    head.append(n)
    return bytes(head) + payload


def decode_frame(data: bytes, most: int | None = None) -> tuple[bytes, bytes]:
    """(payload, what follows)."""
    n = shift = at = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("the frame's length is cut off")
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            break
    if most is not None and n > most:
        raise ValueError("the frame is too long")
    if len(data) - at < n:
        raise ValueError("the frame is cut off")
    return data[at : at + n], data[at + n :]
