"""Block codecs and their limits."""

from __future__ import annotations

import bz2
import struct
import zlib

import pyarrow as pa


class FormatError(ValueError):
    """A container that is not well formed; code names the kind of fault."""

    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}" if what else code)
        self.code = code


#: Names of codecs in a block's header, bytes of an lz4 chunk.
NAMES = {"": "", "none": "", "zlib": "zlib", "bzp2": "bzp2", "lz4": "lz4"}
LZ4_CHUNK = 4 << 20
#: A block may claim so many times its stored size, or the floor.
EXPANSION, FLOOR = 4096, 1 << 20


def name_of(raw: bytes) -> str:
    text = raw.rstrip(b"\0").decode("ascii", "replace")
    if text not in ("", "zlib", "bzp2", "lz4"):
        raise FormatError("UnknownCompression", repr(text))
    return text


def check_claim(stored: int, claimed: int) -> None:
    if claimed > max(EXPANSION * stored, FLOOR):
        raise FormatError("OverLimit", f"{stored} bytes claim to hold {claimed}")


def decompress(raw: bytes, codec: str, size: int) -> bytes:
    """The size bytes that a block holds; never more memory than that is used."""
    if codec == "":
        return raw
    check_claim(len(raw), size)
    try:
        if codec == "zlib":
            out = zlib.decompressobj().decompress(raw, size + 1)
        elif codec == "bzp2":
            out = bz2.BZ2Decompressor().decompress(raw, size + 1)
        elif codec == "lz4":
            out = _lz4(raw, size)
        else:
            raise FormatError("UnknownCompression", codec)
    except (zlib.error, OSError, EOFError, pa.ArrowException, struct.error) as x:
        raise FormatError("CompressionFailed", str(x)) from None
    if len(out) != size:
        raise FormatError("CompressionFailed", f"{len(out)} bytes instead of {size}")
    return out


def _lz4(raw: bytes, size: int) -> bytes:
    """Chunks: bytes that follow (4, big-endian), bytes once decompressed (4, little-endian), an lz4 block."""
    codec, parts, at, total = pa.Codec("lz4_raw"), [], 0, 0
    while at < len(raw):
        follow, whole = struct.unpack_from(">I", raw, at)[0], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 4 + follow]
        total += whole
        if follow < 4 or len(body) != follow - 4 or total > size:
            raise FormatError("CompressionFailed", "an lz4 chunk does not fit")
        parts.append(codec.decompress(body, whole, asbytes=True))
        at += 4 + follow
    return b"".join(parts)


def compress(data: bytes, codec: str) -> bytes:
    if codec == "":
        return data
    if codec == "zlib":
        return zlib.compress(data)
    if codec == "bzp2":
        return bz2.compress(data)
    if codec == "lz4":
        tool, out = pa.Codec("lz4_raw"), []
        for at in range(0, len(data), LZ4_CHUNK):
            part = data[at : at + LZ4_CHUNK]
            body = tool.compress(part, asbytes=True)
            out += [struct.pack(">I", len(body) + 4), struct.pack("<I", len(part)), body]
        return b"".join(out)
    raise FormatError("UnknownCompression", codec)
