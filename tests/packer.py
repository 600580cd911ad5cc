"""Containers made byte by byte, without the library's writer."""

import hashlib
import struct

HEAD = b"#ASDF 1.0.0\n#ASDF_STANDARD 1.6.0\n"
DIRECTIVES = b"%YAML 1.1\n%TAG ! tag:stsci.edu:asdf/\n--- !core/asdf-1.1.0\n"


def block(stored, codec=b"", data_size=None, allocated=None, flags=0, md5=None, header_size=48):
    md5 = hashlib.md5(stored).digest() if md5 is None else md5
    data_size = len(stored) if data_size is None else data_size
    allocated = len(stored) if allocated is None else allocated
    head = struct.pack(">I4sQQQ16s", flags, codec, allocated, len(stored), data_size, md5)
    return b"\xd3BLK" + struct.pack(">H", header_size) + head + b"\0" * (header_size - 48) + stored + b"\0" * max(0, allocated - len(stored))


def tree(text):
    return HEAD + DIRECTIVES + text.encode() + b"\n...\n"


def index(offsets, flow=False):
    body = b"[" + b", ".join(b"%d" % x for x in offsets) + b"]\n" if flow else b"".join(b"- %d\n" % x for x in offsets)
    return b"#ASDF BLOCK INDEX\n%YAML 1.1\n---\n" + body + b"...\n"


def file(text, *blocks, with_index=True, flow=False, padding=b""):
    out = tree(text) + padding
    offsets = []
    for b in blocks:
        offsets.append(len(out))
        out += b
    return out + (index(offsets, flow) if with_index and blocks else b"")


def ndarray(source, shape, datatype, extra=""):
    return f"data: !core/ndarray-1.1.0 {{source: {source}, shape: {shape}, datatype: {datatype}, byteorder: little{extra}}}"
