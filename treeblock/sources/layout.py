"""The byte layout of a container: header, tree, blocks, index; reading and writing. A kernel of executors."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

from treeblock.sources.codecs import FormatError, compress, decompress, name_of

#: Fixed values of the format.
MAGIC = b"\xd3BLK"
HEAD, STANDARD, INDEX = b"#ASDF ", b"#ASDF_STANDARD ", b"#ASDF BLOCK INDEX"
FORMAT_VERSION, STANDARD_VERSION = "1.0.0", "1.6.0"
FIELDS = ">I4sQQQ16s"
HEADER_SIZE, STREAMED = 48, 1
#: Writers whose checksums are of decompressed bytes: the library's name and the first version that is not so.
LENIENT = ("asdf", (5, 3, 0))


@dataclass
class Block:
    index: int
    header_pos: int
    data_pos: int
    header_size: int
    flags: int
    compression: str
    allocated_size: int
    used_size: int
    data_size: int
    checksum: bytes

    @property
    def streamed(self) -> bool:
        return bool(self.flags & STREAMED)


@dataclass
class Layout:
    format_version: str = ""
    standard_version: str | None = None
    comments: list[str] = field(default_factory=list)
    tree_start: int | None = None
    tree_end: int | None = None
    blocks: list[Block] = field(default_factory=list)
    index_pos: int | None = None
    index_offsets: list[int] | None = None
    index_rejection: str | None = None


def scan(buf) -> Layout:
    """The layout of a whole container (bytes or a memory map)."""
    if bytes(buf[: len(HEAD)]) != HEAD:
        raise FormatError("InvalidHeader", "no container")
    out, pos = Layout(), 0
    while pos < len(buf):
        end = buf.find(b"\n", pos)
        end = len(buf) if end < 0 else end
        if bytes(buf[pos : pos + 4]) == MAGIC:
            break
        line = bytes(buf[pos:end]).rstrip(b"\r")
        if line.startswith((b"%YAML ", b"---")):
            out.tree_start = pos
            break
        if not line.startswith(b"#"):
            break
        if pos == 0:
            out.format_version = line[len(HEAD) :].decode("utf-8", "replace").strip()
        elif line.startswith(STANDARD) and out.standard_version is None:
            out.standard_version = line[len(STANDARD) :].decode("utf-8", "replace").strip()
        elif line.startswith(INDEX):
            break
        else:
            out.comments.append(line[1:].decode("utf-8", "replace"))
        pos = end + 1
    if out.tree_start is not None:
        pos = out.tree_end = tree_end(buf, out.tree_start)
    out.blocks = walk(buf, min(pos, len(buf)))
    read_index(buf, out, min(pos, len(buf)))
    return out


def tree_end(buf, start: int) -> int:
    """Past the line of three points; else where the first block begins; else the end."""
    at = start
    while (at := buf.find(b"\n...", at)) >= 0:
        rest = bytes(buf[at + 4 : at + 6])
        if rest[:1] == b"\n" or rest == b"\r\n" or not rest:
            return at + 4 + (1 if rest[:1] == b"\n" else len(rest))
        at += 4
    at = buf.find(MAGIC, start)
    return at if at >= 0 else len(buf)


def parse_header(buf, pos: int, index: int) -> Block:
    if len(buf) < pos + 6:
        raise FormatError("UnexpectedEof", f"block {index}")
    (size,) = struct.unpack(">H", bytes(buf[pos + 4 : pos + 6]))
    if size < HEADER_SIZE:
        raise FormatError("InvalidBlockHeader", f"block {index} has a header of {size} bytes")
    if len(buf) < pos + 6 + size:
        raise FormatError("UnexpectedEof", f"block {index}")
    flags, codec, allocated, used, data, md5 = struct.unpack(FIELDS, bytes(buf[pos + 6 : pos + 6 + HEADER_SIZE]))
    block = Block(index, pos, pos + 6 + size, size, flags, codec.rstrip(b"\0").decode("latin-1"), allocated, used, data, md5)
    if not block.streamed:
        if allocated < used:
            raise FormatError("InvalidBlockHeader", f"block {index} uses more than it has")
        if not block.compression and data != used:
            raise FormatError("InvalidBlockHeader", f"block {index} is not compressed, but has two sizes")
    return block


def walk(buf, pos: int) -> list[Block]:
    """Blocks from the first magic on, each where the one before ends; a streamed one is the last."""
    out: list[Block] = []
    first = buf.find(MAGIC, pos)
    index = buf.find(INDEX, pos)
    if first < 0 or 0 <= index < first:
        return out
    pos = first
    while bytes(buf[pos : pos + 4]) == MAGIC:
        block = parse_header(buf, pos, len(out))
        out.append(block)
        if block.streamed:
            break
        pos = block.data_pos + block.allocated_size
        if pos > len(buf):
            raise FormatError("UnexpectedEof", f"block {block.index} ends after the file")
    return out


def read_index(buf, layout: Layout, start: int) -> None:
    """The last index of the file, and why it is not trusted, if so: blocks come from the walk in any case."""
    blocks = layout.blocks
    at = buf.rfind(INDEX, blocks[-1].data_pos if blocks and blocks[-1].streamed else (blocks[-1].data_pos + blocks[-1].allocated_size if blocks else start))
    if at < 0 or not blocks:
        return
    layout.index_pos = at
    text = bytes(buf[at + len(INDEX) :]).decode("utf-8", "replace")
    body = re.search(r"---[^\n]*\n(.*?)(?:\n?\.\.\.|\Z)", text, re.S)
    body = body[1].strip() if body else ""
    flow = re.fullmatch(r"\[([\s0-9,]*)\]", body)
    items = [x.strip() for x in flow[1].split(",") if x.strip()] if flow else re.findall(r"^-[ \t]+(\S+)[ \t]*$", body, re.M)
    if not items or not all(x.isdigit() for x in items) or (not flow and len(items) != len(body.splitlines())):
        layout.index_rejection = "unparseable"
        return
    found = layout.index_offsets = [int(x) for x in items]
    last = blocks[-1]
    if any(b <= a for a, b in zip(found, found[1:], strict=False)):
        layout.index_rejection = "not_monotonic"
    elif len(found) != len(blocks):
        layout.index_rejection = "count_mismatch"
    elif found[0] != blocks[0].header_pos:
        layout.index_rejection = "first_offset_mismatch"
    elif any(bytes(buf[x : x + 4]) != MAGIC for x in found):
        layout.index_rejection = "not_block_magic"
    elif last.data_pos + last.allocated_size != at:
        layout.index_rejection = "last_block_not_adjacent"


def raw_of(buf, block: Block) -> bytes:
    return bytes(buf[block.data_pos :] if block.streamed else buf[block.data_pos : block.data_pos + block.used_size])


def data_of(buf, block: Block) -> bytes:
    raw = raw_of(buf, block)
    return raw if block.streamed else decompress(raw, name_of(block.compression.encode("latin-1")), block.data_size)


def checksum_status(buf, block: Block, library: tuple[str, tuple[int, ...]] | None = None) -> str:
    """absent (all zeros), valid or invalid; compressed blocks of an old writer may have that of their data."""
    if block.checksum == b"\0" * 16:
        return "absent"
    raw = raw_of(buf, block)
    if hashlib.md5(raw, usedforsecurity=False).digest() == block.checksum:
        return "valid"
    if block.compression and library and library[0] == LENIENT[0] and library[1] < LENIENT[1]:
        try:
            if hashlib.md5(data_of(buf, block), usedforsecurity=False).digest() == block.checksum:
                return "valid"
        except FormatError:
            pass
    return "invalid"


@dataclass
class Pending:
    """A block to write; precompressed data is copied as it is, with the size that it is said to have."""

    data: bytes
    compression: str = ""
    precompressed: bool = False
    uncompressed_size: int | None = None
    allocated_size: int | None = None
    streamed: bool = False


def pack(tree: str | None, blocks: list[Pending], checksums: bool = True, index: bool = True, padding: int = 0, comments: tuple[str, ...] = (), format_version: str = FORMAT_VERSION, standard_version: str = STANDARD_VERSION) -> bytes:
    """A container: header, tree, padding, blocks, index. tree is a whole YAML document with its directives."""
    parts = [HEAD + format_version.encode() + b"\n", STANDARD + standard_version.encode() + b"\n"]
    parts += [b"#" + c.encode() + b"\n" for c in comments]
    if tree is not None:
        text = tree.encode()
        parts.append(text if text.endswith(b"...\n") else text.rstrip(b"\n") + b"\n...\n")
    parts.append(b"\0" * padding)
    pos, offsets = sum(map(len, parts)), []
    for i, b in enumerate(blocks):
        if b.streamed and i < len(blocks) - 1:
            raise FormatError("InvalidArgument", "a streamed block is the last")
        stored = b.data if b.precompressed else compress(b.data, b.compression)
        size = (b.uncompressed_size if b.uncompressed_size is not None else len(b.data)) if b.precompressed else len(b.data)
        room = max(b.allocated_size or 0, len(stored))
        md5 = hashlib.md5(stored, usedforsecurity=False).digest() if checksums and not b.streamed else b"\0" * 16
        sizes = (0, 0, 0) if b.streamed else (room, len(stored), size)
        head = struct.pack(FIELDS, STREAMED if b.streamed else 0, b.compression.encode(), *sizes, md5)
        offsets.append(pos)
        own = [MAGIC, struct.pack(">H", HEADER_SIZE), head, stored, b"" if b.streamed else b"\0" * (room - len(stored))]
        parts += own
        pos += sum(map(len, own))
    if index and blocks and not blocks[-1].streamed:
        parts.append(INDEX + b"\n%YAML 1.1\n---\n" + b"".join(b"- %d\n" % x for x in offsets) + b"...\n")
    return b"".join(parts)
