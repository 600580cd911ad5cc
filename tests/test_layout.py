import bz2
import struct
import zlib

import pyarrow as pa
import pytest

from tests import packer as P
from treeblock.sources import codecs, frames, layout
from treeblock.sources import arrays as A
from treeblock.sources.codecs import FormatError


def code(buf):
    with pytest.raises(FormatError) as e:
        layout.scan(buf)
    return e.value.code


def test_what_is_no_container():
    assert code(b"") == code(b"#YAML") == "InvalidHeader"


@pytest.mark.parametrize("flow", [False, True])
def test_two_blocks_and_both_forms_of_an_index(flow):
    x = layout.scan(P.file("a: 1", P.block(b"abc"), P.block(b"defgh"), flow=flow))
    assert [(b.used_size, b.index) for b in x.blocks] == [(3, 0), (5, 1)]
    assert x.index_rejection is None and x.index_offsets == [b.header_pos for b in x.blocks]
    assert (x.format_version, x.standard_version) == ("1.0.0", "1.6.0")


def test_blocks_without_an_index_and_with_padding():
    x = layout.scan(P.file("a: 1", P.block(b"abc"), P.block(b"d"), with_index=False, padding=b"\0" * 99))
    assert len(x.blocks) == 2 and x.index_offsets is None


def test_comment_shifts_the_index():
    good = P.file("a: 1", P.block(b"abc"))
    x = layout.scan(good.replace(b"%YAML", b"# moved\n%YAML", 1))
    assert x.index_rejection == "first_offset_mismatch" and len(x.blocks) == 1 and x.comments == [" moved"]


@pytest.mark.parametrize("offsets,why", [([5, 4], "not_monotonic"), ([1], "count_mismatch"), ([], "unparseable")])
def test_why_an_index_is_rejected(offsets, why):
    body = P.file("a: 1", P.block(b"abc"), P.block(b"d"), with_index=False)
    assert layout.scan(body + P.index(offsets)).index_rejection == why


def test_index_that_points_elsewhere():
    body = P.file("a: 1", P.block(b"abc"), P.block(b"d"), with_index=False)
    first = layout.scan(body).blocks[0].header_pos
    assert layout.scan(body + P.index([first, first + 1])).index_rejection == "not_block_magic"
    found = layout.scan(body + b"xx" + P.index([b.header_pos for b in layout.scan(body).blocks]))
    assert found.index_rejection == "last_block_not_adjacent"


def test_bad_blocks():
    assert code(P.tree("a: 1") + P.block(b"abc")[:-1]) == "UnexpectedEof"
    assert code(P.tree("a: 1") + P.block(b"abc")[:20]) == "UnexpectedEof"
    assert code(P.tree("a: 1") + P.block(b"abc", data_size=4)) == "InvalidBlockHeader"
    assert code(P.tree("a: 1") + P.block(b"abc", allocated=2)) == "InvalidBlockHeader"
    assert code(P.tree("a: 1") + b"\xd3BLK\0\x10" + b"\0" * 99) == "InvalidBlockHeader"


def test_larger_header_and_no_tree():
    buf = P.HEAD + P.block(b"abc", header_size=64)
    x = layout.scan(buf)
    assert x.tree_start is None and layout.data_of(buf, x.blocks[0]) == b"abc"


def test_streamed_block_takes_the_rest():
    buf = P.tree("a: 1") + P.block(b"", flags=1) + b"0123456789"
    x = layout.scan(buf)
    assert x.blocks[0].streamed and layout.raw_of(buf, x.blocks[0]) == b"0123456789"


def lz4(data, chunk=4 << 20):
    out = b""
    for i in range(0, len(data), chunk):
        body = pa.Codec("lz4_raw").compress(data[i : i + chunk], asbytes=True)
        out += struct.pack(">I", len(body) + 4) + struct.pack("<I", len(data[i : i + chunk])) + body
    return out


@pytest.mark.parametrize("name,fn", [("zlib", zlib.compress), ("bzp2", bz2.compress), ("lz4", lambda d: lz4(d, 1000))])
def test_codecs(name, fn):
    data = b"0123456789" * 500
    assert codecs.decompress(fn(data), name, len(data)) == data
    assert codecs.decompress(codecs.compress(data, name), name, len(data)) == data
    for size in (len(data) - 1, len(data) + 1):
        with pytest.raises(FormatError):
            codecs.decompress(fn(data), name, size)
    with pytest.raises(FormatError):
        codecs.decompress(b"\xff" * 40, name, 40)


def test_codec_limits():
    with pytest.raises(FormatError) as e:
        codecs.decompress(b"x", "zlib", 1 << 40)
    assert e.value.code == "OverLimit"
    with pytest.raises(FormatError) as e:
        codecs.name_of(b"blsc")
    assert e.value.code == "UnknownCompression"


def test_checksums():
    data = b"0" * 100
    stored = zlib.compress(data)
    import hashlib

    of_data = P.block(stored, b"zlib", 100, md5=hashlib.md5(data).digest())
    for library, version, status in (("asdf", "5.2.1", "valid"), ("asdf", "5.3.0", "invalid"), ("other", "1.0", "invalid")):
        buf = P.file(f"asdf_library: {{name: {library}, version: {version}}}", of_data)
        x = layout.scan(buf)
        assert layout.checksum_status(buf, x.blocks[0], frames.library(frames.tree_of(buf, x))) == status
    buf = P.file("a: 1", P.block(b"abc", md5=b"\0" * 16), P.block(b"abc"), P.block(b"abc", md5=b"x" * 16))
    assert [layout.checksum_status(buf, b) for b in layout.scan(buf).blocks] == ["absent", "valid", "invalid"]


def test_pack_is_read_back():
    buf = layout.pack("%YAML 1.1\n---\na: 1\n", [layout.Pending(b"abc", "lz4", allocated_size=100), layout.Pending(zlib.compress(b"x" * 9), "zlib", True, 9)], padding=7)
    x = layout.scan(buf)
    assert x.index_rejection is None and [layout.data_of(buf, b) for b in x.blocks] == [b"abc", b"x" * 9]
    assert x.blocks[0].allocated_size == 100
    assert b"INDEX" not in layout.pack(None, [])


@pytest.mark.parametrize("uri", ["../a.asdf", "/etc/passwd", "http://x/y", "a/../../b", "file:x"])
def test_external_sources_stay_in_their_folder(uri):
    with pytest.raises(FormatError):
        A.safe_relative(uri)


def test_mutations_never_crash():
    import random

    rng, base = random.Random(7), P.file(P.ndarray(0, [4], "int32"), P.block(b"\1\0\0\0" * 4), P.block(zlib.compress(b"x" * 50), b"zlib", 50))
    for _ in range(400):
        buf = bytearray(base)
        for _ in range(rng.randint(1, 6)):
            buf[rng.randrange(len(buf))] = rng.randrange(256)
        buf = bytes(buf[: rng.randint(0, len(buf))] if rng.random() < 0.3 else buf)
        try:
            x = layout.scan(buf)
            for b in x.blocks:
                layout.data_of(buf, b)
            a = frames.find_array(frames.tree_of(buf, x), "data")
            A.view(a, frames.block_bytes(buf, x, a))
        except (FormatError, ValueError):
            pass
