import numpy as np
import pytest

from tests import packer as P
from treeblock.sources import arrays as A
from treeblock.sources import frames, layout
from treeblock.sources import treetext as T
from treeblock.sources.codecs import FormatError


def array(text, key="data"):
    return A.parse(A.get(T.parse(text), key))


def make(datatype, shape, byteorder="little", offset=0, strides=None):
    return A.Array("block", 0, shape, datatype, byteorder, offset, strides)


def read(a, data):
    out = A.values(A.view(a, data), a.datatype)
    return out.tolist() if isinstance(out, np.ndarray) else out


def test_integers_and_byte_orders():
    assert read(make("int32", [4]), np.array([1, -1, 256, -(2**31)], "<i4").tobytes()) == [1, -1, 256, -(2**31)]
    assert read(make("int16", [3], "big"), np.array([1, -2, 1000], ">i2").tobytes()) == [1, -2, 1000]
    assert read(make("uint16", [1]), b"\1\0") == [1] and read(make("uint16", [1], "big"), b"\1\0") == [256]
    assert read(make("bool8", [3]), b"\0\1\7") == [False, True, True]
    assert read(make("float16", [1], "big"), np.array([1.5], ">f2").tobytes()) == [1.5]
    assert read(make("uint64", [1]), b"\xff" * 8) == [2**64 - 1]


def test_strides():
    data = bytes(range(16))
    assert read(make("uint8", [16], offset=15, strides=[-1]), data) == list(range(15, -1, -1))
    with pytest.raises(FormatError) as e:
        A.view(make("uint8", [16], offset=14, strides=[-1]), data)
    assert e.value.code == "UnexpectedEof"
    with pytest.raises(FormatError) as e:
        A.view(make("uint8", [10**6], strides=[0]), b"\0")
    assert e.value.code == "OverLimit"
    assert read(make("uint8", [2, 3], strides=[1, 2]), bytes([1, 4, 2, 5, 3, 6])) == [1, 2, 3, 4, 5, 6]
    assert read(make("uint8", [2, 2], offset=5, strides=[4, 1]), data) == [5, 6, 9, 10]
    assert read(make("uint8", [2], offset=3), bytes([9, 9, 9, 1, 2])) == [1, 2]


@pytest.mark.parametrize("shape", [[10**8, 10**8], [2**63 + 1, 2]])
def test_huge_shapes_are_refused(shape):
    with pytest.raises(FormatError):
        A.view(make("float64", shape), b"\0" * 8)


def test_text_and_records():
    assert read(make(("ascii", 4), [2]), b"M31\0Cas\0") == ["M31", "Cas"]
    assert read(make(("ucs4", 3), [1]), "aé\0".encode("utf-32-le")) == ["aé"]
    fields = [A.Field("id", "uint16"), A.Field("value", "float32", "big")]
    data = b"".join(np.uint16(i).tobytes() + np.array([v], ">f4").tobytes() for i, v in ((1, 1.5), (2, -2.5)))
    assert read(make(fields, [2]), data) == [{"id": 1, "value": 1.5}, {"id": 2, "value": -2.5}]
    sub = [A.Field("p", "uint16", None, [2])]
    assert read(make(sub, [2]), np.arange(4, dtype="<u2").tobytes()) == [{"p": [0, 1]}, {"p": [2, 3]}]


def test_star_takes_whole_rows():
    assert A.resolved_shape(make("int32", [None, 2]), 27) == [3, 2]
    with pytest.raises(FormatError):
        A.resolved_shape(make("int32", [None, 0]), 27)


@pytest.mark.parametrize(
    "text,kind",
    [("[0, 255]", "uint8"), ("[0, 256]", "uint16"), ("[0, 70000]", "uint32"), ("[-200, 1]", "int16"), ("[-1, 200]", "int16"), ("[1, 2.5]", "float64"), ("[true, false]", "bool8"), ("['a']", "unknown"), ("[0, 0]", "bool8")],
)
def test_inline_datatypes(text, kind):
    assert array(f"data: {text}").datatype == kind


def test_inline_values():
    a = array("data: !core/ndarray-1.1.0\n  data: [[1, 2], [~, 4]]\n  datatype: int16")
    assert a.shape == [2, 2] and A.decode_inline(a) == [1, 2, 0, 4]
    with pytest.raises(FormatError):
        array("data: [[1, 2], [3]]")
    c = array("data: !core/ndarray-1.1.0\n  data: [(1+2j), 0j]\n  datatype: complex128")
    assert A.decode_inline(c) == [{"re": 1.0, "im": 2.0}, {"re": 0.0, "im": 0.0}]


def test_sources():
    assert array("data: {source: -1, shape: [1], datatype: int8}").source_kind == "last"
    assert array("data: {source: x.tb, shape: [1], datatype: int8}").source_kind == "external"
    for bad in ("data: {source: -2, shape: [1], datatype: int8}", "data: {shape: [1]}", "data: {source: 0, shape: [1]}", "data: {source: 0, shape: [1], datatype: int9}"):
        with pytest.raises(FormatError):
            array(bad)


def test_fast_and_strided_reads_agree(spark):
    data = np.arange(12, dtype="<i4").reshape(3, 4)
    rows = [("a", P.file(P.ndarray(0, [3, 4], "int32"), P.block(data.tobytes()))), ("b", P.file(P.ndarray(0, [3, 4], "int32", ", strides: [16, 4]"), P.block(data.tobytes())))]
    df = spark.createDataFrame(rows, "file string, content binary")
    found = {}
    for r in frames.read_array(df, "data", "int32", 2).collect():
        found.setdefault(r.file, {})[r.i0, r.i1] = r.value
    assert found["a"] == found["b"] == {(i, j): 4 * i + j for i in range(3) for j in range(4)}


def test_shared_block_and_inlining(spark):
    text = P.ndarray(0, [2], "uint8") + "\nother: !core/ndarray-1.1.0 {source: 0, shape: [2], datatype: uint8, byteorder: big}\ngone: !core/ndarray-1.1.0 {source: 9, shape: [2], datatype: uint8}"
    df = spark.createDataFrame([("a", P.file(text, P.block(b"\5\6")))], "file string, content binary")
    row = frames.inlined(df).first()
    root = T.parse(row.tree)
    assert A.plain(A.get(A.get(root, "data"), "data")) == ["5", "6"] and A.plain(A.get(A.get(root, "other"), "data")) == ["5", "6"] and row.skipped == ["/gone"]


def test_broken_files_have_a_row_and_no_others(spark):
    df = spark.createDataFrame([("a", b"junk"), ("b", P.file("a: [", P.block(b"abc"))), ("c", None)], "file string, content binary")
    assert {r.file: r.error for r in frames.files(df).collect()} == {"a": "InvalidHeader", "b": None}
    assert frames.nodes(df).count() == 0 and frames.blocks(df).count() == 1
    kinds = [r.type for r in frames.events(df).orderBy("file", "seq").collect()]
    assert kinds == ["format_version", "standard_version", "block_index", "tree_start", "tree_end", "block", "end"]
