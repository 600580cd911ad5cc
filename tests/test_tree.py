import pytest
from pyspark.sql import functions as F

from treeblock.operators import compare, extensions
from treeblock.operators import tree as O
from treeblock.plans import render
from treeblock.plans.paths import Path, PathError, Step
from treeblock.sources import arrays as A
from treeblock.sources import treetext as T


def frame(spark, *texts):
    return O.from_text(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "f string, t string"), "f", "t")


def test_paths():
    assert Path.parse("/a//b/").steps == (Step("a", None), Step("b", None))
    assert Path.parse("a[0]/[-1]/2").steps == (Step("a", None), Step(None, 0), Step(None, -1), Step("2", 2))
    assert Path.parse("'a/b'/c\\/d").steps == (Step("a/b", None), Step("c/d", None))
    assert Path.parse("").steps == ()
    for bad in ("a[", "a[x]", "'a", "a\\", "[0]x"):
        with pytest.raises(PathError):
            Path.parse(bad)


def test_aliases_are_followed(spark):
    n = frame(spark, "a: &x {b: [1, 2]}\nc: *x\n", "a: 1")
    assert [r.text for r in O.lookup(n, "c/b/[1]").collect()] == ["2"]
    assert O.lookup(n, "c").first().kind == "mapping"


def test_first_of_equal_keys_counts(spark):
    assert O.lookup(frame(spark, "{a: 1, a: 2}"), "a").first().text == "1"


def test_cycles_end(spark):
    n = frame(spark, "&r\na: *r\nb: 1")
    assert n.count() == 3 and O.find(n, F.lit(True)).count() == 2
    assert "(cycle)" in render.tree(T.parse("&r\na: *r\nb: 1"))


def test_alias_bombs_are_bounded():
    text = "a0: &a0 [x, x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 9)}]\n" for i in range(1, 10))
    assert len(render.tree(T.parse(text))) < 1 << 20


def test_texts_without_a_tree(spark):
    assert frame(spark, None, "", "a: [", "b: *x").count() == 0


def test_insert_and_remove(spark):
    n = frame(spark, "a: [1, 2, 3]\nb: x")
    changed = O.insert(O.insert(O.remove(n, "a/-1".replace("-1", "2")), "b/c", 5), "a/2", "new")
    got = {r.node_path: r.text for r in changed.collect()}
    assert got == {"/": None, "/a": None, "/a/0": "1", "/a/1": "2", "/a/2": "new", "/b": None, "/b/c": "5"}
    assert O.insert(n, "", 7).first().text == "7"


def test_emit_reads_back():
    text = "a: &x [1, 'two', \"3\"]\nb: *x\nc: !core/thing-1.0.0 {d: 0x10, 'e/f': ~}\n"
    root = T.parse(text.replace("!core", "!<tag:stsci.edu:asdf/core").replace("thing-1.0.0", "thing-1.0.0>"))
    again = T.parse(T.emit(root))
    strip = lambda rows: [{k: v for k, v in r.items() if k not in ("anchor", "style")} for r in rows]
    assert strip(T.rows("f", root)) == strip(T.rows("f", again))


@pytest.mark.parametrize("value", ["y", "1", "1.5", "true", "", "~", "2020-01-01", "plain", "a: b", "0o17"])
def test_strings_stay_strings(value):
    node = T.parse(T.emit(T.of_value({"k": value}))).entries[0][1]
    from treeblock.sources.scalars import number

    assert node.text == value and (node.style != "plain" or number(value) == value)


@pytest.mark.parametrize("x,text", [(1.0, "1.0"), (1e300, "1.0e+300"), (float("inf"), ".inf"), (float("nan"), ".nan"), (0.1, "0.1")])
def test_floats(x, text):
    assert T.float_text(x) == text


def test_compare(spark):
    a, b = frame(spark, "{a: 1, b: 0x10, c: {d: 1, e: 2}, f: [1, 2], g: x, h: .nan}"), frame(spark, "{b: 16, a: 1.0, f: [1, 2, 3], g: {y: 1}, h: .nan, i: 1}")
    got = {(r.node_path, r.difference) for r in compare.differences(a, b).collect()}
    assert got == {("/c", "missing_right"), ("/f", "length"), ("/f/2", "missing_left"), ("/g", "kind"), ("/i", "missing_left")}
    assert compare.equal(a, a) and not compare.equal(a, b)
    assert compare.differences(a, b, limit=2).count() == 2


def test_extensions(spark):
    std = "tag:stsci.edu:asdf/"
    text = f"a: !<{std}core/software-1.0.0> {{name: n, version: '1'}}\nb: !<{std}core/software-1.0.0> {{name: n}}\nt: !<{std}time/time-1.1.0> J2000.0\nu: !<{std}time/time-1.1.0> 5"
    n = frame(spark, text)
    got = {r.node_path: (r.value and r.value["name"], r.err) for r in extensions.decoded(n, f"{std}core/software-1.0.0").collect()}
    assert got == {"/a": ("n", "OK"), "/b": (None, "PARSE_FAILURE")}
    times = {r.node_path: r for r in extensions.decoded(n, "stsci.edu:asdf/time/time-1.1.0").collect()}
    assert times["/t"].value["format"] == "jyear" and times["/u"].err == "PARSE_FAILURE"
    with pytest.raises(KeyError):
        extensions.decoded(n, "no-1.0.0")


def test_provenance():
    root = T.parse("asdf_library: {name: l, version: 1.0}\nhistory: {extensions: [{extension_class: c, software: {name: s, version: '2'}}, 3], entries: [{description: d}, {}]}")
    extensions.add_history(root, "more", [{"name": "w", "version": "3"}])
    m = extensions.meta(root)
    assert m["library"]["name"] == "l" and m["extensions"][0]["package"]["name"] == "s" and [e["description"] for e in m["entries"]] == ["d", "more"]
    bare = T.parse("history: [{description: one}]")
    assert extensions.meta(bare)["entries"][0]["description"] == "one"


def test_array_node_reads_back():
    a = A.parse(A.describe(0, [2, 3], "float32"))
    assert (a.shape, a.datatype, a.source) == ([2, 3], "float32", 0)
