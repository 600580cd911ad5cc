import random

import pytest

from treeblock.llm import webtext as H

PAGE = (
    "<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<!-- <article>no</article> --><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p><b>One\n  two<br>three.<br><p>F<i>ou</i>r&nbsp;5 &lt;x&gt; &#233;</p>"
    "<aside>side</aside><div class=\"comments\"><p>first!</p></div><form><p>mail</p></form><ul><li>a<li>b</ul></article><footer>&copy; us</footer>"
)


def test_article_only():
    assert H.blocks(PAGE) == (["Title & more", "One two", "three.", "Four 5 <x> é", "a", "b"], True)


@pytest.mark.parametrize(
    "page,lines",
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<main><p>x</p></main><p>y</p>", ["x"]),
        ("<article>a</article><article>b</article>", ["a", "b"]),
        ("<article><p>cut &amp; da", ["cut & da"]),
        ("<article><p>cut <b", ["cut"]),
        ("<p title='a>b'>x</p>", ["x"]),
        ("<p>1 < 2</p>", ["1 < 2"]),
        ("<p class='leading'>x</p><p class='ad-box'>y</p><p>z</p>", ["x", "z"]),
        ("<div hidden>x</div><p>y</p>", ["y"]),
        ("<script>if (a<b) {}</script><p>x</p>", ["x"]),
        ("</p></div><p>x</p></body></html>", ["x"]),
        ("<article><p>&am", ["&am"]),
        ("a" + "<" * 2000, ["a" + "<" * 2000]),
    ],
)
def test_pages(page, lines):
    assert H.blocks(page)[0] == lines


def test_unmarked_pages_lose_what_neighbours_share(spark):
    frame = lambda i: f"<body><div>Top line</div><p>only page {i} says this, at some length</p><p>and that {i}</p><div>Bottom line</div></body>"
    rows = [(i, f"http://h.org/a/{i}", frame(i)) for i in range(6)] + [(10, "http://other.org/", frame(1)), (11, None, None), (12, "http://h.org/b", "<article>Top line</article>")]
    rows += [(20, "http://c.org/1", "<p>copy of one page</p>"), (21, "http://c.org/2", "<p>copy of one page</p>")]
    out = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for i in range(6):
        assert out[i].text == f"only page {i} says this, at some length and that {i}"
    assert "Top line" in out[10].text and out[11].text == "" and out[12].text == "Top line"
    assert out[20].text == out[21].text == "copy of one page" and out[20].n_chars == 16
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_is_longest(monkeypatch):
    rng = random.Random(2)
    cases = [("m1 A m2 B m3 C r1 r2".split(), "r1 r2 m1 X m2 Y m3 Z".split()), ([], ["a"]), (["a"], [])]
    cases += [([rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcde") for _ in range(rng.randint(0, 90))]) for _ in range(60)]
    for a, b in cases:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for limit in (H.TABLE, 4):
            monkeypatch.setattr(H, "TABLE", limit)
            found = H.common(a, b)
            assert len(found) == table[-1][-1] and all(a[i] == b[j] for i, j in found)
            assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:], strict=False))


def test_large_frame_goes_from_short_articles(spark):
    frame = "".join(f"<div>menu entry of some length {i}</div>" for i in range(20))
    rows = [(i, f"http://h.org/a/{i}", f"<body>{frame}<p>short {i}</p></body>") for i in range(3)]
    out = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in out) == ["short 0", "short 1", "short 2"]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_pairs_are_the_nearest_other_pages(spark, parts, monkeypatch):
    monkeypatch.setattr(H, "partitions", lambda df: parts)
    rng = random.Random(parts)
    rows = [(i, None, f"h{i % 3 * i % 2}", f"/{rng.randint(0, 400):03d}", [f"text {rng.choice([0, 0, 0, 0, i])}"] if i % 7 else [f"{i}"]) for i in range(150)]
    rows += [(200 + i, None, "h1", f"/2{i:02d}x", ["same"]) for i in range(60)] + [(300, None, "alone", "/", ["x"]), (301, None, "", "", ["y"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, lines array<string>").selectExpr("page_id as rid", "*")
    found = {r.rid: (r.before, r.after) for r in H.paired(pages).collect()}
    assert len(found) == len(rows)
    by_host = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        by_host.setdefault(r[2], []).append(r)
    for group in by_host.values():
        for i, r in enumerate(group):
            for side, near in zip(found[r[0]], (reversed(group[:i]), group[i + 1 :]), strict=True):
                want = next((x for x in near if x[4] != r[4]), None)
                assert (side and (side.path, side.lines)) == (want and (want[3], want[4]))


@pytest.mark.parametrize(
    "page,lines",
    [
        ("<main><h1>t</h1><p>a</p><article class='card'>teaser</article><article>other</article></main>", ["t", "a", "teaser", "other"]),
        ("<article>elsewhere</article><main><p>menu of the page</p><article><h2>t</h2><p>a</p></article></main>", ["t", "a"]),
        ("<body><header><h1>site</h1></header><h1>title</h1><article><p>a</p></article><p>after</p>", ["title", "a"]),
        ("<h1>x</h1><article><h1>title</h1><p>a</p></article>", ["title", "a"]),
        ("<div role=main><p>a</p></div><p>b</p>", ["a"]),
    ],
)
def test_scope(page, lines):
    assert sorted(H.blocks(page)[0]) == sorted(lines) and H.blocks(page)[1]


def brute_main_text(rows):
    """Neighbours by sorting, common subsequences by the quadratic table."""
    by, out = {}, {}
    for i, url, page in rows:
        host, _, path = (url or "://").partition("://")[2].partition("/")
        lines = H.lines_of(page)
        by.setdefault(host, []).append((f"/{path}" if url else "", i, lines, *H.scope(lines)))
    for group in by.values():
        group.sort(key=lambda x: x[:2])
        for k, (path, i, lines, inside, marked) in enumerate(group):
            own = [x.text for x in lines]
            near = [next((g for g in side if [x.text for x in g[2]] != own or g[3:] != (inside, marked)), None) for side in (group[:k][::-1], group[k + 1 :])]
            near = sorted((g for g in near if g), key=lambda g: -len(H.commonprefix([g[0], path])))
            lost, first = set(), None
            for g in near:
                other = [x.text for x in g[2]]
                best = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
                for a in range(len(own)):
                    for b in range(len(other)):
                        best[a + 1][b + 1] = best[a][b] + 1 if own[a] == other[b] else max(best[a][b + 1], best[a + 1][b])
                a, b, pairs = len(own), len(other), []
                while a and b:
                    if own[a - 1] == other[b - 1] and best[a][b] == best[a - 1][b - 1] + 1:
                        a, b = a - 1, b - 1
                        pairs.append((a, b))
                    elif best[a - 1][b] >= best[a][b - 1]:
                        a -= 1
                    else:
                        b -= 1
                lost = {a for a, b in pairs if not (marked and inside[a] and (not g[4] or g[3][b]))}
                first = lost if first is None else first
                if len(pairs) <= H.NEAR_COPY * max(len(own), len(other)):
                    break
            else:
                lost = first or set()
            out[i] = " ".join(x.text for j, x in enumerate(lines) if inside[j] and j not in lost)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        host, frame = f"h{rng.choice([0, 0, 0, 1, 2, 3])}.org", rng.randrange(3)
        own = "".join(f"<p>{rng.choice(['text', 'quoted'])} {rng.randrange(40)} of {i if rng.random() < 0.8 else 0}</p>" for _ in range(rng.randrange(5)))
        body = rng.choice([f"{own}<div>read more</div>", f"<article>{own}<div>read more</div></article>", f"<main>{own}</main><div>read more</div>"])
        menu = "".join(f"<div>menu {frame} {k}</div>" for k in range(4))
        rows.append((i, f"http://{host}/{rng.randrange(30):02d}", f"<body>{menu}{body}<footer>end</footer></body>"))
    rows += [(900, None, "<p>x</p>"), (901, "http://alone.org/a", "<p>y</p>"), (902, "http://long.org/a", "<p>z</p>" * 30_000), (903, "http://long.org/b", "<p>z</p>" * 20_000 + "<p>w</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as rid", "2 as lines", "3 as host", "4 as text")
    got = {r.page_id: r.text for r in H.main_text(docs).collect()}
    assert got.pop(902) == " ".join(["z"] * 10_000) and got.pop(903) == "w"
    assert got == brute_main_text([r for r in rows if r[0] < 902])
