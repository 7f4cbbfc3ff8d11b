import html
import random
import re

import pytest

from rowloom.llm import html_text, queries


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines():
    rng = random.Random(12)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 14)) for _ in range(2))
        places = html_text.common_lines(a, b)
        assert places == sorted(set(places)) and len(places) == brute_common(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def text_of(page):
    lines = [(t, inside) for t, inside, marked in html_text.lines_of(page) if not marked]
    own = [t for t, inside in lines if inside]
    return " ".join(own or [t for t, _ in lines])


def test_furniture_goes():
    page = """<!doctype html><html><head><title>T</title><meta charset=utf-8><style>p>a{}</style><script>if (a<b) {"</p>"}</script></head><body class="page">
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><ul><li>Sub</ul></ul></nav><div class="cookie-notice">We use <b>cookies</b><div>OK</div></div>
    <main><article><header><h1>A&nbsp;title &amp; more</h1></header><p class='lead'>First <em>par</em>agraph
      here.<p>Second<br>line &lt;b&gt; &#8364;<div class="ad-slot"><p>Buy!</p></div><form action="x"><input name=q><button>Go</button></form><!-- no <p>x</p> -->
    <table><tr><td>one</td><td>two</td></tr></table><aside>See also</aside><section id="comments"><p>First!</p></section></article></main>
    <div id="sidebar"><p>Side</p></div><footer>&copy; us</footer></body></html>"""
    assert text_of(page) == "A title & more First paragraph here. Second line <b> € one two"


def test_broken_markup():
    assert text_of("<article><p><b>One<br><p>Two</p><p><b>Three") == "One Two Three"
    assert text_of("<div class=ad>x<article>kept</article>") == "kept"
    assert text_of("plain & simple <") == "plain & simple <"
    assert text_of('<article><p title="a>b">t</p><p class="ad">gone<p>stays</article><footer>f') == "t stays"
    assert text_of("<article>a<script>never closed") == "a"
    assert text_of("") == "" and html_text.lines_of("<nav>") == []


def test_class_words_inside_articles():
    assert text_of('<article><div class="search">About search</div><p id="reply">A reply</p><p class="notice">Note</p><div class="comments">gone</div></article>') == "About search A reply Note"
    assert text_of('<div class="notice">gone</div><p><a href="/x">one link</a></p><ul><li><a>menu</a><li><a>of links</a></ul><p>rest</p>') == "one link rest"


def brute_lines(page):
    """Lines of the tables' plain pages: (text, inside the article, furniture)."""
    page = re.sub(r"(?s)<(script|style|title)>.*?</\1>|<!--.*?-->", "", page or "")
    out = []
    for part in re.split(r"(?=<(?:nav|article|footer|div)\b)|(?<=</nav>)|(?<=</article>)|(?<=</div>)", page):
        for piece in re.split(r"<(?!/?(?:b|a)\b)[^>]*>", part):
            if text := " ".join(html.unescape(re.sub(r"<[^>]*>", "", piece)).split()):
                out.append((text, part.startswith("<article"), part.startswith(("<nav", "<footer", '<div class="ad"'))))
    return out


def brute_extract(pages):
    """Every page against the nearest pages of its host with other lines, by the longest common subsequence of whole pages."""
    place = {}
    for p, url, page in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        place[p] = ((m[1].lower(), m[2]) if m else ("", ""), brute_lines(page))
    order = sorted(place, key=lambda p: (place[p][0], p))
    out, deleted = {}, {}
    for i, p in enumerate(order):
        (host, path), lines = place[p]
        words = [t for t, _, _ in lines]
        near = []
        for way in (order[:i][::-1], order[i + 1 :]):
            other = next((q for q in way if [t for t, _, _ in place[q][1]] != words), None)
            if other is not None and place[other][0][0] == host:
                agree = next((k for k, (x, y) in enumerate(zip(path, place[other][0][1])) if x != y), min(len(path), len(place[other][0][1])))
                near.append((agree, [t for t, _, _ in place[other][1]]))
        gone = None
        found = [brute_places(words, x) for _, x in sorted(near, key=lambda x: -x[0])]
        for c in found:
            if 2 * sum(lines[k][1] for k in c) <= sum(x for _, x, _ in lines):
                gone = set(c)
                break
        if gone is None:
            gone = {k for k in found[0] if not lines[k][1]} if found else {k for k, x in enumerate(lines) if not x[1]}
        deleted.setdefault((host, str(lines)), set()).update(gone)
        out[p] = host, lines, bool(found)
    for p, (host, lines, found) in out.items():  # equal pages of a host lose the same lines
        gone = deleted[host, str(lines)]
        out[p] = " ".join(t for k, (t, _, mark) in enumerate(lines) if not mark and k not in gone), len([k for k in gone if found and not lines[k][2]])
    return out


def brute_places(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_table_by_brute_force(spark, size):
    pages = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute_extract(pages)
    rows = queries.op7_html_text(spark, f"/root/testdata/{size}").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["text"], r["n_by_difference"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    if size == "sf0.1":
        assert sum(r["n_by_difference"] for r in rows) > 100 and sum(r["n_shared"] for r in rows) > 400


def test_differencing(spark):
    shared = ["Welcome to the site", "All rights reserved to us"]
    page = lambda own: "<body><div>" + shared[0] + "</div>" + "".join(f"<p>{x}</p>" for x in own) + f"<div>{shared[1]}</div></body>"
    rows = [(i, f"http://h/{i // 10}/{i}", page([f"own line {i}", f"and {i * 7}"])) for i in range(60)] + [(99, "http://lone/x", page(["only"]))]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r["page_id"]: r["text"] for r in html_text.extract(docs).collect()}
        assert got == {i: f"own line {i} and {i * 7}" for i in range(60)} | {99: f"{shared[0]} only {shared[1]}"}


def test_copies_of_an_article_stay(spark):
    article = "<body><nav>menu</nav><article><p>same text</p></article></body>"
    rows = [(1, "http://h/a", article), (2, "http://h/b", article), (3, "http://h/c", article.replace("same", "other"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "same text", 2: "same text", 3: "other text"}


def test_edge_cases(spark):
    rows = [(1, None, None, "a"), (2, "", "", "b"), (None, "http://h/", "<p>x</p>", "c"), (None, "http://h/", "<p>x</p>", "c"), (5, "http://h/long", "<article>" + "<p>word </p>" * 60_000, "d")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html_text.extract(docs).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (2, 0), (5, 299_999)]
    assert html_text.extract(docs.limit(0)).count() == 0


def extracted(spark, rows, parts=None):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract(docs.repartition(parts) if parts else docs).collect()}


def test_differencing_decides_inside_articles(spark):
    page = lambda *own: "<body><article>" + "".join(f"<p>{x}</p>" for x in ("Share this text", *own, "Written by us")) + "</article><div>About us</div></body>"
    rows = [(i, f"http://h/{i}", page(f"one {i}", f"two {i}", f"three {i}")) for i in range(10, 30)]
    rows += [(1, "http://lone/x", page("a")), (2, "http://copies/a", page("a", "b", "c")), (3, "http://copies/b", page("a", "b", "d"))]
    want = {i: f"one {i} two {i} three {i}" for i in range(10, 30)} | {1: "Share this text a Written by us"}
    want |= {2: "Share this text a b c Written by us", 3: "Share this text a b d Written by us"}
    assert extracted(spark, rows) == want
    near = [(4, "http://copies/az", page("x", "y", "z"))]  # nearer to 2; not a copy of 2 or 3
    assert extracted(spark, rows + near) == want | {2: "a b c", 3: "a b d", 4: "x y z"}


def test_differencing_past_runs_of_equal_pages(spark):
    page = lambda own: f"<body><div>Welcome to the site</div><p>{own}</p><div>All rights reserved</div></body>"
    rows = [(i, f"http://h/b/{i:03}", page("copied text")) for i in range(200)] + [(500, "http://h/a", page("before")), (600, "http://h/c", page("after"))]
    want = {i: "copied text" for i in range(200)} | {500: "before", 600: "after"}
    for parts, lone in ((1, rows), (4, rows), (4, rows[:-1]), (4, [r for r in rows if r[0] != 500])):
        assert extracted(spark, lone, parts) == {i: want[i] for i, _, _ in lone}


def test_equal_pages_of_a_host_get_equal_text(spark):
    page = lambda *own: "<body>" + "".join(f"<p>{x}</p>" for x in own) + "</body>"
    rows = [(1, "http://h/a/1", page("top", "same one", "same two")), (2, "http://h/a/2", page("top", "x", "y")), (3, "http://h/m/3", page("nothing", "in common"))]
    rows += [(4, "http://h/z/4", page("top", "same one", "same two")), (5, "http://h/z/5", page("p", "q", "same two")), (6, "http://other/4", page("top", "same one", "same two"))]
    for parts in (1, 3):
        got = extracted(spark, rows, parts)
        assert got == {1: "same one", 2: "x y", 3: "nothing in common", 4: "same one", 5: "p q", 6: "top same one same two"}
