"""Main text of web pages: page structure, and line differences between neighbours by URL.

Pages of a host are sorted by URL path and each is paired with the neighbour whose path agrees longest. All text lines
of the two, menus and footers included, are aligned by longest common subsequence; lines they share are page furniture
and are deleted, wherever they stand. Lines inside ``article`` or ``main`` guard against copies only: a neighbour that
shares more than half of those of a page is a copy of it, so the other neighbour decides, and if both are copies the
lines inside stay (copies of an article must not erase each other). A page that has no neighbour keeps the lines inside,
if any, and else all.

Furniture that differs from page to page cannot be found so. It is marked by element, role and class: menus, headers,
footers, sidebars, notices, adverts, forms and reader comments go wherever they stand, and so do runs of list items that
are links only, outside ``article`` and ``main``. Inside an ``article`` fewer class names count. Scripts, styles and
other text that is not shown are no lines. The counts tell what each rule did: ``n_lines`` of the page, ``n_marked``,
``n_shared`` with the neighbour, and ``n_by_difference``, those deleted as shared that nothing marked.

White space inside a line becomes one space; lines are joined by one. Character references are decoded. Edge cases: null
or empty html gives an empty text; pages without a host are paired like a host; a single page on a host has no
neighbour; pages with the same lines in a row are one run with the same neighbours, the last different page before and
the first after them; what is deleted from a page is deleted from all equal pages of its host, so these get the same
text; unclosed and mismatched tags are tolerated; extra columns do not matter.
"""

from __future__ import annotations

import html as html_module
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .url_filter import host_of, path_of

# Element names, roles and words of class and id attributes, in plain groups.
DROP = frozenset("nav footer aside form script style noscript template iframe svg object select textarea button dialog menu title".split())
RAW = frozenset("script style textarea title template noscript iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion comment comments discussion disqus newsletter subscribe".split()
)
OUTSIDE = WORDS | frozenset(
    "aside header masthead topbar banner notice notices alert popup modal overlay reply replies respond share sharing social related recommended signup login "
    "search widget pagination pager toolbar copyright skip".split()
)  # outside of article elements these count as well
BROADCAST_BYTES = 100_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _furniture(tag: str, attrs: str, article: bool, inside: bool) -> bool:
    if tag in DROP or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main") or not attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            if not (WORDS if article else OUTSIDE).isdisjoint(_WORD.findall(_CAMEL.sub(" ", value).lower())):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside article or main, marked as furniture) of each text line, in page order."""
    out: list[list] = []
    links: list[bool] = []  # of each line: a list item that is all link
    buffer: list[str] = []
    linked = plain = item = False
    inside = article = in_link = 0
    skip, depth, soft = "", 0, False  # the furniture element one is in, its nesting, and whether it is known by its class only
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked, plain
        text = " ".join(html_module.unescape("".join(buffer)).split())
        if text:
            out.append([text, inside > 0, bool(skip)])
            links.append(item and linked and not plain and not inside)
        buffer.clear()
        linked = plain = False

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            buffer.append(text)
            if text.strip():
                if in_link:
                    linked = True
                else:
                    plain = True
        if not m:
            break
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if skip:
            if close:
                if tag == skip:
                    depth -= 1
                elif tag in ("body", "html") or (skip in SELF_CLOSING and tag in ("ul", "ol", "dl", "table", "div", "section", "article")):
                    depth = 0
            elif tag == skip:
                depth = 0 if skip in SELF_CLOSING else depth + 1
            elif (skip == "p" and tag in BLOCK and tag != "br") or (soft and tag in ("article", "main")):
                depth = 0
            if depth <= 0:
                flush()
                skip = ""
                if close:
                    in_link = in_link and tag != "a"
                    continue
        if close:
            if not skip and tag in ("article", "main") and inside:
                inside -= 1
                article -= tag == "article" and article > 0
            elif tag == "a":
                in_link = 0
            elif tag in ("li", "ul", "ol"):
                item = False
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif skip:
            in_link = in_link or tag == "a"
        elif _furniture(tag, attrs, article > 0, inside > 0):
            flush()
            if not attrs.endswith("/"):
                skip, depth, soft = tag, 1, tag not in DROP
        elif tag in ("article", "main"):
            inside += 1
            article += tag == "article"
        elif tag == "a":
            in_link = 1
        elif tag == "li":
            item = True
    flush()
    for i, link in enumerate(links):
        if link and (i and links[i - 1] or i + 1 < len(links) and links[i + 1]):
            out[i][2] = True
    return [tuple(x) for x in out]


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (equal ends first, then Hunt and Szymanski)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


PARSED = "page_id long, url string, host string, path string, texts array<string>, inside array<boolean>, marked array<boolean>, hashes array<long>"
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("texts", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_())), ("marked", pa.list_(pa.bool_())), ("hashes", pa.list_(pa.int64()))])


def _parse(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Each page's lines: text, whether inside article or main, whether marked as furniture, hash."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), F.col(f"`{html}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for p, u, h, path, page in zip(*(some.column(i).to_pylist() for i in range(5)), strict=True):
                    lines = lines_of(page or "")
                    row = {"page_id": p, "url": u, "host": h, "path": path, "texts": [t for t, _, _ in lines], "inside": [x for _, x, _ in lines]}
                    row |= {"marked": [x for _, _, x in lines], "hashes": [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _, _ in lines]}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=_PARSED)

    return rows.mapInArrow(run, PARSED)


def _agree(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _borders(ordered: DataFrame) -> list[tuple[int, int]]:
    """(range, row): the pages of other ranges that each range's first and last page may be paired with.

    These are the nearest pages that have other lines than the range's first (last) page, past whole ranges of equal ones. A
    few numbers a range come to the driver; the pages themselves are fetched by a join.
    """
    page = F.struct("host", "path", "row", "kind")
    rim = sorted(ordered.groupBy("range").agg(F.min(page).alias("first"), F.max(page).alias("last")).select("range", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("row", "kind")]).collect(), key=lambda r: r["range"])
    if not rim:
        return []
    ends = ordered.sparkSession.createDataFrame([(r["range"], r["first_kind"], r["last_kind"]) for r in rim], "range int, f long, l long")
    second, penult = F.min(F.when(F.col("kind") != F.col("f"), page)), F.max(F.when(F.col("kind") != F.col("l"), page))
    inner = ordered.join(F.broadcast(ends), "range").groupBy("range").agg(second.alias("second"), penult.alias("penult"))
    found = {r["range"]: r for r in inner.select("range", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("second", "penult") for c in ("row", "kind")]).collect()}
    n, out = len(rim), []
    for step, near, far, own in ((-1, "last", "penult", "first"), (1, "first", "second", "last")):
        other: list = [None] * n  # (row, kind); the kind tells hosts apart too
        for i in range(1, n) if step < 0 else range(n - 2, -1, -1):
            j = i + step
            if rim[j][f"{near}_kind"] != rim[i][f"{own}_kind"]:
                other[i] = rim[j][f"{near}_row"]
            else:
                x = found[rim[j]["range"]]
                other[i] = other[j] if x[f"{far}_row"] is None else x[f"{far}_row"]
        out += [(rim[i]["range"], row) for i, row in enumerate(other) if row is not None]
    return out


def _shared(before: tuple | None, run: list, after: tuple | None) -> Iterator[dict]:
    """``same``, ``shared`` and ``lone`` of those pages of a run of equal ones that are not left as they are. Pages: (place, lines, inside, own, same)."""
    near = [(_agree(run[e][0][1], x[0][1]), x[1]) for e, x in ((0, before), (-1, after)) if x and x[0][0] == run[0][0][0]]
    lines = list(run[0][1])
    found = [common_lines(lines, list(x)) for _, x in sorted(near, key=lambda x: -x[0])] if lines else []
    seen: set = set()  # pages of a run differ at most in what lies inside an article
    for _, _, inside, own, same in run:
        if not own or same in seen:
            continue
        seen.add(same)
        total = sum(inside)
        if not found:
            if 0 < total < len(inside):
                yield {"same": same, "shared": [], "lone": True}
            continue
        shared = next((c for c in found if 2 * sum(inside[i] for i in c) <= total), None)
        if shared is None:
            shared = [i for i in found[0] if not inside[i]]
        if shared:
            yield {"same": same, "shared": shared, "lone": False}


def _difference(rows: DataFrame) -> DataFrame:
    """``rows``: row, host, path, hashes, inside, same. Gives for each ``same`` the places of lines to delete as shared with a nearest neighbour, and whether there is none."""
    kinds = rows.withColumn("kind", F.xxhash64("host", "hashes"))
    ordered = materialise(kinds.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row").withColumn("range", F.spark_partition_id()), "by-url")
    asked = rows.sparkSession.createDataFrame(_borders(ordered), "asking int, row long")  # two numbers a range
    columns = ["host", "path", "row", "hashes", "range", "inside", "kind", "same"]
    lent = ordered.join(F.broadcast(asked), "row").drop("range").withColumnRenamed("asking", "range").select(*columns, F.lit(False).alias("own"))
    met = ordered.select(*columns, F.lit(True).alias("own")).union(lent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        same: list = []
        kind, before = None, None
        for batch in batches:
            for h, p, r, x, inside, k, equal, own in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7, 8)), strict=True):
                page = ((h, p, r), x, inside, own, equal)
                if same and k != kind:
                    out.extend(_shared(before, same, page))
                    before, same = same[-1], []
                kind = k
                same.append(page)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=_SHARED)
                    out = []
        if same:
            out.extend(_shared(before, same, None))
        yield pa.RecordBatch.from_pylist(out, schema=_SHARED)

    one = met.repartition("range").sortWithinPartitions("range", "host", "path", "row")

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each_range(batches, run)

    found = one.mapInArrow(by_range, "same long, shared array<int>, lone boolean")
    places = found.select("same", "lone", F.explode_outer("shared").alias("place"))
    return places.groupBy("same").agg(F.sort_array(F.collect_set("place")).alias("shared"), F.max("lone").alias("lone"))  # a page's lines at most


_SHARED = pa.schema([("same", pa.int64()), ("shared", pa.list_(pa.int32())), ("lone", pa.bool_())])


def _each_range(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """Run ``run`` on the batches of each range in turn; a task may hold several ranges."""
    source = _cut(batches)
    ahead = next(source, None)
    while ahead is not None:
        current = ahead[0]

        def one():
            nonlocal ahead
            while ahead is not None and ahead[0] == current:  # noqa: B023
                yield ahead[1]
                ahead = next(source, None)

        yield from run(one())


def _cut(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ranges = batch.column(4).to_numpy(zero_copy_only=False)
        at = 0
        for i in range(1, len(ranges) + 1):
            if i == len(ranges) or ranges[i] != ranges[at]:
                yield int(ranges[at]), batch.slice(at, i - at)
                at = i


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars, and the counts n_lines, n_marked, n_shared, n_by_difference."""
    parsed = materialise(_parse(pages, page_id, url, html).withColumns({"row": F.monotonically_increasing_id(), "same": F.xxhash64("host", "hashes", "inside")}), "parsed")
    shared = materialise(_difference(parsed.select("host", "path", "row", "hashes", "inside", "same")), "shared")
    if (shared.agg(F.sum(F.size("shared") * 4 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        shared = F.broadcast(shared)  # checked: so few bytes; the texts need no shuffle then
    rows = parsed.select("same", "page_id", "url", "texts", "inside", "marked").join(shared, "same", "left")
    guarded = F.coalesce("lone", F.lit(False))
    by_tag = lambda i: F.get("marked", i) | (guarded & ~F.get("inside", i))
    by_difference = lambda i: F.coalesce(F.array_contains("shared", i), F.lit(False))
    kept = F.filter(F.col("texts"), lambda t, i: ~by_tag(i) & ~by_difference(i))
    found = F.coalesce("shared", F.array().cast("array<int>"))
    only = F.size(F.filter(found, lambda i: ~by_tag(i)))
    counts = [F.size("texts").alias("n_lines"), F.size(F.filter("texts", lambda t, i: by_tag(i))).alias("n_marked"), F.size(found).alias("n_shared"), only.alias("n_by_difference")]
    out = rows.select("page_id", "url", F.array_join(kept, " ").alias("text"), *counts)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_marked", "n_shared", "n_by_difference")
