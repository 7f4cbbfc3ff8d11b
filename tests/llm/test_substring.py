import random

import numpy as np
import pyarrow as pa

from rowloom.llm import align, queries, substring


def brute_lcs(a, b):
    old = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(old[j] + 1 if x == y else max(old[j + 1], new[j]))
        old = new
    return old[-1]


def test_common_length():
    rng = random.Random(7)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in range(2))
        assert substring.common_length(a, b) == brute_lcs(a, b)


def test_chain_is_the_best_collinear_one():
    rng = random.Random(8)
    for _ in range(200):
        a = sorted(rng.choices(range(60), k=8))
        b = rng.choices(range(60), k=8)
        best = substring.chain(a, b, [5] * 8, gap_cost=0.02, most_gap=1000)[0]
        assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(best, best[1:], strict=False))

        def value(path):
            return sum(5 - (0.02 * (a[j] - a[path[k - 1]] + b[j] - b[path[k - 1]]) if k else 0) for k, j in enumerate(path))

        def search(path, i):
            top = value(path)
            for j in range(i, 8):
                if not path or (a[j] > a[path[-1]] and b[j] > b[path[-1]]):
                    top = max(top, search([*path, j], j + 1))
            return top

        assert abs(value(best) - search([], 0)) < 1e-9


def _docs(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(4000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    shared, fuzzy, short = words(60), words(90), words(30)
    docs, truth = [], {"shared": set(), "fuzzy": set()}
    for d in range(150):
        text = words(rng.randint(20, 250))
        at = rng.randint(0, len(text))
        if d < 40:
            text[at:at] = shared
            truth["shared"].add(d)
        elif d < 60:
            copy = list(fuzzy)
            for i in range(rng.randint(0, 9), 90, 14):
                copy[i] = rng.choice(vocabulary)
            if d % 2:
                del copy[45]
            text[at:at] = copy
            truth["fuzzy"].add(d)
        elif d < 90:
            text[at:at] = short
        docs.append((d, " ".join(text)))
    return docs, truth


def test_planted_passages(spark):
    docs, truth = _docs(spark)
    rows = substring.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    texts = dict(docs)
    for r in rows:
        a, b = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]], texts[r["other_doc_id"]].split()[r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 50 and brute_lcs(a, b) == r["equal_words"] >= 0.8 * max(len(a), len(b))
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for r in rows:
        root[find(r["doc_id"])] = find(r["other_doc_id"])
    assert {r[k] for r in rows for k in ("doc_id", "other_doc_id")} == truth["shared"] | truth["fuzzy"]
    assert len({find(d) for d in truth["shared"]}) == 1 and len({find(d) for d in truth["fuzzy"]}) == 1


def test_fragments_elsewhere_do_not_hide_a_passage(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(4000)]
    passage = rng.choices(vocabulary, k=55)
    docs = [(i, " ".join(rng.choices(vocabulary, k=30) + passage[i : i + 20] + rng.choices(vocabulary, k=30))) for i in range(0, 36)]
    docs += [(100, " ".join(passage)), (101, " ".join(rng.choices(vocabulary, k=9) + passage))]
    rows = substring.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {frozenset((r["doc_id"], r["other_doc_id"])) for r in rows} == {frozenset((100, 101))}


def test_a_repeating_phrase_is_one_run(spark):
    rng = random.Random(12)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    phrase = fresh(3)
    a, b = fresh(30) + phrase * 90 + fresh(20), fresh(10) + phrase * 60 + fresh(25)
    passage = fresh(60)
    a, b = a + passage, b + passage
    rows = substring.passages(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()
    assert len(rows) == 2
    for r in rows:
        x, y = (a, b) if r["doc_id"] == 1 else (b, a)
        assert brute_lcs(x[r["start_word"] : r["end_word"]], y[r["other_start"] : r["other_end"]]) == r["equal_words"]
        assert r["run_start"] <= r["start_word"] < r["end_word"] <= r["run_end"] and r["other_run_start"] <= r["other_start"] < r["other_end"] <= r["other_run_end"]
    loop = max(rows, key=lambda r: r["n_passages"])
    held = 30 if loop["doc_id"] == 1 else 10
    assert loop["n_passages"] > 1 and loop["run_start"] <= held + 3 and loop["run_end"] >= held + len(phrase) * (90 if loop["doc_id"] == 1 else 60) - 3


def test_query_runs_whole(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_substring_dedup(spark, sf_dir).collect()
    found = {r[k] for r in rows for k in ("doc_id", "other_doc_id")}
    grams = {}
    for d, w in docs.items():
        for i in range(len(w) - 54):
            grams.setdefault(tuple(w[i : i + 55]), set()).add(d)
    want = set().union(*[s for s in grams.values() if len(s) > 1])
    assert want and want <= found


def classes(rows):
    root = {}

    def find(d):
        root.setdefault(d, d)
        while root[d] != d:
            d = root[d]
        return d

    for r in rows:
        root[find(r["doc_id"])] = find(r["other_doc_id"])
    return {d: find(d) for d in root}


def test_query_by_brute_force(spark, sf_dir, monkeypatch):
    """All pairs of documents that share a 5-gram, by alignment with scores at which a best range has at least 0.8 equal words."""
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_substring_dedup(spark, sf_dir).collect()
    for r in rows:
        a, b = docs[r["doc_id"]][r["start_word"] : r["end_word"]], docs[r["other_doc_id"]][r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 50 and substring.common_length(a, b) == r["equal_words"] >= 0.8 * max(len(a), len(b))
    grams = {}
    for d, w in docs.items():
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i : i + 5]), set()).add(d)
    near = sorted({(x, y) for s in grams.values() for x in s for y in s if x < y})
    number = {w: k for k, w in enumerate(sorted({w for t in docs.values() for w in t}), 1)}
    coded = {d: np.array([number[w] for w in t], np.uint64) for d, t in docs.items()}
    monkeypatch.setattr(align, "MATCH", 1)
    monkeypatch.setattr(align, "MISMATCH", -4)
    monkeypatch.setattr(align, "GAP", -4)
    found = align.smith_waterman([(coded[x], coded[y]) for x, y in near])
    want = [p for p, (_, equal, lo, hi) in zip(near, found, strict=True) if equal >= 50 and hi - lo >= 50]
    got = classes(rows)
    assert len(want) > 20
    assert all(x in got and y in got and got[x] == got[y] for x, y in want)


def noisy(rng, n, edits, fragments, cut):
    """A passage of ``n`` words, a copy with ``edits`` words replaced, dropped or put in, and documents with fragments of ``cut`` words of it."""
    fresh = lambda m: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(m)]
    passage = fresh(n)
    copy = list(passage)
    for at in sorted(rng.sample(range(n), edits), reverse=True):
        kind = rng.random()
        copy[at : at + (kind < 0.8)] = fresh(1) if kind < 0.6 or kind >= 0.8 else []
    texts = [fresh(rng.randint(0, 40)) + passage + fresh(9), fresh(rng.randint(0, 40)) + copy + fresh(5)]
    for _ in range(fragments):
        at = rng.randint(0, n - cut)
        texts.append(fresh(rng.randint(3, 9)) + passage[at : at + cut] + fresh(4))
    return [" ".join(t) for t in texts]


def test_a_copy_among_thousands_of_fragments(spark):
    texts = noisy(random.Random(21), 100, 4, 3450, 12)
    rows = substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert {frozenset((r["doc_id"], r["other_doc_id"])) for r in rows} == {frozenset((0, 1))}


def test_recall_of_fuzzy_passages_under_fragments(spark):
    rng = random.Random(22)
    for n, edits, cut, least in ((60, 2, 12, 0.98), (100, 4, 17, 0.98), (100, 10, 12, 0.95), (60, 6, 12, 0.9), (150, 8, 30, 0.95), (60, 9, 12, 0.75), (60, 0, 45, 0.9)):
        docs, pairs = [], []
        for _ in range(60):
            pairs.append((len(docs), len(docs) + 1))
            docs += noisy(rng, n, edits, 25, cut)
        got = classes(substring.passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect())
        hit = sum(x in got and y in got and got[x] == got[y] for x, y in pairs)
        print(n, edits, cut, hit / len(pairs))
        assert hit >= least * len(pairs), (n, edits, cut, hit / len(pairs))


def test_rows_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for parts in (1, 6, 13):
        found.append(sorted(map(repr, substring.passages(docs.repartition(parts, "doc_id")).collect())))
    assert found[0] and found[0] == found[1] == found[2]


def test_edge_cases(spark):
    rng = random.Random(11)
    text = " ".join(str(rng.random()) for _ in range(70))
    rows = [(1, text, 1), (1, text, 1), (2, text, 2), (None, text.upper(), 3), (4, None, 4), (5, "", 5), (6, "word " * 100_000, 6), (6, "other text", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start_word int")
    got = substring.passages(docs).collect()
    assert {r[k] for r in got for k in ("doc_id", "other_doc_id")} == {1, 2, None}
    assert all((r["start_word"], r["end_word"], r["similarity"]) == (0, 70, 1.0) for r in got)
    assert substring.passages(docs.limit(0)).count() == 0


def test_chains_of_a_pair_are_one_row_a_document(spark, monkeypatch):
    rng = random.Random(13)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    phrase, passage = fresh(3), fresh(60)
    docs = [(i, " ".join(fresh(10) + phrase * (40 + 10 * i) + fresh(20) + passage)) for i in range(6)]
    kept, plain = {}, substring.materialise
    monkeypatch.setattr(substring, "materialise", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert max(r["n_passages"] for r in rows) > 10
    pairs = kept["chains"].select("pair").distinct().count()
    assert pairs and kept["chains"].count() == 2 * pairs


def test_ranges_asked_of_a_document_are_cut_from_what_they_cover():
    rng = random.Random(14)
    for n_ranges in (1, 2, 3, 30):
        words = [f"w{i}" for i in range(300)]
        ranges = [(low := rng.randrange(300), low + rng.randint(1, 60), 3, 5) for _ in range(n_ranges)]
        places, stretches = substring._asked(np.array(ranges, np.int32).tobytes(), len(words))
        cut = [w for low, high in stretches for w in words[low:high]]
        assert len(cut) == len(set(cut)) == len({i for low, high, *_ in ranges for i in range(low, min(high, 300))})
        for (low, high, left, right), (at, size, *rest) in zip(ranges, np.frombuffer(places, np.int32).reshape(-1, 5).tolist(), strict=True):
            assert cut[at : at + size] == words[low:high] and rest == [low, left, right]


def test_cut_words_of_a_long_document_are_passed_on_in_small_batches():
    text = " ".join(f"w{i}" for i in range(20_000))
    asked = np.array([0, 20_000, 0, 20_000], np.int32).tobytes()
    n = 400
    columns = {"kind": [0] + [1] * n, "doc_id": [7] + [None] * n, "text": [text] + [None] * n, "pair": [None, *range(n)], "side": [None] + [0] * n, "ranges": [None] + [asked] * n}
    out = list(substring._cut(iter([pa.RecordBatch.from_pydict(columns)])))
    assert sum(b.num_rows for b in out) == n and max(b.nbytes for b in out) < 2 * substring.BATCH_BYTES
    assert all(w.as_py() == text.encode() for b in out for w in b.column(4))
