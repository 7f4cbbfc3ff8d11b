import random
import re

import numpy as np
import pytest

from rowloom.llm import decontaminate, queries
from rowloom.llm.align import smith_waterman


def brute_alignment(a, b):
    """Best local score by the plain recurrence."""
    best, old = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, old[j] + (2 if x == y else -1), old[j + 1] - 1, new[j] - 1))
        best = max(best, *new)
        old = new
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(4)
    pairs = [(np.array(rng.choices(range(1, 5), k=rng.randint(0, 12)), np.uint64), np.array(rng.choices(range(1, 5), k=rng.randint(0, 30)), np.uint64)) for _ in range(300)]
    got = smith_waterman(pairs)
    for (a, b), (score, equal, start, end) in zip(pairs, got, strict=True):
        assert score == (brute_alignment(a.tolist(), b.tolist()) if len(a) and len(b) else 0)
        assert equal <= min(len(a), end - start) and 0 <= start <= end <= len(b)
        if score:
            assert brute_alignment(a.tolist(), b[start:end].tolist()) == score


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_verbatim_leaks_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: " ".join(words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: " ".join(words(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    rows = queries.op1_decontaminate(spark, sf).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert want and want <= found and len(rows) == len(found)
    assert all(r["similarity"] >= 0.8 for r in rows)
    assert len(found - want) <= 0.1 * len(want)


def _tables(spark, edit):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(30)]
    docs = []
    for d in range(120):
        text = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d < 60:
            copy = items[d % 30][1].split()
            copy = edit(rng, copy)
            at = rng.randint(0, len(text))
            text[at:at] = copy
        docs.append((d, " ".join(text)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_edited_copies_are_found_and_clean_ones_are_not(spark):
    def edit(rng, copy):
        for i in range(5, len(copy), 8):  # one word in eight replaced, one dropped, one put in; case and signs changed
            copy[i] = "changed"
        del copy[20]
        copy.insert(11, "extra")
        return [w.upper() + "," if rng.random() < 0.3 else w for w in copy]

    docs, items = _tables(spark, edit)
    rows = decontaminate.report(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, d % 30) for d in range(60)}
    kept = decontaminate.remove_leaks(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60, 120))


def test_half_copies_stay(spark):
    docs, items = _tables(spark, lambda rng, copy: copy[:20])
    assert decontaminate.report(docs, items).count() == 0
    assert decontaminate.remove_leaks(docs, items).count() == 120


def brute_leaks(docs, items):
    """Every document against every item by the plain alignment."""
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = words(item), words(text)
            if a and b:
                number = {w: k for k, w in enumerate(sorted({*a, *b}), 1)}
                found = smith_waterman([(np.array([number[w] for w in a], np.uint64), np.array([number[w] for w in b], np.uint64))])[0]
                if found[1] >= 0.8 * len(a):
                    out.add((d, i))
    return out


def edited(rng, copy, edits, kinds, vocabulary):
    copy = list(copy)
    for at in sorted(rng.sample(range(len(copy)), edits), reverse=True):
        kind = rng.choice(kinds)
        if kind == "replace":
            copy[at] = rng.choice(vocabulary)
        elif kind == "drop":
            del copy[at]
        else:
            copy.insert(at, rng.choice(vocabulary))
    return copy


@pytest.mark.parametrize("kinds", [["replace"], ["replace", "drop", "insert"]])
def test_edited_copies_match_brute_force(spark, kinds):
    rng = random.Random(8)
    rare = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(rare, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15, 16, 17, 18, 19, 20, 20, 23, 25, 30, 40, 60])]
    docs, too_many = [], set()
    for d in range(12 * len(items)):
        copy = items[d % len(items)][1].split()
        edits = min(rng.choice([len(copy) // 5, len(copy) // 5, len(copy) // 5 + 1, 0]), len(copy))
        if edits > len(copy) // 5:
            too_many.add((d, d % len(items)))
        text = rng.choices(rare, k=rng.randint(0, 30))
        at = rng.randint(0, len(text))
        text[at:at] = edited(rng, copy, edits, kinds, rare)
        if d % 3 == 0:  # fragments, so that some grams are frequent
            cut = rng.randint(0, max(0, len(copy) - 5))
            text += ["beside", *copy[cut : cut + 5]]
        docs.append((d, " ".join(text)))
    want = brute_leaks(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(table, tests).collect()}
    assert got <= want and len(want) > 200
    assert want - got <= too_many and len(got) > 0.99 * len(want)
    assert {r["doc_id"] for r in decontaminate.remove_leaks(table, tests).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_frequent_grams_do_not_hide_an_edited_copy(spark):
    item = [f"w{i}" for i in range(20)]
    copy = [f"x{i}" if i in (2, 7, 12, 18) else w for i, w in enumerate(item)]
    docs = [(0, " ".join(copy))] + [(i, " ".join(["noise", *item[at : at + 4], f"end{i}"])) for i, at in enumerate([3, 8, 13, 14, 8, 3, 13] * 40, 1)]
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "a\u00a0b one two three four"), (3, "word")], "item_id long, text string")
    docs += [(900, "said a\u00a0b one two three four five"), (901, "Word"), (902, "sword")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), tests).collect()}
    assert got == {(0, 1), (900, 2), (901, 3)}


def test_a_long_item_widens_its_own_passages_only(spark):
    long = " ".join(f"l{i}" for i in range(5000))
    short = "one two three four five six"
    texts = ["x " * 3000 + short + " y" * 3000, long.replace("l4 ", "") + " z"]
    maps = decontaminate._bit_maps(decontaminate._grams(spark.createDataFrame([(0, short), (1, long)], "item long, text string"), 0.8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "null as mark")
    got = {r["doc_id"]: len(r["words"].split()) for r in decontaminate._passages(docs.withColumn("mark", docs["mark"].cast("string")), maps).collect()}
    assert got[0] < 40 and got[1] == 5000


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item, 1), (2, None, 2), (3, "", 3), (4, f"x {item} y", 4), (4, f"x {item} y", 4), (5, "z " * 200_000 + item, 5), (6, "clean text it is", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (4, "", 0), (5, "clean text on", 0), (None, item, 0)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(docs, items).collect()}
    assert found == {(d, i) for d in (None, 4, 5) for i in (1, 2, None)}
    kept = decontaminate.remove_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [2, 3, 6]
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).count() == 0
    assert decontaminate.remove_leaks(docs, items.limit(0)).count() == 7
