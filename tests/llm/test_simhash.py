import random

import pytest

import numpy as np
import pyarrow as pa
import xxhash

from rowloom.llm import graph, simhash
from rowloom.llm.common import slices, xxh64


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def brute_classes(values, distance=4):
    """Smallest index reachable over pairs within the distance."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_xxh64_matches_the_library():
    rng = np.random.default_rng(1)
    texts = [rng.bytes(int(n)) for n in rng.integers(0, 150, 400)]
    size = np.array([len(t) for t in texts])
    got = xxh64(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]


def test_fingerprints_match_brute_force():
    texts = ["", None, " \t\n", "a", "A b", "a b c", "a b c d", "x " * 70_000, "É é\x0bz  q\r\nw e", "word" * 500, "a\x00b c d e f", "one two three four five six seven"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = np.concatenate([simhash.fingerprints_of(d, o) for _, d, o in slices([batch], most=64)])
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_every_near_pair_meets_at_an_anchor():
    rng = random.Random(2)
    for wide in (False, True):
        plan = simhash.covers(wide)
        for _ in range(150):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            fp = np.array([x, y], np.uint64)
            met = False
            for cover in plan:
                row, anchor, home = cover.anchors(fp)
                assert home[row == 0].sum() == 1 and home[row == 1].sum() == 1
                mine = anchor[(row == 0) & home][0]
                met |= bool((anchor[row == 1] == mine).any())
            assert met


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (1, 1), (2, 9), (3, 5), (None, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(600, 700)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(got) == len(rows)
    want = {3: 3, 4: 3, 5: 3, 8: 2, 9: 2, 2: 2} | {i: 100 for i in range(100, 141)} | {i: 500 for i in [500, *range(600, 700)]}
    assert got == want


def test_links_of_a_dense_group_and_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 16)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(values)[:3]:
        for _ in range(80):
            v = centre
            for b in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = simhash.classes(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["fp"])
    want = {}
    for i, c in enumerate(brute_classes(values)):
        want.setdefault(c, set()).add(signed[i])
    assert len(rows) == len(values)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


@pytest.mark.parametrize("wide_from", [simhash.WIDE_FROM, 1])
def test_query_matches_brute_force(spark, sf_dir, monkeypatch, wide_from):
    from rowloom.llm import queries

    monkeypatch.setattr(simhash, "WIDE_FROM", wide_from)  # both covers end to end
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [brute_fingerprint(docs[i]) for i in ids]
    want = {(i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute_classes(prints), strict=True)}
    got = queries.op9_simhash_dedup(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(ids)


def test_edge_cases(spark):
    rows = [(3, None, 1), (2, "", 2), (7, "the quick brown fox jumps over", 3), (None, "the quick brown fox jumps over", 4), (7, "the quick brown fox jumps over", 3), (9, "nothing like the others at all here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 7), (2, 2), (3, 2), (7, 7), (7, 7), (9, 9)]
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect()) == sorted(docs.where("doc_id in (2, 9)").collect() + docs.where("doc_id = 7").limit(1).collect())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0
