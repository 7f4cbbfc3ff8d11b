import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from rowloom.llm import ngram_lm, queries
from rowloom.llm.common import Words
from rowloom.llm.ngram_lm import EliasFano


def tokens_of(text):
    return (text or "").encode().lower().split() + [None]


class Brute:
    def __init__(self, texts, order=3):
        self.counts = [Counter() for _ in range(order)]
        for t in texts:
            for gram in self.grams(tokens_of(t)):
                for k in range(len(gram)):
                    self.counts[k][gram[len(gram) - 1 - k :]] += 1
        self.one = Counter({g[0]: c for g, c in self.counts[0].items()})
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.total, self.types = Counter(), Counter()
        for k in range(1, order):
            for gram, c in self.counts[k].items():
                self.total[gram[:-1]] += c
                self.types[gram[:-1]] += 1

    def grams(self, words):
        """The longest n-gram that ends at each token; an end token stands before the first."""
        whole = [None, *words]
        return [tuple(whole[max(0, i - len(self.counts) + 1) : i + 1]) for i in range(1, len(whole))]

    def p1(self, w):
        return (self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, gram):
        if len(gram) == 1:
            return self.p1(gram[0])
        lower, context = self.p(gram[1:]), gram[:-1]
        if not self.total[context]:
            return lower
        return max(self.counts[len(context)][gram] - 0.75, 0) / self.total[context] + 0.75 * self.types[context] / self.total[context] * lower

    def base(self, text):
        return sum(math.log10(self.p1(w)) for w in tokens_of(text))

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(tokens_of(text)))


@pytest.mark.parametrize("top", [1, 50, 2**20, 2**62])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_elias_fano(n, top):
    values = np.unique(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64))
    ef = EliasFano(EliasFano.build(values))
    assert (ef.get(np.arange(len(values))) == values).all()
    if n > 1:
        one, two = ef.get_two(np.arange(len(values) - 1))
        assert (one == values[:-1]).all() and (two == values[1:]).all()
    assert (ef.find(values) == np.arange(len(values))).all()
    others = np.setdiff1d(np.random.default_rng(n + 1).integers(0, 2 * top, 300, dtype=np.uint64), values)
    assert (ef.find(others) == -1).all()


def test_elias_fano_repeats():
    values = np.array([0, 0, 0, 3, 3, 9, 9, 9, 70, 70], np.uint64)
    assert (EliasFano(EliasFano.build(values)).get(np.arange(10)) == values).all()


def test_elias_fano_dense_and_sparse_runs():
    values = np.concatenate([np.arange(0, 400), 10**6 + np.arange(0, 300, 3), [10**9], 2**40 + np.arange(200)]).astype(np.uint64)
    ef = EliasFano(EliasFano.build(values))
    assert (ef.get(np.arange(len(values))) == values).all() and (ef.find(values) == np.arange(len(values))).all()
    one, two = ef.get_two(np.arange(len(values) - 1))
    assert (one == values[:-1]).all() and (two == values[1:]).all()
    assert (ef.find(values[399:-1] + np.uint64(1)) == np.where(values[400:] == values[399:-1] + 1, np.arange(400, len(values)), -1)).all()


def compare(model, docs, rows):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    assert len(rows) == len(docs)
    off, count = 0.0, 0
    for r in rows:
        t = docs[r["doc_id"]]
        w = tokens_of(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(model.one[x] > 0 for x in w), model.n)
        assert abs(r["base_score"] - model.base(t)) < 1e-6 * len(w) + 1e-9
        assert abs(r["score"] - model.score(t)) < 0.05 * len(w)  # probabilities are quantised to 8 bits
        off, count = off + abs(r["score"] - model.score(t)), count + len(w)
    assert off / count < 0.01


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_order_matches_brute_force(spark, sf_dir, order):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = Brute([t for d, t in docs.items() if zlib.crc32(str(d).encode()) % 10], order)
    rows = ngram_lm.train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), order=order).collect()
    compare(model, docs, rows)


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_lm_score(spark, sf_dir).collect()
    compare(Brute([t for d, t in docs.items() if zlib.crc32(str(d).encode()) % 10]), docs, rows)
    kept = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)


def test_probabilities_sum_to_one():
    model = Brute(["a b a", "b c", "", "a b c a b"])
    for c in model.total:
        assert abs(sum(model.p((*c, x)) for x in [*model.one, b"unseen"]) - 1) < 1e-9


def test_words_are_told_apart_by_xxh64():
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    data = f"{one} {other} {one[:200]} {other[:200]} short".encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert words.hash.tolist() == [xxhash.xxh64_intdigest(w) for w in data.split()] and len(set(words.hash.tolist())) == 5


def test_edge_cases(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (3, "A b  a\x0bB", "w"), (3, "A b  a\x0bB", "w"), (4, "q" * 100_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = ngram_lm.train_and_score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 5), (3, 5), (4, 2)]
    assert ngram_lm.train_and_score(docs.limit(0)).count() == 0
    alone = ngram_lm.train_and_score(docs.where("doc_id is null")).first()
    assert (alone["held_out"], alone["n_known"], alone["train_tokens"]) == (True, 0, 0)
