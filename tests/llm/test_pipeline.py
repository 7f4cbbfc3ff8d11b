import math
from collections import Counter
from functools import cache

import public_tokenizers
import sentencepiece
import tiktoken
from test_decontaminate import brute_leaks, words
from test_mixing import poisson, uniform
from test_quality import brute as base_measures
from test_simhash import brute_classes, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from rowloom.llm import quality, queries


def brute_quality():
    """The verdict on one text, word by word."""
    import base64

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = cache(lambda w: model.encode(w))
    others = cache(lambda w: len(bpe.encode_ordinary(" " + w)))

    def kept(text, lang):
        n, chars, _, _, repeated = base_measures(text)
        if n < 50 or 100 * repeated > 50 * n:
            return False
        split = [w.decode() for w in text.encode().split()]
        ids = [i for w in split for i in pieces(w)]
        band = quality.BANDS[lang]
        bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
        return (
            band.least_chars <= chars / len(ids) <= band.most_chars
            and chars / sum(map(others, split)) >= band.least_chars_bpe
            and sum(model.is_byte(i) for i in ids) / len(ids) <= band.most_bytes
            and (len(ids) < 200 or bits >= band.least_bits)
        )

    return kept


def test_pipeline_matches_brute_force(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    good = brute_quality()
    rows = sorted((r for r in rows if good(r["text"], r["lang"])), key=lambda r: r["doc_id"])
    classes = brute_classes([brute_fingerprint(r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if classes[i] == i]
    bags = {i: Counter(words(t)) for i, t in items}
    near = [(r, i) for r in rows for i in bags if (bags[i] & Counter(words(r["text"]))).total() >= 0.8 * bags[i].total()]  # no other pair can align so
    text = dict(items)
    leaking = {r["doc_id"] for r, i in near if brute_leaks([(r["doc_id"], r["text"])], [(i, text[i])])}
    assert leaking
    rows = [r for r in rows if r["doc_id"] not in leaking]
    sizes = Counter(r["source"] for r in rows)
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want[r["doc_id"], n] = poisson(uniform(42, r["doc_id"]), len(rows) / len(sizes) / sizes[r["source"]])
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == +want
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_tokens_keep_the_shuffled_order(spark, sf_dir):
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()]
    copied = {d for d, n in Counter(ids).items() if n > 1}
    side_by_side = sum(a == b for a, b in zip(ids, ids[1:], strict=False))
    assert len(copied) > 10 and side_by_side < len(ids) / 20
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.65 * len(ids)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
