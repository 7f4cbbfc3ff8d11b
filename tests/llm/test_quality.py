import random
from collections import Counter

import numpy as np

from rowloom.llm import quality, queries


def brute(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(covered)


def judge(docs, keep):
    return quality.judge(docs, keep, queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.tiktoken"))


def test_base_measures_match_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_fertility_matches_the_vocabulary(spark):
    import math

    import sentencepiece

    text = "Plain words, some naïve ones and 日本語 too. " * 12
    row = judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), ["doc_id"]).first()
    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    ids = [i for w in text.split() for i in model.encode(w)]
    assert abs(row["chars_per_token"] - sum(map(len, text.split())) / len(ids)) < 1e-9
    assert abs(row["byte_share"] - sum(model.is_byte(i) for i in ids) / len(ids)) < 1e-9
    assert abs(row["token_bits"] + sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())) < 1e-9


def test_clean_documents_stay(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality_rules(spark, "/root/testdata/sf0.01").collect() if not r["base_failed"] and labels.get(r["doc_id"]) == 1]
    assert sum(r["kept"] for r in rows) >= 0.98 * len(rows)


def test_labelled_junk_goes(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality_rules(spark, "/root/testdata/sf0.01").collect() if not r["base_failed"] and labels.get(r["doc_id"]) == 0]
    assert sum(not r["kept"] for r in rows) >= 0.6 * len(rows) > 0


def test_bands_are_what_the_labels_give(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").where("doc_id % 2 = 0") for t in ("documents", "labels"))
    bands, scripts = quality.fit(docs, labels, queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.tiktoken"))
    assert set(bands) == set(quality.BANDS) and set(scripts) == {"latin"}
    for name, band in bands.items():
        want = quality.BANDS[name]
        for field in ("least_chars", "least_bits", "least_chars_bpe"):
            assert abs(getattr(band, field) - getattr(want, field)) < 0.002, (name, field, band)


def test_bands_reject(spark):
    rng = random.Random(3)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clean = next(r["text"] for r in docs.join(labels, "doc_id").where("lang = 'en' and quality = 1 and toxic = 0").orderBy("doc_id").collect() if len(r["text"].split()) > 200)
    words = clean.split()
    noise = " ".join("".join(rng.choices("xqzjkvw#%{}", k=9)) for _ in range(120))
    garbled = " ".join("".join(rng.sample(w, len(w))) + rng.choice("#~^") for w in words)
    cyrillic = " ".join("".join(rng.choices("абвгдежзиклмнопрст", k=rng.randint(2, 9))) for _ in range(200))
    fallback = " ".join("".join(chr(rng.randint(0x10400, 0x1044F)) for _ in range(5)) for _ in range(150))
    mixed = " ".join(w + chr(rng.randint(0x1F600, 0x1F640)) for w in words)
    rows = [(1, noise, "en"), (2, noise, None), (3, garbled, "en"), (4, cyrillic, "en"), (5, fallback, "en"), (6, fallback, "xx"), (7, mixed, "en"), (8, clean, "en"), (9, clean, None), (10, cyrillic, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in judge(docs, ["doc_id"]).collect() if r["kept"]} == {8, 9, 10}


def test_edge_cases(spark):
    rows = [(1, None, "en", 5), (2, "", None, 6), (None, " \n\t", "xx", 7), (4, "a\n\na\n a\nb", "en", 8), (4, "a\n\na\n a\nb", "en", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = judge(docs.drop("n_words"), ["doc_id"]).orderBy("n_words").collect()
    assert [(r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"]) for r in got] == [(0, 0, True, False)] * 3 + [(4, 1, True, False)] * 2
    kept = quality.filter_rejected(docs, queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.tiktoken"))
    assert kept.columns == docs.columns and kept.count() == 0
    assert judge(docs.drop("n_words").limit(0), ["doc_id"]).count() == 0


def measured(texts, vocabularies):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return quality.measure(np.frombuffer(b"".join(raw), np.uint8), offsets, vocabularies)


def test_words_used_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(quality, "KEEP_WORDS", 60)
    vocabularies = quality.Vocabularies(queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.tiktoken"))
    plain = vocabularies.pieces
    asked = Counter()

    class Counting:
        def encode(self, words, **options):
            asked.update(words)
            return plain.encode(words, **options)

    vocabularies.pieces = Counting()
    often = [f"often{i}" for i in range(20)]
    for k in range(30):  # 20 words of each text come again, 10 never do
        text = " ".join(often + [f"once{k}x{i}" for i in range(10)])
        got = measured([text], vocabularies)
        ids = plain.encode(text.split())
        assert got["chars_per_token"][0] == sum(map(len, text.split())) / sum(map(len, ids))
        assert got["chars_per_token_bpe"][0] == sum(map(len, text.split())) / sum(len(vocabularies.bpe.encode_ordinary(" " + w)) for w in text.split())
    assert all(asked[w] == 1 for w in often)


def test_bpe_pieces_of_words_with_odd_spaces():
    vocabularies = quality.Vocabularies(queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.tiktoken"))
    odd = ["a\u00a0", "\u00a0a", "\u2003", "\u00a0\u00a0", "x\u3000\u3000y", "\x1c", "\x85z", "it's", "'s", "naïve", "日本語", "a,b.", "١٢x", "e\u0301", "\U0001f600"]
    rng = random.Random(5)
    texts = [" ".join(rng.sample(odd, rng.randint(1, len(odd)))) for _ in range(60)]
    for text in texts:
        words = text.split(" ")
        want = sum(len(vocabularies.bpe.encode_ordinary(" " + w)) for w in words)
        assert measured([text], vocabularies)["chars_per_token_bpe"][0] == sum(map(len, words)) / want
