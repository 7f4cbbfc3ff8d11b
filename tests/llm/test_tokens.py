import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowloom.llm import queries, tokens

VOCABULARY = queries.vocabulary("byte_bpe_50k.json")
BPE = tokens.ByteBPE(VOCABULARY)
ODD = ["", "a", " a", "it's  'so  \n\n x", " 's''s\t\tq", "x<|endoftext|>y", "日本語 'll", "naïve café — “q”", "  z", "a\x85b\x1cc", "Ǆ ͅ ١٢", "tab\t end \n", "''''re've 've", "123abc 4 5six", "é"]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65_536, 65_537, 200_000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (tokens.unpack_planes(tokens.pack_planes(ids, planes=planes)) == ids).all()


def test_pieces_match_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = tokens.ByteBPE(VOCABULARY).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_piece_classes_are_those_of_unicode():
    import unicodedata

    plain = [c for c in map(chr, range(0x3000)) if not tokens.UNUSUAL(c)]
    assert len(plain) == 552
    for c in plain:
        kind = unicodedata.category(c)[0]
        assert bool(re.match(f"[{tokens.LETTER}]", c)) == (kind == "L"), c
        assert bool(re.match(f"[{tokens.NUMBER}]", c)) == (kind == "N"), c
        assert c.isspace() == (c in " \t\n\r"), c


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\t\r.,1²éßs re-‐½", max_size=40))
def test_any_text_matches_the_library(text):
    assert np.frombuffer(BPE.encode([text])[0], "<u4").tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_character_is_split_as_the_library_does():
    bpe = tokens.ByteBPE(VOCABULARY)
    codes = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 11)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 10_000):
        texts = [f"x{chr(c)}1 {chr(c)}{chr(c)}a 2{chr(c)} " for c in codes[at : at + 10_000]]
        want = [np.array(e.ids, "<u4").tobytes() for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert bpe.encode(texts) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_unicode_text_matches_the_library(text):
    assert np.frombuffer(BPE.encode([text])[0], "<u4").tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids


def test_generations_forget_nothing_wrong():
    bpe = tokens.ByteBPE(VOCABULARY)
    bpe.KEEP = 3
    texts = ["a b c d e f", "a b x", "", "f e d c b a", "a b c d e f"]
    assert bpe.encode(texts) == BPE.encode(texts)


def test_query_matches_brute_force(spark, sf_dir):
    library = Tokenizer.from_file(VOCABULARY)
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, start = [], 0
    for d, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op5_token_output(spark, sf_dir).collect()) == want


def test_edge_cases(spark, tmp_path):
    rows = [(2, None, 1), (1, "b", 2), (1, "b", 2), (None, "c", 3), (3, "long " * 300_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    tokens.write_tokens(docs, str(tmp_path / "t"), VOCABULARY, planes="bit")
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3]
    assert [r["start"] for r in got] == [0, 2, 4, 6, 7]
    assert np.frombuffer(got[3]["ids"], "<u4").tolist() == [0] and got[4]["n_tokens"] > 300_000
    assert tokens.encode_and_read_back(docs.limit(0), VOCABULARY).count() == 0


def test_given_order_is_kept(spark, tmp_path):
    rows = [(7, "seven of them"), (1, "one"), (7, "seven of them"), (3, "three"), (None, None), (2, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tokens.write_tokens(docs, str(tmp_path / "t"), VOCABULARY, order="given")
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    many = spark.range(0, 5000, 1, 6).selectExpr("(id * 7919) % 5000 as doc_id", "repeat('w ', int(id % 9)) as text")
    given = [r["doc_id"] for r in tokens.encode_and_read_back(many, VOCABULARY, order="given").orderBy("start").collect()]
    assert given == [i * 7919 % 5000 for i in range(5000)]
