"""Quality rules with tokeniser fertility.

Base rules look at words, symbols, repeated lines and repeated three-word windows. The fertility rules encode every
distinct word with public vocabularies and measure, over the whole text: characters per token, the share of tokens
that are byte fall-backs, the entropy of the tokens in bits, and characters per token of the second vocabulary. A text
outside its language's band in any of them is rejected, and so is one written mostly in another script than its
language's; a language without a band of its own takes its script's, then the widest. ``fit`` draws bands from labelled
documents: the least values are a low quantile of good ones, by language and by script.

Edge cases: a null, empty or blank text has no words, all measures are zero and it fails the base rules; repeated rows
each get their row; an unknown or null language falls back to the script; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, slices


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte fall-back share, least entropy in bits for texts of 200 tokens or more, least characters per token of the BPE."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_bits: float
    least_chars_bpe: float


# Bands by language, then by script. The least values of the languages and of Latin script are what ``fit`` gives for the even ids of
# sf0.1. README: shares rejected of other good documents and of junk. Scripts without labelled documents have wide bands.
QUANTILE = 0.0025
BANDS = {
    "en": Band(2.049, 7.5, 0.03, 6.021, 2.118),
    "de": Band(2.061, 7.5, 0.05, 5.997, 1.882),
    "fr": Band(1.734, 7.5, 0.05, 5.955, 1.751),
    "es": Band(1.803, 7.5, 0.05, 5.866, 1.657),
}
LANGUAGE_SCRIPT = dict.fromkeys(BANDS, "latin")
SCRIPTS = {"latin": Band(1.734, 8.0, 0.10, 5.866, 1.657), "greek": Band(0.4, 8.0, 0.95, 3.5, 0.4), "cyrillic": Band(0.4, 8.0, 0.95, 3.5, 0.4)}
WIDEST = Band(0.2, 8.0, 0.95, 2.0, 0.2)
# First bytes of UTF-8 letters by script, as ranges.
LEADS = {"latin": [(65, 91), (97, 123), (0xC3, 0xCA)], "greek": [(0xCD, 0xD0)], "cyrillic": [(0xD0, 0xD4)], "hebrew": [(0xD6, 0xD8)], "arabic": [(0xD8, 0xDC)], "indic": [(0xE0, 0xE1)], "east asian": [(0xE3, 0xEE)]}
ENTROPY_FROM = 200
KEEP_WORDS = 400_000  # words whose pieces a worker remembers
ODD_SPACE = re.compile(r"[^\S ]").search

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_bits double, chars_per_token_bpe double, script long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCRIPT = np.full(256, len(LEADS), np.int64)
for _i, _ranges_of in enumerate(LEADS.values()):
    for _a, _b in _ranges_of:
        _SCRIPT[_a:_b] = _i


class Vocabularies:
    """Pieces of single words by a sentencepiece vocabulary with byte fall-back, and piece counts by a byte-level BPE."""

    def __init__(self, piece_model: str, bpe_ranks: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(bpe_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bpe_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bpe_bytes[list(ranks.values())] = [len(b) for b in ranks]
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U64)  # hashes of the words remembered, ascending
        self.place = np.zeros(0, np.int64)  # where each of them is in the arrays below
        self.flat = np.zeros(0, np.int32)  # the pieces of all words remembered, one after another
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.other = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)  # calls that asked for it, halved whenever words are forgotten

    def forget(self) -> None:
        """Keep the more used half of the words; most words of a large table come once."""
        least = len(self.used) - KEEP_WORDS // 2
        kept = np.sort(np.argpartition(self.used, least)[least:])
        now = np.full(len(self.used), -1)
        now[kept] = np.arange(len(kept))
        still = now[self.place] >= 0
        self.keys, self.place = self.keys[still], now[self.place[still]]
        self.flat = self.flat[_ranges(self.begin[kept], self.size[kept])]
        self.size, self.other, self.used = self.size[kept], self.other[kept], self.used[kept] >> 1
        self.begin = np.cumsum(self.size) - self.size

    def look_up(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Places of distinct words, given by ascending hashes, in ``begin``, ``size`` (pieces in ``flat``) and ``other`` (BPE pieces).

        ``text_of`` gives the text of those at some places of ``hashes``, with a space between words."""
        if len(self.keys) > KEEP_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, hashes)
        known = np.append(self.keys, U64(0))[at] == hashes
        known &= at < len(self.keys)
        out = np.empty(len(hashes), np.int64)
        out[known] = self.place[at[known]]
        self.used[out[known]] += 1
        new = np.flatnonzero(~known)
        if len(new):
            text = text_of(new)
            found = self.pieces.encode(text.split(" "), num_threads=1)
            size = np.fromiter(map(len, found), np.int64, len(found))
            out[new] = len(self.begin) + np.arange(len(new))
            self.keys, self.place = np.insert(self.keys, at[new], hashes[new]), np.insert(self.place, at[new], out[new])
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())))
            self.size, self.other = np.append(self.size, size), np.append(self.other, self.bpe_pieces(text))
            self.used = np.append(self.used, np.ones(len(new), np.int64))
        return out

    def bpe_pieces(self, text: str) -> np.ndarray:
        """How many pieces the BPE makes of each word (and a space before it) of ``text``, which has a space between words.

        The pre-tokenizer cuts before a space that follows anything but white space, so such words are encoded in one call."""
        words = text.split(" ")
        odd = [i for i, w in enumerate(words) if not w or ODD_SPACE(w)] if ODD_SPACE(text) or not all(words) else []
        out = np.zeros(len(words), np.int64)
        for i in odd:
            out[i] = len(self.bpe.encode_ordinary(" " + words[i]))
        plain = np.delete(np.arange(len(words)), odd)
        if len(plain):
            rest = " " + (text if not odd else " ".join([words[i] for i in plain.tolist()]))
            upto = np.cumsum(self.bpe_bytes[self.bpe.encode_ordinary(rest)])
            raw = np.frombuffer(rest.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            out[plain] = np.diff(np.searchsorted(upto, ends, "right"), prepend=0)
        return out


_held: dict[tuple[str, str], Vocabularies] = {}


def vocabularies_of(piece_model: str, bpe_ranks: str) -> Vocabularies:
    """The worker process's vocabularies, which later tasks of it find with their words remembered (bounded as above)."""
    if (piece_model, bpe_ranks) not in _held:
        _held.clear()
        _held[piece_model, bpe_ranks] = Vocabularies(piece_model, bpe_ranks)
    return _held[piece_model, bpe_ranks]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i] + size[i]."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text the script (a place in ``LEADS``) with most letters."""
    n, kinds = len(offsets) - 1, len(LEADS) + 1
    wide = np.flatnonzero(data >= 0xC0)  # few bytes of most texts
    owner = np.searchsorted(offsets, wide, "right") - 1
    letters = np.bincount(owner * kinds + _SCRIPT[data[wide]], minlength=n * kinds).reshape(n, kinds)
    letters[:, 0] += _sums((data | 32) - np.uint8(97) < 26, offsets)  # a to z; no other byte comes to these values
    return letters[:, : len(LEADS)].argmax(1)


def measure(data: np.ndarray, offsets: np.ndarray, vocabularies: Vocabularies | None) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    n = words.count
    lead = (data & 0xC0) != 0x80
    out = {"n_words": n}
    out["word_chars"] = _sums(lead & words.inside, offsets)
    out["n_symbols"] = _sums(_SYMBOL[data], offsets)
    raw = data.tobytes()
    dup = np.zeros(len(n), np.int64)
    for i in range(len(n)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    at, gram = words.grams(3)
    owner = words.text_of()
    _, back, times = np.unique(mix(gram ^ mix(owner[at].astype(U64) + U64(1))), return_inverse=True, return_counts=True)
    twice = at[times[back] > 1]
    covered = np.zeros(len(owner), bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = _sums(covered, words.first)
    zero = np.zeros(len(n))
    out |= {"chars_per_token": zero, "byte_share": zero, "token_bits": zero, "chars_per_token_bpe": zero, "script": zero}
    if vocabularies is None or not len(owner):
        return out
    out["script"] = _scripts(data, offsets)
    distinct, seen, which = np.unique(words.hash, return_index=True, return_inverse=True)

    def text_of(i: np.ndarray) -> str:
        start, size = words.start[seen[i]], words.end[seen[i]] - words.start[seen[i]] + 1
        some = np.append(data, np.uint8(32))[_ranges(start, size)]
        some[np.cumsum(size) - 1] = 32
        return some[:-1].tobytes().decode()

    place = vocabularies.look_up(distinct, text_of)[which]
    of_word = vocabularies.size[place]
    tokens = vocabularies.flat[_ranges(vocabularies.begin[place], of_word)]
    n_tokens = _sums(of_word, words.first)
    bounds = np.concatenate([[0], np.cumsum(n_tokens)])
    out["chars_per_token"] = out["word_chars"] / np.maximum(n_tokens, 1)
    out["chars_per_token_bpe"] = out["word_chars"] / np.maximum(_sums(vocabularies.other[place], words.first), 1)
    out["byte_share"] = _sums(vocabularies.is_byte[tokens], bounds) / np.maximum(n_tokens, 1)
    text = np.repeat(np.arange(len(n)), n_tokens)
    key, times = np.unique((text.astype(np.int64) << 32) | tokens, return_counts=True)
    share = times / n_tokens[key >> 32]
    bits = np.zeros(len(n))
    np.add.at(bits, key >> 32, -share * np.log2(share))
    out["token_bits"] = bits
    return out


def measures(docs: DataFrame, keep: list[str], piece_model: str, bpe_ranks: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the measures of ``text``. The vocabularies' paths must exist on every executor."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep if c != text], F.col(f"`{text}`"))
    kept = source.select(*[F.col(f"`{c}`") for c in keep]).schema
    extra = docs.sparkSession.createDataFrame([], MEASURES).schema
    for field in extra:
        kept = kept.add(field)
    names = [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = vocabularies_of(piece_model, bpe_ranks)
        for rows, data, offsets in slices(batches, text):
            m = measure(data, offsets, vocabularies)
            values = [pa.array(m[x.split()[0]].astype(float if "double" in x else np.int64)) for x in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], *values], [*keep, *names])

    return source.mapInArrow(run, kept)


def verdict(lang: F.Column, bands: dict[str, Band] = BANDS, scripts: dict[str, Band] = SCRIPTS) -> F.Column:
    """True where the fertility measures lie within the band of the row's language or else its script."""

    def within(b: Band) -> F.Column:
        tokens = F.col("word_chars") / F.greatest("chars_per_token", F.lit(1e-9))
        rich = (F.col("token_bits") >= b.least_bits) | (tokens < ENTROPY_FROM)
        return F.col("chars_per_token").between(b.least_chars, b.most_chars) & (F.col("chars_per_token_bpe") >= b.least_chars_bpe) & (F.col("byte_share") <= b.most_bytes) & rich

    script = lambda name: F.col("script") == list(LEADS).index(name)
    out = within(WIDEST)
    for name, band in scripts.items():
        out = F.when(script(name), within(band)).otherwise(out)
    for name, band in bands.items():
        right = script(LANGUAGE_SCRIPT[name]) if name in LANGUAGE_SCRIPT else F.lit(True)
        out = F.when(lang.eqNullSafe(name), right & within(band)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, piece_model: str, bpe_ranks: str, quantile: float = QUANTILE, most_rows: int = 20_000, least_rows: int = 100) -> tuple[dict, dict]:
    """Bands by language and by script from labelled documents (``docs``: doc_id, lang, text; ``labels``: doc_id, quality).

    The least values are the ``quantile`` of documents with quality 1 that pass the base rules (entropy: of those with
    ``ENTROPY_FROM`` tokens); the upper limits stay as set. At most ``most_rows`` documents are measured, those with the least hashes
    of ``doc_id``; groups of fewer than ``least_rows`` get no band.
    """
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = measures(docs.select("doc_id", "lang", "text").join(F.broadcast(good), "doc_id"), ["lang"], piece_model, bpe_ranks).where(~base_failed())
    tokens = F.col("word_chars") / F.greatest("chars_per_token", F.lit(1e-9))
    low = [F.percentile(c, F.lit(quantile)).alias(c) for c in ("chars_per_token", "chars_per_token_bpe")]
    low.append(F.percentile(F.when(tokens >= ENTROPY_FROM, F.col("token_bits")), F.lit(quantile)).alias("token_bits"))
    out: list[dict] = []
    for by, given in (("lang", BANDS), ("script", SCRIPTS)):
        found = {}
        for r in rows.groupBy(by).agg(F.count("*").alias("n"), *low).where((F.col("n") >= least_rows) & F.col(by).isNotNull()).collect():  # one row a language or script
            name = list(LEADS)[r["script"]] if by == "script" else r["lang"]
            base = given.get(name, WIDEST)
            found[name] = Band(r["chars_per_token"], base.most_chars, base.most_bytes, r["token_bits"] or base.least_bits, r["chars_per_token_bpe"])
        out.append(found)
    return out[0], out[1]


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, keep: list[str], piece_model: str, bpe_ranks: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """``keep``, all measures, ``base_failed`` and ``kept``."""
    rows = measures(docs, list(dict.fromkeys([*keep, lang])), piece_model, bpe_ranks, text)
    judged = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(F.col(f"`{lang}`")))
    return judged if lang in keep else judged.drop(lang)


def filter_rejected(docs: DataFrame, piece_model: str, bpe_ranks: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the rejected rows. Columns are renamed meanwhile, so none can clash with a measure."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    judged = judge(plain, plain.columns, piece_model, bpe_ranks, f"c{columns.index(lang)}", f"c{columns.index(text)}")
    return judged.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
