"""Alignment, periodic runs and byte-level BPE against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayweave.llm import align, bytepairs, queries, runs

A, B, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
TEXTS = ["", "hello world", "a<|endoftext|>b", "日本語 x", "a▁b", " lead", "trail  ", "  ", "x" * 3000, "it's <s> </s> <0x0A>\n\nok",
         "é ́x İ ﬁ\U0001F600", "a\x00b", "  \x1c\x85 x"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def noise(seed, n=300, letters="ab \n'1.é日"):
    random.seed(seed)
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 90))) for _ in range(n)]


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


# ---- byte-level BPE ----


def library():
    return bytepairs.encoder(RANKS).by_match


@pytest.mark.parametrize("size", [1, 7, 64])
def test_safe_chunks_encode_alike(size):
    for text in TEXTS + noise(size) + noise(size, letters="ab12!?'日、 \n "):
        parts = list(bytepairs.safe_chunks(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in library().encode_ordinary(p)] == library().encode_ordinary(text)


def test_one_vocabulary_until_spaces_are_long():
    own = bytepairs.ByteEncoder(bytepairs.encoder(RANKS).ranks)
    own.encode("it's  plain text")
    assert "whole" not in vars(own)
    long = "a" + " " * 1000 + "b"
    assert own.encode(long).tolist() == library().encode_ordinary(long) and "whole" in vars(own)


def test_long_spaces_encode_alike(monkeypatch):
    monkeypatch.setattr(bytepairs, "_SPACES", re.compile(bytepairs._SPACES.pattern.replace("256", "2")))
    own = bytepairs.ByteEncoder(bytepairs.encoder(RANKS).by_match._mergeable_ranks)
    for text in [*TEXTS, *noise(3, letters="ab  \n\t1'"), *noise(4, letters="a 　 \x85\x1c")]:
        assert own.encode(text).tolist() == library().encode_ordinary(text), text


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "\n" * 700_000, "a" + " \n" * 500_000 + "1"])
def test_spaces_that_overflow_the_library(text):
    own = bytepairs.encoder(RANKS)
    ids = own.encode(text)
    assert own.decode(ids) == text.encode()
    assert own.encode("a" + text[:600] + "b").tolist() == library().encode_ordinary("a" + text[:600] + "b")


def test_special_strings():
    tokenizer = Tokenizer.from_file(A)
    for text in ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x"]:
        assert bytepairs.file_encoder(A, special=True).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    for text in TEXTS:
        assert bytepairs.file_encoder(A).encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_byte_bpe_rows(odd, none):
    encoded = bytepairs.encode_bytes(odd, RANKS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter(
        (r.doc_id, tuple(library().encode_ordinary(r.text or ""))) for r in odd.collect())
    decoded = bytepairs.decode_bytes(encoded, RANKS).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in decoded) == Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert bytepairs.decode_bytes(bytepairs.encode_bytes(none, RANKS), RANKS).count() == 0
    gone = encoded.withColumn("ids", F.lit(None).cast("array<int>"))
    assert {bytes(r.bytes) for r in bytepairs.decode_bytes(gone, RANKS).collect()} == {b""}


def test_byte_bpe_query(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op13_byte_bpe"](spark, SMALL).collect()}
    ids = {d: library().encode_ordinary(t) for d, t in documents(spark).items()}
    assert got == {d: (len(ids[d]), sha(" ".join(map(str, ids[d]))), sha(t)) for d, t in documents(spark).items()}


# ---- alignment ----


class Brute:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        letters = {v: k for k, v in bytepairs.byte_letters().items()}
        self.a_bytes = {i: bytes(map(letters.get, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if i != 50256}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        sides = [(self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.get), (self.b.encode(text), self.b_bytes)]
        if any(b"".join(map(f, ids)) != (" " + text).encode() for ids, f in sides):
            return []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for ids, f in sides]
        both, at, out = set(ends[0]) & set(ends[1]), [0, 0], []
        for end in sorted(both):
            group = []
            for s in (0, 1):
                k = ends[s].index(end) + 1
                group.append(sides[s][0][at[s]:k])
                at[s] = k
            out.append(tuple(group))
        return out

    def table(self, docs):
        groups = [(d, self.groups(t)) for d, t in docs]
        links = [(d, Counter((x, y) for a, b in g for x in a for y in b)) for d, g in groups]
        held = Counter(p for _, c in links for p in c)
        most = defaultdict(int)
        for (x, _), n in held.items():
            most[x] = max(most[x], n)
        return [(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                 sum(m for p, m in c.items() if held[p] == most[p[0]]), sum(m * held[p] for p, m in c.items()), g)
                for (d, g), (_, c) in zip(groups, links)]


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def numbers(spark, docs):
    aligned = align.align_tokens(docs, A, B)
    found = align.written_groups(aligned).join(align.link_statistics(aligned), "_row", "left").na.fill(0, ["n_best", "count_sum"])
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found.collect())


def expected(docs):
    return Counter((*row[:7], written(row[7])) for row in Brute().table(docs))


def test_alignment_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert numbers(spark, odd) == expected(docs)
    assert numbers(spark, none) == Counter()
    more = list(enumerate(TEXTS + noise(9, 60)))
    frame = spark.createDataFrame(more, "doc_id long, text string").repartition(5)
    assert numbers(spark, frame) == expected(more)


def test_long_text_in_parts():
    side = align.sides(A, B)[1]
    for text in TEXTS + noise(5, letters="ab  \n日"):
        assert [i for p in side.parts(text, 5) for i in side.model.encode(p)] == side.model.encode(text)


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
def test_pairs_in_parts(most):
    rng = np.random.default_rng(most)
    docs = [[(rng.integers(0, 6, rng.integers(1, 7)).tolist(), rng.integers(0, 6, rng.integers(1, 7)).tolist()) for _ in range(rng.integers(0, 5))]
            for _ in range(30)]
    lists = lambda rows: pa.array(rows, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays(
        [lists([[i for g in d for i in g[s]] for d in docs]) for s in (0, 1)] + [lists([[len(g[s]) for g in d] for d in docs]) for s in (0, 1)],
        names=["a_ids", "b_ids", "a_sizes", "b_sizes"]).slice(3)
    got = [(d, p >> 20, p & 0xFFFFF, n) for part in align.linked_pairs(batch, most) for d, p, n in zip(*(x.tolist() for x in part))]
    assert len({r[:3] for r in got}) == len(got)
    assert Counter({r[:3]: r[3] for r in got}) == Counter((k, x, y) for k, d in enumerate(docs[3:]) for a, b in d for x in a for y in b)


def test_alignment_query(spark):
    got = [tuple(r) for r in queries.QUERIES["op11_alignment"](spark, SMALL).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    want = [(*row[:7], sha(written(row[7])) if row[7] else "") for row in Brute().table(list(documents(spark).items()))]
    assert sorted(got) == sorted(want)


# ---- periodic runs ----


def brute_runs(words):
    code, n = {}, len(words)
    w, found = np.array([code.setdefault(x, len(code)) for x in words], dtype=np.int64), []
    for p in range(1, n // 3 + 1):
        same = np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]])
        edge = np.diff(same)
        for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            size = y - x + p
            if size >= max(24, 3 * p) and not any(
                    p % q == 0 and (w[x:x + p - q] == w[x + q:x + p]).all() for q in range(1, p)):
                found.append((x, size, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looping_texts():
    random.seed(8)
    out = ["a " * 24, "a " * 23, "a b " * 12 + "a", "x " + "a b c " * 9 + "y", ("a a b " * 10 + "c ") * 4, "a " * 30 + "b " * 40 + "a " * 25,
           " ".join(random.choice("ab") for _ in range(600)), "p q " * 200 + "p p q " * 200]
    for _ in range(60):
        parts = []
        for _ in range(random.randint(1, 4)):
            block = [random.choice("abcdefgh") for _ in range(random.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 50, 64, 100]))]
            n = random.randint(1, 5 * len(block))
            parts += [block[i % len(block)] for i in range(n)] + [random.choice("abcdefghij") for _ in range(random.randint(0, 20))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("tile", [8, 64, 1 << 16])
def test_fragments_stitch_to_runs(tile):
    for text in looping_texts():
        words, codes = runs.word_codes(text)
        pieces = sorted(f for got in runs.fragments(list(runs.tiles(codes, tile))) for f in got)
        merged = []
        for p, a, b in pieces:
            if merged and merged[-1][0] == p and a <= merged[-1][2]:
                merged[-1][2] = max(b, merged[-1][2])
            else:
                merged.append([p, a, b])
        got = sorted(((a, b - a + p, p) for p, a, b in merged if b - a + p >= max(24, 3 * p)), key=lambda r: (r[0], r[2]))
        assert got == brute_runs([w.decode() for w in words]), text


def of_runs(rows):
    return Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in rows)


def by_hand(rows):
    out = Counter()
    for d, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = brute_runs(words) if len(set(words)) > 1 else list(one_word(words))
        out[d, len(words), tuple(found), brute_collapsed(words, found)] += 1
    return out


def one_word(words):
    return ((0, len(words), 1),) if len(words) >= 24 else ()


@pytest.mark.parametrize("giant", [500, 1 << 22])
def test_run_rows(spark, odd, none, giant):
    assert of_runs(runs.periodic_runs(odd, giant_bytes=giant).collect()) == by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert runs.periodic_runs(none, giant_bytes=giant).count() == 0
    texts = list(enumerate(looping_texts()))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert of_runs(runs.periodic_runs(frame, giant_bytes=giant).collect()) == by_hand(texts)


def looped(doc_id, text):
    words = [w.decode() for w in text.encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_run_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    want, with_runs = {}, 0
    for d, text in documents(spark).items():
        words = looped(d, text)
        found = brute_runs(words)
        with_runs += bool(found)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want[d] = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                   sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(brute_collapsed(words, found)))
    assert with_runs > 5 and got == want
