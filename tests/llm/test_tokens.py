"""Encoding, id files and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward_texts, clashing, documents, rows_of

from joblattice.llm import bpe_trie, id_files, packing, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    draw = random.Random(1)
    letters = "ab \n.,'sé1ÀΣ<|>\t日\x1c\x85\xa0ß"
    made = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(300)]
    return made + [t or "" for _, t in awkward_texts()] + ["it's DON'T <|endoftext|> a<|startoftext|>b", "İΑΣ", "a" * 300, "é x ́"]


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
def test_pieces_equal_library(path, keeps_space):
    library, own = tokens.load(path), tokens.PieceEncoder(path, keeps_space, kept=50)
    for start in range(0, len(odd_texts()), 40):
        texts = odd_texts()[start : start + 40]
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, "<u4").tolist() for i in own.ids(texts)] == expected


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.inner, self.model, self.seen = tokenizer, tokenizer.model, 0

    def encode(self, text, **how):
        self.seen += 1
        return self.inner.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.seen += len(texts)
        return self.inner.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
def test_plain_words_go_to_the_model(monkeypatch, path, keeps_space):
    draw = random.Random(4)
    letters = "abcdefghijklmnoprstuvwyzABCDEÀÉÖßàçèéñöøÿĀıŁŉŒſ"
    words = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(3000)]
    texts = []
    for start in range(0, len(words), 30):
        ends = [draw.choice([" ", " ", " ", ", ", ".\n", "\n", "!) "]) for _ in range(29)] + [""]
        texts.append("".join(w + e for w, e in zip(words[start : start + 30], ends)))
    library = tokens.load(path)
    counting = Counting(library)
    monkeypatch.setattr(tokens, "load", lambda path: counting)
    own = tokens.PieceEncoder(path, keeps_space)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.ids(texts)] == expected
    assert counting.seen <= 10


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
def test_odd_words_and_lines(path, keeps_space):
    texts = [
        "İstanbul İ ŉaı ſtraße µ ª º × aµb ƒoo Ǆ ΑΣ éx́ e\u0301a\u0301 ﬁn K Å ①a ١٢ a١", "a\nb\n\nc\n d\n", "\na", "a\r\nb", "a\n\tb",
        "x.\n'll y's\n<|endoftext|>\nz", "\n", " \n", "a \nb", "word\n" * 2000 + "word", "a,\nb!\x1c\nc", "a\u2028\nb\x85\nc", "don't\nDON'T,",
    ]
    library, own = tokens.load(path), tokens.PieceEncoder(path, keeps_space)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.ids(texts)] == expected


def test_trie_equals_library():
    library, own = tokens.load(WORD), bpe_trie.TrieEncoder(WORD, kept=100)
    for start in range(0, len(odd_texts()), 40):
        texts = odd_texts()[start : start + 40]
        for text, (count, ids, decoded) in zip(texts, own.encode(texts)):
            expected = library.encode(text, add_special_tokens=False).ids
            assert (count, ids) == (len(expected), " ".join(map(str, expected)))
            assert decoded == library.decode(expected, skip_special_tokens=False)


def test_trie_shares_prefixes():
    trie = bpe_trie.WordTrie(bpe_trie.Vocabulary(WORD))
    trie.encode(["transport", "transports"])
    size = trie.size
    trie.encode(["transporter"])
    assert trie.size - size == 1


def test_encode_rows(spark):
    library = tokens.load(WORD)
    docs = clashing(documents(spark), "n_tokens", "ids")
    got = rows_of(bpe_trie.encoded_digests(docs, WORD), "doc_id", "n_tokens", "ids_sha256")
    expected = []
    for doc_id, text in awkward_texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert rows_of(bpe_trie.encode(docs.filter("doc_id = 6"), WORD), "n_tokens", "ids", "decoded") == [(0, "", "")]
    assert bpe_trie.encode(documents(spark, []), WORD).count() == 0


def test_planes_round_trip():
    draw = np.random.default_rng(2)
    for size in (0, 1, 7, 8, 1000):
        for top in (1, 2, 49408, 1 << 32):
            ids = draw.integers(0, top, size, dtype=np.uint64).astype(np.uint32)
            assert (id_files.from_planes(id_files.to_planes(ids), size) == ids).all()


def test_file_round_trip():
    import io

    draw, sink, docs = np.random.default_rng(3), io.BytesIO(), []
    writer = id_files.FileWriter(sink, chunk=64)
    for doc_id in [None, None, -5, 1, 1, 2]:
        docs.append((doc_id, draw.integers(0, 50_000, int(draw.integers(0, 300))).astype("<u4")))
        writer.add(doc_id, docs[-1][1].tobytes())
    writer.close()
    got = list(id_files.read_file(sink.getvalue()))
    assert [d for d, _ in got] == [d for d, _ in docs]
    assert all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    with pytest.raises(ValueError):
        list(id_files.read_file(b"x" * 40))


def test_id_files(spark):
    library = tokens.load(WORD)
    docs = clashing(documents(spark), "start", "path")
    got = id_files.digests(id_files.write_and_read(docs, WORD, end_id=1, files=4)).collect()
    expected = Counter()
    for doc_id, text in awkward_texts():
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    inorder, start = sorted(got, key=lambda r: r.start), 0
    for row in inorder:
        assert row.start == start
        start += row.n_tokens
    known = [r.doc_id for r in inorder]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))
    assert id_files.write_and_read(documents(spark, []), WORD, end_id=1).count() == 0


def test_bins_hold_and_close():
    draw = random.Random(5)
    for open_bins in (1, 3, 1000):
        bins, used = packing.OpenBins(100, open_bins), {}
        for _ in range(500):
            length = draw.randrange(1, 101)
            number, offset = bins.place(length)
            assert used.get(number, 0) == offset and offset + length <= 100
            used[number] = offset + length
            assert sum(len(b) for b in bins.by_free) == bins.open <= open_bins
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 9, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]


def test_fullest_bin_closes():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # bin 1 (7 of 10) closed
    assert bins.place(3)[0] == 0


def test_cut():
    assert list(packing.cut(5, 10)) == [(0, 5)]
    assert list(packing.cut(10, 10)) == [(0, 10)]
    assert list(packing.cut(23, 10)) == [(0, 3), (3, 10), (13, 10)]


def test_packing(spark):
    library = tokens.load(BYTE)
    docs = clashing(documents(spark), "piece", "sequence_id")
    got = packing.pack_documents(docs, BYTE, end_id=0, capacity=128, rows_per_packer=1000).collect()
    expected = Counter()
    for doc_id, text in awkward_texts():
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, (start, length) in enumerate(packing.cut(len(ids), 128)):
            expected[doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = {}
    for row in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(row.sequence_id, 0) == row.offset
        bins[row.sequence_id] = row.offset + row.length
    assert max(bins.values()) <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) + 1
    assert packing.pack_documents(documents(spark, []), BYTE, end_id=0).count() == 0
