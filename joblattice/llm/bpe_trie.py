"""Byte-pair encoding by a walk over a prefix trie of the distinct words.

A sequence of tokens is the encoding of its text exactly if each two neighbours, joined and
encoded alone, stay these two tokens. So the encoding of a prefix is known from its last
token and the encoding of the shorter prefix before that token, and the walk from a trie
node to its child only has to find the last token of one more prefix. Words that share a
prefix share its nodes, which are computed once.

Null and empty texts have no ids, an empty id text and an empty decoded text. Repeated rows
and rows with equal ids are each encoded; no row depends on another. Extra columns are
ignored. Very long texts are read whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import held, text_or_empty, uncollected
from joblattice.llm.tokens import ODD_SPACES, slices

END = "</w>"
# Fixed value: the word pattern of the vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The visible letter of each byte: itself where printable, else one from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, odd = [], 0
    for byte in range(256):
        letters.append(chr(byte if byte in printable else 256 + odd))
        odd += byte not in printable
    return letters


class Vocabulary:
    """Token ids, merge ranks, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.texts = {token: str(number) for token, number in self.ids.items()}
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        # for each token, which tokens have stood in front of it or could not
        self.pairs: dict[str, dict[str, bool]] = {token: {} for token in self.ids}
        self.traces: dict[str, tuple[list[int], list[str], list[str]] | None] = {}
        self.letters = str.maketrans(dict(enumerate(byte_letters())))

    @staticmethod
    def symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], body[-1:] + END] if token != body and body else list(body or token)

    def trace(self, token: str) -> tuple[list[int], list[str], list[str]] | None:
        """The ranks of the merges that make a token of its symbols, in order, and its first and last
        symbol before each of them and at the end; None if its symbols don't become the token."""
        if token not in self.traces:
            known, none, symbols = self.ranks, len(self.ranks), self.symbols(token)
            ranks, firsts, lasts = [], [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                open_pairs = [known.get(pair, none) for pair in zip(symbols, symbols[1:])]
                least = min(open_pairs)
                if least == none:
                    break
                at = open_pairs.index(least)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                ranks.append(least)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
            self.traces[token] = (ranks + [none], firsts, lasts) if symbols == [token] else None
        return self.traces[token]

    def stand_together(self, left: str, right: str) -> bool:
        """Whether ``left right`` is an encoding; an empty left asks for ``right`` alone.

        Both tokens are merged side by side, the lower rank first and of equal ranks the left one, as
        long as the symbols at their border are not due to be merged before.
        """
        known = self.pairs[right].get(left)
        if known is None:
            known = self.pairs[right][left] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: str, right: str) -> bool:
        after = self.trace(right)
        before = self.trace(left) if left else None
        if after is None or left and before is None:
            return False
        if not left:
            return True
        (left_ranks, _, lasts), (right_ranks, firsts, _) = before, after
        ranks, none, i, j = self.ranks, len(self.ranks), 0, 0
        while True:
            border, a, b = ranks.get((lasts[i], firsts[j]), none), left_ranks[i], right_ranks[j]
            if border < a and border <= b and border < none:
                return False
            if a == b == none:
                return True
            if a <= b:
                i += 1
            else:
                j += 1


class Node:
    __slots__ = ("children", "last", "before")

    def __init__(self, last: str = "", before: Node | None = None):
        self.children: dict[str, Node] | None = None
        self.last, self.before = last, before  # the last token, and the node in front of it


class WordTrie:
    """Encodings of words; ``kept`` nodes at most are held between two batches."""

    def __init__(self, vocabulary: Vocabulary, kept: int = 900_000):
        self.vocabulary, self.kept = vocabulary, kept
        self.root, self.size = Node(), 0

    def _child(self, path: list[Node], prefix: str, tail: str) -> Node:
        """The node one symbol below ``path[-1]``; ``prefix`` is its text, ``tail`` the end mark or nothing."""
        pairs = self.vocabulary.pairs.get
        text, depth = prefix + tail, len(prefix)
        for start in range(max(0, depth - self.vocabulary.longest), depth):
            token = text[start:]
            known = pairs(token)
            if known is not None:
                before = path[start]
                together = known.get(before.last)
                if together or together is None and self.vocabulary.stand_together(before.last, token):
                    return Node(token, before)
        raise ValueError(f"no encoding of {prefix!r}")

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, walked depth first."""
        if self.size > self.kept:
            self.root, self.size = Node(), 0
            gc.collect()  # nodes know those above and below
        out, path, previous, child = {}, [self.root], "", self._child
        for word in sorted(set(words)):
            shared, last = 0, len(word) - 1
            while shared < last and shared < len(path) - 1 and previous[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            node = path[-1]
            for depth in range(shared, last):
                following = node.children.get(word[depth]) if node.children else None
                if following is None:
                    following = child(path, word[: depth + 1], "")
                    if node.children is None:
                        node.children = {}
                    node.children[word[depth]] = following
                    self.size += 1
                path.append(following)
                node = following
            node = child(path, word, END)  # the end of a word, which no other word shares
            tokens = []
            while node.before is not None:
                tokens.append(node.last)
                node = node.before
            tokens.reverse()
            out[word] = tokens
            previous = word
        return out


class TrieEncoder:
    """Whole texts to their ids and their decoded text, both as words joined by a space.

    What is known of pieces between white space, and of words, is kept, ``kept`` of each at most.
    """

    def __init__(self, path: str, kept: int = 1_200_000):
        self.vocabulary = Vocabulary(path)
        self.trie = WordTrie(self.vocabulary)
        self.kept = kept
        self.pattern = regex.compile(WORD)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.known: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def _words(self, piece: str) -> list[str]:
        if piece.isascii():
            lower = piece.lower()
        else:  # one character at a time: no rule for a letter at the end of a word
            lower = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        words = [lower] if lower.isalpha() else self.pattern.findall(lower)
        if lower.isascii() and lower.isprintable():
            return words
        return [w.encode().decode("latin-1").translate(self.vocabulary.letters) for w in words]

    def _split(self, piece: str) -> list[str]:
        """Words, and special tokens as they are."""
        if "<|" not in piece:
            return self._words(piece)
        parts = self.marks.split(piece)
        return [w for i, p in enumerate(parts) if p for w in ([p] if i % 2 else self._words(p))]

    def _learn(self, pieces: Iterable[str]) -> None:
        known, words, special = self.known, self.words, self.vocabulary.special
        for mark, number in special.items():
            words[mark] = (1, str(number), mark)
        plain = {p: p.lower() for p in pieces if p.isascii() and p.isalpha()}
        split = {p: self._split(p) for p in pieces if p not in plain}
        ids = self.vocabulary.texts.__getitem__
        fresh = set(plain.values()).union(*split.values()) - words.keys()
        for word, tokens in self.trie.encode(fresh).items():
            words[word] = (len(tokens), " ".join(map(ids, tokens)), " ".join(tokens))
        known.update(zip(plain, map(words.__getitem__, plain.values())))
        for piece, own in split.items():
            if len(own) == 1:
                known[piece] = words[own[0]]
            else:
                found = [words[w] for w in own]
                known[piece] = (sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found]))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, the ids, the decoded text."""
        if len(self.known) > self.kept or len(self.words) > self.kept:
            self.known.clear()
            self.words.clear()
        cut = [[t] if any(c in t for c in ODD_SPACES) else t.split() for t in texts]
        self._learn(set().union(*cut) - self.known.keys())
        for pieces in cut:
            if not pieces:
                yield 0, "", ""
                continue
            counts, ids, tokens = zip(*map(self.known.__getitem__, pieces))
            if 0 in counts:  # a text of odd spaces alone has no tokens
                found = map(self.known.__getitem__, pieces)
                counts, ids, tokens = zip(*[f for f in found if f[0]] or [(0, "", "")])
            yield sum(counts), " ".join(ids), " ".join(tokens)


def encoder(path: str) -> TrieEncoder:
    return held(TrieEncoder, path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids, decoded): decimal ids and decoded tokens, each joined by a space."""
    schema = f"{id_col} long, n_tokens long, ids string, decoded string"

    def run(batches):
        own = encoder(vocabulary)
        with uncollected():
            yield from encoded(own, batches)

    def encoded(own, batches):
        for batch in batches:
            for part in slices(batch):
                keys, texts = part.column(0), part.column(1).to_pylist()
                counts, ids, decoded = zip(*own.encode(texts))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def encoded_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 sums in place of the two texts, formed before rows leave Python."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        own = encoder(vocabulary)
        with uncollected():
            yield from digested(own, batches)

    def digested(own, batches):
        for batch in batches:
            for part in slices(batch):
                rows = list(own.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([hashlib.sha256(i.encode()).hexdigest() for _, i, _ in rows]),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for _, _, d in rows]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
