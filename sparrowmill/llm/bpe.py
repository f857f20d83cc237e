"""Byte-pair encoding with a segment tree over adjacent pair ranks, and decoding.

For every pre-token the leaves of the tree hold (rank, place) of the pairs that can merge.  The
root is the leftmost pair of lowest rank; a merge changes three leaves, each in logarithmic
time, until no pair is left.  A word of n bytes costs n log n, however long it is.  Words of up to `WIDE`
bytes are merged many at once: their trees are rows of one array, and a step applies each row's root
and updates its three leaves; longer ones are merged one by one by the same steps.

Normalisation and the split into pre-tokens follow the vocabulary file's own settings: NFC,
white space to one space, lower case, then letters, single digits and other runs.  Chunks
between spaces are independent of each other, so their results are remembered per worker
(at most `REMEMBER` chunks, or those of one group of texts).  Chunks with characters from U+0250 on
take normaliser and splitter from the tokenizers library, whose Unicode tables may differ from Python's.

Defined results: null text is empty and has no tokens; repeated rows get equal results; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Recent, held, map_batches, pick, table, texts_of

REMEMBER, WIDE, GROUP = 200_000, 64, 1 << 21
_LATIN = "ɏ"
#: White space as the vocabulary's patterns understand it.
_WS = r"\t-\r \x85\xa0  -     　"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


_NONE = 1 << 62


def merge(ids: list[int], pairs: dict[int, int], merged: list[int]) -> list[int]:
    """Apply `pairs` ((left << 32 | right) -> rank << 32) to `ids`, lowest rank first, leftmost first;
    merged[rank] is the new id.  A leaf holds rank << 32 | place, or _NONE | place if its pair has no rank."""
    n, get = len(ids), pairs.get
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * size + [get(a << 32 | b, _NONE) | i for i, (a, b) in enumerate(zip(ids, ids[1:]))] + [_NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) < _NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        new = ids[i] = merged[top >> 32]
        ids[j] = -1
        k, h = after[j], before[i]
        after[i] = k
        changed = [(j, _NONE)]
        if k < n:
            before[k] = i
            changed.append((i, get(new << 32 | ids[k], _NONE) | i))
        else:
            changed.append((i, _NONE))
        if h >= 0:
            changed.append((h, get(ids[h] << 32 | new, _NONE) | h))
        for at, value in changed:
            at += size
            tree[at] = value
            while at > 1:
                twin = tree[at ^ 1]
                if twin < value:
                    value = twin
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    return [x for x in ids if x >= 0]


class Merges:
    """Pair ranks as a hash table in arrays, and trees of many words at once."""

    NONE, NOTHING, SLOTS = 1 << 62, 1 << 20, 1 << 18  # no rank; a symbol that no pair has; places of the table, well over the number of pairs

    def __init__(self, pairs: dict[int, int], merged: list[int]) -> None:
        slots = max(self.SLOTS, 4 << len(pairs).bit_length())
        self.turn = np.uint64(64 - slots.bit_length() + 1)
        self.keys, self.ranks = np.full(slots, -1, np.int64), np.full(slots, self.NONE, np.int64)
        for k, rank in pairs.items():
            key = k >> 32 << 21 | k & 0xFFFFFFFF
            at = key * 0x9E3779B97F4A7C15 % (1 << 64) >> int(self.turn)
            while self.keys[at] >= 0:
                at = (at + 1) % slots
            self.keys[at], self.ranks[at] = key, rank >> 32 << 8
        self.merged = np.array(merged, np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank << 8 | place of each pair, NONE if it has no rank."""
        key = left << 21 | right
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.turn).view(np.int64)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at] | place, self.NONE)
        rows = np.flatnonzero((there != key) & (there >= 0))
        while len(rows):
            at[rows] = (at[rows] + 1) % len(self.keys)
            there = self.keys[at[rows]]
            hit = there == key[rows]
            out[rows[hit]] = self.ranks[at[rows[hit]]] | place[rows[hit]]
            rows = rows[~hit & (there >= 0)]
        return out

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """`symbols`: a row of words x size (a power of two up to 64, NOTHING after each word's end); the merged ones, -1 for places that went."""
        rows, size = symbols.shape
        wide = size + 2  # one place after the last symbol, one before the first (as place -1)
        sym = np.full((rows, wide), self.NOTHING, np.int64)
        sym[:, :size] = symbols
        tree = np.full((rows, 2 * size), self.NONE, np.int64)
        row, place = np.nonzero(symbols[:, 1:] != self.NOTHING)
        tree[row, size + place] = self.leaf(symbols[row, place], symbols[row, place + 1], place)
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        after = np.tile(np.arange(1, wide + 1), (rows, 1))
        before = np.tile(np.arange(-1, wide - 1), (rows, 1))
        sym, tree, after, before = (x.reshape(-1) for x in (sym, tree, after, before))
        live = np.arange(rows)
        while True:
            top = tree[live * (2 * size) + 1]
            on = top < self.NONE
            live, top = live[on], top[on]
            if not len(live):
                break
            base, root = live * wide, live * (2 * size)
            i, new = top & 255, self.merged[top >> 8]
            j = after[base + i]
            k, h = after[base + j], before[base + i]
            sym[base + i], sym[base + j] = new, -1
            after[base + i] = k
            before[base + np.minimum(k, size)] = i
            leaves = self.leaf(np.concatenate([sym[base + h % wide], new]), np.concatenate([new, sym[base + np.minimum(k, size)]]), np.concatenate([h, i]))
            # a word without a symbol before has no pair there: the last leaf, which never has one, takes its place
            at = np.concatenate([h % size, i, j]) + size
            root = np.tile(root, 3)
            tree[root + at] = np.concatenate([leaves, np.full(len(j), self.NONE)])
            while at[0] > 1:
                at >>= 1
                tree[root + at] = np.minimum(tree[root + 2 * at], tree[root + 2 * at + 1])
        return sym.reshape(rows, wide)[:, :size]


class Codec:
    """Encoder and decoder of a word-level BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WS}\p{{L}}\p{{N}}]+")
        self.alphabet = byte_alphabet()
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, new = self.vocab.get(a), self.vocab.get(b), self.vocab.get(a + b)
            self.merged.append(-1 if new is None else new)
            if None not in (left, right, new):
                self.pairs.setdefault(left << 32 | right, rank << 32)
        self.many = Merges(self.pairs, self.merged)
        #: by code point of the byte alphabet, the ids of a symbol inside a word and at its end; -1: not in the vocabulary
        self.inner, self.last = (np.array([self.vocab.get(chr(c) + end, -1) for c in range(0x200)], np.int64) for end in ("", self.suffix))
        every = range(max(self.tokens) + 1)
        self.written = pa.array([str(i).encode() for i in every], pa.binary())
        self.spelled = pa.array([self.tokens.get(i, "").encode() for i in every], pa.binary())
        self.words = Recent(REMEMBER, self.word)
        self.written_of: dict[str, bytes] = {}  # chunk -> its ids
        self.spelled_of: dict[str, bytes] = {}  # chunk -> its decoded text

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet."""
        first = [*map(self.vocab.get, piece[:-1]), self.vocab.get(piece[-1] + self.suffix)]
        return merge([x for x in first if x is not None], self.pairs, self.merged)

    def all_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, one after the other, and where each one's begin (an entry more than pre-tokens)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sizes = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        count = np.zeros(len(pieces) + 1, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows, their ids
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            step = max(1, GROUP // (64 * size)) if size <= WIDE else 1
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                names, n = [pieces[r] for r in some.tolist()], lengths[some]
                codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
                row, place = np.repeat(np.arange(len(some)), n), np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
                ids = np.where(place == n[row] - 1, self.last[codes], self.inner[codes])
                if size > WIDE or (ids < 0).any():
                    for r, name in zip(some.tolist(), names):
                        x = self.word(name)
                        count[r + 1] = len(x)
                        parts.append((np.array([r]), np.array(x, np.int64)))
                    continue
                symbols = np.full((len(some), size), Merges.NOTHING, np.int64)
                symbols[row, place] = ids
                got = self.many.merge(symbols)
                stay = (got >= 0) & (got < Merges.NOTHING)
                count[some + 1] = stay.sum(axis=1)
                parts.append((some, got[stay]))
        at = np.cumsum(count)
        out = np.zeros(int(at[-1]), np.int64)
        for some, ids in parts:
            n = count[some + 1]
            out[np.repeat(at[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, at

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, in the byte alphabet."""
        if not text:
            return []
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[-1] in ".,;:!?)" and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
        if max(text) <= _LATIN:
            alphabet = self.alphabet
            return ["".join([alphabet[b] for b in p.encode()]) if not p.isascii() or not p.isprintable() else p for p in self.pieces.findall(text.lower())]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        words = self.words
        return [i for p in self.split(text) for i in words[p]]

    def chunk(self, chunk: str) -> list[int]:
        if self.cut is None or "<" not in chunk:
            return self.plain(chunk)
        out: list[int] = []
        for part in self.cut.split(chunk):
            out += [self.special[part]] if part in self.special else self.plain(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for c in text.split(" ") if c for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: tokens are joined by spaces."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def learn(self, chunks: set[str]) -> None:
        """Have the ids and decoded texts of `chunks` ready: those that aren't remembered are encoded together."""
        new = [c for c in chunks if c not in self.written_of]
        if len(self.written_of) + len(new) > REMEMBER:  # what this group of texts doesn't use goes
            self.written_of, self.spelled_of = ({c: kept[c] for c in chunks if c in kept} for kept in (self.written_of, self.spelled_of))
        split, odd = [], []
        for c in new:
            if "<" in c and self.cut is not None and self.cut.search(c):
                odd.append(c)
                split.append([])
            else:
                split.append(self.split(c))
        place = {p: k for k, p in enumerate(set(chain.from_iterable(split)))}
        ids, at = self.all_words(list(place))
        which = np.fromiter((place[p] for ps in split for p in ps), np.int64)
        size = at[which + 1] - at[which]
        ids = ids[np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]
        for kept, table_ in ((self.written_of, self.written), (self.spelled_of, self.spelled)):
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table_.take(pa.array(ids)))
            kept.update(zip(new, pc.binary_join(words, b" ").to_pylist()))
        for c in odd:
            x = self.chunk(c)
            self.written_of[c] = " ".join(map(str, x)).encode()
            self.spelled_of[c] = self.decode(x).encode()

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, and SHA-256 of the ids and of the decoded text."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP):
                size += len(texts[at])
                group.append([c for c in texts[at].split(" ") if c])
                at += 1
            self.learn(set(chain.from_iterable(group)))
            for chunks in group:
                ids, decoded = ([kept[c] for c in chunks] for kept in (self.written_of, self.spelled_of))
                if b"" in ids:
                    ids, decoded = [x for x in ids if x], [y for x, y in zip(ids, decoded) if x]
                every = b" ".join(ids)
                yield every.count(b" ") + 1 if ids else 0, hashlib.sha256(every).hexdigest(), hashlib.sha256(b" ".join(decoded)).hexdigest()


def codec(path: str) -> Codec:
    return held((Codec, path), lambda: Codec(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = [c.encode(t) for t in texts_of(batch.column(1))]
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(c.decode, ids), pa.string())}

    return map_batches(pick(docs, "doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` returns, digested in the worker instead of carried along."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        rows = list(c.digests(texts_of(batch.column(1))))
        n, a, b = zip(*rows) if rows else ((), (), ())
        return {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}

    return map_batches(pick(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": query}
