"""Byte-level BPE over whole partitions by a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("CITEWISE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern by which the public byte-level vocabularies split text before any merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split in the faster matcher of the standard library: its classes in the place of \p{L}, \p{N} and \s.
FAST_SPLIT = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]+|_+)+|\s+(?!\S)|\s+"
CLASSES = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
#: Text taken into one index, in characters, and words remembered between indexes.
BLOCK_CHARS, REMEMBERED = 6_000_000, 600_000
SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def unlike() -> np.ndarray:
    """By code point, whether the two matchers put it into different classes, found by asking both about all of them.

    Both patterns are made of these classes and the same fixed characters, so they split every other text alike.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    differ: set[str] = set()
    for exact, fast in CLASSES:
        differ |= set("".join(regex.findall(f"{exact}+", every))) ^ set("".join(re.findall(f"{fast}+", every)))
    table = np.zeros(0x110000, bool)
    table[list(map(ord, differ))] = True
    return table


class PairIndex:
    """The merges of one vocabulary, and encoding of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        keys = (np.array(self.left, np.int64) << SHIFT) | np.array(self.right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        of = {c: b for b, c in enumerate(letters)}
        self.token_bytes = {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = (a.astype(np.int64) << SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of tokens of each word.

        All words lie in one array with links to the neighbours inside the word. The index maps each rank whose pair
        occurs to the positions of its left parts; the smallest active rank is taken, all its positions merge at
        once, and the pairs this makes with the neighbours enter the index. Stale positions are found by looking.
        Work follows the number of bytes and merges, also for one word of any length.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        ends = np.cumsum(sizes)
        tok = np.empty(n + 1, np.int32)
        tok[:n] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        tok[n] = -1
        nxt = np.arange(1, n + 2, dtype=np.int64)
        nxt[ends[sizes > 0] - 1] = n
        nxt[n] = n
        prv = np.arange(-1, n, dtype=np.int64)
        prv[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[int]] = {}
        if n:
            here = np.flatnonzero(nxt[:n] < n)
            rank = self.rank(tok[here], tok[nxt[here]])
            here, rank = here[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            here, rank = here[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            if len(here):
                index = {int(r): p.tolist() for r, p in zip(rank[np.r_[0, cuts]], np.split(here, cuts), strict=True)}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b, made = self.left[r], self.right[r], self.made[r]
            pos = np.array(index.pop(r), np.int64)
            pos = np.unique(pos) if len(pos) > 1 else pos
            right = nxt[pos]
            real = (tok[pos] == a) & (tok[right] == b)
            pos, right = pos[real], right[real]
            if a == b and len(pos) > 1:  # in a run of equal tokens every other pair merges, from the left
                new_run = np.r_[True, right[:-1] != pos[1:]]
                at = np.arange(len(pos))
                even = (at - np.maximum.accumulate(np.where(new_run, at, 0))) % 2 == 0
                pos, right = pos[even], right[even]
            if not len(pos):
                continue
            tok[pos] = made
            tok[right] = -1
            after = nxt[right]
            nxt[pos] = after
            inside = after < n
            prv[after[inside]] = pos[inside]
            before = prv[pos]
            has = before >= 0
            lefts = np.concatenate((pos[inside], before[has]))
            if len(lefts):
                rank = self.rank(tok[lefts], tok[np.concatenate((after[inside], pos[has]))])
                for k, p in zip(rank.tolist(), lefts.tolist(), strict=True):
                    if k >= 0:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heapq.heappush(heap, k)
        live = tok[:n] >= 0
        before = np.r_[0, np.cumsum(live)]
        return tok[:n][live], before[ends] - before[ends - sizes]


def with_room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy of at least double length if it has no room for n."""
    return a if n <= len(a) else np.concatenate((a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)))


class Encoder:
    """Texts to ids. Words met before are looked up; new ones of a block of texts go through one PairIndex.encode."""

    def __init__(self, path: str):
        self.pairs = PairIndex(path)
        self.exact, self.fast, self.unlike = regex.compile(SPLIT).findall, re.compile(FAST_SPLIT).findall, unlike()
        self.forget()

    def split(self, text: str) -> list[str]:
        return self.exact(text) if self.unlike[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any() else self.fast(text)

    def forget(self) -> None:
        self.of: dict[str, int] = {}
        self.n_words = self.n_ids = 0
        self.words: list[str] = []
        self.ids, self.start, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in set(words) if w not in self.of]
        if not new:
            return
        ids, size = self.pairs.encode([w.encode() for w in new])
        word, first = self.n_words, self.n_ids
        self.n_words, self.n_ids = word + len(new), first + len(ids)
        self.of.update(zip(new, range(word, self.n_words), strict=True))
        self.words += new
        self.start, self.size = with_room(self.start, self.n_words), with_room(self.size, self.n_words)
        self.ids = with_room(self.ids, self.n_ids)
        self.start[word : self.n_words] = first + np.cumsum(size) - size
        self.size[word : self.n_words] = size
        self.ids[first : self.n_ids] = ids

    def look_up(self, texts: list[str], keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The store's index of each word of the texts, and the number of words of each text.

        A full store is emptied first, and indexes given before are void then; not with keep.
        """
        if len(self.of) > REMEMBERED and not keep:
            self.forget()
        words = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        self.learn(chain.from_iterable(words))
        at = np.fromiter(map(self.of.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        return at, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets at which texts begin and end in it."""
        at, counts = self.look_up(texts)
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(start - (ends - size), size) + np.arange(total)]
        per_word = np.r_[0, ends]
        return ids, per_word[np.r_[0, np.cumsum(counts)]]

    def count(self, texts: list[str], keep: bool = False) -> np.ndarray:
        """The number of tokens of each text."""
        at, counts = self.look_up(texts, keep)
        per_word = np.r_[0, np.cumsum(self.size[at])]
        ends = np.cumsum(counts)
        return per_word[ends] - per_word[ends - counts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def vocabulary(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.json")


def blocks(batches: Iterable[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(keys, texts) of two-column batches in blocks of about so many characters, whatever the batches' sizes."""
    keys: list = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            body = part.column(1).to_pylist()
            keys += part.column(0).to_pylist()
            texts += body
            held += sum(map(len, filter(None, body)))
            if held >= chars:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """key (as long) and ids, the token ids of text without special tokens.

    Empty and null texts have the empty list; special tokens' strings in a text are ordinary text. One narrow pass:
    no shuffle, nothing broadcast; each worker reads the vocabulary from folder, which all executors must see.
    """
    path = vocabulary(name, folder)

    def run(batches):
        enc = encoder(path)
        for keys, texts in blocks(batches):
            ids, offsets = enc.encode([t or "" for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], names=["key", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """key (as long) and n_tokens of text; 0 for empty and null texts."""
    path = vocabulary(name, folder)

    def run(batches):
        enc = encoder(path)
        for keys, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(enc.count([t or "" for t in texts]), pa.int64())], names=["key", "n_tokens"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n_tokens long").withColumnRenamed("key", key)
