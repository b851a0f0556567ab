"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.llm.bpe import Encoder, blocks, encoder, vocabulary

BLOCK_CHARS = 3_000_000
#: Marks of a word: white space only, starts with white space, one line break, more of them, ends a sentence, ends it without a space after, a comma.
BLANK, SPACED, BREAK, BREAKS, STOP, CLOSE, COMMA = (1 << i for i in range(7))
_STOP = re.compile(r"""[.!?…]+["'”’»)\]]*\Z""")
_CLOSE = re.compile(r"[。！？][」』）]*\Z")
#: Kinds of natural boundaries, the strongest first.
KINDS = ("paragraph", "line", "sentence", "word")


def marks(word: str) -> int:
    lines = word.count("\n")
    return (
        BLANK * word.isspace() + SPACED * word[0].isspace() + BREAK * (lines == 1) + BREAKS * (lines > 1)
        + STOP * bool(_STOP.search(word)) + CLOSE * bool(_CLOSE.search(word)) + COMMA * (word[-1] in ",;、，；")
    )


class Splitter:
    """Pieces of texts by the tokens of an Encoder. Words are the units: a cut between words changes no token but those of
    white space at a piece's end. Words of more than half of the overlap (or of what a piece adds) are cut further."""

    def __init__(self, enc: Encoder, limit: int, overlap: int):
        self.enc, self.limit, self.overlap = enc, limit, overlap
        self.most = max(1, min(overlap or limit, limit - overlap) // 2)
        self.store: list[str] | None = None

    def learn_marks(self) -> None:
        """Marks and lengths of the encoder's new words."""
        if self.store is not self.enc.words:
            self.store, self.marks, self.chars = self.enc.words, np.empty(0, np.uint8), np.empty(0, np.int64)
        new = self.store[len(self.marks) :]
        if new:
            self.marks = np.concatenate((self.marks, np.fromiter(map(marks, new), np.uint8, len(new))))
            self.chars = np.concatenate((self.chars, np.fromiter(map(len, new), np.int64, len(new))))

    def fragments(self, word: int) -> list[str]:
        """A word cut after whole characters into parts of about self.most of its tokens."""
        enc = self.enc
        ids = enc.ids[enc.start[word] : enc.start[word] + enc.size[word]].tolist()
        raw, cuts, want = enc.words[word].encode(), [0], self.most
        for k, e in enumerate(accumulate(len(enc.pairs.token_bytes[i]) for i in ids), 1):
            if e == len(raw) or (k >= want and raw[e] & 0xC0 != 0x80):
                cuts.append(e)
                want = k + self.most
        return [raw[x:y].decode() for x, y in zip(cuts, cuts[1:], strict=False)]

    def prepare(self, words: np.ndarray) -> dict[int, list[int]]:
        """For each long word among words, its fragments' indexes in the encoder's store."""
        enc = self.enc
        long = np.unique(words[enc.size[words] > self.most]).tolist()
        parts = {w: self.fragments(w) for w in long}
        enc.learn([f for fs in parts.values() for f in fs])
        self.learn_marks()
        return {w: [enc.of[f] for f in fs] for w, fs in parts.items()}

    def boundaries(self, units: np.ndarray) -> list[list[int]]:
        """By KINDS, the sorted units before which a text may be cut."""
        m = self.marks[units]
        blank, spaced = (m & BLANK) > 0, (m & SPACED) > 0
        breaks = np.where(m & BREAKS, 2, np.where(m & BREAK, 1, 0)) * blank
        run = breaks[:-1].copy()
        run[1:] += np.where(blank[1:-1], breaks[:-2], 0)
        here = ~blank[1:]
        after = (m[:-1] & STOP > 0) & spaced[1:] | (m[:-1] & CLOSE > 0)
        word = spaced[1:] | blank[:-1] | (m[:-1] & COMMA > 0)
        return [(np.flatnonzero(x) + 1).tolist() for x in (here & (run > 1), here & (run == 1), after, word)]

    def cut(self, text: str, words: np.ndarray, parts: dict[int, list[int]]) -> list[tuple[int, int, int, str]]:
        """Pieces of text, whose words' indexes are given: (first character, end character, tokens, kind of the cut at the end).

        Token counts are prefix sums over the units, boundaries sorted arrays of token offsets. From a piece's start the
        last boundary within limit is found by binary search: of the strongest kind that leaves the piece at least half
        full, else of the strongest kind there is, else at any unit ('hard'). The next piece starts at the last unit at
        least overlap tokens, of the whole text's encoding, before the cut. A piece's own tokens are counted. Pieces
        cover the text and advance always; none exceeds limit but a single character that does. Where what a piece adds
        would not fit beside the whole overlap, the overlap is shorter.
        """
        enc, limit, overlap = self.enc, self.limit, self.overlap
        inner: set[int] = set()
        units = words
        if parts:
            long = np.flatnonzero(enc.size[words] > self.most)
            if len(long):
                out, at, n = [], 0, 0
                for i in long.tolist():
                    own = parts[int(words[i])]
                    out += [words[at:i], np.array(own, np.int64)]
                    n += i - at
                    inner.update(range(n + 1, n + len(own)))
                    n, at = n + len(own), i + 1
                units = np.concatenate([*out, words[at:]])
        tokens = [0, *np.cumsum(enc.size[units]).tolist()]
        chars = [0, *np.cumsum(self.chars[units]).tolist()]
        blank = (self.marks[units] & BLANK) > 0
        places = [(kind, k, [tokens[i] for i in k]) for kind, k in zip(KINDS, self.boundaries(units), strict=True)]
        pieces = []
        start = done = 0
        last = len(units)
        while True:
            top = tokens[start] + limit
            if tokens[-1] <= top:
                end, kind = last, "end"
            else:
                end, kind = 0, ""
                for least in (max(tokens[done], tokens[start] + max(overlap, limit // 2)), tokens[done]):
                    for name, at, offsets in places:
                        k = bisect_right(offsets, top) - 1
                        if k >= 0 and offsets[k] > least:
                            end, kind = at[k], name
                            break
                    if kind:
                        break
                if not kind:
                    end, kind = max(bisect_right(tokens, top) - 1, done + 1), "hard"
            if start in inner or end in inner:
                whole = int(enc.count([text[chars[start] : chars[end]]], keep=True)[0])
            else:
                k = end
                while kind != "end" and k > start and blank[k - 1]:
                    k -= 1
                whole = tokens[k] - tokens[start]
                if k < end:
                    space = text[chars[k] : chars[end]]
                    enc.learn((space,))
                    whole += int(enc.size[enc.of[space]])
            while whole > limit and end - 1 > done:  # parts of one word may join to other tokens
                end, kind = end - 1, "hard"
                whole = int(enc.count([text[chars[start] : chars[end]]], keep=True)[0])
            while whole > limit and start < done:  # one more unit is more than limit less overlap: the overlap gives way
                start += 1
                whole = int(enc.count([text[chars[start] : chars[end]]], keep=True)[0])
            pieces.append((chars[start], chars[end], whole, kind))
            if end == last:
                return pieces
            start, done = max(bisect_right(tokens, tokens[end] - overlap) - 1, start + 1), end


def split_block(splitter: Splitter, texts: list[str | None]) -> list[list[tuple[int, int, int, str]]]:
    """The pieces of each text; one, with the cut 'end', for a text within the limit, none for an empty or null one."""
    enc, limit = splitter.enc, splitter.limit
    at, counts = enc.look_up([t or "" for t in texts])
    ends = np.cumsum(counts)
    tokens = np.r_[0, np.cumsum(enc.size[at])]
    sizes = (tokens[ends] - tokens[ends - counts]).tolist()
    large = [i for i, n in enumerate(sizes) if n > limit]
    words = {i: at[ends[i] - counts[i] : ends[i]] for i in large}
    parts = splitter.prepare(np.concatenate(list(words.values()))) if large else {}
    return [splitter.cut(t, words[i], parts) if i in words else [(0, len(t), n, "end")] if t else [] for i, (t, n) in enumerate(zip(texts, sizes, strict=True))]


def split_texts(df: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """key (as long), piece, start_pos, end_pos, n_tokens, cut, piece_text of every text, by Splitter.cut.

    A text of at most limit tokens is one piece, its cut 'end'; empty and null texts have no pieces. Positions count
    code points. piece counts from 0. overlap must be less than limit. One narrow pass without shuffle, in blocks of
    bounded size; rows of a repeated key come out each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    path = vocabulary(name, folder)
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("n_tokens", pa.int32()), ("cut", pa.string()), ("piece_text", pa.string())])

    def run(batches):
        splitter = Splitter(encoder(path), limit, overlap)
        for keys, texts in blocks(batches, BLOCK_CHARS):
            rows = [(k, i, a, b, n, kind, t[a:b]) for k, t, pieces in zip(keys, texts, split_block(splitter, texts), strict=True) for i, (a, b, n, kind) in enumerate(pieces)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, piece int, start_pos int, end_pos int, n_tokens int, cut string, piece_text string").withColumnRenamed("key", key)
