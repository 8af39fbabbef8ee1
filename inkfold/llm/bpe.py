"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively down to leaves.  Leaves are encoded; two neighbours are joined by encoding again a window of text
around their border.  The window grows to both sides until it ends at places where the pre-tokenizer provably begins a piece
whatever lies beyond: tokens never cross pieces, so those outside the window are final.  Such a place is a space between two
characters that are not white space: the pattern allows a space only as the first character of a piece or in a run of white
space, and here the run is that space.  Where there is none, the window grows to the whole half.  Elements (text, tokens) thus
form a monoid under joining, and any tree gives the tokens of the whole text.  Decoding concatenates tokens' bytes up a tree.

Defined results: null text has null tokens, empty text none; texts of any length are encoded whole; repeated rows and null ids are
encoded like any other; an empty table gives no rows.  Other columns, whatever their names, are of no account.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import ID, TEXT, data_dir_vocab, keyed, map_arrow

VOCAB = "byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 4096
WINDOW_CHARS = 16
SCHEMA = "doc_id long, n_tokens long, tokens array<int>, decoded_bytes long, round_trip boolean"


class Codec:
    """The vocabulary at ``path`` (lines of base64 token and rank)."""

    def __init__(self, path: str | None = None) -> None:
        path = path or os.path.join(data_dir_vocab(), VOCAB)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.size = size
        by_rank: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.lengths = np.array([len(x) for x in by_rank], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)

    # encoding
    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.int32)

    def count(self, text: str) -> int:
        """The number of tokens."""
        return len(self.bpe.encode_ordinary(text)) if len(text) <= LEAF_CHARS else len(self.encode(text))

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        if len(text) <= leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf_chars), right, self.encode(right, leaf_chars))

    def join(self, left: str, lt: np.ndarray, right: str, rt: np.ndarray) -> np.ndarray:
        """The tokens of ``left + right`` from those of both."""
        if not left or not right:
            return rt if not left else lt
        a, b = self._last_border(left), self._first_border(right)
        keep = len(lt) - self._tokens_of(lt, len(left[a:].encode()), last=True)
        skip = self._tokens_of(rt, len(right[:b].encode()), last=False)
        return np.concatenate([lt[:keep], self.leaf(left[a:] + right[:b]), rt[skip:]])

    #: a space between two characters that are not white space is the first of its piece in every scan that contains all three
    _sync = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}]) (?=[\p{L}\p{N}\p{P}\p{S}])")

    def _last_border(self, left: str) -> int:
        """Where the window begins: it grows until it holds a border that nothing after ``left`` can move."""
        width = WINDOW_CHARS
        while width < len(left):
            found = [m.start() for m in self._sync.finditer(left, len(left) - width)]
            if found:
                return found[-1]
            width *= 2
        return 0

    def _first_border(self, right: str) -> int:
        """Where the window ends: the first border that nothing before ``right`` can move."""
        width = WINDOW_CHARS
        while width < len(right):
            m = self._sync.search(right, 0, width)
            if m:
                return m.start()
            width *= 2
        return len(right)

    def _tokens_of(self, tokens: np.ndarray, n_bytes: int, *, last: bool) -> int:
        """How many tokens at the end (or start) have ``n_bytes`` bytes."""
        if n_bytes == 0:
            return 0
        k = 64
        while True:
            part = tokens[len(tokens) - min(k, len(tokens)) :][::-1] if last else tokens[:k]
            total = np.cumsum(self.lengths[part])
            at = int(np.searchsorted(total, n_bytes))
            if at < len(total):
                assert total[at] == n_bytes, "a border inside a token"
                return at + 1
            k *= 4

    # decoding
    def decode(self, tokens: np.ndarray, leaf_tokens: int = 1 << 16) -> bytes:
        if len(tokens) > leaf_tokens:
            half = len(tokens) // 2
            return self.decode(tokens[:half], leaf_tokens) + self.decode(tokens[half:], leaf_tokens)
        n = self.lengths[tokens]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.begins[tokens] - (ends - n), n)].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    key = path or ""
    if key not in _codecs:
        _codecs[key] = Codec(path)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each document, decoded again and compared with its bytes; one pass without a shuffle."""

    def run(batches):
        c = codec(vocab)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                counts, sizes, same, flat, lens, null = [], [], [], [], [], []
                for text in part.column(TEXT):
                    text = text.as_py()
                    null.append(text is None)
                    if text is None:
                        counts.append(None), sizes.append(None), same.append(None), lens.append(0)
                        continue
                    tokens = c.encode(text)
                    raw = c.decode(tokens)
                    counts.append(len(tokens)), sizes.append(len(raw)), same.append(raw == text.encode())
                    flat.append(tokens), lens.append(len(tokens))
                offs = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32), mask=np.array([*null, False]))
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(ID), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offs, values), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "decoded_bytes", "round_trip"])

    return keyed(docs, id_col, text_col).drop("_key").mapInArrow(run, SCHEMA)
