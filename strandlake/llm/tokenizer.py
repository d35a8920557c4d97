"""Byte-level BPE of whole texts with a public vocabulary.

A text is cut into pre-tokens, and each distinct pre-token is merged once per worker: a priority
queue holds (merge rank, position) over a doubly linked list of symbols, and entries whose pair has
changed since they were queued are skipped. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters worked on at once; a longer text is worked on alone, in parts of about this length.
BLOCK_CHARS = 1_000_000
#: Right after a word or number and before a blank a pre-token ends, whatever stands farther on either side.
_SAFE_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?=\s)")
#: Distinct pre-tokens kept by a worker; beyond it the store starts anew (only time depends on it).
KEPT_PIECES = 400_000

_LETTER, _NUMBER, _SPACE, _OTHER, _BREAK = 1, 2, 3, 0, 9
_END = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))


def _char_classes() -> np.ndarray:
    points = [c for c in range(_END) if not 0xD800 <= c <= 0xDFFF]
    whole, at = "".join(map(chr, points)), np.array(points)
    table = np.zeros(_END + 1, "uint8")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            table[at[m.start() : m.end()]] = kind
    table[_END] = _BREAK
    return table


def _contraction_lengths(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters after the apostrophes at ``at`` that belong to 's 't 're 've 'm 'll 'd; 0 where there are none."""
    a, b = code[at + 1], code[np.minimum(at + 2, len(code) - 1)]
    s, t, m, d, r, v, l, e = (ord(c) for c in "stmdrvle")
    one = (a == s) | (a == t) | (a == m) | (a == d)
    two = ((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == l) & (b == l))
    return np.where(one, 1, np.where(two, 2, 0))


class ByteBPE:
    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.bytes_to_ids = bytes(self.ranks[bytes([b])] for b in range(256))
        self.pairs = self._pairs()
        self.classes = _char_classes()
        self.powers = self.unpowers = np.zeros(0, "uint64")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first = np.zeros(1024, "int64")
        self.count = np.zeros(1024, "int64")
        self.store = np.zeros(4096, "int32")
        self.used = 0

    def _pairs(self) -> dict[int, int]:
        """(left id, right id) as one integer -> id of the joined string, for every way to cut a vocabulary string."""
        ranks, out = self.ranks, {}
        for s, i in ranks.items():
            for k in range(1, len(s)):
                a, b = ranks.get(s[:k]), ranks.get(s[k:])
                if a is not None and b is not None:
                    out[a << 20 | b] = i
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get = self.pairs.get
        symbol = list(piece.translate(self.bytes_to_ids))
        n = len(symbol)
        pair = [get(a << 20 | b, -1) for a, b in zip(symbol, symbol[1:])]
        pair.append(-1)
        queue = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            r = top >> 32
            if pair[i] != r:
                continue
            symbol[i] = r
            gone = after[i]
            nxt = after[i] = after[gone]
            symbol[gone] = pair[gone] = -1
            if nxt < n:
                before[nxt] = i
                q = pair[i] = get(r << 20 | symbol[nxt], -1)
                if q >= 0:
                    heappush(queue, q << 32 | i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                q = pair[p] = get(symbol[p] << 20 | r, -1)
                if q >= 0:
                    heappush(queue, q << 32 | p)
        return [s for s in symbol if s >= 0]

    def pieces(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens in code points whose texts end with ``_END`` each.

        The rules are those of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
        """
        kind = self.classes[code]
        n = len(code)
        start = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        # The last blank before a word: a space joins it, another blank stands alone.
        word = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _BREAK)) + 1
        start[word - 1] = True
        start[word[code[word - 1] == 32]] = False
        # A lone apostrophe that begins a pre-token, before letters.
        mark = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER))
        if len(mark):
            length = _contraction_lengths(code, mark)
            mark, length = mark[length > 0], length[length > 0]
            inside = kind[mark + length] == _LETTER
            mark, length = mark[inside], length[inside]
            start[mark + 1] = False
            start[mark + 1 + length] = True
        ends_text = kind == _BREAK
        start |= ends_text
        at = np.flatnonzero(start)
        real = ~ends_text[at]
        stop = np.append(at[1:], n)
        return at[real], stop[real]

    def _keys(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(code) + 1:
            n = max(len(code) + 1, 1 << 16)
            self.powers, self.unpowers = np.full(n, _BASE), np.full(n, _UNBASE)
            for p in (self.powers, self.unpowers):
                p[0] = 1
                np.multiply.accumulate(p, out=p)
        total = np.zeros(len(code) + 1, "uint64")
        np.cumsum((code.astype("uint64") + np.uint64(1)) * self.powers[: len(code)], out=total[1:])
        key = (total[hi] - total[lo]) * self.unpowers[lo]
        return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (hi - lo).astype("uint64")

    def _same(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, like: np.ndarray) -> bool:
        """Whether each pre-token equals, character by character, the one it shares a key with."""
        length = hi - lo
        if not np.array_equal(length, length[like]):
            return False
        shift = np.repeat(lo[like] - lo, length)
        here = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.array_equal(code[here], code[here + shift])

    def _add(self, pieces: list[str]) -> None:
        """Merges new pre-tokens and stores their ids."""
        merge, ids, counts = self.merge, [], []
        for piece in pieces:
            out = merge(piece.encode())
            ids += out
            counts.append(len(out))
        n, at = len(self.known), len(self.known) - len(pieces)
        while n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros(len(x), "int64")]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store), "int32")])
        self.count[at:n] = counts
        self.first[at:n] = self.used + np.cumsum(counts) - counts
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode_block(self, texts: list[str], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each text has."""
        if len(self.known) > KEPT_PIECES:
            self._forget()
        bounds = np.cumsum([len(t) + 1 for t in texts])
        code = np.frombuffer("".join([t + "\0" for t in texts]).encode("utf-32-le"), "<u4").copy()
        code[bounds - 1] = _END
        lo, hi = self.pieces(code)
        if not len(lo):
            return np.zeros(0, "int32"), np.zeros(len(texts), "int64")
        _, rep, which = np.unique(self._keys(code, lo, hi), return_index=True, return_inverse=True)
        if not self._same(code, lo, hi, rep[which]):
            rep = which = np.arange(len(lo))
        joined = "\0".join(texts)
        known, rows, new = self.known, [], []
        for a, b in zip(lo[rep].tolist(), hi[rep].tolist()):
            piece = joined[a:b]
            i = known.get(piece)
            if i is None:
                i = known[piece] = len(known)
                new.append(piece)
            rows.append(i)
        if new:
            self._add(new)
        rows = np.array(rows)
        n = self.count[rows][which]
        total = np.concatenate([[0], np.cumsum(n)])
        per_text = np.diff(total[np.concatenate([[0], np.searchsorted(lo, bounds)])])
        if counts_only:
            return np.zeros(0, "int32"), per_text
        at = np.repeat(self.first[rows][which] - total[:-1], n) + np.arange(total[-1])
        return self.store[at], per_text

    def encode_long(self, text: str, counts_only: bool = False, block: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_block`` of one text, part by part, so that the work space doesn't grow with the text."""
        ids, n, at = [], 0, 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + block)
            end = cut.start() if cut else len(text)
            part, counts = self.encode_block([text[at:end]], counts_only)
            ids.append(part)
            n += int(counts[0])
            at = end
        return np.concatenate(ids), np.array([n])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_block([text])[0].tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(vocabulary: str) -> ByteBPE:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = ByteBPE(vocabulary)
    return _LOADED[vocabulary]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of (id, text) batches of about BLOCK_CHARS bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    # A text above the block size has a block of its own.
    large = size > BLOCK_CHARS
    group = np.cumsum(np.where(large, 0, size)) // BLOCK_CHARS + np.cumsum(large | np.append(False, large[:-1]))
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _encoder(vocabulary: str, counts_only: bool, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in chain.from_iterable(map(_blocks, batches)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            long = len(texts) == 1 and len(texts[0]) > BLOCK_CHARS
            ids, n = bpe.encode_long(texts[0], counts_only) if long else bpe.encode_block(texts, counts_only)
            if counts_only:
                out = pa.array(n)
            else:
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32")), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=names)

    return work


def _id_and_text(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    return df.select(F.col(key), F.col(text).cast("string").alias("_sl_text")), df.schema[key].dataType.simpleString()


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens.

    Null and empty texts give an empty list, blank texts are encoded as they are, equal rows stay
    equal rows, an empty table gives no rows, and columns other than the two are not read. The
    vocabulary file (50,256 entries) is read once per Python worker from a path every node has.
    """
    rows, kind = _id_and_text(df, key, text)
    return rows.mapInArrow(_encoder(vocabulary, False, [key, "ids"]), f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens bigint) of every row; 0 for null and empty texts."""
    rows, kind = _id_and_text(df, key, text)
    return rows.mapInArrow(_encoder(vocabulary, True, [key, "n_tokens"]), f"`{key}` {kind}, n_tokens bigint")


def decoded_texts(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row: the vocabulary strings of the ids, joined. Null and empty lists give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
