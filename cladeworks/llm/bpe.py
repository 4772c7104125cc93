"""Byte-level BPE encoding and decoding (operator 3) as a monoid tree reduction.

Method. Each pre-token is halved recursively down to single bytes, whose tokens are known, and
neighbours are joined on the way up. A join re-encodes a window of tokens around the seam
and widens it, to the side that is unsettled, until the seam tokens are compatible with the tokens
outside. Two tokens are compatible if the bytes of the pair encode to exactly that pair. A token
sequence is the BPE encoding of its bytes if and only if all neighbours are compatible, so tokens
outside the window are then proven final. Pre-tokens are encoded apart, hence the document level of
the tree is plain concatenation. Decoding maps ids to their bytes and concatenates neighbours up a
tree as well. Halves that recur in many pre-tokens are remembered.

Defined cases: null counts as empty and gives no ids; any length is encoded whole; equal texts give
equal ids; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from operator import add

from pyspark.sql import DataFrame

from ..sources.tables import ship
from .common import text_map
from .pretokens import TwoGenerations, splitter

#: Bytes up to which the encoding of a half is remembered; it only costs time.
KEPT_BYTES = 48

OUTPUTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class TreeBPE:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.single = [(self.ranks[bytes([b])],) for b in range(256)]
        #: The encoding of two tokens' bytes, by the pair of tokens.
        self.pairs = TwoGenerations(lambda pair: self.window(self.tokens[pair[0]] + self.tokens[pair[1]]), 200_000)
        self.halves = TwoGenerations(self._split, 400_000)
        self.joins = 0

    def window(self, piece: bytes) -> tuple[int, ...]:
        """Plain merging, lowest rank first and leftmost among equals; meant for the bytes around a seam."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, get = self.ranks, self.ranks.get
        scores = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 60:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        return tuple([ranks[p] for p in parts])

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes, given the encodings of both sides."""
        if not left or not right:
            return left + right
        self.joins += 1
        pairs, tokens = self.pairs, self.tokens
        middle = pairs[left[-1], right[0]]
        a = b = 1
        while True:
            settled_left = a >= len(left) or pairs[edge := (left[-a - 1], middle[0])] == edge
            settled_right = b >= len(right) or pairs[edge := (middle[-1], right[b])] == edge
            if settled_left and settled_right:
                return left[: len(left) - a] + middle + right[b:]
            if not settled_left:
                a = min(len(left), 2 * a)
            if not settled_right:
                b = min(len(right), 2 * b)
            middle = self.window(b"".join([tokens[t] for t in left[len(left) - a :]] + [tokens[t] for t in right[:b]]))

    def _split(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece) // 2
        return self.join(self.encode_piece(piece[:n]), self.encode_piece(piece[n:]))

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The tree over one pre-token. Halving keeps the recursion as deep as the logarithm of the length."""
        if len(piece) == 1:
            return self.single[piece[0]]
        if len(piece) <= KEPT_BYTES:
            return self.halves[piece] if piece else ()
        return self._split(piece)

    def decode(self, ids) -> bytes:
        """Bytes of the ids, neighbours concatenated level by level."""
        level = [self.tokens[i] for i in ids]
        while len(level) > 1:
            odd = level[len(level) - len(level) % 2 :]
            level = [*map(add, level[::2], level[1::2]), *odd]
        return level[0] if level else b""


def fresh_codec(path: str) -> tuple[TreeBPE, TwoGenerations]:
    """Tables and what they remember; some 100 to 200 MB after much text."""
    bpe = TreeBPE(path)
    return bpe, TwoGenerations(lambda word: bpe.encode_piece(word.encode()))


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[TreeBPE, TwoGenerations]:
    return fresh_codec(path)


def encode_text(text: str | None, path: str) -> list[int]:
    """Token ids of a whole text."""
    _, words = codec(path)
    return list(chain.from_iterable(map(words.__getitem__, splitter("tiktoken")(text or ""))))


def digests(texts: list[str | None], path: str) -> dict:
    return _digests(texts, *codec(path), _names(path))


def digester(path: str) -> Callable[[list[str | None]], dict]:
    """``digests`` for one task: its tables go when it goes, so the worker doesn't hold them in later stages."""
    bpe, words = fresh_codec(path)
    names = {i: str(i).encode() for i in bpe.tokens}
    return lambda texts: _digests(texts, bpe, words, names)


def _digests(texts: list[str | None], bpe: TreeBPE, words: TwoGenerations, names: dict[int, bytes]) -> dict:
    find = splitter("tiktoken")
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for text in texts:
        ids = list(chain.from_iterable(map(words.__getitem__, find(text or ""))))
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
        out["decoded_sha256"].append(sha256(bpe.decode(ids)).hexdigest())
    return out


@lru_cache(maxsize=2)
def _names(path: str) -> dict[int, bytes]:
    return {i: str(i).encode() for i in codec(path)[0].tokens}


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``ids`` (array of int) and ``n_tokens`` of the whole text; null encodes as empty. No shuffle."""

    def run(texts):
        ids = [encode_text(t, path) for t in texts]
        return {"ids": ids, "n_tokens": [len(x) for x in ids]}

    return text_map(docs, id_col, text_col, "ids array<int>, n_tokens long", run)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: ``decoded`` (binary), the bytes of the ids; null ids decode to no bytes. No shuffle."""
    import pyarrow as pa

    ship(encoded.sparkSession)
    source = encoded.select(encoded[id_col], encoded[ids_col].alias("_ids"))

    def run(batches):
        bpe, _ = codec(path)
        for batch in batches:
            made = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_col, "decoded"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])
    return source.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens, digest of the ids and digest of the bytes decoded from them. No shuffle."""
    return text_map(docs, id_col, text_col, OUTPUTS, start=lambda: digester(path))
