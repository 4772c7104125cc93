"""Token counts (operator 9) by rank-synchronous array merging.

Method. The distinct new pre-tokens of a batch lie end to end in one numpy array, with the number of
their pre-token beside each symbol. In a round every pre-token finds its own lowest merge rank and
applies that merge to all its places, left to right, at once. Pre-tokens without a merge leave the
array. The symbols that survive are the tokens. A merge's result only takes part in merges of higher
rank, so all places of the lowest rank may be merged together.

Special tokens written in a text are cut out first and count one token each, as the library does.

Defined cases: null counts as empty: 0 bytes, 0 tokens, not over the limit; any length is counted
whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import text_map
from .pretokens import splitter

LIMIT = 512
OUTPUTS = "n_bytes long, n_tokens long, over_limit boolean"
NONE = np.int64(1) << 60


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class ArrayMerger:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        letters = _byte_letters()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        result = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            same = owner[:-1] == owner[1:]
            ranks = np.where(same, self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
            ranks = np.append(ranks, NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            result[owner[starts]] = sizes
            live = np.repeat(lowest != NONE, sizes)
            if not live.all():
                if not live.any():
                    break
                symbols, owner, ranks = symbols[live], owner[live], ranks[live]
                keep = lowest != NONE
                lowest, sizes = lowest[keep], sizes[keep]
            hit = ranks == np.repeat(lowest, sizes)
            hit &= ranks != NONE
            at = np.flatnonzero(hit)
            # overlapping places form runs of neighbouring indices; every second of a run is merged
            run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
            first = at[np.append(True, np.diff(at) != 1)]
            at = at[(at - first[run]) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        else:
            if len(symbols) == 1:
                result[owner[0]] = 1
        return result


#: Pre-tokens a worker remembers before it starts afresh; it only costs time.
REMEMBERED = 600_000


@lru_cache(maxsize=2)
def counter(path: str) -> tuple[ArrayMerger, dict[str, int], re.Pattern | None]:
    merger = ArrayMerger(path)
    special = "|".join(map(re.escape, sorted(merger.special, key=len, reverse=True)))
    return merger, {}, re.compile(special) if special else None


def count_tokens(texts: list[str | None], path: str, limit: int = LIMIT) -> dict:
    merger, known, special = counter(path)
    find = splitter("tokenizers")
    n_bytes, n_tokens, words = [], [], []
    for text in texts:
        text = text or ""
        n_bytes.append(len(text.encode()))
        if special is not None and special.search(text):
            parts = special.split(text)
            words.append([w for part in parts for w in find(part)])
            n_tokens.append(len(parts) - 1)
        else:
            words.append(find(text))
            n_tokens.append(0)
    if len(known) > REMEMBERED:
        known.clear()
    if new := list(set(chain.from_iterable(words)).difference(known)):
        known.update(zip(new, merger.count([w.encode() for w in new]).tolist()))
    n_tokens = [n + sum(map(known.__getitem__, found)) for n, found in zip(n_tokens, words)]
    return {"n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: UTF-8 bytes and tokens of the whole text, and whether the tokens exceed ``limit``. No shuffle."""
    return text_map(docs, id_col, text_col, OUTPUTS, lambda texts: count_tokens(texts, path, limit))
