"""String similarities that Spark lacks, in Python and as Pandas UDFs, and scores as expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import normalized


def block_edits(a: str, b: str, block: int = 1) -> int:
    """Edit distance where two neighbouring blocks of up to ``block`` letters may trade places.

    A swap of blocks of k letters costs k. There is no limit on the length.
    """
    if a == b:
        return 0
    n, m = len(a), len(b)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        row, above = d[i], d[i - 1]
        for j in range(1, m + 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, min(block, i // 2, j // 2) + 1):
                if a[i - 2 * k : i - k] == b[j - k : j] and a[i - k : i] == b[j - 2 * k : j - k]:
                    best = min(best, d[i - 2 * k][j - 2 * k] + k)
            row[j] = best
    return d[n][m]


def costly_edits(a: str, b: str) -> int:
    """Insertions and deletions cost 1, substitutions 2, and a swap of neighbours what the letter pair costs."""
    n, m = len(a), len(b)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost = 0 if a[i - 1] == b[j - 1] else 2
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + cost)
    return d[n][m]


def edits_to_similarity(edits: int, a: str, b: str) -> float:
    """100 for no edits, falling faster than in proportion to the shorter string (or ten letters)."""
    length = min(10, len(a), len(b))
    if edits == 0:
        return 100.0
    share = edits**1.4 / length if length else 2.0
    return 0.0 if edits > length or share > 1 else float(int(100 * (1 - share) + 0.5))


def damerau_similarity(a: str, b: str) -> float:
    return edits_to_similarity(costly_edits(a, b), a, b)


def block_similarity(a: str, b: str, block: int = 3) -> float:
    return edits_to_similarity(block_edits(a, b, block), a, b)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    k = len(left)
    return (k / len(a) + k / len(b) + (k - swaps) / k) / 3


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def jaro_winkler(a: str, b: str) -> float:
    """0 to 100, with a bonus for a shared start that is smaller for long strings."""
    j = _jaro(a, b)
    if j < 0.7:
        return 100 * j
    return 100 * (j + min(0.1, 1 / max(len(a), len(b))) * _shared_start(a, b) * (1 - j))


def damped_jaro_winkler(a: str, b: str) -> float:
    """The fifth power of the similarity, damped when lengths differ."""
    if not a and not b:
        return 100.0
    shorter, longer = sorted((len(a), len(b)))
    return 100 * (jaro_winkler(a, b) / 100) ** 5 * (shorter / longer) ** 0.5


_HEAD = 4


def _word_similarity(a: str, b: str) -> float:
    if not a or not b or a[0] != b[0]:
        return 0.0
    if min(len(a), len(b)) < _HEAD:
        return 100.0 if a == b else 0.0
    if block_edits(a[:_HEAD], b[:_HEAD]) > 1:
        return 0.0
    return {0: 100.0, 1: 90.0, 2: 80.0}.get(block_edits(a, b), 0.0)


def name_similarity(a: str, b: str) -> float:
    """Similarity of two scientific names, word by word; a word that fails spoils the name."""
    if a == b:
        return 100.0
    a, b = normalized(a), normalized(b)
    left, right = a.split(" "), b.split(" ")
    if len(left) != len(right):
        return block_similarity(a, b)
    scores = [_word_similarity(x, y) for x, y in zip(left, right)]
    scores[0] = max(0.0, 2 * scores[0] - 100)
    mean = sum(scores) / len(scores)
    return min(mean, 5.0) if 0.0 in scores else mean


def longest_common_substring(a: str, b: str) -> str:
    """The first longest one in ``a``."""
    best, end, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else 0
            if row[j] > best:
                best, end = row[j], i
    return a[end - best : end]


def pair_udf(fn: Callable[[str, str], object], kind: str) -> Callable[[Column, Column], Column]:
    """A function of two strings as a Pandas UDF; null if either is null. Equal pairs of a batch are computed once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], object] = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = fn(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return run


def name_similarity_col(a: Column, b: Column) -> Column:
    return pair_udf(name_similarity, "double")(a, b)


def edits_col(edits: Column, a: Column, b: Column) -> Column:
    """``edits_to_similarity`` as an expression."""
    length = F.least(F.lit(10), F.length(a), F.length(b))
    share = F.pow(edits, F.lit(1.4)) / length
    return F.when(edits == 0, 100.0).when((edits > length) | (share > 1), 0.0).otherwise(F.floor(100 * (1 - share) + 0.5).cast("double"))


def normalize_confidence(c: Column) -> Column:
    """Raw scores up to 80 stay, better ones are squeezed into 80 to 100."""
    squeezed = F.round(F.lit(75.8) + 26 * (F.log10((c - 70) * 1.5) - 1))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(c <= 80, c).otherwise(squeezed))).cast("int")


_COMPARED = {"phylum": (10, -10, -1), "class": (15, -10, 0), "order": (15, -10, 0), "family": (25, -15, 0), "genus": (2, 1, 0)}
_CRISP = ("ANIMALIA", "PLANTAE")


def _same(a: Column, b: Column, match: int, mismatch: int, missing: int) -> Column:
    tidy = lambda c: F.nullif(F.trim(F.upper(F.regexp_replace(c, r"[^\p{L}]+", " "))), F.lit(""))
    a, b = tidy(a), tidy(b)
    return F.when(a.isNull() | b.isNull(), missing).when(a == b, match).otherwise(mismatch)


def classification_similarity(query: dict[str, Column], ref: dict[str, Column]) -> Column:
    """Agreement of two classifications, -60 to 50; kingdoms weigh most."""
    k = _same(query["kingdom"], ref["kingdom"], 5, -10, -1)
    q, r = F.upper(F.trim(query["kingdom"])), F.upper(F.trim(ref["kingdom"]))
    k = (
        F.when((k == -10) & q.isin(*_CRISP) & r.isin(*_CRISP), -51)
        .when((k == -10) & q.isin(*_CRISP) & r.isin("BACTERIA", "ARCHAEA", "VIRUSES"), -31)
        .otherwise(k)
    )
    score = k - F.when(r == "VIRUSES", 10).otherwise(0)
    for rank, points in _COMPARED.items():
        score = score + _same(query[rank], ref[rank], *points)
    return F.greatest(F.lit(-60), F.least(F.lit(50), score))
