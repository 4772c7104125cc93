"""Quality rules (operator 10): word statistics and zstandard compression bands.

Method. A text is compressed as a whole and in fixed chunks of ``CHUNK_BYTES``. The ratio of raw to
compressed bytes has to lie inside a band that depends on the length, because short texts hardly
compress and long ones always do. Above the band the text is repetitive, below it is close to random.
It is rejected if the whole ratio leaves its band, or if more than half of its bytes are in chunks
that leave theirs.

Defined cases: a null or empty text has no words, ratio 0 and fails the base rules; a text of any
length is read whole; equal rows give equal results; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import text_map

CHUNK_BYTES = 4096
LEVEL = 3
MIN_WORDS = 50
#: (least bytes, lowest ratio, highest ratio); texts under the first length are not judged.
BANDS = ((256, 1.05, 4.0), (512, 1.15, 5.0), (1024, 1.25, 6.0), (4096, 1.35, 7.0), (16384, 1.35, 8.0), (65536, 1.35, 10.0))

OUTPUTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, bad_chunk_share double, verdict string"
)
SYMBOLS = b"#*$%&|<>"


def band(n_bytes: int, bands=BANDS) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands:
        if n_bytes >= least:
            found = (low, high)
    return found


def outside(n_bytes: int, ratio: float, bands=BANDS) -> str:
    limits = band(n_bytes, bands)
    if limits is None:
        return ""
    return "incompressible" if ratio < limits[0] else "repetitive" if ratio > limits[1] else ""


def compression(raw: bytes, compressor, chunk_bytes: int = CHUNK_BYTES, bands=BANDS) -> tuple[float, float, str]:
    """Ratio of the whole, share of bytes in bad chunks, verdict ('' is good)."""
    if not raw:
        return 0.0, 0.0, ""
    ratio = len(raw) / len(compressor.compress(raw))
    bad = 0
    if len(raw) > chunk_bytes:
        for at in range(0, len(raw), chunk_bytes):
            chunk = raw[at : at + chunk_bytes]
            if outside(len(chunk), len(chunk) / len(compressor.compress(chunk)), bands):
                bad += len(chunk)
    verdict = outside(len(raw), ratio, bands)
    share = bad / len(raw)
    if not verdict and share > 0.5:
        verdict = "chunks"
    return ratio, share, verdict


def repeated_words(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Per text, the words covered by 3-word windows that occur twice or more in that text."""
    n = len(words)
    counts = np.zeros(len(lengths), np.int64)
    if n < 3:
        return counts
    doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    pair = pd.factorize(ids[:-1] * (ids.max() + 1) + ids[1:])[0].astype(np.int64)
    triple = pd.factorize(pair[:-1] * (ids.max() + 1) + ids[2:])[0].astype(np.int64)
    inside = doc[:-2] == doc[2:]
    at = np.flatnonzero(inside)
    again = pd.Series(triple[at] * len(lengths) + doc[at]).duplicated(keep=False).to_numpy()
    covered = np.zeros(n, bool)
    hit = at[again]
    for k in range(3):
        covered[hit + k] = True
    np.add.at(counts, doc[covered], 1)
    return counts


def judge(texts: list[str | None], chunk_bytes: int = CHUNK_BYTES, bands=BANDS, level: int = LEVEL) -> dict:
    compressor = zstandard.ZstdCompressor(level=level)
    out: dict[str, list] = {k: [] for k in ("word_chars", "n_symbols", "n_dup_lines", "ratio", "bad_chunk_share", "verdict")}
    all_words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        text = text or ""
        raw = text.encode()
        words = raw.split()
        lengths[i] = len(words)
        all_words += words
        out["word_chars"].append(len(text) - len(raw) + len(b"".join(words)))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = raw.split(b"\n")
        dups = 0
        if len(lines) > 1 and len(seen := set(lines)) < len(lines):
            empty = sum(1 for x in lines if not x.strip(b" \t\r\x0b\x0c"))
            dups = len(lines) - empty - sum(1 for x in seen if x.strip(b" \t\r\x0b\x0c"))
        out["n_dup_lines"].append(dups)
        ratio, share, verdict = compression(raw, compressor, chunk_bytes, bands)
        out["ratio"].append(ratio)
        out["bad_chunk_share"].append(share)
        out["verdict"].append(verdict)
    repeats = repeated_words(all_words, lengths)
    failed = (lengths < MIN_WORDS) | (100 * repeats > 50 * lengths)
    good = np.array([v == "" for v in out["verdict"]], bool)
    return out | {"n_words": lengths, "n_repeat_words": repeats, "base_failed": failed, "kept": good & ~failed}


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bands=BANDS, level: int = LEVEL
) -> DataFrame:
    """One row per input row: the rule columns, the compression figures, ``kept`` and the reason in ``verdict``.

    Null or empty text: zero counts, base_failed true, kept false. No shuffle.
    """
    return text_map(docs, id_col, text_col, OUTPUTS, lambda texts: judge(texts, chunk_bytes, bands, level))
