"""Exact pre-tokenization for the public rank files, and per-worker caches.

Libraries carry different Unicode versions. The letter, number and white-space classes are
therefore asked from the library itself, once per worker, and written into an explicit pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache


def _ranges(chars: Iterable[str]) -> str:
    """A character class body for the characters given in code-point order."""
    out, start, last = [], None, None
    for c in map(ord, chars):
        if last is not None and c == last + 1:
            last = c
            continue
        if start is not None:
            out.append((start, last))
        start = last = c
    if start is not None:
        out.append((start, last))
    esc = lambda c: f"\\u{c:04x}" if c < 0x10000 else f"\\U{c:08x}"
    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in out)


def _every_char() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _class_tiktoken(name: str) -> str:
    import tiktoken

    only = tiktoken.Encoding(f"class {name}", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return only.decode(only.encode_ordinary(_every_char()))


def _class_tokenizers(name: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(f"{name}+"), behavior="removed", invert=True)
    return "".join(part for part, _ in split.pre_tokenize_str(_every_char()))


def _pattern(letter: str, number: str, space: str) -> re.Pattern:
    either = lambda *sets: "".join(sets)
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{either(space, letter, number)}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


@lru_cache(maxsize=2)
def splitter(library: str) -> Callable[[str], list[str]]:
    """Splits a text as ``public_tokenizers.PATTERN`` does with the classes of ``library`` ('tiktoken' or 'tokenizers').

    Large character classes match slowly, so three patterns with the classes cut at U+0100 and
    U+10000 share the work; a text takes the smallest one that holds all its characters.
    """
    of = {"tiktoken": _class_tiktoken, "tokenizers": _class_tokenizers}[library]
    classes = [of(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
    latin, basic, whole = (_pattern(*(_ranges(c for c in cs if c <= top) for cs in classes)).findall for top in ("\xff", "\uffff", "\U0010ffff"))
    astral = re.compile("[\U00010000-\U0010ffff]").search

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return latin(text)
        except UnicodeEncodeError:
            return whole(text) if astral(text) else basic(text)

    return split


class TwoGenerations(dict):
    """A dict that computes missing values and forgets those not used lately; the size bound only costs time."""

    def __init__(self, compute, size: int = 300_000) -> None:
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
