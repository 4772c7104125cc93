"""Personal data (operator 8): fixed base patterns plus a semi-Markov conditional random field.

Base. Email, IP, card and phone spans by fixed patterns, leftmost and non-overlapping per kind. They
are written so that no text makes them backtrack quadratically.

Method. The surroundings of digits, ``@`` and spelled-out addresses are tokenized. Every run of at
most ``MAX_TOKENS`` tokens that could be an entity is a candidate segment, and so is an unbroken run of
letters and digits of any length. Features of the whole
segment (check digits, digit groups, shape, cue words before it, neighbours) score it for each kind.
A dynamic programme over the tokens picks the best cover by segments and single outside tokens, so
that boundaries and kinds are chosen jointly. Weights maximise the conditional likelihood of
generated training lines (``training_lines``), with exact expectations by forward and backward sums.
Segments that overlap no base span are added to the base spans.

Defined cases: null counts as empty and has no spans; texts of any length are searched whole;
equal texts give equal spans; other columns are not read; an empty table gives an empty result.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import text_map

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
MAX_TOKENS = 16
#: Fields of a line on either side of a trigger that belong to its region.
CONTEXT_FIELDS = 3

OUTPUTS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]|[\[(]dot[\])]| dot ")
_FIELD = re.compile(r"[^\s]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[^\w\s]|[\w]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the semi-Markov model -------------------------------------------------------------------

_CUES = {
    "mail": "email", "email": "email", "contact": "email", "write": "email", "reach": "email",
    "call": "phone", "tel": "phone", "phone": "phone", "mobile": "phone", "fax": "phone", "cell": "phone", "dial": "phone",
    "card": "card", "visa": "card", "mastercard": "card", "payment": "card", "amex": "card", "charged": "card",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "from": "ip",
    "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "apikey": "secret", "bearer": "secret",
    "version": "number", "page": "number", "isbn": "number", "order": "number", "year": "number", "total": "number", "id": "number",
}
_SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("spelled", re.compile(r"[A-Za-z0-9._-]+ ?[\[(]?(?:at|AT|@)[\])]? ?[A-Za-z0-9-]+(?: ?(?:[\[(]dot[\])]|dot|\.) ?[A-Za-z0-9-]+)+")),
    ("quad", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    ("phone_plus", re.compile(r"\+[0-9][ ().0-9-]+[0-9]")),
    ("phone_local", re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("groups4", re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}")),
    ("date", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}")),
    ("hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}")),
    ("mixed", re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9_-]{20,}")),
)


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, str]]]:
    """For each token index j, the (i, segment) that end with token j."""
    n = len(tokens)
    digits, strong, opens, closes = [0] * (n + 1), [0] * (n + 1), [False] * n, [False] * n
    gap = -1
    first_ok = [0] * n
    for k, (a, b) in enumerate(tokens):
        c = text[a]
        number = "0" <= c <= "9"
        digits[k + 1] = digits[k] + (b - a if number else 0)
        strong[k + 1] = strong[k] + (c == "@" or (b - a <= 3 and text[a:b].lower() in ("at", "dot")))
        word = c.isalnum()
        opens[k] = word or c in "+("
        closes[k] = word
        if c.isspace() and (b - a > 1 or c != " "):
            gap = k
        first_ok[k] = gap + 1
    out: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for j in range(n):
        if not closes[j]:
            continue
        for i in range(j, max(first_ok[j], j - MAX_TOKENS + 1) - 1, -1):
            if opens[i] and (digits[j + 1] - digits[i] >= 7 or strong[j + 1] - strong[i]):
                out[j].append((i, text[tokens[i][0] : tokens[j][1]]))
    # an unbroken run of letters and digits is one field: a candidate although it may have many tokens
    start = 0
    for k in range(n):
        a, b = tokens[k]
        if not (text[a].isalnum() and text[a].isascii()):
            start = k + 1
        elif k + 1 == n or not (text[tokens[k + 1][0]].isalnum() and text[tokens[k + 1][0]].isascii()):
            if b - tokens[start][0] >= 20 and digits[k + 1] - digits[start] >= 2 and all(i != start for i, _ in out[k]):
                out[k].append((start, text[tokens[start][0] : b]))
    return out


def features(text: str, start: int, end: int, segment: str) -> list[str]:
    digits = _NOT_DIGIT.sub("", segment)
    n = len(digits)
    out = ["bias", f"digits{min(n, 20)}", f"share{4 * n // len(segment)}", f"length{min(len(segment).bit_length(), 7)}"]
    out += [name for name, shape in _SHAPES if shape.fullmatch(segment)]
    if 13 <= n <= 19 and not re.search("[A-Za-z.@+]", segment):
        out.append("luhn" if luhn(digits) else "no_luhn")
    if "quad" in out:
        out.append("octets" if all(int(x) < 256 for x in segment.split(".")) else "no_octets")
    left, right = text[start - 1 : start], text[end : end + 1]
    out.append("left_" + ("none" if not left else "word" if left.isalnum() else "join" if left in "@._%+-" else "space" if left.isspace() else "mark"))
    out.append("right_" + ("none" if not right else "word" if right.isalnum() else "join" if right in "@_-" or right == "." and text[end + 1 : end + 2].isalnum() else "space" if right.isspace() else "mark"))
    cues = [_CUES[w] for w in re.findall(r"[a-z]+", text[max(0, start - 30) : start].lower()) if w in _CUES]
    out.append("cue_" + (cues[-1] if cues else "none"))
    return out


def _lattice(text: str):
    tokens = tokens_of(text)
    ends = [[(i, features(text, tokens[i][0], tokens[j][1], seg)) for i, seg in found] for j, found in enumerate(candidates(text, tokens))]
    return tokens, ends


def _scores(ends, weights: dict[tuple[str, str], float]):
    get = weights.get
    return [[(i, f, [sum([get((k, x), 0.0) for x in f]) for k in KINDS]) for i, f in found] for found in ends]


def best_segments(text: str, weights) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the best cover; an outside token scores 0."""
    tokens, ends = _lattice(text)
    best, back = [0.0], [None]
    for j, found in enumerate(_scores(ends, weights)):
        top, choice = best[j], None
        for i, _, scores in found:
            k = max(range(len(KINDS)), key=scores.__getitem__)
            if (s := best[i] + scores[k]) > top:
                top, choice = s, (i, k)
        best.append(top)
        back.append(choice)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((tokens[i][0], KINDS[k], tokens[j - 1][1]))
            j = i
    return out[::-1]


def _logadd(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def gradient(text: str, truth: list[tuple[int, str, int]], weights, lattice=None) -> tuple[float, dict[tuple[str, str], float]]:
    """Log-likelihood of the true segments and its gradient."""
    tokens, ends = lattice or _lattice(text)
    scored = _scores(ends, weights)
    n = len(tokens)
    forward = [0.0]
    for j in range(n):
        forward.append(_logadd([forward[j]] + [forward[i] + s for i, _, scores in scored[j] for s in scores]))
    backward: list[list[float]] = [[] for _ in range(n + 1)]
    beta = [0.0] * (n + 1)
    for j in range(n - 1, -1, -1):
        beta[j + 1] = _logadd(backward[j + 1]) if backward[j + 1] else 0.0
        backward[j].append(beta[j + 1])
        for i, _, scores in scored[j]:
            backward[i] += [beta[j + 1] + s for s in scores]
    wanted = {(a, b): k for a, k, b in truth}
    total, out = -forward[n], {}
    for j in range(n):
        for i, f, scores in scored[j]:
            kind = wanted.get((tokens[i][0], tokens[j][1]))
            for k, s in zip(KINDS, scores):
                p = math.exp(forward[i] + s + beta[j + 1] - forward[n])
                if kind == k:
                    total += s
                g = (kind == k) - p
                if abs(g) > 1e-6:
                    for x in f:
                        out[k, x] = out.get((k, x), 0.0) + g
    return total, out


def training_lines(n: int = 450, seed: int = 7) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Generated lines with entities of each kind, look-alikes that are none, and the true segments."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdmkpbch") for _ in range(r.randint(2, 9)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        while luhn(d := number(r.choice([15, 16, 16, 16]))) is not good:
            pass
        return d if r.random() < 0.6 or len(d) != 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    host = lambda: word() + r.choice([".example", "", "mail"]) + "." + r.choice(["com", "org", "net", "de", "fr", "io"])
    user = lambda: word() + r.choice(["", "." + word(), number(2), "_" + word(), "." + number(2)])
    entity = {
        "email": lambda: r.choice([lambda: f"{user()}@{host()}", lambda: f"{word()} [at] {word()} [dot] {r.choice(['com', 'org'])}", lambda: f"{word()} at {word()} dot com", lambda: f"{word()}(at){host()}"])(),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(True),
        "phone": lambda: r.choice([lambda: f"+{r.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"+{number(11)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"+{r.randint(1, 99)} {number(3)} {number(3)} {number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}"])(),
        "secret": lambda: r.choice([lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(24, 48)))])(),
    }
    other = [
        lambda: f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"20{number(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: number(r.randint(1, 13)), lambda: card(False), lambda: f"1{r.randint(0, 9)}.0{r.randint(1, 9)}.19{number(2)}",
        lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"{r.randint(300, 999)}.{r.randint(256, 999)}.{number(3)}.{number(3)}", lambda: f"@{word()}", lambda: f"{number(3)},{number(3)},{number(3)}", lambda: f"{number(2)}:{number(2)}:{number(2)}.{number(4)}", lambda: f"at {word()}", lambda: f"{number(4)} {number(3)} {word()} {number(2)}",
        lambda: " ".join(number(r.randint(1, 3)) for _ in range(r.randint(4, 9))), lambda: number(r.randint(20, 40)),
    ]
    cues = {k: [w for w, c in _CUES.items() if c == k] for k in [*KINDS, "number"]}
    out = []
    for _ in range(n):
        text, truth = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 4))) + " "
            kind = r.choice([*KINDS, None, None])
            if r.random() < 0.3:
                text += r.choice(cues[kind or "number"]) + r.choice([" ", ": ", " = ", ' = "'])
            elif r.random() < 0.1:
                text += r.choice(cues[r.choice(list(cues))]) + " "
            made = entity[kind]() if kind else r.choice(other)()
            if kind:
                truth.append((len(text), kind, len(text) + len(made)))
            text += made + r.choice(["", ".", ",", '"', "!!", ")"]) + " " + word() + " "
        out.append((text.rstrip(), truth))
    return out


@lru_cache(maxsize=1)
def trained(epochs: int = 10, rate: float = 0.5, decay: float = 1e-4) -> dict[tuple[str, str], float]:
    """Weights by AdaGrad over the generated lines; a few seconds on the driver, of fixed size."""
    lines = [(text, truth, _lattice(text)) for text, truth in training_lines()]
    weights: dict[tuple[str, str], float] = {}
    seen: dict[tuple[str, str], float] = {}
    order = random.Random(1)
    for _ in range(epochs):
        order.shuffle(lines)
        for text, truth, lattice in lines:
            for key, g in gradient(text, truth, weights, lattice)[1].items():
                g -= decay * weights.get(key, 0.0)
                seen[key] = seen.get(key, 1e-6) + g * g
                weights[key] = weights.get(key, 0.0) + rate * g / math.sqrt(seen[key])
    return weights


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of single lines around triggers, merged where they touch."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if out and at < out[-1][1]:
            continue
        low, high = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        high = len(text) if high < 0 else high
        start, end = at, m.end()
        for _ in range(CONTEXT_FIELDS + 1):
            start = max(low, text.rfind(" ", low, max(low, start - 1)) + 1) if start > low else low
        for _ in range(CONTEXT_FIELDS + 1):
            found = text.find(" ", end + 1, high)
            end = high if found < 0 or end >= high else found
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def find_spans(text: str | None, weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the model adds, each as (start, kind number, end)."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    added, at = [], 0
    for low, high in regions(text):
        piece = text[low:high]
        for a, kind, b in best_segments(piece, weights):
            a, b = a + low, b + low
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if not any(x < b and a < y for x, y in taken[max(0, at - 4) : at + 4]):
                added.append((a, KINDS.index(kind), b))
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)])


def summarize(texts: list[str | None], weights) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added")}
    for text in texts:
        base, added = find_spans(text, weights)
        for i, k in enumerate(BASE_KINDS):
            out[f"n_{k}"].append(sum(1 for x in base if x[1] == i))
        out["base_sha256"].append(sha256(written(base).encode()).hexdigest())
        out["spans"].append(written(base + added))
        out["n_spans"].append(len(base) + len(added))
        out["n_added"].append(len(added))
    return out


def redact(text: str | None, weights) -> str | None:
    """The text with each maximal run of overlapping spans replaced by the name of its first kind."""
    if text is None:
        return None
    base, added = find_spans(text, weights)
    out, last = [], 0
    for a, k, b in sorted(base + added):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base counts, digest of the base spans, all spans as ``kind:start:end``, how many there are, and how
    many of them the model added. No shuffle.

    Null or empty text: zero counts, the digest of the empty string, empty ``spans``.
    """
    weights = trained()
    return text_map(docs, id_col, text_col, OUTPUTS, lambda texts: summarize(texts, weights))


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``redacted``, the text with all spans replaced by their kind; null stays null. No shuffle."""
    weights = trained()
    return text_map(docs, id_col, text_col, "redacted string", lambda texts: {"redacted": [redact(t, weights) for t in texts]}, carry)
