"""Scientific names: folding, normalizing, parsing and assembling.

Column expressions stay in the JVM. The plain Python twins serve the Pandas UDFs and the tests.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MANY = {"ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
_ODD = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ŋ": "n", "Ŋ": "N"}


def _plain(c: str) -> str | None:
    base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return base if len(base) == 1 and base.isascii() and base != c else None


_FOLDED = {chr(i): p for i in range(0xC0, 0x250) if (p := _plain(chr(i)))} | {chr(i): p for i in range(0x1E00, 0x1F00) if (p := _plain(chr(i)))} | _ODD


def fold(text: str) -> str:
    """Latin letters with marks, and ligatures, to ASCII."""
    for a, b in _MANY.items():
        text = text.replace(a, b)
    return "".join(_FOLDED.get(c, c) for c in text)


def fold_ascii(c: Column) -> Column:
    """``fold`` as an expression."""
    for a, b in _MANY.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(_FOLDED), "".join(_FOLDED.values()))


#: (pattern, replacement): the strong rules for epithets, in order; the marked ones only when stemming.
_STRONG = (
    (r"(\p{L})\1+", "$1", False),
    (r"(?:on|um|us|a)$", "a", True),
    (r"(?<!\b)[jyi]+", "i", False),
    (r"ei$", "i", True),
    (r"(?i)([tr])h", "$1", False),
)
_HYBRID_GENUS = r"^\s*[×xX]\s*([A-Z])"
_HYBRID_EPITHET = r"(?:^|\s)(?:×\s*|[xX]\s+)([^A-Z])"


def stem_epithet(c: Column) -> Column:
    """The feminine ending of an epithet."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?:on|um|us|a)$", "a")


def _strong(c: Column, stemming: bool) -> Column:
    for pattern, to, stem_only in _STRONG:
        if stemming or not stem_only:
            c = F.regexp_replace(c, pattern, to)
    return c


def normalize_name(c: Column, stemming: bool = True, whole: bool = False) -> Column:
    """Spelling and gender variants of a name become one string. Null gives ''.

    The first word stays as it is unless ``whole``; a monomial stays as well.
    """
    s = F.trim(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, _HYBRID_GENUS, "$1"), _HYBRID_EPITHET, " $1")
    s = F.regexp_replace(F.regexp_replace(fold_ascii(s), "['_-]", ""), r"\s{2,}", " ")
    if whole:
        return F.trim(_strong(s, stemming))
    at = F.locate(" ", s)
    rest = F.substring(s, at + 1, F.lit(100_000))
    return F.trim(F.when(at > 3, F.concat_ws(" ", F.substring_index(s, " ", 1), _strong(rest, stemming))).otherwise(s))


def match_key(c: Column) -> Column:
    """The key under which names are looked up."""
    return F.lower(normalize_name(c))


def exact_key(c: Column) -> Column:
    """The key of names that have no spelling variants, such as codes spelled in letters: only case is folded."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


_PY = [(re.compile(p.replace(r"\p{L}", r"[^\W\d_]")), to.replace("$", "\\"), stem) for p, to, stem in _STRONG]


def normalized(text: str | None, stemming: bool = True, whole: bool = False) -> str:
    """``normalize_name`` for one string."""
    s = (text or "").strip()
    s = re.sub(_HYBRID_EPITHET, r" \1", re.sub(_HYBRID_GENUS, r"\1", s))
    s = re.sub(r"\s{2,}", " ", re.sub("['_-]", "", fold(s)))
    head, blank, rest = s.partition(" ")
    if whole:
        head, blank, rest = "", "", s
    elif len(head) <= 2 or not blank:
        return s.strip()
    for pattern, to, stem_only in _PY:
        if stemming or not stem_only:
            rest = pattern.sub(to, rest)
    return (head + blank + rest).strip()


# --- parsing -----------------------------------------------------------------------------------

_MARKERS = {
    "subsp": "SUBSPECIES", "ssp": "SUBSPECIES", "var": "VARIETY", "subvar": "SUBVARIETY", "f": "FORM", "fo": "FORM", "forma": "FORM", "subf": "SUBFORM", "convar": "CONVARIETY", "cv": "CULTIVAR",
    "agg": "SPECIES_AGGREGATE", "sp": "SPECIES", "spp": "SPECIES", "sect": "SECTION", "subgen": "SUBGENUS", "ser": "SERIES", "pv": "PATHOVAR", "bv": "BIOVAR",
}
_E = r"[a-zäöüßàáâãåæçèéêëìíîïñòóôõøœùúûüýÿ][a-zäöüßàáâãåæçèéêëìíîïñòóôõøœùúûüýÿ-]+"
_G = r"[A-ZÄÖÜÆŒÉ][a-zäöüßæœëéèïö-]+"
_PARTICLE = r"(?:d[eu'’]|des|della|di|la|le|van|von|vom|den|der|zu|ex|et|in|and|&|f\.|fil\.|bis)"
_AUTHORS = rf"[^\d()\[\]]*?"
_PARSER = re.compile(
    rf"^(?P<hybrid>×\s*)?(?P<genus>{_G}|[A-Z]\.)"
    rf"(?:\s*\((?P<infragenus>{_G})\))?"
    rf"(?:\s+(?P<cross>×)?\s*(?P<species>(?!(?:{_PARTICLE})\s){_E})(?![a-zA-Z.]))?"
    rf"(?:(?:\s+(?P<marker>{'|'.join(sorted(_MARKERS, key=len, reverse=True))})\.?)?\s+(?P<infra>(?!(?:{_PARTICLE})\b){_E})(?![a-zA-Z.]))?"
    rf"(?:\s*(?P<bracket>\((?P<bauthor>{_AUTHORS})(?:,?\s*(?P<byear>[12][0-9?]{{3}}))?\)))?"
    rf"(?:\s*(?P<author>(?!\d)[^()\d\[\]]+?))?(?:,?\s*[\[(]?(?P<year>[12][0-9?]{{3}})[\])]?)?\s*$"
)
_VIRUS = re.compile(r"virus|phage\b|viroid|prion|\b[A-Z]{2,5}NPV\b", re.I)
_OTU = re.compile(r"^(?:BOLD:[0-9A-Z]{7}|SH[0-9]{6,}\.[0-9]{2}FU)$", re.I)
_HYBRID = re.compile(r"\s[×xX]\s+[A-Z]")
_PLACEHOLDER = re.compile(r"incertae|unassigned|unknown|not assigned|^\[|unplaced|dummy", re.I)
_INDET = re.compile(r"\b(?:sp|spp|ssp|subsp|cf|aff|indet)\.?(?:\s*[0-9A-Z][\w-]*)?\s*$")
PARSED_FIELDS = (
    "type string, genus_or_above string, infra_generic string, specific_epithet string, infra_specific_epithet string, rank_marker string, notho boolean, "
    "authorship string, year string, bracket_authorship string, bracket_year string, canonical_name string, parsed boolean"
)


def parse(name: str | None) -> dict:
    """Atoms of one name; a string that does not fit keeps only its type and ``parsed`` false."""
    out = dict.fromkeys(f.split()[0] for f in PARSED_FIELDS.split(", "))
    out["parsed"], out["notho"] = False, False
    text = re.sub(r"\s+", " ", name or "").strip()
    if not text:
        out["type"] = "NO_NAME"
    elif _OTU.match(text):
        out.update(type="OTU", canonical_name=text.upper())
    elif _VIRUS.search(text):
        out["type"] = "VIRUS"
    elif _HYBRID.search(text):
        out["type"] = "HYBRID"
    elif _PLACEHOLDER.search(text):
        out["type"] = "PLACEHOLDER"
    else:
        indet = _INDET.search(text)
        m = _PARSER.match(text[: indet.start()].strip() if indet else text)
        if not m:
            out["type"] = "NO_NAME" if not re.match(r"^[×A-Z]", text) else "UNPARSED"
        else:
            g = m.groupdict()
            tidy = lambda x: x.strip(" ,") or None if x else None
            out.update(
                type="INFORMAL" if indet else "SCIENTIFIC", genus_or_above=g["genus"], infra_generic=g["infragenus"], specific_epithet=g["species"], infra_specific_epithet=g["infra"],
                rank_marker=_MARKERS.get(g["marker"] or ""), notho=bool(g["hybrid"] or g["cross"]), authorship=tidy(g["author"]), year=g["year"], bracket_authorship=tidy(g["bauthor"]), bracket_year=g["byear"],
                canonical_name=" ".join(x for x in (g["genus"], g["species"], g["infra"]) if x), parsed=True,
            )
    return out


def parse_name(c: Column) -> Column:
    """``parse`` as a struct column; one Arrow batch at a time."""

    @F.pandas_udf(PARSED_FIELDS)
    def run(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(n) for n in names], columns=[f.split()[0] for f in PARSED_FIELDS.split(", ")])

    return run(c)


def assemble(name: Column, generic: Column, specific: Column, infraspecific: Column, rank: Column, authorship: Column) -> tuple[Column, Column]:
    """A full name and a rank from a name or its atoms.

    The given name wins and gets the authorship if it lacks it. An abbreviated genus in it is spelled
    out. Without a name the atoms make one. The rank, if not given, follows from the atoms.
    """
    from .cleaning import blank_to_null

    name, generic, specific, infraspecific, authorship = (blank_to_null(x) for x in (name, generic, specific, infraspecific, authorship))
    initial = F.regexp_extract(name, r"^([A-Z])\.? ", 1)
    spelled = F.when((initial != "") & (F.substring(generic, 1, 1) == initial), F.concat(generic, F.lit(" "), F.regexp_replace(name, r"^[A-Z]\.? ", ""))).otherwise(name)
    atoms = F.when(generic.isNotNull(), F.concat_ws(" ", generic, specific, infraspecific))
    full = F.coalesce(spelled, atoms)
    full = F.when(authorship.isNotNull() & (F.position(authorship, full) == 0), F.concat_ws(" ", full, authorship)).otherwise(full)
    guess = F.when(generic.isNull(), F.lit(None)).when(infraspecific.isNotNull(), "INFRASPECIFIC_NAME").when(specific.isNotNull(), "SPECIES").otherwise("GENUS")
    return full, F.coalesce(rank, guess)


def format_name(generic: Column, specific: Column, infraspecific: Column, rank: Column, authorship: Column, code: Column) -> Column:
    """A name written after its code: zoological trinomials go without a rank marker, others with one."""
    marker = F.when(rank == "SUBSPECIES", "subsp.").when(rank == "VARIETY", "var.").when(rank == "FORM", "f.")
    lower = F.when(code == "ZOOLOGICAL", infraspecific).otherwise(F.concat_ws(" ", F.when(infraspecific.isNotNull(), marker), infraspecific))
    return F.concat_ws(" ", generic, specific, F.nullif(lower, F.lit("")), authorship)
