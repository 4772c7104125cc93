"""Cleaning and assembling of single values, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARKERS = (r"\N", r"\NULL", "NULL", "null")
#: Delimiters that a multi-value field may use; the first that really splits is taken.
DELIMITERS = ("[", "|", ";", ",", " ", "]")
_MEDIA = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp",
    "mp3": "audio/mpeg", "wav": "audio/x-wav", "ogg": "audio/ogg", "mp4": "video/mp4", "mpeg": "video/mpeg", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain", "xml": "application/xml",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean(c: Column) -> Column:
    """Null markers and blank strings become null; control characters and runs of white space one blank."""
    tidy = F.trim(F.regexp_replace(c, r"[\x00-\x20\x7F\u0080-   ]+", " "))
    return F.when(tidy.isin(*NULL_MARKERS) | (tidy == ""), F.lit(None)).otherwise(tidy)


def nfc(c: Column) -> Column:
    """Canonical composition; the only cleaning step that the JVM functions lack."""
    import unicodedata

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return compose(c)


def tab_field(c: Column) -> Column:
    r"""A field of a tab row: empty and ``\N`` are null."""
    return F.when((c == "") | (c == r"\N"), F.lit(None)).otherwise(c)


def canonical_or_name(canonical: Column, name: Column) -> Column:
    return F.coalesce(blank_to_null(canonical), name)


def default_status(status: Column, is_synonym: Column) -> Column:
    return F.coalesce(status, F.when(is_synonym, F.lit("SYNONYM")).otherwise(F.lit("ACCEPTED")))


def full_authorship(author: Column, year: Column, original_author: Column, original_year: Column) -> Column:
    """``Author, year (Original, year)``; parts that are null vanish with their punctuation."""
    inner = F.concat_ws(", ", original_author, original_year)
    return F.concat(
        F.coalesce(author, F.lit("")),
        F.when(year.isNotNull(), F.concat(F.lit(", "), year)).otherwise(F.lit("")),
        F.when(original_author.isNotNull() | original_year.isNotNull(), F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(F.lit("")),
    )


def strip_html(c: Column) -> Column:
    """Tags become blanks, then white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def tagged_name(language: Column, name: Column, separator: str = "_@_") -> Column:
    return F.concat(F.coalesce(language, F.lit("")), F.lit(separator), name)


def mime_type(url: Column, given: Column | None = None) -> Column:
    """The given type if it looks like one, else the type by the file's ending."""
    from .ranks import lookup

    ending = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1))
    guessed = lookup(ending, _MEDIA)
    return guessed if given is None else F.coalesce(F.when(F.lower(given).rlike("^[a-z]+/[a-z0-9.+-]+$"), F.lower(given)), guessed)


def media_type(mime: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "STILL_IMAGE").when(mime.startswith("audio/"), "SOUND").when(mime.startswith("video/"), "MOVING_IMAGE")
    )


def page_as_reference(mime: Column, identifier: Column, references: Column) -> tuple[Column, Column]:
    """A medium whose identifier is a web page: the page moves to references and the identifier goes."""
    page = mime == "text/html"
    return F.when(page, F.lit(None)).otherwise(identifier), F.when(page, F.coalesce(references, identifier)).otherwise(references)


def split_values(c: Column) -> Column:
    """Values of a field by the first delimiter that yields more than one; blanks are dropped."""
    out = F.array(F.trim(c))
    for d in reversed(DELIMITERS):
        parts = F.filter(F.transform(F.split(c, "\\" + d), lambda x: F.trim(x)), lambda x: x != "")
        out = F.when(F.size(parts) > 1, parts).otherwise(out)
    return F.when(blank_to_null(c).isNull(), F.array().cast("array<string>")).otherwise(out)


def citation(author: Column, title: Column, year: Column, source: Column) -> Column:
    """``Author (year): title. source`` of the parts that are there."""
    dated = F.concat_ws(" ", blank_to_null(author), F.when(blank_to_null(year).isNotNull(), F.concat(F.lit("("), F.trim(year), F.lit(")"))))
    head = F.concat_ws(": ", blank_to_null(dated), blank_to_null(title))
    return blank_to_null(F.concat_ws(". ", blank_to_null(head), blank_to_null(source)))


def expand_genus(abbreviated: Column, name: Column) -> Column:
    """``A. alba`` beside ``Abies ...`` becomes ``Abies alba``; other names stay."""
    initial = F.regexp_extract(abbreviated, r"^([A-Z])\. ", 1)
    genus = F.split(name, " ")[0]
    return F.when((initial != "") & (F.substring(genus, 1, 1) == initial), F.concat(genus, F.substring(abbreviated, 3, 10_000))).otherwise(abbreviated)


def first_parsable(table: dict[str, str], *columns: Column) -> tuple[Column, Column]:
    """The first column whose folded value is in the table, and whether some value was there but none parsed."""
    from .ranks import lookup

    parsed = F.coalesce(*[lookup(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), table) for c in columns])
    given = F.coalesce(*[blank_to_null(c) for c in columns]).isNotNull()
    return parsed, given & parsed.isNull()


def edge_ngrams(c: Column, longest: int = 30) -> Column:
    """All prefixes of up to ``longest`` characters of each word, in lower case."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(w))), lambda n: F.substring(w, F.lit(1), n))))


def percentage(count: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing is 0."""
    return F.when(total > 0, F.floor(count * 100 / total)).otherwise(F.lit(0)).cast("long")


def verbatim_field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")
