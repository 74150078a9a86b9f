"""Text functions: columns of built-ins where Spark has them, Arrow UDFs for Unicode forms and entities."""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: What is folded, dropped or looked for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
SPACES = r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b-\u200f\u2028-\u202e\u2060\ufeff]"
ABSTRACT_LABEL = r"(?iU)^\s*(abstract|résumé|resume|summary|description)\s*[:.\-–—]?\s+"
ELLIPSIS_END = r"(?U)\s*(…|\.{3,})\s*$"
AFFILIATION = r"(?iU)\b(universit\w*|laborator\w*|facult\w*|department|d[ée]partement|institute|institut|school|college|morocco|maroc|casablanca|france|spain|usa)\b"
SENTENCE_CUES = r"(?iU)\b(we|this paper|this study|this article|propose\w*|present\w*|show\w*|results?|aims?|investigat\w*|study|studies|approach|method)\b"
DOI_PREFIX = r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)"
TITLES = ("pr", "prof", "professeur", "dr", "docteur", "mme", "mr", "m", "mlle")


@pandas_udf(StringType())
def _unescape_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", html.unescape(x)), na_action="ignore")


@pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@pandas_udf(StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, everything beyond ASCII dropped."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; it depends on the order of its arguments.  An empty side gives 0."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def _tags_out(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column) -> Column:
    """Tags to spaces, then entities decoded, in that order."""
    return _unescape(_tags_out(c))


def clean_light(c: Column) -> Column:
    """Readable text in its own case: no tags, entities, ligatures, odd spaces or controls; empty becomes null."""
    out = _unescape_nfc(_tags_out(c))
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    out = F.regexp_replace(F.regexp_replace(out, SPACES, " "), CONTROLS, "")
    return F.nullif(collapse(out), F.lit(""))


def light(x: str | None) -> str | None:
    """clean_light() of one Python text, for elements of arrays."""
    if x is None:
        return None
    x = unicodedata.normalize("NFC", html.unescape(re.sub("<[^>]+>", " ", x)))
    for ligature, letters in LIGATURES.items():
        x = x.replace(ligature, letters)
    return " ".join(re.sub(CONTROLS, "", re.sub(SPACES, " ", x)).split()) or None


@pandas_udf(ArrayType(StringType()))
def clean_light_all(s: pd.Series) -> pd.Series:
    """Each text of an array cleaned lightly; empty ones and dots that stand for more are left out."""
    return s.map(lambda xs: [y for y in map(light, xs) if y and y not in ("...", "…")], na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def light_cells(s: pd.Series) -> pd.Series:
    """Each text of an array cleaned lightly, at its place."""
    return s.map(lambda xs: [light(x) for x in xs], na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def match_keys(s: pd.Series) -> pd.Series:
    """The matching key of each text of an array, empty for none."""
    fold = lambda x: unicodedata.normalize("NFKD", html.unescape(re.sub("<[^>]+>", " ", x or ""))).encode("ascii", "ignore").decode()
    return s.map(lambda xs: [" ".join(re.findall("[a-z0-9]+", fold(x).lower())) for x in xs], na_action="ignore")


def api_abstract(c: Column) -> Column:
    """The abstract that a service gives, in its own case, without the label; null if it lists affiliations."""
    clean = clean_light(strip_html(c))
    bare = F.when(F.lower(clean).startswith("abstract"), F.nullif(F.ltrim(F.substring(clean, 9, 2**30), F.lit(" :.-–—")), F.lit(""))).otherwise(clean)
    return F.when(~looks_like_affiliation(bare), bare)


def clean_light_ascii(c: Column) -> Column:
    """clean_light() for text without entities and of composed characters, in built-ins alone."""
    return F.nullif(collapse(F.regexp_replace(F.regexp_replace(_tags_out(c), SPACES, " "), CONTROLS, "")), F.lit(""))


def is_truncated(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)(…|\.{3,})\s*$"), F.lit(False))


def clean_abstract(light: Column) -> Column:
    """From a lightly cleaned abstract: no leading label, no trailing ellipsis, lower case."""
    return F.nullif(F.lower(collapse(F.regexp_replace(F.regexp_replace(light, ABSTRACT_LABEL, ""), ELLIPSIS_END, ""))), F.lit(""))


def _alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def match_key(c: Column) -> Column:
    """Folded lower-case words and digits; null becomes empty."""
    return F.coalesce(_alnum(fold_ascii(strip_html(c))), F.lit(""))


def match_key_ascii(c: Column) -> Column:
    """match_key() in built-ins alone, for ASCII text without markup."""
    return F.coalesce(_alnum(F.regexp_replace(c, r"[^\x00-\x7F]", "")), F.lit(""))


def slug(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit("_"))


def tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda t: t != "")


def name_key(key: Column) -> Column:
    """Words of a matching key in order of the alphabet."""
    return F.array_join(F.array_sort(tokens(key)), " ")


def percent_decode(c: Column) -> Column:
    """A plus stays a plus, a bad escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normalize_doi(c: Column) -> Column:
    bare = F.rtrim(F.lower(F.regexp_replace(F.trim(percent_decode(c)), DOI_PREFIX, "")), F.lit(".,;"))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def extract_doi(c: Column) -> Column:
    return normalize_doi(F.nullif(F.regexp_extract(percent_decode(c), r"(?i)10\.\d{4,9}/[^\s\"'<>?#&]+", 0), F.lit("")))


def looks_like_affiliation(light: Column) -> Column:
    """Two places of work in a short text, or one after a number and a capital, and no sign of sentences.

    The costly patterns are only tried on texts that the cheap ones leave.
    """
    hits = F.regexp_count(light, F.lit(AFFILIATION))
    short, listed = F.length(light) < 600, light.rlike(r"^\d+\s?[A-Z]")
    places = F.when(listed, hits >= 1).otherwise(hits >= 2)
    return F.when(short | listed, places & ~light.rlike(SENTENCE_CUES)).otherwise(F.lit(False))


def embedding_text(title: Column, abstract: Column, least: int = 50) -> tuple[Column, Column]:
    """(text to embed, which parts it has)."""
    title, abstract = F.nullif(F.trim(title), F.lit("")), F.when(F.length(F.trim(abstract)) >= least, F.trim(abstract))
    joint = F.when(F.right(title, F.lit(1)).isin(*".!?:;"), " ").otherwise(". ")
    text = F.when(title.isNotNull() & abstract.isNotNull(), F.concat(title, joint, abstract)).otherwise(F.coalesce(title, abstract))
    source = F.when(title.isNotNull() & abstract.isNotNull(), "title_abstract").when(title.isNotNull(), "title_only").when(abstract.isNotNull(), "abstract_only").otherwise("none")
    return text, source


def shorten(c: Column, size: int = 300) -> Column:
    """Cut at the last space within `size` characters, with an ellipsis."""
    head = F.left(c, F.lit(size))
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…")))


def person_name(c: Column) -> Column:
    """No titles in front, each part of each word capitalised."""
    words = F.split(collapse(F.regexp_replace(clean_light(c), "[._]+", " ")), " ")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))
    first = F.coalesce(F.array_position(F.transform(words, lambda w: ~bare(w).isin(*TITLES)), True), F.lit(0))
    kept = F.when(first == 0, F.slice(words, F.size(words), 1)).otherwise(F.slice(words, first.cast("int"), F.size(words)))
    segment = lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 1000)))
    piece = lambda w: F.array_join(F.transform(F.split(w, r"(?<=[\-'’])"), segment), "")
    return F.nullif(F.array_join(F.transform(kept, piece), " "), F.lit(""))


def join_wrapped(lines: Column) -> Column:
    """One text from lines; a trailing hyphen joins a line that goes on in lower case."""
    clean = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    hyphen = lambda acc, x: acc.endswith("-") & x.rlike(r"^\p{Ll}")
    return F.aggregate(clean, F.lit(""), lambda acc, x: F.when(acc == "", x).when(hyphen(acc, x), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x)))


def contains_any(key: Column, needles: list[str]) -> Column:
    """Whether a matching key, its spaces removed, holds one of the needles."""
    packed = F.replace(key, F.lit(" "), F.lit(""))
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(packed, F.lit(needle))
    return out
