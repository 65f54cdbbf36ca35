"""Text functions: normalisation, character streams, Roman numerals, names of columns and labels."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROMAN = "^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
SURFACE_EXCEPTIONS = ("di", "vi")
STREAMS = ("full", "no_punctuation", "letters_spaces", "letters_only")
_SPACE = r"(?U)\s"


#: All characters that count as white space at the ends of a string.
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(c, F.lit(_BLANKS))


def folded_key(c: Column) -> Column:
    """Stripped and lower-cased; null where nothing is left."""
    return F.nullif(F.lower(stripped(c)), F.lit(""))


_FOLDS = {c: f for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (f := c.casefold()) != c}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_MANY = {c: f for c, f in _FOLDS.items() if len(f) > 1 and c != "ß"}
#: Letters whose folding isn't their lower case, and all beyond Latin, for which that is not asked.
_SELDOM = "[^\\x00-\u024f]|[µŉſǰ]"


def casefold(c: Column) -> Column:
    """Full Unicode case folding, character by character, all in the JVM."""
    one = F.replace(F.translate(c, "".join(_ONE), "".join(_ONE.values())), F.lit("ß"), F.lit("ss"))
    folds = F.create_map(*[F.lit(x) for pair in _MANY.items() for x in pair])
    many = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(folds, x), x)), "")
    usual = F.when(~c.rlike(_SELDOM), F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.coalesce(usual, F.when(c.rlike(f"[{''.join(_MANY)}]"), many), one))


@F.pandas_udf(T.StringType())
def _unaccented(c: pd.Series) -> pd.Series:
    return c.map(
        lambda s: "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x)), na_action="ignore"
    )


def strip_diacritics(c: Column) -> Column:
    """Decomposed, without combining marks; ASCII text stays in the JVM."""
    return F.when(c.rlike("[^\\x00-\\x7f]"), _unaccented(F.when(c.rlike("[^\\x00-\\x7f]"), c))).otherwise(c)


def unicode_form(c: Column, form: str) -> Column:
    """One of NFC, NFD, NFKC and NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown Unicode form: {form!r}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.when(c.rlike("[^\\x00-\\x7f]"), run(F.when(c.rlike("[^\\x00-\\x7f]"), c))).otherwise(c)


def normalize_text(
    c: Column,
    *,
    enabled: bool = True,
    form: str | None = None,
    fold: bool = False,
    ligatures: bool = False,
    u_for_v: bool = False,
    i_for_j: bool = False,
    unaccent: bool = False,
) -> Column:
    """The steps asked for, in this order; then brackets and quotes are set apart and blanks collapsed."""
    if not enabled:
        return c
    if form:
        c = unicode_form(c, form)
    if fold:
        c = casefold(c)
    if ligatures:
        c = F.replace(F.replace(c, F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    if u_for_v:
        c = F.translate(c, "vV", "uU")
    if i_for_j:
        c = F.translate(c, "jJ", "iI")
    if unaccent:
        c = strip_diacritics(c)
    c = F.regexp_replace(c, "([()\\[\\]{}“”‘’'\"«»])", " $1 ")
    return F.regexp_replace(c, "[ \\t]+", " ")


def roman(key: Column, exceptions: Collection[str] = (), surface: bool = False) -> Column:
    """Whether a key is a Roman numeral and none of the exceptions; surface forms have two more of those."""
    low = F.lower(stripped(key))
    but = sorted({e.strip().lower() for e in exceptions if e.strip()} | set(SURFACE_EXCEPTIONS if surface else ()))
    found = low.rlike(ROMAN)
    return found & ~low.isin(but) if but else found


def character_stream(c: Column, mode: str = "full") -> Column:
    """Lower-cased text as a stream for character n-grams."""
    low = F.lower(c)
    if mode == "full":
        return stripped(F.regexp_replace(low, f"{_SPACE}+", " "))
    if mode == "letters_only":
        return F.regexp_replace(low, "[^\\p{L}\\p{M}]", "")
    if mode not in STREAMS:
        raise ValueError(f"unknown stream: {mode!r}")
    drop = "[\\p{P}]" if mode == "no_punctuation" else "[^\\p{L}\\p{M}]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, drop, " "), _SPACE, " "), " +", " "))


# ------------------------------------------------------------------ names, on the driver


def encode_gram(gram: str) -> str:
    """A character n-gram as part of a column name."""
    plain = "abcdefghijklmnopqrstuvwxyz0123456789"
    return "".join(x if x in plain else "_sp_" if x == " " else f"_u{ord(x):06x}_" for x in gram)


_STREAM_NAMES = {"full": "char", "no_punctuation": "char_nopunct", "letters_spaces": "char_letters_spaces", "letters_only": "char_letters_only"}


def gram_column(gram: str, mode: str = "full") -> str:
    return f"{_STREAM_NAMES[mode]}{len(gram)}_{encode_gram(gram)}"


def encode_feature(part: str) -> str:
    """A morphological attribute or value as part of a column name."""
    return "".join(x if x.isascii() and x.isalnum() else f"_u{ord(x):05x}_" for x in part)


def safe_name(term: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]+", "_", term).strip("_") or "empty"


def safe_names(terms: Iterable[str], prefix: str) -> dict[str, str]:
    """Column name of each term; where names collide, the later term's letters are written as code points."""
    names: dict[str, str] = {}
    taken: set[str] = set()
    for term in terms:
        name = f"{prefix}{safe_name(term)}"
        if name in taken:
            name = f"{prefix}{encode_gram(term)}"
        taken.add(name)
        names[term] = name
    return names


def sanitize_label(label: str, default: str = "file") -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", label).strip("_").lower() or default


def unique_labels(labels: Iterable[str]) -> list[str]:
    """Sanitised labels; a repeated one gets the first free suffix from ``_2`` on."""
    out: list[str] = []
    for label in map(sanitize_label, labels):
        name, n = label, 2
        while name in out:
            name, n = f"{label}_{n}", n + 1
        out.append(name)
    return out


def encode_feats(pairs: Iterable[tuple[str, str]]) -> str:
    """``A=x|B=y``, sorted by attribute."""
    pairs = sorted((a.strip(), v.strip()) for a, v in pairs)
    if len({a for a, _ in pairs}) < len(pairs):
        raise ValueError("an attribute occurs twice")
    if any(not a or "=" in a or "|" in a or "|" in v for a, v in pairs):
        raise ValueError("an attribute or a value can't be written")
    return "|".join(f"{a}={v}" for a, v in pairs)


def decode_feats(c: Column) -> Column:
    """Map of attribute to value; empty for a null or empty string."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(
        F.str_to_map(c, F.lit("[|]"), F.lit("="))
    )
