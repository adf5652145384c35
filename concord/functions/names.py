"""Name cleaning and normalisation as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import vocab
from concord.session import sql_literal


def _accent_table() -> tuple[str, str]:
    """Every BMP character that decomposes to one ASCII character plus marks, and that character."""
    accented, plain = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        base = "".join(
            ch for ch in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(ch) != "Mn"
        )
        if len(base) == 1 and base.isascii():
            accented.append(chr(cp))
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(sql_literal(x) for kv in pairs.items() for x in kv) + ")")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The entry for ``key``, NULL when there is none."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(pairs), key)


def normalize(c: Column | str) -> Column:
    """Split camelCase, fold accents, lower-case, keep [a-z0-9] words joined by one space."""
    x = F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2")
    x = F.translate(x, _ACCENTED, _PLAIN)
    x = F.lower(F.regexp_replace(x, r"\p{Mn}", ""))
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def _closed(pairs: dict[str, str]) -> dict[str, str]:
    return {**pairs, **{v: v for v in pairs.values()}}


def canonical(
    c: Column | str,
    aliases: dict[str, str] = vocab.NAME_ALIASES,
    synonyms: dict[str, str] = vocab.NAME_SYNONYMS,
) -> Column:
    """Normalised name after whole-name alias, else whole-name synonym."""
    n = normalize(c)
    return F.coalesce(lookup(_closed(aliases), n), lookup(_closed(synonyms), n), n)


def canonical_tokens(c: Column | str, abbreviations: dict[str, str], synonyms: dict[str, str]) -> Column:
    """Abbreviations per word, then a whole-phrase synonym, then synonyms per word."""
    def swapped(text: Column, pairs: dict[str, str]) -> Column:
        words = F.transform(F.split(text, " "), lambda w: F.coalesce(lookup(pairs, w), w))
        return F.array_join(words, " ")

    phrase = swapped(normalize(c), abbreviations)
    phrase = F.coalesce(lookup(synonyms, phrase), phrase)
    return normalize(swapped(normalize(phrase), synonyms))


def squeeze(c: Column | str) -> Column:
    """Without spaces."""
    return F.replace(_col(c), F.lit(" "), F.lit(""))


def simple_canonical(c: Column | str) -> Column:
    """Lower-cased, trimmed, underscores to spaces."""
    return F.replace(F.trim(F.lower(_col(c))), F.lit("_"), F.lit(" "))


def acronym(c: Column | str) -> Column:
    """Initials at upper-case boundaries: NhaCungCap -> NCC."""
    parts = F.filter(F.split(_col(c), r"(?=\p{Lu})"), lambda p: p != "")
    return F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def strip_numbering(c: Column | str) -> Column:
    """Without a leading '08.' style number."""
    return F.regexp_replace(_col(c), r"^\d+\.\s*", "")


# A separator after the prefix is required unless ``compat``, which also strips the bare letter.
_PREFIX = "^(c|dm|tbl|bang|t|b)[ _]+"
_PREFIX_COMPAT = "^(c|dm|tbl|bang|t|b)[ _]*"


def clean_table(c: Column | str, compat: bool = False) -> Column:
    """Upper-cased table name without numbering and without one known prefix."""
    pattern = "(?i)" + (_PREFIX_COMPAT if compat else _PREFIX)
    return F.upper(F.regexp_replace(strip_numbering(c), pattern, ""))


def clean_table_plain(c: Column | str) -> Column:
    """Upper-cased table name without numbering."""
    return F.upper(strip_numbering(c))


def is_system(c: Column | str) -> Column:
    return F.lower(_col(c)).startswith("sys")


def is_stage(c: Column | str, prefix_only: bool = False) -> Column:
    low = F.lower(_col(c))
    return low.startswith("stage") if prefix_only else low.contains("stage")


def alias(c: Column | str, aliases: dict[str, str]) -> Column:
    """Replacement for a name found, in lower case, among the aliases."""
    return F.coalesce(lookup(aliases, F.lower(_col(c))), _col(c))


def clean_fk_table(c: Column | str) -> Column:
    return F.regexp_replace(strip_numbering(c), r"_\d+$", "")


def clean_fk_column(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"_\d+$", "")


def clean_constraint(c: Column | str) -> Column:
    return F.replace(F.regexp_replace(_col(c), r"_\d+", ""), F.lit("."), F.lit("_"))


def file_stem(path: Column | str) -> Column:
    """Last path part without its extension."""
    return F.regexp_extract(_col(path), r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def submission_id(path: Column | str, answer_stems: tuple[str, ...] = ("dapan",)) -> Column:
    """Eight digits in the file name, else its stem; the answer file gets the answer id."""
    stem = file_stem(path)
    digits = F.regexp_extract(stem, r"(\d{8})", 1)
    own = F.when(digits != "", digits).otherwise(stem)
    return F.when(F.lower(stem).isin(*answer_stems), F.lit(vocab.ANSWER_ID)).otherwise(own)
