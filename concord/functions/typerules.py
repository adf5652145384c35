"""Data type compatibility as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import vocab
from concord.functions.names import lookup

# decimal(12,2) counts as decimal, varchar(20) as varchar.
_BASE = r"\(.*$"


def base_type(t: Column | str) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.trim(F.regexp_replace(F.lower(t), _BASE, ""))


def family(t: Column | str) -> Column:
    b = base_type(t)
    return F.coalesce(lookup(vocab.TYPE_FAMILY, b), b)


def is_code_column(name: Column | str, words: tuple[str, ...] = vocab.CODE_WORDS) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    any_word = "|".join(words)
    return F.lower(name).rlike(f"^({any_word})|({any_word})$")


def same_type(
    type_a: Column | str, type_b: Column | str, name_a: Column | str, name_b: Column | str, mode: str = "either"
) -> Column:
    """Equal families; code columns take strings and integers alike.

    ``mode`` says whether one code name is enough ('either') or both are needed ('both').
    """
    code_a, code_b = is_code_column(name_a), is_code_column(name_b)
    code = (code_a | code_b) if mode == "either" else (code_a & code_b)
    fam_a, fam_b = family(type_a), family(type_b)
    return F.when(code, fam_a.isin("str", "int") & fam_b.isin("str", "int")).otherwise(fam_a == fam_b)


def loose_type(type_a: Column | str, type_b: Column | str) -> Column:
    """Equal, or both strings, both numbers of any kind, or both dates."""
    def wide(t):
        fam = family(t)
        return F.when(fam == "int", F.lit("num")).otherwise(fam)

    return wide(type_a) == wide(type_b)


def exact_type(type_a: Column | str, type_b: Column | str) -> Column:
    a = F.col(type_a) if isinstance(type_a, str) else type_a
    b = F.col(type_b) if isinstance(type_b, str) else type_b
    return F.lower(a) == F.lower(b)
