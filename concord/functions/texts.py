"""Texts that describe tables, columns and keys, and what is embedded from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import vocab


def table_text(table: Column, columns: Column, limit: int | None = None) -> Column:
    """'TABLE name: a, b, c' with all column names, or the first ``limit`` (``vocab.TABLE_TEXT_COLUMNS`` for the short form)."""
    listed = F.array_join(F.slice(columns, 1, limit) if limit else columns, ", ")
    return F.when(listed == "", F.concat(F.lit("TABLE "), table)).otherwise(
        F.concat(F.lit("TABLE "), table, F.lit(": "), listed)
    )


def table_text_full(table: Column, columns: Column, pk: Column, fks: Column, limit: int | None = None) -> Column:
    """Table text with types, the key and all foreign keys, or the first ``limit`` (``vocab.TABLE_TEXT_FKS`` for the short form).

    ``columns`` holds structs (name, type); ``fks`` structs (parent, parent_cols, ref, ref_cols).
    """
    cols = F.array_join(F.transform(columns, lambda c: F.format_string("%s (%s)", c["name"], c["type"])), ", ")
    key = F.when(F.size(pk) > 0, F.concat(F.lit(" | PK:"), F.array_join(pk, "_"))).otherwise(F.lit(""))
    refs = F.transform(
        F.slice(fks, 1, limit) if limit else fks,
        lambda f: F.format_string(
            " | FK %s(%s)->%s(%s)", f["parent"], F.array_join(f["parent_cols"], "_"),
            f["ref"], F.array_join(f["ref_cols"], "_"),
        ),
    )
    return F.concat(F.lit("TABLE "), table, F.lit(": "), cols, key, F.array_join(refs, ""))


def column_text(table: Column, column: Column, dtype: Column) -> Column:
    return F.format_string("%s.%s (%s)", table, column, dtype)


def fk_text(parent: Column, fk_cols: Column, ref: Column, pk_cols: Column) -> Column:
    """'parent(a,b) -> ref(x,y)'; callers pass canonical names."""
    return F.format_string("%s(%s) -> %s(%s)", parent, F.array_join(fk_cols, ","), ref, F.array_join(pk_cols, ","))


def domain_text(c: Column, patterns: dict[str, list[str]] = vocab.DOMAIN_PATTERNS) -> Column:
    """The text framed with one line per domain phrase that it, or a synonym in it, mentions."""
    low = F.lower(c)
    lines = []
    for phrase, synonyms in patterns.items():
        hit = low.contains(phrase)
        for s in synonyms:
            hit = hit | low.contains(s)
        lines.append(F.when(hit, F.lit(f"- {phrase}: {', '.join(synonyms)}")))
    return F.concat(
        F.lit(vocab.DOMAIN_INTRO + "\n"), c, F.lit("\n" + vocab.DOMAIN_OUTRO + "\n"), F.concat_ws("\n", *lines)
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value`` worked out once (a lambda body repeats what it takes from outside)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_vector(c: Column) -> Column:
    """The 32 bytes of sha256 as numbers, L2-normed (the rest of the 384 places is zero)."""
    def byte(digest: Column, i: Column) -> Column:
        return F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double")

    raw = bind(F.sha2(c, 256), lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(d, i)))
    with_norm = bind(raw, lambda v: F.struct(
        v.alias("v"), (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-8).alias("n")))
    return bind(with_norm, lambda r: F.transform(r["v"], lambda x: x / r["n"]))


def pad(vector: Column, width: int = 384) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))


def gram_norm(grams_of: Column) -> Column:
    """Squared length of the count vector of an array of grams: the sum of squared run lengths once sorted."""
    def step(s: Column, g: Column) -> Column:
        run = F.when(s["last"] == g, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        # (r + 1)^2 - r^2 = 2 r + 1, with run = r + 1
        return F.struct(g.alias("last"), run.alias("run"), (s["total"] + run * 2 - 1).alias("total"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(F.array_sort(grams_of), start, step, lambda s: s["total"])


def gram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the count vectors of two short gram arrays; 0 when either is empty."""
    def value(p: Column) -> Column:
        shared = F.aggregate(
            p["a"], F.lit(0).cast("long"), lambda s, x: s + F.size(F.filter(p["b"], lambda y: y == x)))
        size = F.sqrt((gram_norm(p["a"]) * gram_norm(p["b"])).cast("double"))
        return F.when(size > 0, shared / size).otherwise(F.lit(0.0))

    return bind(F.struct(a.alias("a"), b.alias("b")), value)


def grams(c: Column, n: int = 3) -> Column:
    """Character n-grams of the text with one space on either side."""
    def cut(padded: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(
            F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return bind(F.concat(F.lit(" "), c, F.lit(" ")), cut)
