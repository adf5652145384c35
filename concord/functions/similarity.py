"""String and vector similarity as column expressions.

The longest common subsequence is counted with one bit per character of the shorter
string, so a pair costs one step per character of the other; strings over 62 characters
on both sides take the table form of the same recurrence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 62


def _masks(s: str) -> str:
    """Map from each character of ``s`` to the bits of its positions."""
    return (
        f"map_from_entries(transform(array_distinct(split({s}, '')), mc -> struct(mc, "
        f"aggregate(transform(split({s}, ''), (mx, mi) -> if(mx = mc, shiftleft(1L, mi), 0L)), "
        f"0L, (ma, mb) -> ma | mb))))"
    )


_STEP = "(ls, lm) -> (ls + (ls & lm)) | (ls & ~lm)"
_DONE = "ls -> bit_count(~ls)"


def _lcs_bits(a: str, b: str) -> str:
    return (
        f"element_at(transform(array({_masks(a)}), lk -> aggregate(transform(split({b}, ''), "
        f"lc -> coalesce(try_element_at(lk, lc), 0L)), -1L, {_STEP}, {_DONE})), 1)"
    )


def _lcs_table(a: str, b: str) -> str:
    return (
        f"element_at(aggregate(split({a}, ''), array_repeat(0, length({b}) + 1), (lr, la) -> "
        f"aggregate(sequence(1, length({b})), array(0), (lt, lj) -> array_append(lt, "
        f"if(substr({b}, lj, 1) = la, element_at(lr, lj) + 1, "
        f"greatest(element_at(lr, lj + 1), element_at(lt, lj)))))), -1)"
    )


def lcs_sql(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 "
        f"WHEN length({a}) <= {_BITS} THEN {_lcs_bits(a, b)} "
        f"WHEN length({b}) <= {_BITS} THEN {_lcs_bits(b, a)} "
        f"ELSE {_lcs_table(a, b)} END)"
    )


def ratio_sql(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} THEN 100D "
        f"ELSE 200D * {lcs_sql(a, b)} / (length({a}) + length({b})) END)"
    )


def _best_window(s: str, t: str) -> str:
    """Best ratio of ``s`` against windows of ``t`` and its shorter prefixes and suffixes; |s| <= |t|."""
    n, m = f"length({s})", f"length({t})"
    size = f"(least(pi + {n}, {m}) - greatest(pi, 0))"
    bits = (
        f"element_at(transform(array({_masks(s)}), pk -> array_max(transform(array(transform(split({t}, ''), "
        f"pc -> coalesce(try_element_at(pk, pc), 0L))), pv -> array_max(transform(sequence(1 - {n}, {m} - 1), "
        f"pi -> 200D * aggregate(slice(pv, greatest(pi, 0) + 1, {size}), -1L, {_STEP}, {_DONE}) "
        f"/ ({n} + {size})))))), 1)"
    )
    window = f"substr({t}, greatest(pi, 0) + 1, {size})"
    table = (
        f"array_max(transform(sequence(1 - {n}, {m} - 1), "
        f"pi -> 200D * {_lcs_table(s, window)} / ({n} + {size})))"
    )
    return f"(CASE WHEN {n} <= {_BITS} THEN {bits} ELSE {table} END)"


def partial_ratio_sql(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} THEN 100D WHEN {a} = '' OR {b} = '' THEN 0D "
        f"WHEN length({a}) < length({b}) THEN {_best_window(a, b)} "
        f"WHEN length({a}) > length({b}) THEN {_best_window(b, a)} "
        f"ELSE greatest({_best_window(a, b)}, {_best_window(b, a)}) END)"
    )


def _words(s: str) -> str:
    return f"array_sort(array_distinct(filter(split({s}, ' '), sw -> sw <> '')))"


def token_set_ratio_sql(a: str, b: str) -> str:
    """Common words against common words plus either remainder."""
    wa, wb = _words(a), _words(b)
    common = f"array_intersect({wa}, {wb})"
    parts = (
        f"named_struct('i', array_join({common}, ' '), "
        f"'a', array_join(concat({common}, array_except({wa}, {wb})), ' '), "
        f"'b', array_join(concat({common}, array_except({wb}, {wa})), ' '))"
    )
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0D ELSE element_at(transform(array({parts}), tp -> "
        f"CASE WHEN tp.i <> '' AND (tp.a = tp.i OR tp.b = tp.i) THEN 100D "
        f"ELSE greatest({ratio_sql('tp.a', 'tp.b')}, "
        f"if(tp.i = '', 0D, 200D * length(tp.i) / (length(tp.i) + least(length(tp.a), length(tp.b))))) END), 1) END)"
    )


def ratio(a: str, b: str) -> Column:
    return F.expr(ratio_sql(a, b))


def partial_ratio(a: str, b: str) -> Column:
    return F.expr(partial_ratio_sql(a, b))


def token_set_ratio(a: str, b: str) -> Column:
    return F.expr(token_set_ratio_sql(a, b))


def fuzzy_sql(a: str, b: str) -> str:
    squeezed = ratio_sql(f"replace({a}, ' ', '')", f"replace({b}, ' ', '')")
    return f"greatest({token_set_ratio_sql(a, b)}, {partial_ratio_sql(a, b)}, {squeezed})"


def fuzzy(a: str, b: str) -> Column:
    """Best of the three ratios on two canonical names (given as column names)."""
    return F.expr(fuzzy_sql(a, b))


def smart_sql(a: str, b: str) -> str:
    # canonical names are lower case, so their initials at upper-case boundaries are the first letter
    ia, ib = f"upper(substr({a}, 1, 1))", f"upper(substr({b}, 1, 1))"
    return (
        f"(CASE WHEN {a} = {b} THEN 100D "
        f"WHEN (length({ia}) >= 2 AND {ia} = {b}) OR (length({ib}) >= 2 AND {ib} = {a}) THEN 95D "
        f"WHEN length({ia}) >= 2 AND {ia} = {ib} THEN 90D "
        f"ELSE {fuzzy_sql(a, b)} END)"
    )


def smart(a: str, b: str) -> Column:
    """Fuzzy score after the abbreviation steps, on two canonical names (given as column names)."""
    return F.expr(smart_sql(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Size of intersection over union of two arrays; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union.cast("double")
    ).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct entries of ``a`` that ``b`` has."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n.cast("double")).otherwise(F.lit(0.0))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(F.lower(a)), words(F.lower(b)))


def char_similarity(a: Column, b: Column) -> Column:
    """Share of positions that hold the same character, over the longer length."""
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")),
                           lambda p: p["x"] == p["y"]))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(
        (F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)
    ).otherwise(same / longest.cast("double"))


def shared_word_boost(score: Column, a: Column, b: Column, shared: tuple[str, ...], low=0.5, high=0.8) -> Column:
    """+0.1, at most 1, for an uncertain score when both names contain one of the words."""
    both = F.exists(F.array(*[F.lit(w) for w in shared]),
                    lambda w: F.lower(a).contains(w) & F.lower(b).contains(w))
    return F.when(score.between(low, high) & both, F.least(score + 0.1, F.lit(1.0))).otherwise(score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """Cosine of two dense arrays; 0 when either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clamp else value
