"""SQL building blocks for the side-by-side checks: named subqueries and text functions for DuckDB."""

from __future__ import annotations

from concord.functions import vocab
from concord.sources import synthetic


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def case_map(pairs: dict[str, str], x: str, default: str) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


def normalize(x: str) -> str:
    spaced = f"replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')"
    return f"trim(regexp_replace(lower(strip_accents({spaced})), '[^a-z0-9]+', ' ', 'g'))"


def canonical(x: str, aliases=vocab.NAME_ALIASES, synonyms=vocab.NAME_SYNONYMS) -> str:
    n = normalize(x)
    known = {**synonyms, **{v: v for v in synonyms.values()}, **aliases, **{v: v for v in aliases.values()}}
    return case_map(known, n, n)


def clean_table(x: str, pattern: str = "^(c|dm|tbl|bang|t|b)[ _]+") -> str:
    return f"upper(regexp_replace(regexp_replace({x}, '^\\d+\\.\\s*', ''), '{pattern}', '', 'i'))"


def lcs(a: str, b: str) -> str:
    """Common subsequence length, one bit per character of ``a`` (at most 62)."""
    bits = (
        f"list_reduce(list_transform(range(1, length({a}) + 1), lambda li: "
        f"CASE WHEN substr({a}, li, 1) = lc THEN 1::BIGINT << (li - 1)::INT ELSE 0::BIGINT END), lambda lx, ly: lx | ly)"
    )
    masks = f"list_transform(string_split({b}, ''), lambda lc: {bits})"
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE "
        f"bit_count(~list_reduce({masks}, lambda ls, lm: (ls + (ls & lm)) | (ls & ~lm), -1::BIGINT)) END)"
    )


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100::DOUBLE ELSE 200::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END)"


def partial_ratio(a: str, b: str) -> str:
    def window(s: str, t: str) -> str:
        n, m = f"length({s})", f"length({t})"
        cut = f"substr({t}, greatest(pi, 0) + 1, least(pi + {n}, {m}) - greatest(pi, 0))"
        return (
            f"list_max(list_transform(range(1 - {n}, {m}), lambda pi: "
            f"200::DOUBLE * {lcs(s, cut)} / ({n} + least(pi + {n}, {m}) - greatest(pi, 0))))"
        )

    return (
        f"(CASE WHEN {a} = {b} THEN 100::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0 "
        f"WHEN length({a}) < length({b}) THEN {window(a, b)} WHEN length({a}) > length({b}) THEN {window(b, a)} "
        f"ELSE greatest({window(a, b)}, {window(b, a)}) END)"
    )


def word_list(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda sw: sw <> '')))"


def token_parts(a: str, b: str) -> str:
    """SELECT list: common words, and either side with the common words first."""
    wa, wb = word_list(a), word_list(b)
    both = f"list_filter({wa}, lambda w: list_contains({wb}, w))"
    only_a = f"list_filter({wa}, lambda w: NOT list_contains({wb}, w))"
    only_b = f"list_filter({wb}, lambda w: NOT list_contains({wa}, w))"
    return (
        f"array_to_string({both}, ' ') AS ti, array_to_string(list_concat({both}, {only_a}), ' ') AS ta, "
        f"array_to_string(list_concat({both}, {only_b}), ' ') AS tb"
    )


def token_set(a: str, b: str) -> str:
    """Uses the columns of ``token_parts``."""
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE WHEN ti <> '' AND (ta = ti OR tb = ti) THEN 100::DOUBLE "
        f"ELSE greatest({ratio('ta', 'tb')}, CASE WHEN ti = '' THEN 0::DOUBLE "
        f"ELSE 200::DOUBLE * length(ti) / (length(ti) + least(length(ta), length(tb))) END) END)"
    )


def scored(pairs: str, a: str = "a", b: str = "b") -> str:
    """``pairs`` with the columns ratio_, squeezed_, partial_, token_ and fuzzy_."""
    sa, sb = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    return f"""
    SELECT *, greatest(token_, partial_, squeezed_) AS fuzzy_ FROM (
      SELECT *, {ratio(a, b)} AS ratio_, {ratio('sa_', 'sb_')} AS squeezed_, {partial_ratio(a, b)} AS partial_,
             {token_set(a, b)} AS token_
      FROM (SELECT *, {sa} AS sa_, {sb} AS sb_, {token_parts(a, b)} FROM ({pairs}) p0) p1) p2
    """


def grams(x: str) -> str:
    padded = f"(' ' || {normalize(x)} || ' ')"
    return f"list_transform(range(1, length({padded}) - 1), lambda gi: substr({padded}, gi, 3))"


def gram_edges(left: str, right: str, by: list[str], left_key: str, right_key: str) -> str:
    """Cosine of the gram counts of every pair with a common gram (``left``/``right`` have a ``text``)."""
    lead = "".join(f"{c}, " for c in by)
    on = " AND ".join([*[f"l.{c} = r.{c}" for c in by], "l.g = r.g"])

    def counts(source: str, key: str) -> str:
        return f"""
          SELECT {lead}{key}, g, count(*) AS n, sum(count(*) * count(*)) OVER (PARTITION BY {lead}{key}) AS nn
          FROM (SELECT {lead}{key}, unnest({grams('text')}) AS g FROM ({source}) s0) s1 GROUP BY {lead}{key}, g"""

    back = "".join(f"l.{c}, " for c in by)
    return f"""
      SELECT {back}l.{left_key}, r.{right_key}, sum(l.n * r.n)::DOUBLE / sqrt((any_value(l.nn) * any_value(r.nn))::DOUBLE) AS cosine
      FROM ({counts(left, left_key)}) l JOIN ({counts(right, right_key)}) r ON {on}
      GROUP BY {back}l.{left_key}, r.{right_key}"""


def micro(x: str) -> str:
    return f"floor({x} * 1000000 + 0.5)::BIGINT"


def greedy(edges: str, group: list[str], left: str, right: str, order: list[str], descending: bool) -> str:
    """Edges kept by the sequential walk: group, left, right."""
    way = "DESC" if descending else "ASC"
    ranked = [*order, *[c for c in (left, right) if c not in order]]
    sort = ", ".join(f"{c} {way}" for c in ranked)
    lead = ", ".join(group)
    return f"""
      SELECT {lead}, unnest(done.ls) AS {left}, unnest(done.rs) AS {right} FROM (
        SELECT {lead}, list_reduce(es,
            lambda acc, e: CASE WHEN list_contains(acc.ls, e.l) OR list_contains(acc.rs, e.r) THEN acc
              ELSE {{'l': e.l, 'r': e.r, 'ls': list_append(acc.ls, e.l), 'rs': list_append(acc.rs, e.r)}} END, es[1]) AS done
        FROM (SELECT {lead}, list({{'l': {left}, 'r': {right}, 'ls': list_filter([{left}], lambda q: false),
                'rs': list_filter([{right}], lambda q: false)}} ORDER BY {sort}) AS es
              FROM ({edges}) e0 GROUP BY {lead}) e1) e2"""


def optimal(edges: str, group: list[str], left: str, right: str, weight: str, steps: int) -> str:
    """WITH-body: table ``best`` (group, left, right) by dynamic programming over sets of right ends.

    ``steps`` is the largest number of left ends in a group.
    """
    lead = ", ".join(group)
    g = " AND ".join(f"s.{c} = e.{c}" for c in group)
    tie = f"('0x' || substr(md5(CAST({left} AS VARCHAR) || '|' || CAST({right} AS VARCHAR)), 1, 5))::INT"
    parts = [f"""
    dp_e AS (SELECT *, dense_rank() OVER (PARTITION BY {lead} ORDER BY {left}) AS li,
        dense_rank() OVER (PARTITION BY {lead} ORDER BY {right}) - 1 AS ri,
        {weight}::HUGEINT * 4294967296 + {tie} AS w FROM ({edges}) e0),
    dp_0 AS (SELECT DISTINCT {lead}, 0::BIGINT AS mask, 0::HUGEINT AS total, []::INT[] AS picks FROM dp_e)"""]
    for k in range(1, steps + 1):
        s_lead = ", ".join(f"s.{c}" for c in group)
        parts.append(f"""
    dp_{k} AS (SELECT {lead}, mask, max(total) AS total, arg_max(picks, total) AS picks FROM (
        SELECT {lead}, mask, total, picks FROM dp_{k - 1}
        UNION ALL
        SELECT {s_lead}, s.mask | (1::BIGINT << e.ri::INT), s.total + e.w, list_append(s.picks, (e.li * 100 + e.ri)::INT)
        FROM dp_{k - 1} s JOIN dp_e e ON {g} AND e.li = {k} AND (s.mask & (1::BIGINT << e.ri::INT)) = 0) u
      GROUP BY {lead}, mask)""")
    parts.append(f"""
    dp_best AS (SELECT {lead}, unnest(arg_max(picks, total)) AS pick FROM dp_{steps} GROUP BY {lead}),
    best AS (SELECT e.* FROM dp_best s JOIN dp_e e ON {g} AND e.li * 100 + e.ri = s.pick)""")
    return ",".join(parts)


# --- the synthetic catalogs -----------------------------------------------------------------

KEY = "key"


def _dropped(t: str) -> str:
    return (
        f"(({t} < 8 AND (key + {t}) % 11 = 0) OR ({t} = 8 AND key % 3 <> 0) OR ({t} = 9 AND key % 4 <> 0))"
    )


def _named(t: str, table: str) -> str:
    return (
        f"(CASE WHEN {t} < 8 AND (key + {t}) % 5 = 0 THEN (CASE WHEN key % 2 = 0 "
        f"THEN lpad((key % 97 + 1)::VARCHAR, 2, '0') || '. ' || {table} ELSE 'tbl_' || {table} END) ELSE {table} END)"
    )


def _variant(t: str, o: str) -> str:
    return f"((key * 7 + {t} * 3 + {o}) % 10)"


def _fk_rows() -> list[tuple]:
    facts = {(table, name): (t, o, n) for t, table, o, name, _, n, _ in synthetic.spec()}
    return [
        (i, p, r, *facts[p, c][:2], facts[p, c][2], *facts[r, rc][:2], facts[r, rc][2])
        for i, (p, c, r, rc) in enumerate(synthetic.FOREIGN_KEYS, 1)
    ]


def _pk_rows() -> list[tuple]:
    facts = {(table, name): (t, o, n) for t, table, o, name, _, n, _ in synthetic.spec()}
    return [
        (facts[table, c][0], table, facts[table, c][1], pos, facts[table, c][2])
        for table, cols in synthetic.PRIMARY_KEYS.items() for pos, c in enumerate(cols, 1)
    ]


_T = synthetic.TABLES
_star_counts = " UNION ALL ".join(f"SELECT {lit(t)} AS original_name, count(*) AS row_count FROM {t}" for t in _T)

TABLES: dict[str, str] = {
    "subs": "SELECT CAST(c_custkey + 10000000 AS VARCHAR) AS submission_id, c_custkey AS key FROM customer",
    "spec": values([(t, tb, o, n, d, v, s) for t, tb, o, n, d, v, s in synthetic.spec()], "t, tbl, ordinal, col, dtype, variants, swapped"),
    "raw_cols": f"""SELECT submission_id, key, t, {_named('t', 'tbl')} AS original_name, ordinal,
        variants[{_variant('t', 'ordinal')} + 1] AS column_name,
        CASE WHEN {_variant('t', 'ordinal')} = 2 THEN swapped ELSE dtype END AS data_type
        FROM subs, spec WHERE NOT {_dropped('t')} AND {_variant('t', 'ordinal')} <> 3""",
    "cols": f"""SELECT submission_id, original_name, {clean_table('original_name')} AS cleaned_name, ordinal, column_name, data_type
        FROM raw_cols WHERE NOT lower(original_name) LIKE 'sys%' AND NOT lower(original_name) LIKE '%stage%'""",
    "ans": "SELECT t, tbl AS original_name, upper(tbl) AS ans_table, ordinal AS ans_ordinal, col AS ans_col, dtype AS ans_type FROM spec WHERE t < 8",
    "pk_spec": values(_pk_rows(), "t, tbl, o, position, variants"),
    "raw_keys": f"""SELECT submission_id, 'PK_' || tbl AS pk_name,
        CASE WHEN (key + t) % 13 = 0 THEN {_named('t', 'tbl')} || '_old' WHEN (key + t) % 7 = 0 THEN ' ' || upper({_named('t', 'tbl')})
        ELSE {_named('t', 'tbl')} END AS original_name, variants[{_variant('t', 'o')} + 1] AS column_name, position
        FROM subs, pk_spec WHERE NOT {_dropped('t')} AND {_variant('t', 'o')} <> 3""",
    "ans_keys": values([(t.upper(), c) for t, cs in synthetic.PRIMARY_KEYS.items() for c in cs], "ans_table, column_name"),
    "fk_spec": values(_fk_rows(), "n, parent, ref, pt, po, pv, rt, ro, rv"),
    "raw_fks": f"""SELECT submission_id, 'FK_' || n || '.' || parent || '_' || (key % 5) AS fk_name, n,
        {_named('pt', 'parent')} AS parent_table, pv[{_variant('pt', 'po')} + 1] AS fk_column,
        {_named('rt', 'ref')} AS ref_table, rv[{_variant('rt', 'ro')} + 1] AS pk_column
        FROM subs, fk_spec WHERE NOT {_dropped('pt')} AND NOT {_dropped('rt')} AND {_variant('pt', 'po')} <> 3 AND {_variant('rt', 'ro')} <> 3""",
    "ans_fks": values([(f"FK_{n}.{p}_0", p, c, r, rc) for n, (p, c, r, rc) in enumerate(synthetic.FOREIGN_KEYS, 1)],
                      "fk_name, parent_table, fk_column, ref_table, pk_column"),
    "ans_counts": _star_counts,
    "raw_counts": f"""SELECT submission_id, {_named('t', 'tbl')} AS original_name,
        row_count + {lit(synthetic.COUNT_DELTA)}[(key * 3 + t * 7) % 10 + 1] AS row_count
        FROM subs, (SELECT DISTINCT t, tbl FROM spec WHERE t < 8) s JOIN ans_counts ON tbl = ans_counts.original_name WHERE NOT {_dropped('t')}""",
    "ans_views": f"""SELECT * FROM (VALUES
        (0, {lit(synthetic.VIEWS[0])}, 3, (SELECT count(DISTINCT o_orderstatus) FROM orders)),
        (1, {lit(synthetic.VIEWS[1])}, 4, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) q)),
        (2, {lit(synthetic.VIEWS[2])}, 2, (SELECT count(DISTINCT c_mktsegment) FROM customer))) v(i, view_name, num_columns, num_rows)""",
    "raw_views": """SELECT submission_id, CASE WHEN (key + i) % 6 = 0 THEN 'my_' || view_name ELSE view_name END AS view_name,
        num_columns + ((key + i) % 4 = 0)::INT AS num_columns,
        CASE WHEN (key + i) % 9 = 0 THEN NULL ELSE num_rows + ((key * 2 + i) % 5 = 0)::INT END AS num_rows,
        'select * from ' || view_name AS definition FROM subs, ans_views""",
}


def statement(final: str, tables: dict[str, str] | None = None) -> str:
    """``final`` preceded by the named tables it needs, directly or through others, in order."""
    import re

    known = {**TABLES, **(tables or {})}

    def uses(sql: str) -> set[str]:
        return {n for n in known if re.search(rf"\b{n}\b", sql)}

    needed, todo = set(), uses(final)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo |= uses(known[n]) - {n}
    ordered = [n for n in known if n in needed]
    if not ordered:
        return final
    head = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in ordered)
    return f"WITH {head}\n{final}"
