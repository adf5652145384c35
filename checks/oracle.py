"""For each query the same result in plain SQL, run by DuckDB on the same Parquet tables."""

from __future__ import annotations

from checks import sqlkit as K
from concord.functions import vocab
from concord.plans import registry as R
from concord.sources import synthetic

SQL: dict[str, str] = {}


def lit(v) -> str:
    return K.lit(v)


def add(name: str, final: str) -> None:
    SQL[name] = K.statement(final, EXTRA)


def family(t: str) -> str:
    base = f"trim(regexp_replace(lower({t}), '\\(.*$', ''))"
    return K.case_map(vocab.TYPE_FAMILY, base, base)


def loose(a: str, b: str) -> str:
    def wide(t):
        return f"replace({family(t)}, 'int', 'num')"

    return f"({wide(a)} = {wide(b)})"


def is_code(x: str, words=vocab.CODE_WORDS) -> str:
    return f"regexp_matches(lower({x}), '^({'|'.join(words)})|({'|'.join(words)})$')"


def same_type(ta: str, tb: str, a: str, b: str, mode: str = "either") -> str:
    word = "OR" if mode == "either" else "AND"
    return (
        f"(CASE WHEN {is_code(a)} {word} {is_code(b)} THEN {family(ta)} IN ('str', 'int') AND {family(tb)} IN ('str', 'int') "
        f"ELSE {family(ta)} = {family(tb)} END)"
    )


def hit(a: str, ca: str, b: str, cb: str) -> str:
    return f"({ca} = {cb} OR replace({ca}, ' ', '') = replace({cb}, ' ', '') OR lower({a}) = lower({b}))"


_plain = lambda x: f"replace(trim(lower({x})), '_', ' ')"
def jaccard(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / "
        f"len(list_distinct(list_concat({a}, {b}))) ELSE 0 END)"
    )


def split_words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def char_sim(a: str, b: str) -> str:
    same = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)))"
    return (
        f"(CASE WHEN {a} = {b} THEN 1::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
        f"ELSE {same}::DOUBLE / greatest(length({a}), length({b})) END)"
    )


def alias(x: str, pairs: dict[str, str]) -> str:
    return K.case_map(pairs, f"lower({x})", x)


PAIR = ["ans_table", "stu_table", "cid"]
ends = "ans_table, stu_table, cid"
FIRST_COLS = "list(column_name ORDER BY ordinal, column_name)"
COLTEXT = "cleaned_name || '.' || column_name || ' (' || data_type || ')'"

EXTRA: dict[str, str] = {
    # pairs of names met in tables of the same cleaned name
    "met": """SELECT DISTINCT ans_col AS ans_name, ans_type, column_name AS stu_name, data_type AS stu_type
        FROM (SELECT DISTINCT cleaned_name, column_name, data_type FROM cols) c JOIN ans ON ans_table = cleaned_name""",
    "canon_met": f"SELECT DISTINCT {K.canonical('ans_name')} AS a, {K.canonical('stu_name')} AS b FROM met",
    "canon_scored": K.scored("SELECT a, b FROM canon_met"),
    # every distinct name once, in canonical form
    "ans_names": f"SELECT DISTINCT ans_col AS ans_name, {K.canonical('ans_col')} AS ac FROM ans",
    "stu_names": f"SELECT column_name AS stu_name, {K.canonical('column_name')} AS sc FROM (SELECT DISTINCT column_name FROM cols) q",
    "canon_all": K.scored("SELECT DISTINCT ac AS a, sc AS b FROM ans_names, stu_names"),
    "hits": f"""SELECT ans_name, stu_name FROM ans_names, stu_names JOIN canon_all ON a = ac AND b = sc
        WHERE {hit('ans_name', 'ac', 'stu_name', 'sc')} OR fuzzy_ >= 70""",
    # tables with equal content share a cid
    "tabs": f"""SELECT submission_id, cleaned_name, min(original_name) AS original_name,
        string_agg(ordinal || ':' || column_name || ':' || data_type, ',' ORDER BY ordinal) AS cid,
        'TABLE ' || cleaned_name || ': ' || array_to_string({FIRST_COLS}, ', ') AS text
        FROM cols GROUP BY submission_id, cleaned_name""",
    "content": "SELECT DISTINCT cid, ordinal, column_name, data_type FROM cols JOIN tabs USING (submission_id, cleaned_name)",
    "ans_texts": """SELECT ans_table, 'TABLE ' || ans_table || ': ' || array_to_string(list(ans_col ORDER BY ans_ordinal), ', ') AS text
        FROM ans GROUP BY ans_table""",
    "stu_texts": "SELECT DISTINCT text, text AS stu_text FROM tabs",
    "text_cos": K.gram_edges("SELECT * FROM ans_texts", "SELECT * FROM stu_texts", [], "ans_table", "stu_text"),
    "fit_edges": f"""SELECT cid, ans_table, ans_ordinal, c.ordinal AS stu_ordinal
        FROM content c JOIN hits ON column_name = stu_name JOIN ans ON ans_col = ans_name WHERE {loose('ans_type', 'data_type')}""",
    "fit": K.greedy("SELECT * FROM fit_edges", ["cid", "ans_table"], "ans_ordinal", "stu_ordinal", ["ans_ordinal"], False),
    "fit_n": "SELECT cid, ans_table, count(*) AS n_cols FROM fit GROUP BY cid, ans_table",
    "tab_edges": """SELECT submission_id, n.ans_table, cleaned_name AS stu_table, original_name, cid, n_cols, cosine
        FROM tabs JOIN fit_n n USING (cid) JOIN text_cos x ON x.ans_table = n.ans_table AND x.stu_text = tabs.text""",
}


def _map_tables(edges: str, weight: str) -> str:
    return f"""WITH {K.optimal(f"SELECT *, {weight} AS weight FROM ({edges}) w0", ["submission_id"], "ans_table", "stu_table", "weight", 8)}
        SELECT * FROM best"""


EXTRA["tab_best"] = _map_tables("SELECT * FROM tab_edges", f"(1000000 + n_cols * 1000) * 1000000 + {K.micro('cosine')}")
EXTRA["plain_hits"] = f"""SELECT ans_name, stu_name FROM ans_names, stu_names
    WHERE replace({_plain('ans_name')}, ' ', '') = replace({_plain('stu_name')}, ' ', '') OR lower(ans_name) = lower(stu_name)
      OR {jaccard(split_words('lower(ans_name)'), split_words('lower(stu_name)'))} * 100 >= 70"""
EXTRA["plain_fit"] = K.greedy(f"""SELECT cid, ans_table, ans_ordinal, c.ordinal AS stu_ordinal
    FROM content c JOIN plain_hits ON column_name = stu_name JOIN ans ON ans_col = ans_name WHERE {loose('ans_type', 'data_type')}""",
    ["cid", "ans_table"], "ans_ordinal", "stu_ordinal", ["ans_ordinal"], False)
EXTRA["plain_sim"] = f"""SELECT submission_id, ans_table, stu_table, ns, cs, (ns + cs) / 2 AS similarity FROM (
      SELECT submission_id, ans_table, cleaned_name AS stu_table, CASE WHEN ans_table = cleaned_name THEN 1::DOUBLE
        ELSE {jaccard('aw', 'bw')} END AS ns, {jaccard('ac', 'bc')} AS cs FROM
      (SELECT ans_table, list(DISTINCT {_plain('ans_col')}) AS ac, {split_words(_plain('ans_table'))} AS aw FROM ans GROUP BY ans_table) a,
      (SELECT submission_id, cleaned_name, list(DISTINCT {_plain('column_name')}) AS bc, {split_words(_plain('cleaned_name'))} AS bw
       FROM cols GROUP BY submission_id, cleaned_name) b) q WHERE ns > 0 OR cs > 0"""
EXTRA["plain_edges"] = """SELECT submission_id, n.ans_table, cleaned_name AS stu_table, n_cols, coalesce(similarity, 0) AS cosine FROM tabs
    JOIN (SELECT cid, ans_table, count(*) AS n_cols FROM plain_fit GROUP BY 1, 2) n USING (cid)
    LEFT JOIN (SELECT submission_id, ans_table, stu_table AS cleaned_name, similarity FROM plain_sim) p USING (submission_id, ans_table, cleaned_name)"""
EXTRA["plain_best"] = _map_tables("SELECT * FROM plain_edges", f"(1000000 + n_cols * 1000) * 1000000 + {K.micro('cosine')}")
EXTRA["every_tab"] = "SELECT submission_id, ans_table FROM subs, (SELECT DISTINCT ans_table FROM ans) a"
EXTRA["tab_map"] = """SELECT submission_id, ans_table, stu_table, original_name, cid, n_cols, cosine
    FROM every_tab LEFT JOIN (SELECT * FROM tab_best WHERE cosine >= 0.5) b USING (submission_id, ans_table)"""
EXTRA["wanted"] = f"SELECT DISTINCT {ends} FROM tab_map WHERE stu_table IS NOT NULL"
EXTRA["l_side"] = f"SELECT {ends}, ans_ordinal, ans_col, ans_type, {K.canonical('ans_col')} AS ac FROM wanted JOIN ans USING (ans_table)"
EXTRA["r_side"] = f"""SELECT {ends}, ordinal AS stu_ordinal, column_name AS stu_col, data_type AS stu_type,
    {K.canonical('column_name')} AS sc FROM wanted JOIN content USING (cid)"""


def _column_pairs(method: str) -> str:
    """Column matches of every mapped table by one of the three methods."""
    both = f"SELECT * FROM l_side JOIN r_side USING ({ends})"
    exact_on = hit("ans_col", "ac", "stu_col", "sc") if method == "two_phase" else "ac = sc"
    if method == "plain":
        exact_on = hit("ans_col", _plain("ans_col"), "stu_col", _plain("stu_col"))
    mode = "either" if method == "two_phase" else "both"
    ok = same_type("ans_type", "stu_type", "ans_col", "stu_col", mode)
    if method == "plain":
        ok = loose("ans_type", "stu_type")
    left_text = "ans_table || '.' || ans_col || ' (' || ans_type || ')'"
    right_text = "stu_table || '.' || stu_col || ' (' || stu_type || ')'"
    exact = K.greedy(f"SELECT {ends}, ans_ordinal, stu_ordinal FROM ({both}) b WHERE {exact_on}", PAIR, "ans_ordinal", "stu_ordinal", ["ans_ordinal"], False)
    if method == "text":
        exact = f"SELECT {ends}, ans_ordinal, stu_ordinal FROM ({both}) b WHERE false"
    if method == "two_phase":
        cos = K.gram_edges("SELECT DISTINCT ac AS a, ac AS text FROM rest_l", "SELECT DISTINCT sc AS b, sc AS text FROM rest_r", [], "a", "b")
        edges = f"SELECT {ends}, ans_ordinal, stu_ordinal, cosine AS score0 FROM rest_l JOIN rest_r USING ({ends}) JOIN cos ON a = ac AND b = sc"
        extra = f"""typed AS ({K.gram_edges(
            "SELECT DISTINCT p, 1 AS x, ans_col || ' ' || ans_type AS text FROM joined",
            "SELECT DISTINCT p, 2 AS y, stu_col || ' ' || stu_type AS text FROM joined", ["p"], "x", "y")}),"""
        score = "CASE WHEN score0 BETWEEN 0.5 AND 0.8 THEN greatest(score0, coalesce(typed.cosine, 0)) ELSE score0 END"
        join_typed, cutoff = "LEFT JOIN typed USING (p)", "0.75"
    elif method == "plain":
        cos = "SELECT 1 AS unused"
        value = f"greatest({jaccard(split_words(_plain('ans_col')), split_words(_plain('stu_col')))}, {char_sim('lower(ans_col)', 'lower(stu_col)')})"
        edges = f"SELECT {ends}, ans_ordinal, stu_ordinal, {value} AS score0 FROM rest_l JOIN rest_r USING ({ends})"
        shared = " OR ".join(f"(contains(lower(ans_col), '{w}') AND contains(lower(stu_col), '{w}'))" for w in vocab.SHARED_WORDS)
        extra, join_typed, cutoff = "", "", "0.75"
        score = f"CASE WHEN score0 BETWEEN 0.5 AND 0.8 AND ({shared}) THEN least(score0 + 0.1::DOUBLE, 1) ELSE score0 END"
    else:
        cos = K.gram_edges(f"SELECT {ends}, ans_ordinal, {left_text} AS text FROM rest_l", f"SELECT {ends}, stu_ordinal, {right_text} AS text FROM rest_r", PAIR, "ans_ordinal", "stu_ordinal")
        if method == "text":
            edges = f"SELECT {ends}, ans_ordinal, stu_ordinal, cosine AS score0 FROM cos"
        else:
            tok = K.scored("SELECT DISTINCT ac AS a, sc AS b FROM rest_l JOIN rest_r USING (" + ends + ")")
            edges = f"""SELECT {ends}, ans_ordinal, stu_ordinal,
                coalesce(cosine, 0) * 0.7::DOUBLE + (token_ / 100) * 0.3::DOUBLE AS score0
                FROM rest_l JOIN rest_r USING ({ends}) JOIN ({tok}) t ON t.a = ac AND t.b = sc
                LEFT JOIN cos USING ({ends}, ans_ordinal, stu_ordinal)"""
        extra, score, join_typed, cutoff = "", "score0", "", "0.82"
    best = K.optimal(f"SELECT *, {K.micro('score0')} AS weight FROM ({edges}) z WHERE {K.micro('score0')} > 0", PAIR, "ans_ordinal", "stu_ordinal", "weight", 11)
    solved = f"""
      WITH exact AS MATERIALIZED ({exact}),
      rest_l AS MATERIALIZED (SELECT * FROM l_side ANTI JOIN exact USING ({ends}, ans_ordinal)),
      rest_r AS MATERIALIZED (SELECT * FROM r_side ANTI JOIN exact USING ({ends}, stu_ordinal)),
      cos AS MATERIALIZED ({cos}),
      {best},
      joined AS MATERIALIZED (SELECT {ends}, ans_ordinal, stu_ordinal, score0, ans_col, ans_type, stu_col, stu_type,
          row_number() OVER () AS p
          FROM best JOIN l_side USING ({ends}, ans_ordinal) JOIN r_side USING ({ends}, stu_ordinal)),
      {extra}
      matched AS (
        SELECT {ends}, ans_ordinal, stu_col, stu_type, 1::DOUBLE AS score, {ok} AS match
        FROM exact JOIN l_side USING ({ends}, ans_ordinal) JOIN r_side USING ({ends}, stu_ordinal)
        UNION ALL
        SELECT {ends}, ans_ordinal, stu_col, stu_type, score, score >= {cutoff} AND {ok} FROM (
          SELECT joined.*, {score} AS score FROM joined {join_typed}) j)
      SELECT {ends}, ans_ordinal, ans_col, ans_type, stu_col, stu_type, coalesce(score, 0) AS score, coalesce(match, false) AS match
      FROM l_side LEFT JOIN matched USING ({ends}, ans_ordinal)"""
    return f"""
      SELECT submission_id, ans_table, ans_col, ans_type, stu_table, stu_col, stu_type, score, match
      FROM tab_map JOIN ({solved}) s USING ({ends})
      UNION ALL
      SELECT submission_id, ans_table, ans_col, ans_type, NULL, NULL, NULL, 0::DOUBLE, false
      FROM tab_map JOIN ans USING (ans_table) WHERE stu_table IS NULL"""


EXTRA["col_pairs"] = _column_pairs("two_phase")

# --- foreign keys
_fk = lambda p, c, r, rc, f: f"{f(p)} || '(' || {f(c)} || ') -> ' || {f(r)} || '(' || {f(rc)} || ')'"
EXTRA["fk_ans"] = f"""SELECT fk_name AS ans_fk, {_fk('parent_table', 'fk_column', 'ref_table', 'pk_column', K.canonical)} AS answer_fk,
    {_fk('parent_table', 'fk_column', 'ref_table', 'pk_column', _plain)} AS plain_fk FROM ans_fks"""
EXTRA["fk_stu"] = f"""SELECT submission_id, fk_name AS stu_fk, {_fk('pt', 'fk_column', 'rt', 'pk_column', K.canonical)} AS student_fk,
    {_fk('pt', 'fk_column', 'rt', 'pk_column', _plain)} AS plain_fk FROM (
      SELECT f.submission_id, fk_name, fk_column, pk_column, coalesce(a.ans_table, parent_table) AS pt, coalesce(b.ans_table, ref_table) AS rt
      FROM raw_fks f LEFT JOIN tab_map a ON a.submission_id = f.submission_id AND a.original_name = parent_table
      LEFT JOIN tab_map b ON b.submission_id = f.submission_id AND b.original_name = ref_table) q"""


def _fk_match(cosines: str, column: str) -> str:
    own = "answer_fk" if column == "student_fk" else "plain_fk"
    edges = f"""SELECT submission_id, ans_fk, stu_fk, similarity FROM fk_stu s JOIN ({cosines}) x ON x.st = s.{column}
        JOIN fk_ans a ON a.{own} = x.a_text WHERE similarity >= 0.85"""
    return f"""SELECT e.submission_id, e.ans_fk, e.answer_fk, s.{column} AS student_fk, coalesce(x.similarity, 0) AS similarity,
          x.similarity IS NOT NULL AS is_matched
        FROM (SELECT submission_id, ans_fk, {own} AS answer_fk FROM subs, fk_ans) e
        LEFT JOIN ({K.greedy(edges, ['submission_id'], 'ans_fk', 'stu_fk', ['similarity'], True)}) g USING (submission_id, ans_fk)
        LEFT JOIN ({edges}) x USING (submission_id, ans_fk, stu_fk)
        LEFT JOIN fk_stu s USING (submission_id, stu_fk)"""


_fk_cos = f"""SELECT a_text, st, cosine AS similarity FROM ({K.gram_edges('SELECT DISTINCT answer_fk AS a_text, answer_fk AS text FROM fk_ans',
    'SELECT DISTINCT student_fk AS st, student_fk AS text FROM fk_stu', [], 'a_text', 'st')}) q"""


_fk_plain = f"""SELECT a_text, st, greatest({jaccard(split_words('a_text'), split_words('st'))}, {char_sim('a_text', 'st')}) AS similarity
    FROM (SELECT DISTINCT plain_fk AS a_text FROM fk_ans) a, (SELECT DISTINCT plain_fk AS st FROM fk_stu) b"""
EXTRA["fk_pairs"] = _fk_match(_fk_cos, "student_fk")

# --- attaching keys
EXTRA["attached"] = """SELECT k.*, coalesce(x.original_name, n.near) AS table_name FROM raw_keys k
    LEFT JOIN (SELECT DISTINCT submission_id, original_name FROM cols) x USING (submission_id, original_name)
    LEFT JOIN (SELECT submission_id, upper(trim(original_name)) AS l, min(original_name) AS near FROM cols GROUP BY 1, 2) n
      ON n.submission_id = k.submission_id AND n.l = upper(trim(k.original_name))"""
EXTRA["own_keys"] = """SELECT a.submission_id, t.cleaned_name AS stu_table, column_name, position FROM attached a
    JOIN tabs t ON t.submission_id = a.submission_id AND t.original_name = a.table_name"""
EXTRA["own_fks"] = f"""SELECT submission_id, fk_name, {K.clean_table('parent_table')} AS stu_table, fk_column,
    {K.clean_table('ref_table')} AS ref_table, pk_column FROM raw_fks"""
EXTRA["ans_refs"] = "SELECT fk_name, upper(parent_table) AS ans_table, fk_column, upper(ref_table) AS ref_table, pk_column FROM ans_fks"


def _pk_ok(mapped: str) -> str:
    return f"""SELECT m.submission_id, m.ans_table,
      coalesce((SELECT list(DISTINCT column_name ORDER BY column_name) FROM ans_keys a WHERE a.ans_table = m.ans_table), []) =
      coalesce((SELECT list(DISTINCT column_name ORDER BY column_name) FROM own_keys o
        WHERE o.submission_id = m.submission_id AND o.stu_table = m.stu_table), []) AS pk_ok,
      NOT EXISTS (SELECT 1 FROM ans_refs r WHERE r.ans_table = m.ans_table AND NOT EXISTS (SELECT 1 FROM own_fks f
        WHERE f.submission_id = m.submission_id AND f.stu_table = m.stu_table AND f.fk_column = r.fk_column
          AND f.ref_table = r.ref_table AND f.pk_column = r.pk_column)) AS fk_ok
      FROM ({mapped}) m"""


# --- full texts and the schema score
def _full_text(cols: str, keys: str, refs: str, table: str, lead: str) -> str:
    on = f"USING ({lead}{table})"
    return f"""SELECT {lead}{table}, 'TABLE ' || {table} || ': ' || c || coalesce(' | PK:' || k, '') || coalesce(f, '') AS text FROM
      ({cols}) c0 LEFT JOIN ({keys}) k0 {on} LEFT JOIN ({refs}) f0 {on}"""


EXTRA["full_stu"] = _full_text(
    "SELECT submission_id, cleaned_name AS stu_table, string_agg(column_name || ' (' || data_type || ')', ', ' ORDER BY ordinal) AS c FROM cols GROUP BY 1, 2",
    "SELECT submission_id, stu_table, string_agg(column_name, '_' ORDER BY position, column_name) AS k FROM own_keys GROUP BY 1, 2",
    "SELECT submission_id, stu_table, string_agg(' | FK ' || stu_table || '(' || fk_column || ')->' || ref_table || '(' || pk_column || ')', '' ORDER BY fk_name) AS f FROM own_fks GROUP BY 1, 2",
    "stu_table", "submission_id, ")
EXTRA["ans_key_order"] = K.values([(t.upper(), c, n) for t, cs in synthetic.PRIMARY_KEYS.items() for n, c in enumerate(cs)], "ans_table, column_name, position")
EXTRA["full_ans"] = _full_text(
    "SELECT ans_table, string_agg(ans_col || ' (' || ans_type || ')', ', ' ORDER BY ans_ordinal) AS c FROM ans GROUP BY 1",
    "SELECT ans_table, string_agg(column_name, '_' ORDER BY position) AS k FROM ans_key_order GROUP BY 1",
    "SELECT ans_table, string_agg(' | FK ' || ans_table || '(' || fk_column || ')->' || ref_table || '(' || pk_column || ')', '' ORDER BY fk_name) AS f FROM ans_refs GROUP BY 1",
    "ans_table", "")
EXTRA["full_cos"] = K.gram_edges("SELECT * FROM full_ans", "SELECT DISTINCT text, text AS stu_text FROM full_stu", [], "ans_table", "stu_text")
EXTRA["text_best"] = _map_tables(
    f"SELECT submission_id, ans_table, stu_table, cosine FROM full_stu JOIN full_cos ON stu_text = full_stu.text WHERE {K.micro('cosine')} > 0", K.micro("cosine"))
EXTRA["text_map"] = """SELECT submission_id, ans_table, stu_table, cosine, cid FROM text_best
    JOIN (SELECT submission_id, cleaned_name AS stu_table, cid FROM tabs) t USING (submission_id, stu_table) WHERE cosine >= 0.8"""
EXTRA["text_wanted"] = f"SELECT DISTINCT {ends} FROM text_map"
_tl = f"SELECT {ends}, ans_ordinal, ans_table || '.' || ans_col || ' (' || ans_type || ')' AS text FROM text_wanted JOIN ans USING (ans_table)"
_tr = f"SELECT {ends}, ordinal AS stu_ordinal, stu_table || '.' || column_name || ' (' || data_type || ')' AS text FROM text_wanted JOIN content USING (cid)"
EXTRA["text_cols"] = f"""WITH {K.optimal(
    f"SELECT *, {K.micro('cosine')} AS weight FROM ({K.gram_edges(_tl, _tr, PAIR, 'ans_ordinal', 'stu_ordinal')}) z WHERE {K.micro('cosine')} > 0",
    PAIR, 'ans_ordinal', 'stu_ordinal', 'weight', 11)}
    SELECT {ends}, count(*) AS matched_cols FROM best JOIN ans USING (ans_table, ans_ordinal)
    JOIN (SELECT cid, ordinal AS stu_ordinal, data_type FROM content) c USING (cid, stu_ordinal)
    WHERE cosine >= 0.82 AND lower(ans_type) = lower(data_type) GROUP BY {ends}"""
EXTRA["results"] = f"""SELECT m.submission_id, m.ans_table, m.stu_table, m.cosine, coalesce(t.matched_cols, 0) AS matched_cols,
    coalesce(t.matched_cols, 0)::DOUBLE / (SELECT count(*) FROM ans a WHERE a.ans_table = m.ans_table) >= 0.8 AS enough_cols, pk_ok, fk_ok
    FROM text_map m LEFT JOIN text_cols t USING ({ends}) JOIN ({_pk_ok('SELECT * FROM text_map')}) p USING (submission_id, ans_table)"""
EXTRA["schema_scores"] = """SELECT submission_id, coalesce(mapped_tables, 0) AS mapped_tables, coalesce(hit_tables, 0) AS hit_tables,
    coalesce(hit_tables, 0) * 0.5::DOUBLE AS schema_score, coalesce(matched, 0)::DOUBLE / (SELECT count(*) FROM ans) AS column_ratio
    FROM subs LEFT JOIN (SELECT submission_id, count(*) AS mapped_tables, sum((enough_cols AND pk_ok AND fk_ok)::INT)::BIGINT AS hit_tables,
      sum(matched_cols)::BIGINT AS matched FROM results GROUP BY 1) r USING (submission_id)"""

# --- counts
_expected = {k.upper(): v for k, v in synthetic.EXPECTED_DELTA.items()}


def _checks(mapping: str) -> str:
    d = "(student_count - answer_count)"
    rule = K.case_map({k: 0 for k in []}, "ans_table", "NULL") if not _expected else (
        "(CASE ans_table " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _expected.items()) + " END)")
    return f"""SELECT *, CASE WHEN error IS NOT NULL THEN 'error'
        WHEN is_business AND difference = expected_increase THEN 'business_logic_correct'
        WHEN is_business AND exact_match THEN 'data_correct_business_logic_missing'
        WHEN is_business THEN 'incorrect_business_logic'
        WHEN exact_match THEN 'correct_data_import' ELSE 'incorrect_data_import' END AS status FROM (
      SELECT submission_id, ans_table, original_name, answer_count, student_count, CASE WHEN error IS NULL THEN {d} END AS difference,
        coalesce(error IS NULL AND {d} = 0, false) AS exact_match, rule IS NOT NULL AS is_business, coalesce(rule, 0) AS expected_increase, error
      FROM (SELECT m.submission_id, m.ans_table, m.original_name, a.row_count AS answer_count, c.row_count AS student_count, {rule} AS rule,
          CASE WHEN m.stu_table IS NULL THEN 'unmapped' WHEN a.row_count IS NULL THEN 'answer_not_counted'
            WHEN c.row_count IS NULL THEN 'student_not_counted' END AS error
        FROM ({mapping}) m LEFT JOIN ans_counts a ON upper(a.original_name) = m.ans_table
        LEFT JOIN raw_counts c ON c.submission_id = m.submission_id AND c.original_name = m.original_name) q) r"""


EXTRA["checks"] = _checks("""SELECT submission_id, ans_table, stu_table, original_name FROM every_tab LEFT JOIN
    (SELECT submission_id, cleaned_name AS ans_table, cleaned_name AS stu_table, original_name FROM tabs) t USING (submission_id, ans_table)""")
EXTRA["map_checks"] = _checks("SELECT * FROM tab_map")


def _overall(checks: str) -> str:
    n = lambda c: f"sum(coalesce({c}, false)::INT)::BIGINT"
    return f"""SELECT *, CASE WHEN unmapped_tables > 0 OR query_errors > 0 THEN 'critical_errors_mapping_or_querying'
        WHEN data_complete AND business_complete AND perfect THEN 'perfect_all_correct'
        WHEN data_complete AND business_complete THEN 'complete_with_business_logic'
        WHEN data_complete THEN 'data_complete_business_partial_or_incorrect'
        WHEN business_complete THEN 'data_partial_or_incorrect_business_complete'
        ELSE 'incomplete_data_and_business_logic' END AS overall_status FROM (
      SELECT *, data_score = regular_tables AS data_complete, business_score = business_max AS business_complete FROM (
        SELECT submission_id, count(*) AS total_tables, {n('exact_match')} AS exact_matches,
          {n('is_business AND error IS NULL')} AS business_tables, {n('NOT is_business AND error IS NULL')} AS regular_tables,
          {n("status = 'business_logic_correct'")} AS business_score, {n("status = 'correct_data_import'")} AS data_score,
          {n("error = 'unmapped'")} AS unmapped_tables, {n("error = 'student_not_counted'")} AS query_errors,
          bool_and(error IS NULL AND CASE WHEN is_business THEN difference = expected_increase ELSE exact_match END) AS perfect,
          bool_and(exact_match) AS all_tables_match, {len(_expected)} AS business_max FROM {checks} GROUP BY submission_id) a) b"""


EXTRA["overall"] = _overall("checks")
EXTRA["map_overall"] = _overall("map_checks")


def _report(checks: str, overall: str, baseline: str) -> str:
    if baseline == "after":
        rule, only = "difference = 0", "is_business AND difference = -1"
    else:
        rule, only = "difference = expected_increase", "is_business AND difference = 0"
    yes = lambda c: f"CASE WHEN {c} THEN {lit(vocab.YES)} ELSE {lit(vocab.NO)} END"
    wrong_b = lit(vocab.NOTE_BUSINESS_WRONG).replace("%d", "' || difference || '")
    wrong_d = lit(vocab.NOTE_DATA_WRONG).replace("%d", "' || difference || '")
    return f"""SELECT submission_id, ans_table, original_name, answer_count, student_count, difference, {yes('dok')} AS data_ok,
        {yes('rok')} AS rule_ok, {yes('is_business')} AS business_table, business_score || '/' || business_max AS business_points,
        CASE WHEN error IS NOT NULL THEN {lit(vocab.STATUS_ERROR)} WHEN dok AND NOT is_business THEN {lit(vocab.STATUS_DATA)}
          WHEN dok AND rok THEN {lit(vocab.STATUS_BUSINESS)} WHEN is_business THEN {lit(vocab.STATUS_BUSINESS_WRONG)}
          ELSE {lit(vocab.STATUS_DATA_WRONG)} END AS status,
        CASE WHEN error IS NOT NULL THEN error WHEN dok AND NOT is_business THEN {lit(vocab.NOTE_DATA)}
          WHEN dok AND rok THEN {lit(vocab.NOTE_BUSINESS)} WHEN is_business THEN {wrong_b} ELSE {wrong_d} END AS note
      FROM (SELECT *, coalesce(error IS NULL AND ({rule} OR ({only})), false) AS dok, coalesce(error IS NULL AND {rule}, false) AS rok
        FROM {checks}) c JOIN (SELECT submission_id, business_score, business_max FROM {overall}) o USING (submission_id)"""


EXTRA["report"] = _report("map_checks", "map_overall", "after")
EXTRA["delta"] = f"""SELECT *, bool_and(correct) OVER w AS all_correct,
      sum(correct::INT) OVER w || '/{len(_expected)}' AS points,
      CASE WHEN correct THEN 'OK' ELSE {lit(vocab.NOTE_DELTA.split('%d')[0])} || actual_increase || {lit(vocab.NOTE_DELTA.split('%d')[1])} || expected_increase END AS note
    FROM (SELECT *, coalesce(student_count IS NOT NULL AND answer_count IS NOT NULL AND actual_increase = expected_increase, false) AS correct FROM (
      SELECT s.submission_id, r.table_name, a.row_count AS answer_count, c.row_count AS student_count, expected_increase,
        coalesce(c.row_count - a.row_count, 0) AS actual_increase
      FROM subs s, (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in synthetic.EXPECTED_DELTA.items())}) v(table_name, expected_increase)) r
      LEFT JOIN ans_counts a ON a.original_name = r.table_name
      LEFT JOIN (SELECT submission_id, lower({K.clean_table('original_name')}) AS table_name, row_count FROM raw_counts) c
        ON c.submission_id = s.submission_id AND c.table_name = r.table_name) q) p WINDOW w AS (PARTITION BY submission_id)"""
EXTRA["shape_views"] = """SELECT r.submission_id, a.view_name AS view, r.view_name AS stu_view, a.num_columns, a.num_rows
    FROM raw_views r JOIN ans_views a USING (num_columns, num_rows)"""
EXTRA["one_views"] = K.greedy("SELECT * FROM shape_views", ["submission_id"], "view", "stu_view", ["view"], False)
EXTRA["contained"] = """SELECT submission_id, ans_table, cleaned_name AS stu_table, count(*)::DOUBLE / any_value(n) AS ratio FROM
    (SELECT DISTINCT submission_id, cleaned_name, column_name FROM cols) c JOIN (SELECT *, count(*) OVER (PARTITION BY ans_table) AS n FROM ans) a
    ON ans_col = column_name GROUP BY 1, 2, 3"""
EXTRA["all_names"] = "SELECT column_name AS name FROM raw_cols UNION SELECT original_name FROM raw_cols UNION SELECT p_name FROM part"

# --- the statements -------------------------------------------------------------------------

add("catalog_columns", "SELECT * FROM cols")
add("alias_columns", f"SELECT submission_id, original_name, cleaned_name, ordinal, {alias('column_name', R.COLUMN_ALIASES)} AS column_name, data_type FROM cols")
_early = {**R.COLUMN_ALIASES, "events": "event_log"}
add("catalog_early_rows", f"""SELECT submission_id, {alias('original_name', _early)} AS table_name, ordinal, {alias('column_name', _early)} AS column_name,
    data_type FROM raw_cols WHERE NOT lower(original_name) LIKE '%stage%' AND NOT regexp_matches(original_name, '^\\d+\\.')""")
add("catalog_stats", """SELECT submission_id, tables, columns, coalesce(tables_with_pk, 0) AS tables_with_pk, coalesce(tables_with_fk, 0) AS tables_with_fk,
    coalesce(relationships, 0) AS relationships FROM (SELECT submission_id, count(DISTINCT cleaned_name) AS tables, count(*) AS columns FROM cols GROUP BY 1) c
    LEFT JOIN (SELECT submission_id, count(DISTINCT original_name) AS tables_with_pk FROM raw_keys GROUP BY 1) k USING (submission_id)
    LEFT JOIN (SELECT submission_id, count(DISTINCT parent_table) AS tables_with_fk, count(DISTINCT (fk_name, parent_table, ref_table)) AS relationships FROM raw_fks GROUP BY 1) f USING (submission_id)""")
SQL["catalog_stats_composite"] = SQL["catalog_stats"].replace("count(DISTINCT (fk_name, parent_table, ref_table))", "count(DISTINCT parent_table)")
add("wide_table_texts", """SELECT submission_id, 'TABLE WIDE: ' || array_to_string(l, ', ') AS text, 'TABLE WIDE: ' || array_to_string(list_slice(l, 1, 30), ', ') AS short_text
    FROM (SELECT submission_id, list(column_name ORDER BY ordinal, column_name) AS l FROM cols GROUP BY 1) q""")
add("nested_schema", """SELECT submission_id, cleaned_name, min(original_name) AS original_name,
    string_agg(column_name || ' ' || data_type, ', ' ORDER BY original_name, ordinal) AS cols, count(DISTINCT original_name) > 1 AS collision
    FROM cols GROUP BY 1, 2""")
add("star_catalog", f"""SELECT original_name, {lit(vocab.ANSWER_ID)} AS submission_id, ordinal, col AS column_name, dtype AS data_type, row_count
    FROM (SELECT tbl AS original_name, o AS ordinal, col, dtype FROM (SELECT tbl, ordinal AS o, col, dtype FROM spec WHERE t < 8) q) s JOIN ans_counts USING (original_name)""")
add("distinct_submissions", "SELECT DISTINCT submission_id FROM raw_cols")
add("base_tables", "SELECT DISTINCT submission_id, original_name FROM raw_cols WHERE NOT lower(original_name) LIKE '%stage%'")
add("key_usage", "SELECT submission_id, pk_name || '_' || original_name AS pk_name, original_name, string_agg(column_name, ',' ORDER BY position) AS pk FROM raw_keys GROUP BY 1, 2, 3")
add("clean_table_names", f"""SELECT original_name, {K.clean_table('original_name')} AS cleaned,
    {K.clean_table('original_name', '^(c|dm|tbl|bang|t|b)[ _]*')} AS compat, upper(regexp_replace(original_name, '^\\d+\\.\\s*', '')) AS plain,
    lower(original_name) LIKE 'sys%' AS is_system, lower(original_name) LIKE '%stage%' AS is_stage, lower(original_name) LIKE 'stage%' AS stage_prefix
    FROM (SELECT DISTINCT original_name FROM raw_cols) q""")
add("normalize_names", f"""SELECT 'doc ' || doc_id AS item, {K.normalize('text')} AS normalized FROM documents
    UNION ALL SELECT 'column ' || column_name, {K.normalize('column_name')} FROM (SELECT DISTINCT column_name FROM raw_cols) q""")
add("canonical_names", f"SELECT name, {K.canonical('name', R.NAME_ALIASES, R.NAME_SYNONYMS)} AS canonical FROM all_names")
_abbr = {k.strip().lower(): v.strip().lower() for k, v in R.ABBREVIATIONS.items()}
_syn = {k.lower(): v for k, v in R.SYNONYMS.items()}


def _words(x: str, pairs: dict[str, str]) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {K.case_map(pairs, 'w', 'w')}), ' ')"


add("canonical_tokens", f"""SELECT name, {K.normalize(_words('p', _syn))} AS canonical FROM (
    SELECT name, {K.normalize(K.case_map(_syn, 'q', 'q'))} AS p FROM (SELECT name, {_words(K.normalize('name'), _abbr)} AS q FROM all_names) a) b""")
add("name_forms", f"""SELECT name, {_plain('name')} AS plain,
    upper(array_to_string(list_transform(list_filter(regexp_extract_all(name, '\\p{{Lu}}[^\\p{{Lu}}]*|^[^\\p{{Lu}}]+'), lambda p: p <> ''), lambda p: substr(p, 1, 1)), '')) AS acronym,
    lower(name) LIKE '%stage%' AS is_stage, {is_code('name')} AS is_code, {is_code('name', vocab.CODE_WORDS_EARLY)} AS is_code_early FROM all_names""")
_stem = "regexp_extract(url, '([^/\\\\]*?)(\\.[^./\\\\]*)?$', 1)"
add("submission_ids", f"""SELECT page_id, stem, CASE WHEN lower(stem) = 'dapan' THEN {lit(vocab.ANSWER_ID)}
    WHEN regexp_matches(stem, '\\d{{8}}') THEN regexp_extract(stem, '(\\d{{8}})', 1) ELSE stem END AS submission_id
    FROM (SELECT page_id, {_stem} AS stem FROM pages) q""")
add("fk_fold", """SELECT submission_id, 'FK_' || parent_table AS fk_name, parent_table, 'all' AS ref_table, string_agg(fk_column, '|' ORDER BY n) AS parent_cols,
    string_agg(pk_column, '|' ORDER BY n) AS ref_cols FROM raw_fks GROUP BY submission_id, parent_table""")
add("fk_text", f"""SELECT submission_id, fk_name, 1 AS n_columns, {_fk('parent_table', 'fk_column', 'ref_table', 'pk_column', K.canonical)} AS fk_text,
    {_fk('parent_table', 'fk_column', 'ref_table', 'pk_column', _plain)} AS plain_text FROM raw_fks""")
_no_number = lambda x: f"regexp_replace({x}, '^\\d+\\.\\s*', '')"
_no_tail = lambda x: f"regexp_replace({x}, '_\\d+$', '')"
add("fk_clean", f"""SELECT submission_id, replace(regexp_replace(fk_name, '_\\d+', '', 'g'), '.', '_') AS fk_name,
    {_no_tail(_no_number('parent_table'))} AS parent_table, {_no_tail('fk_column')} AS fk_column,
    {_no_tail(_no_number('ref_table'))} AS ref_table, {_no_tail('pk_column')} AS pk_column FROM raw_fks""")
add("attach_keys", "SELECT submission_id, table_name, original_name, column_name, position FROM attached WHERE table_name IS NOT NULL")
add("unresolved_keys", "SELECT submission_id, original_name, column_name, position FROM attached WHERE table_name IS NULL")
add("key_ids", """SELECT k.submission_id, k.original_name, k.column_name,
    CASE WHEN c.column_name IS NOT NULL THEN k.submission_id || '/' || k.original_name || '/' || k.column_name END AS column_id,
    CASE WHEN t.original_name IS NULL THEN 'table' WHEN c.column_name IS NULL THEN 'column' END AS missing FROM raw_keys k
    LEFT JOIN (SELECT DISTINCT submission_id, original_name FROM cols) t USING (submission_id, original_name)
    LEFT JOIN (SELECT DISTINCT submission_id, original_name, column_name FROM cols) c USING (submission_id, original_name, column_name)""")
_args = ("ans_type", "stu_type", "ans_name", "stu_name")
add("type_compat", f"""SELECT ans_type, stu_type, ans_name, stu_name, {family('stu_type')} AS family, {same_type(*_args)} AS same_either,
    {same_type(*_args, mode='both')} AS same_both, {loose('ans_type', 'stu_type')} AS loose, lower(ans_type) = lower(stu_type) AS exact FROM met""")
for _name, _column in (("ratio_pairs", "ratio_"), ("partial_ratio_pairs", "partial_"), ("token_set_pairs", "token_")):
    add(_name, f"SELECT a, b, round({_column}, 6) AS score FROM canon_scored")
add("fuzzy_pairs", "SELECT a, b, round(fuzzy_, 6) AS score, round(fuzzy_, 6) >= 80 AS is_equal FROM canon_scored")
add("smart_pairs", "SELECT a, b, round(CASE WHEN a = b THEN 100 ELSE fuzzy_ END, 6) AS score FROM canon_scored")
add("name_hits", "SELECT ans_name, stu_name FROM hits")
_mp = "(SELECT DISTINCT ans_name, stu_name FROM met) m"
_pj = jaccard(split_words(_plain("ans_name")), split_words(_plain("stu_name")))
_cs = char_sim("lower(ans_name)", "lower(stu_name)")
add("jaccard_pairs", f"SELECT ans_name, stu_name, round({_pj} * 100, 6) AS score FROM {_mp}")
add("char_sim_pairs", f"SELECT ans_name, stu_name, round({_cs}, 6) AS score FROM {_mp}")
_shared = " OR ".join(f"(contains(lower(ans_name), '{w}') AND contains(lower(stu_name), '{w}'))" for w in vocab.SHARED_WORDS)
add("pattern_boost", f"""SELECT ans_name, stu_name, round(base, 6) AS base,
    round(CASE WHEN base BETWEEN 0.5 AND 0.8 AND ({_shared}) THEN least(base + 0.1::DOUBLE, 1) ELSE base END, 6) AS score
    FROM (SELECT *, greatest({_pj}, {_cs}) AS base FROM {_mp}) q""")
add("plain_table_similarity", """SELECT submission_id, ans_table, stu_table, round(ns, 6) AS name_similarity, round(cs, 6) AS column_similarity,
    round(similarity, 6) AS similarity FROM plain_sim""")
add("first_fit_columns", "SELECT submission_id, ans_table, cleaned_name AS stu_table, n_cols FROM tabs JOIN fit_n USING (cid)")
add("table_map_plain", """SELECT submission_id, ans_table, stu_table, n_cols, round(cosine, 6) AS similarity FROM every_tab
    LEFT JOIN (SELECT * FROM plain_best WHERE cosine >= 0.5) b USING (submission_id, ans_table)""")
add("fk_system_tables", """SELECT submission_id, fk_name, parent_table, fk_column, ref_table, pk_column, 1 AS ordinal FROM raw_fks""")
add("fk_relationships", "SELECT DISTINCT submission_id, parent_table, ref_table FROM raw_fks")
add("table_texts", "SELECT submission_id, cleaned_name, text FROM tabs")
add("full_table_texts", "SELECT submission_id, stu_table, text FROM full_stu")
add("column_texts", f"SELECT submission_id, ordinal, {COLTEXT} AS text FROM cols")
add("hash_embed", """SELECT doc_id, place, round(v / (norm + 1e-8), 6) AS value FROM (
    SELECT doc_id, place, v, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS norm FROM (
      SELECT doc_id, place, ('0x' || substr(sha256(text), 2 * place + 1, 2))::INT::DOUBLE AS v
      FROM documents, (SELECT unnest(range(0, 32))::INT AS place) p) a) b""")
_dom = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(text), {lit(w)})' for w in [p, *s])} THEN {lit('- ' + p + ': ' + ', '.join(s))} END"
    for p, s in vocab.DOMAIN_PATTERNS.items())
add("domain_text", f"""SELECT doc_id, {lit(vocab.DOMAIN_INTRO)} || chr(10) || text || chr(10) || {lit(vocab.DOMAIN_OUTRO)} || chr(10) ||
    concat_ws(chr(10), {_dom}) AS text FROM documents""")
add("gram_cosine", "SELECT ans_table, stu_text, round(cosine, 6) AS cosine FROM text_cos")
add("embedding_cache", """SELECT sha256(text) AS key, round(b / (norm + 1e-8), 6) AS first, 384 AS width FROM (
    SELECT text, ('0x' || substr(sha256(text), 1, 2))::INT AS b,
      sqrt(list_sum(list_transform(range(0, 32), lambda i: (('0x' || substr(sha256(text), 2 * i + 1, 2))::INT ** 2)::DOUBLE))) AS norm
    FROM (SELECT text FROM benchmark UNION SELECT text FROM conversations) t) q""")
EXTRA["centroid"] = """SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) p GROUP BY label, i) q GROUP BY label"""
EXTRA["vec_edges"] = """SELECT vec_id, centroid.label, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS cosine FROM embeddings, centroid"""
add("dense_cosine_topk", """SELECT vec_id, label, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank
    FROM vec_edges) q WHERE rank <= 5""")
add("vector_link", f"""SELECT vec_id, label, cosine FROM ({K.greedy('SELECT 0 AS g, * FROM vec_edges WHERE cosine > 0', ['g'], 'vec_id', 'label', ['cosine'], True)}) w
    JOIN vec_edges USING (vec_id, label)""")
EXTRA["half_edges"] = """SELECT * FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) q WHERE cosine >= 0.3"""
add("vector_nearest", "SELECT a_id, b_id, cosine FROM half_edges QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY cosine DESC, b_id) = 1")
add("vector_pairs", f"""SELECT a_id, b_id, cosine FROM ({K.greedy('SELECT 0 AS g, * FROM half_edges', ['g'], 'a_id', 'b_id', ['cosine'], True)}) w
    JOIN half_edges USING (a_id, b_id)""")
# of each label's vectors only the ten best can be in the optimum, as there are ten labels
add("vector_assign", "SELECT * FROM (WITH " + K.optimal("""SELECT 0 AS g, vec_id, label, cosine FROM vec_edges WHERE cosine > 0
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC) <= 10""", ["g"], "vec_id", "label", K.micro("cosine"), 100).replace(
        "AS (SELECT g, mask, max", "AS MATERIALIZED (SELECT g, mask, max") + " SELECT vec_id, label, cosine FROM best) q")
add("table_edges", "SELECT submission_id, ans_table, stu_table, n_cols, round(cosine, 6) AS cosine FROM tab_edges")
add("table_map", "SELECT submission_id, ans_table, stu_table, original_name, n_cols, round(cosine, 6) AS cosine FROM tab_map")
add("table_map_text", "SELECT submission_id, ans_table, stu_table, round(cosine, 6) AS cosine FROM text_map")
add("unmapped_tables", """SELECT submission_id, ans_table AS table_name, 'answer' AS side FROM tab_map WHERE stu_table IS NULL
    UNION ALL SELECT submission_id, cleaned_name, 'student' FROM tabs WHERE (submission_id, cleaned_name) NOT IN
      (SELECT (submission_id, stu_table) FROM tab_map WHERE stu_table IS NOT NULL)""")
_same = f"""SELECT ans_table, cid, ans_ordinal, ordinal AS stu_ordinal FROM (SELECT DISTINCT cleaned_name AS ans_table, cid FROM tabs) t
    JOIN (SELECT *, {K.canonical('ans_col')} AS ac FROM ans) a USING (ans_table)
    JOIN (SELECT *, {K.canonical('column_name')} AS sc FROM content) c USING (cid) WHERE {hit('ans_col', 'ac', 'column_name', 'sc')}"""
add("exact_column_match", f"""SELECT submission_id, ans_table, ans_col, column_name AS stu_col, {same_type('ans_type', 'data_type', 'ans_col', 'column_name')} AS match
    FROM tabs JOIN ({K.greedy(_same, ['ans_table', 'cid'], 'ans_ordinal', 'stu_ordinal', ['ans_ordinal'], False)}) g ON ans_table = cleaned_name AND g.cid = tabs.cid
    JOIN ans USING (ans_table, ans_ordinal) JOIN content c ON c.cid = tabs.cid AND c.ordinal = stu_ordinal""")
_out = "submission_id, ans_table, ans_col, ans_type, stu_table, stu_col, stu_type, round(score, 6) AS score, match"
add("column_pairs", f"SELECT {_out} FROM col_pairs")
add("column_pairs_blended", f"SELECT {_out} FROM ({_column_pairs('blended')}) q")
add("column_pairs_single_phase", f"SELECT {_out} FROM ({_column_pairs('text')}) q")
add("column_pairs_plain", f"SELECT {_out} FROM ({_column_pairs('plain')}) q")
add("best_table", """SELECT submission_id, ans_table, stu_table, round(ratio, 6) AS ratio FROM (SELECT *,
    row_number() OVER (PARTITION BY submission_id, ans_table ORDER BY ratio DESC, stu_table) AS rank FROM contained) q WHERE rank = 1""")
add("table_suggestions", """SELECT submission_id, ans_table, stu_table, round(ratio, 6) AS ratio, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY submission_id, ans_table ORDER BY ratio DESC, stu_table) AS rank FROM contained) q WHERE rank <= 5""")
# blocked lookup
EXTRA["block_names"] = K.scored(f"""SELECT DISTINCT {K.canonical('tbl')} AS a, {K.canonical('original_name')} AS b
    FROM (SELECT DISTINCT tbl FROM spec WHERE t < 8) s, (SELECT DISTINCT original_name FROM tabs) o""")
EXTRA["blocks"] = f"""SELECT submission_id, ans_table, original_name, cid, a = b AS same FROM tabs
    JOIN block_names ON b = {K.canonical('original_name')}
    JOIN (SELECT DISTINCT ans_table, {K.canonical('original_name')} AS ca FROM ans) x ON ca = a
    WHERE a = b OR (greatest(token_, ratio_, partial_) >= 80 AND NOT b LIKE 'stage %')"""
EXTRA["use_blocks"] = "SELECT * FROM blocks QUALIFY same OR NOT bool_or(same) OVER (PARTITION BY submission_id, ans_table)"
EXTRA["lookup_scores"] = K.scored("SELECT DISTINCT ac AS a, sc AS b FROM ans_names, stu_names")
EXTRA["found"] = """SELECT cid, ans_table, ans_col, min(CASE WHEN fuzzy_ >= 80 THEN c.ordinal END) AS first_hit, arg_min(fuzzy_, c.ordinal) FILTER (fuzzy_ >= 80) AS hit_score,
    max(fuzzy_) AS best FROM (SELECT DISTINCT cid, ans_table FROM use_blocks) w JOIN ans USING (ans_table) JOIN content c USING (cid)
    JOIN ans_names ON ans_name = ans_col JOIN stu_names ON stu_name = column_name JOIN lookup_scores ON a = ac AND b = sc GROUP BY 1, 2, 3"""
EXTRA["lookup"] = """SELECT e.submission_id, e.ans_table, e.ans_col, (h IS NOT NULL)::INT AS result, round(coalesce(h, best, 0), 6) AS best_score
    FROM (SELECT submission_id, ans_table, ans_col FROM subs, ans) e LEFT JOIN (
      SELECT submission_id, ans_table, ans_col, arg_min(hit_score, original_name) FILTER (first_hit IS NOT NULL) AS h, max(best) AS best
      FROM use_blocks JOIN found USING (cid, ans_table) GROUP BY 1, 2, 3) f USING (submission_id, ans_table, ans_col)"""
add("blocked_lookup", "SELECT * FROM lookup")
add("lookup_totals", "SELECT submission_id, sum(result)::BIGINT AS score FROM lookup GROUP BY submission_id")
_fo = "submission_id, ans_fk, answer_fk, student_fk, round(similarity, 6) AS similarity, is_matched"
add("fk_match", f"SELECT {_fo} FROM fk_pairs")
add("fk_match_plain", f"SELECT {_fo} FROM ({_fk_match(_fk_plain, 'plain_fk')}) q")
add("fk_ratio", "SELECT submission_id, round(avg(is_matched::INT), 6) AS fk_ratio FROM fk_pairs GROUP BY submission_id")
add("pk_fk_check", _pk_ok("SELECT submission_id, cleaned_name AS ans_table, cleaned_name AS stu_table FROM tabs"))
add("table_report", f"""SELECT submission_id, ans_table, stu_table, round(cosine, 6) AS cosine, enough_cols, pk_ok, fk_ok,
    CASE WHEN enough_cols AND pk_ok AND fk_ok THEN {lit(vocab.TABLE_COMPLETE)} ELSE {lit(vocab.TABLE_INCOMPLETE)} END AS status FROM results""")
add("schema_score", "SELECT submission_id, mapped_tables, hit_tables, schema_score, round(column_ratio, 6) AS column_ratio FROM schema_scores")
add("table_row_counts", "SELECT * FROM ans_counts")
add("count_checks", """SELECT submission_id, ans_table, original_name, answer_count, student_count, difference, exact_match, is_business,
    expected_increase, error, status FROM checks""")
add("count_overall", "SELECT * EXCLUDE (perfect) FROM overall")
add("count_report", _report("checks", "overall", "after"))
add("count_report_before", _report("checks", "overall", "before"))
add("count_summary", f"""SELECT submission_id, ans_table, original_name, answer_count, student_count, difference, exact_match::INT AS rows_match,
    business_complete::INT AS business_done, is_business::INT AS business_table, business_score || '/' || business_max AS business_points,
    overall_status AS data_status, CASE WHEN exact_match AND is_business THEN {lit(vocab.SUMMARY_PERFECT)} WHEN exact_match THEN {lit(vocab.SUMMARY_EQUAL)}
      WHEN is_business AND status = 'incorrect_business_logic' THEN {lit(vocab.SUMMARY_BUSINESS_WRONG)}
      WHEN is_business OR difference IS NULL THEN {lit(vocab.SUMMARY_DIFFERENT)} ELSE {lit(vocab.SUMMARY_DIFFERENT + ' ')} || difference END AS note
    FROM checks JOIN (SELECT submission_id, business_complete, business_score, business_max, overall_status FROM overall) o USING (submission_id)""")


def _reconcile(table: str, key: str, keep: str) -> str:
    return f"""SELECT {key}, coalesce(a.n, 0) AS answer_count, coalesce(b.n, 0) AS student_count, coalesce(b.n, 0) - coalesce(a.n, 0) AS difference,
      CASE WHEN a.n IS NULL THEN 'only_student' WHEN b.n IS NULL THEN 'only_answer' WHEN a.n = b.n THEN 'equal' ELSE 'different' END AS status
      FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY 1) a FULL JOIN (SELECT {key}, count(*) AS n FROM {table} WHERE {keep} GROUP BY 1) b USING ({key})"""


add("row_count_reconcile", _reconcile("lineitem", "l_suppkey", "l_returnflag <> 'R'"))
add("order_count_reconcile", _reconcile("orders", "o_custkey", "o_orderstatus <> 'F'"))
add("business_delta", """SELECT submission_id, table_name, answer_count, student_count, expected_increase, actual_increase, correct, all_correct, points, note FROM delta""")
add("score_distribution", "SELECT points, count(DISTINCT submission_id) AS submissions FROM delta GROUP BY points")
add("delta_statistics", """SELECT count(*) AS submissions, sum(r::INT)::BIGINT AS fully_read, sum(p::INT)::BIGINT AS perfect, round(avg(p::INT) * 100, 1) AS perfect_rate
    FROM (SELECT submission_id, bool_and(student_count IS NOT NULL) AS r, bool_and(correct) AS p FROM delta GROUP BY 1) q""")
add("customer_growth", """SELECT *, student_count - answer_count AS actual_increase, student_count - answer_count = 1 AS correct FROM (
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS answer_count, count(*) FILTER (o_orderstatus = 'O') AS student_count FROM orders GROUP BY 1) q""")
add("view_shapes", "SELECT view_name, num_columns, num_rows FROM ans_views")
add("view_definitions", "SELECT submission_id, view_name, definition FROM raw_views")
add("view_match_shape", "SELECT * FROM shape_views")
add("view_match_name", """SELECT submission_id, view_name AS view, a.num_columns AS ans_cols, r.num_columns AS stu_cols, a.num_rows AS ans_rows,
    r.num_rows AS stu_rows, true AS matched FROM raw_views r JOIN ans_views a USING (view_name) WHERE a.num_columns = r.num_columns AND a.num_rows = r.num_rows""")
add("view_match", "SELECT submission_id, view, stu_view FROM one_views")


def _key_check(table: str, keys: list[str]) -> str:
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    return f"""SELECT '{table}' AS table_name, '{",".join(keys)}' AS key_columns, rows, distinct_keys, rows - distinct_keys AS duplicate_rows, null_rows,
      rows = distinct_keys AND null_rows = 0 AS is_key FROM (SELECT (SELECT count(*) FROM {table}) AS rows,
      (SELECT count(*) FROM (SELECT DISTINCT {", ".join(keys)} FROM {table}) d) AS distinct_keys, (SELECT count(*) FROM {table} WHERE {null}) AS null_rows) q"""


add("key_check", " UNION ALL ".join([_key_check(t, k) for t, k in synthetic.PRIMARY_KEYS.items()] + [_key_check("conversations", ["conv_id", "turn"])]))
add("orphan_check", " UNION ALL ".join(
    f"""SELECT '{p}.{c}' AS fk_name, count(*) AS child_rows, count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {r})) AS orphans,
      count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {r})) = 0 AS holds FROM {p}"""
    for p, c, r, rc in [*synthetic.FOREIGN_KEYS, ("documents", "doc_id", "labels", "doc_id")]))


def _link(a: str, b: str, jac: float, score: float) -> str:
    wa, wb = "list_distinct(string_split(a, ' '))", "list_distinct(string_split(b, ' '))"
    pairs = f"""SELECT a, b FROM (SELECT DISTINCT {K.normalize(a[1])} AS a FROM {a[0]}) x JOIN (SELECT DISTINCT {K.normalize(b[1])} AS b FROM {b[0]}) y
      ON len(list_intersect({wa}, {wb})) > 0 WHERE a <> '' AND b <> '' AND {jaccard(wa, wb)} >= {jac}"""
    edges = f"SELECT 0 AS g, a AS a_name, b AS b_name, round(fuzzy_, 6) AS score FROM ({K.scored(pairs)}) s WHERE round(fuzzy_, 6) >= {score}"
    return f"""SELECT a_name, b_name, score FROM ({K.greedy(edges, ['g'], 'a_name', 'b_name', ['score'], True)}) w JOIN ({edges}) e USING (a_name, b_name)"""


add("record_link", _link(("supplier", "s_name"), ("customer", "c_name"), 0.3, 60))
add("part_name_link", _link(("part", "p_name"), ("part", "upper(p_type || ' ' || p_name)"), 0.5, 70))
add("score_card", """SELECT o_custkey, round(f, 4) AS finished, round(p, 4) AS prioritised, round(l, 4) AS large, round(f * 4 + p * 2 + l * 4, 2) AS total FROM (
    SELECT o_custkey, avg((o_orderstatus = 'F')::INT) AS f, avg((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT) AS p, avg((o_totalprice > 250000)::INT) AS l
    FROM orders GROUP BY 1) q""")
SUMMARY = f"""SELECT submission_id, round(c, 4) AS column_ratio, round(f, 4) AS fk_ratio, round(d, 4) AS data_ratio, round(b, 4) AS business_ratio,
    round(v, 4) AS view_ratio, round(c * 3, 2) AS mark_a1, round(f * 2, 2) AS mark_a2, round(d * 1, 2) AS mark_a3, round(v * 3, 2) AS mark_b,
    round(b * 1, 2) AS mark_c, least(round(c * 3 + f * 2 + d * 1 + v * 3 + b * 1, 2), 10::DOUBLE) AS total FROM (
      SELECT submission_id, coalesce(c, 0) AS c, coalesce(f, 0) AS f, coalesce(d, 0) AS d, coalesce(b, 0) AS b, coalesce(v, 0) AS v FROM subs
      LEFT JOIN (SELECT submission_id, avg(match::INT) AS c FROM col_pairs GROUP BY 1) c USING (submission_id)
      LEFT JOIN (SELECT submission_id, avg(is_matched::INT) AS f FROM fk_pairs GROUP BY 1) f USING (submission_id)
      LEFT JOIN (SELECT submission_id, avg((data_ok = {lit(vocab.YES)})::INT) AS d, avg((rule_ok = {lit(vocab.YES)})::INT) AS b FROM report GROUP BY 1) r USING (submission_id)
      LEFT JOIN (SELECT submission_id, count(*)::DOUBLE / 3 AS v FROM one_views GROUP BY 1) v USING (submission_id)) q"""
add("summary", SUMMARY)
SQL["summary_from_files"] = SQL["summary"]

# a folder of four submissions with the answer's types, four fifths of its rows, and one table that can't be read
_first = {t: cols[0].split()[0] for t, cols in synthetic.ANSWER.items()}
FOLDER = {
    "subs": "SELECT CAST(key + 10000000 AS VARCHAR) AS submission_id, key FROM (VALUES " + ", ".join(f"({k})" for k in synthetic.FOLDER_KEYS) + ") v(key)",
    "raw_cols": f"""SELECT submission_id, key, t, {K._named('t', 'tbl')} AS original_name, row_number() OVER (PARTITION BY submission_id, t ORDER BY ordinal)::INT AS ordinal,
        variants[{K._variant('t', 'ordinal')} + 1] AS column_name, dtype AS data_type
        FROM subs, spec WHERE t < 8 AND NOT {K._dropped('t')} AND {K._variant('t', 'ordinal')} <> 3""",
    "raw_counts": f"SELECT submission_id, {K._named('t', 'tbl')} AS original_name, row_count FROM (" + " UNION ALL ".join(
        f"SELECT submission_id, key, {n} AS t, {lit(t)} AS tbl, (SELECT count(*) FROM {t} WHERE {c} % 5 <> key % 5) AS row_count FROM subs"
        for n, (t, c) in enumerate(_first.items())) + f") q WHERE NOT {K._dropped('t')}",
    "raw_fks": K.TABLES["raw_fks"] + " AND false",
    "raw_views": K.TABLES["raw_views"] + " WHERE false",
}


def add_folder(name: str, final: str) -> None:
    SQL[name] = K.statement(final, {**EXTRA, **FOLDER})


add_folder("folder_catalog", f"""SELECT * FROM cols UNION ALL
    SELECT {lit(vocab.ANSWER_ID)} AS submission_id, original_name, ans_table AS cleaned_name, ans_ordinal AS ordinal, ans_col AS column_name, ans_type AS data_type FROM ans""")
add_folder("folder_counts", f"""SELECT submission_id, original_name, row_count, false AS failed FROM raw_counts
    UNION ALL SELECT {lit(vocab.ANSWER_ID)}, original_name, row_count, false FROM ans_counts
    UNION ALL VALUES ({lit(str(synthetic.UNREADABLE[0] + 10000000))}, {lit(synthetic.UNREADABLE[1])}, NULL, true)""")
add_folder("folder_summary", SUMMARY)
add("batch_stats", """SELECT count(schema_score) AS submissions, round(avg(schema_score), 4) AS average, max(schema_score) AS highest, min(schema_score) AS lowest
    FROM schema_scores""")
add("report_enriched", """SELECT submission_id, schema_score, business_score, business_max, business_complete,
    round(business_score::DOUBLE * 100 / business_max, 6) AS business_percentage, total_tables AS tables_compared, exact_matches AS tables_matched,
    all_tables_match, round(fk_ratio, 6) AS fk_ratio, 8 AS total_tables, round(hit_tables::DOUBLE / 8, 6) AS table_match_ratio
    FROM schema_scores JOIN map_overall USING (submission_id) JOIN (SELECT submission_id, avg(is_matched::INT) AS fk_ratio FROM fk_pairs GROUP BY 1) f USING (submission_id)""")
add("store_replace", """SELECT submission_id, n, key_sum FROM (
    SELECT c_nationkey::VARCHAR AS submission_id, count(*) FILTER (o_orderstatus = 'F') AS nf, count(*) AS na,
      sum(o_orderkey) FILTER (o_orderstatus = 'F') AS sf, sum(o_orderkey) AS sa,
      CASE WHEN nf > 0 THEN nf ELSE na END AS n, (CASE WHEN nf > 0 THEN sf ELSE sa END)::BIGINT AS key_sum
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) q""")
add("report_round_trip", """SELECT submission_id, round(count(*)::DOUBLE / 3, 4) AS view_ratio FROM raw_views r JOIN ans_views a USING (view_name)
    WHERE a.num_columns = r.num_columns AND a.num_rows = r.num_rows GROUP BY 1""")
add("incremental_intake", """SELECT user_id::VARCHAR AS submission_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors
    FROM events GROUP BY 1""")
add("order_intake", """SELECT o_custkey::VARCHAR AS submission_id, count(DISTINCT o_orderpriority) AS priorities, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order,
    round(median(o_totalprice), 4) AS middle_price FROM orders GROUP BY 1""")
add("catalog_intake", "SELECT submission_id, round(avg(match::INT), 6) AS column_ratio FROM col_pairs GROUP BY submission_id")
SQL["name_hits_joined"] = SQL["name_hits"]
SQL["blocked_lookup_joined"] = SQL["blocked_lookup"]
add("ordered_catalog", """SELECT submission_id, original_name, ordinal, column_name, data_type,
    row_number() OVER (ORDER BY submission_id, original_name, ordinal, column_name, data_type) AS row_number FROM cols""")
add("tied_pairs", """SELECT p_partkey, s_suppkey, p_size FROM
    (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS r FROM part) p JOIN
    (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier) s ON p_size = s_nationkey AND p.r = s.r""")
SQL["domain_text_joined"] = SQL["domain_text"]
add("phrase_hits", """SELECT DISTINCT doc_id, phrase FROM documents JOIN (SELECT DISTINCT lower(p) AS phrase FROM (
      SELECT substr(text, (k * length(text) // 3 + 1)::INT, 24) AS p FROM benchmark, (VALUES (0), (1), (2)) t(k) UNION ALL SELECT p_name FROM part) u WHERE p <> '') q
    ON contains(lower(text), phrase)""")
