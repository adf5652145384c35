"""Candidate pairs and their scores over distinct texts.

Submissions repeat the same names, so texts are scored once per distinct pair and joined
back.  Nothing here pairs everything with everything: gram vectors meet on a shared gram,
names on a shared rare letter or inside a size-checked answer list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import names, similarity, texts, vocab
from concord.session import literal_rows, local_table, settle, with_each

# Answer names carried along as one literal list; a longer answer goes through a join instead.
ANSWER_LIST_LIMIT = 2_000

# A table of at most this many rows may be sent to every task; rows here are under a hundred bytes or so.
BROADCAST_ROWS = 100_000

# Characters of a canonical name, rarest first.
RARE_FIRST = "0123456789zqjxkwvfbgypmdhucltsroniae_ "


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few rows with much work each, over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_back(many: DataFrame, few: DataFrame, keys: list[str], salt_from: str = "submission_id", salts: int = 16) -> DataFrame:
    """Rows joined to what was worked out once per distinct key.

    ``few`` is a settled table, so counting it is cheap: up to ``BROADCAST_ROWS`` it is sent to
    every task.  Beyond that both sides are shuffled, with the rows of a key that very many
    share spread over ``salts`` tasks and ``few``, which holds distinct keys, repeated as often.
    """
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), keys)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int")
    return many.withColumn("_salt", salt).join(salted, [*keys, "_salt"]).drop("_salt")


def matching_items(df: DataFrame, items: DataFrame, test: Callable[[Column], Column], limit: int = ANSWER_LIST_LIMIT) -> DataFrame:
    """Each row with the answer's items that pass ``test``; only those are emitted.

    The items travel as one literal list and are refused above ``limit``.
    """
    rows = items.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"an answer has at most {limit} entries of a kind")
    listed = df.withColumn("_items", literal_rows([r.asDict() for r in sorted(rows)]))
    return listed.withColumn("_item", F.explode(F.filter("_items", test))).select(*df.columns, "_item.*")


def gram_edges(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str) -> DataFrame:
    """Cosine of every (left, right) pair that shares a gram; both sides carry a ``text``.

    Pairs meet inside equal ``by`` values.  ``left`` is the answer's side, whose grams are
    counted; a right text adds the left count of each gram it holds, so its own grams go
    through the join uncounted and are summed in the same task before any shuffle.
    """
    grams = texts.grams(names.normalize("text"))
    a = (
        left.select(*by, left_key, F.explode_outer(grams).alias("_gram"))
        .groupBy(*by, left_key, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    )
    norms = left.select(*by, left_key, texts.gram_norm(grams).alias("_na"))
    b = spread(right.select(*by, right_key, "text"), *by, right_key).withColumn("_grams", grams).select(
        *by, right_key, texts.gram_norm(F.col("_grams")).alias("_nb"), F.explode_outer("_grams").alias("_gram")
    )
    # inside a pair of tables no gram is common enough to matter; over all texts some are in every one
    met = b.join(a, [*by, "_gram"]) if by else join_back(b, settle(a), ["_gram"], salt_from=right_key)
    dots = met.groupBy(*by, right_key, "_nb", left_key).agg(F.sum("_n").alias("_dot"))
    return dots.join(norms, [*by, left_key]).select(
        *by, left_key, right_key, (F.col("_dot") / F.sqrt((F.col("_na") * F.col("_nb")).cast("double"))).alias("cosine")
    )


def text_cosine(a: Column, b: Column) -> Column:
    """Cosine of two short texts of one row."""
    return texts.gram_cosine(texts.grams(names.normalize(a)), texts.grams(names.normalize(b)))


def micro(c: Column) -> Column:
    """A score as whole millionths, so that totals are exact."""
    return F.floor(c * 1000000 + 0.5).cast("long")


def exact_name(a: str, b: str) -> str:
    """SQL: raw names a, b with canonical forms a_canon, b_canon count as the same name.

    A name without a letter or digit has an empty form, which is the same as no other; the raw names may still be.
    """
    return (
        f"(({a}_canon <> '' AND replace({a}_canon, ' ', '') = replace({b}_canon, ' ', '')) OR lower({a}) = lower({b}))"
    )


def _distinct_names(df: DataFrame, out: str) -> DataFrame:
    return df.select(F.col("column_name").alias(out)).distinct().withColumn(f"{out}_canon", names.canonical(out))


def name_hits(
    answers: DataFrame, students: DataFrame, threshold: float = vocab.SMART_MIN, limit: int = ANSWER_LIST_LIMIT
) -> DataFrame:
    """Distinct (ans_name, stu_name) that are the same name or score at least ``threshold``."""
    ans, stu = _distinct_names(answers, "ans_name"), _distinct_names(students, "stu_name")
    return like_names(ans, stu, lambda a, b: _is_hit(a, b, threshold), threshold, limit)


def like_names(
    ans: DataFrame, stu: DataFrame, test: Callable[[str, str], str], threshold: float, limit: int = ANSWER_LIST_LIMIT
) -> DataFrame:
    """Distinct (ans_name, stu_name) that pass ``test``, SQL over two names and their forms ``<name>_canon``.

    ``test`` holds for equal names in lower case at most, or from ``threshold`` on by a ratio, partial ratio or token
    set ratio of the forms.  A short answer is tried inside each student name's row; a longer one of any size
    meets the names through joins on letters that miss no such pair.  Both give the same pairs.
    """
    listed = sorted(ans.select("ans_name", "ans_name_canon").limit(limit + 1).collect())
    if len(listed) > limit:
        # names are cleaned once, and a pair is tested once, not for each letter on which it meets
        ans, stu = settle(ans), settle(stu)
        pairs = settle(_plausible(ans, stu, threshold).unionByName(
            ans.join(stu, F.lower("ans_name") == F.lower("stu_name")).select("ans_name", "ans_name_canon", "stu_name", "stu_name_canon")
        ).distinct())
        return spread(pairs).filter(test("ans_name", "stu_name")).select("ans_name", "stu_name")
    if not listed:
        return stu.select(F.lit(None).cast("string").alias("ans_name"), "stu_name").filter(F.lit(False))
    entries = literal_rows([r.asDict() for r in listed])
    kept = F.expr(f"filter(answer_list, an -> {test('an.ans_name', 'stu_name')})")
    return spread(stu).withColumn("answer_list", entries).select("stu_name", F.explode(kept).alias("a")).select("a.ans_name", "stu_name")


def plain_hits(answers: DataFrame, students: DataFrame, threshold: float = vocab.SMART_MIN) -> DataFrame:
    """Distinct (ans_name, stu_name): equal plainly, without spaces or in lower case, or by word Jaccard in percent.

    One equi-join per way of being alike.
    """
    ans = answers.select(F.col("column_name").alias("ans_name")).distinct()
    stu = students.select(F.col("column_name").alias("stu_name")).distinct()

    def meet(key: Callable[[str], Column]) -> DataFrame:
        return ans.withColumn("_k", key("ans_name")).join(stu.withColumn("_k", key("stu_name")), "_k").drop("_k")

    by_word = meet(lambda c: F.explode(similarity.words(F.lower(c)))).distinct().filter(
        similarity.token_jaccard(F.col("ans_name"), F.col("stu_name")) * 100 >= threshold)
    return meet(lambda c: names.squeeze(names.simple_canonical(c))).unionByName(meet(F.lower)).unionByName(by_word).distinct()


def _is_hit(a: str, b: str, threshold: float) -> str:
    return f"({exact_name(a, b)} OR ({a}_canon <> '' AND {b}_canon <> '' AND {similarity.smart_sql(a + '_canon', b + '_canon')} >= {threshold}))"


def per_submission(submissions: DataFrame, items: DataFrame, limit: int = 10_000) -> DataFrame:
    """Every item for every submission; ``items`` belong to the answer and are refused above ``limit``."""
    rows = items.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"an answer has at most {limit} entries of a kind")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return with_each(submissions.select("submission_id"), local_table(submissions.sparkSession, [tuple(r) for r in rows], schema))


def _plausible(ans: DataFrame, stu: DataFrame, threshold: float) -> DataFrame:
    """Pairs that can reach ``threshold``, found by joins on letters.

    A pair scoring t has in common at least t/(200-t) of the letters of its shorter name, so
    the shorter name's letters, rarest first and without that many of the last ones, contain
    a letter of the other name.
    """
    share = threshold / (200 - threshold) - 1e-9

    def letters(df: DataFrame, name: str) -> DataFrame:
        text = F.col(f"{name}_canon")
        kept = F.length(F.array_join(F.array_distinct(F.split(text, " ")), ""))
        tokens = F.flatten(F.transform(F.array(*[F.lit(c) for c in RARE_FIRST]), lambda c: F.transform(
            F.filter(F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, c, F.lit("")))), lambda k: k > 0),
            lambda k: F.concat(c, k.cast("string")))))
        head = F.length(text) - F.ceil(kept * share).cast("int") + 1
        return df.select(name, f"{name}_canon", kept.alias(f"{name}_n"), tokens.alias(f"{name}_all"),
                         F.slice(tokens, 1, F.greatest(head, F.lit(1))).alias(f"{name}_head"))

    a, b = letters(ans, "ans_name"), letters(stu, "stu_name")
    out = ["ans_name", "ans_name_canon", "stu_name", "stu_name_canon"]

    def meet(a_letters: str, b_letters: str, shorter: Column) -> DataFrame:
        return a.withColumn("_t", F.explode(a_letters)).join(b.withColumn("_t", F.explode(b_letters)), "_t").filter(shorter).select(*out)

    a_short = F.col("ans_name_n") <= F.col("stu_name_n")
    return meet("ans_name_head", "stu_name_all", a_short).unionByName(meet("ans_name_all", "stu_name_head", ~a_short)).distinct()
