"""Phrases of a dictionary of any size looked for in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import vocab
from concord.operators import pairs
from concord.session import settle

#: Characters of a phrase's anchor; a shorter phrase is its own anchor.
ANCHOR = 4


def _grams(chars: Column, size: int) -> Column:
    """All runs of ``size`` characters, from an array of characters."""
    starts = F.filter(F.sequence(F.lit(0), F.size(chars) - size), lambda i: i >= 0)
    return F.when(F.size(chars) >= size, F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])))


def _contained(sizes: list[int], known: dict[str, list[str]]):
    """Function of a text: its phrases, searched for where it holds their anchor; nested so that tasks receive it by value."""
    @F.pandas_udf("array<string>")
    def contained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                held = known.keys() & {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}
                out.append([phrase for anchor in held for phrase in known[anchor] if phrase in text])
            yield pd.Series(out, dtype=object)

    return contained


def anchors(phrases: DataFrame) -> DataFrame:
    """(phrase, anchor): of each distinct phrase in lower case the run of characters that the fewest phrases hold."""
    low = phrases.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct().withColumn("_chars", F.split("phrase", ""))
    runs = F.coalesce(F.array_distinct(_grams(F.col("_chars"), ANCHOR)), F.array("phrase"))
    held = settle(low.select("phrase", F.explode(runs).alias("anchor")))
    counted = held.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    return held.join(counted, "anchor").groupBy("phrase").agg(F.min(F.struct("_n", "anchor")).alias("_a")).select("phrase", F.col("_a.anchor").alias("anchor"))


def phrase_hits(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, limit: int = pairs.BROADCAST_ROWS) -> DataFrame:
    """Distinct (id, phrase) of texts that contain a phrase, both in lower case; null texts contain none.

    Only texts that hold a phrase's anchor are searched for the phrase itself.  Up to ``limit`` phrases travel to
    every task, and texts stay where they are and only their phrases leave them; more meet the texts' runs in a join
    on the anchor.
    """
    known = settle(anchors(phrases))
    sizes = sorted(r[0] for r in known.select(F.length("anchor").alias("n")).distinct().collect())  # at most ANCHOR values
    low = texts.select(id_col, F.lower(text_col).alias("_low")).filter(F.col("_low").isNotNull())
    if not sizes:
        return low.select(id_col, F.lit("").alias("phrase")).filter(F.lit(False))
    if known.count() <= limit:
        listed: dict[str, list[str]] = {}
        for r in known.collect():
            listed.setdefault(r["anchor"], []).append(r["phrase"])
        return low.select(id_col, F.explode(_contained(sizes, listed)("_low")).alias("phrase")).distinct()
    chars = low.withColumn("_chars", F.split("_low", ""))
    runs = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.col("_chars"), n), F.array().cast("array<string>")) for n in sizes])))
    near = settle(chars.select(id_col, F.explode(runs).alias("anchor")).join(known, "anchor").select(id_col, "phrase").distinct())
    return near.join(low, id_col).filter(F.col("_low").contains(F.col("phrase"))).select(id_col, "phrase").distinct()


def expanded(
    texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, intro: str = vocab.DOMAIN_INTRO, outro: str = vocab.DOMAIN_OUTRO,
    limit: int = pairs.BROADCAST_ROWS,
) -> DataFrame:
    """(id, text) framed with a line for each entry of a dictionary that the text mentions, for any dictionary.

    ``dictionary`` (position, phrase, synonyms): an entry is mentioned by its phrase or any synonym; lines stand by
    position.  Ids must be unique; a null text stays null.
    """
    words = dictionary.select("position", "phrase", "synonyms", F.explode(F.concat(F.array("phrase"), "synonyms")).alias("_word"))
    words = settle(words.withColumn("_word", F.lower("_word")))
    hits = phrase_hits(texts, id_col, text_col, words.select(F.col("_word").alias("phrase")), limit).withColumnRenamed("phrase", "_word")
    line = F.concat(F.lit("- "), "phrase", F.lit(": "), F.array_join("synonyms", ", "))
    lines = hits.join(words, "_word").groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_set(F.struct("position", line.alias("line")))), lambda p: p["line"]).alias("_lines"))
    return texts.select(id_col, text_col).join(lines, id_col, "left").select(id_col, F.concat(
        F.lit(intro + "\n"), text_col, F.lit("\n" + outro + "\n"), F.coalesce(F.array_join("_lines", "\n"), F.lit(""))).alias("text"))
