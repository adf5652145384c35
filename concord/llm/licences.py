"""Licence scans: sparse TF-IDF cosines of lines and whole texts to templates, then inheritance along paths.

Word frequencies come from all documents.  A line can only reach the asked cosine if it holds one of a template's
heaviest words (without them the rest of the template is too light), so only such lines are weighed.  Texts that are
a licence as a whole cover their directory; every file without a licence of its own takes that of the nearest
directory above it that has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.words import Words, distinct, slices, words_of
from concord.session import local_table, settle

#: (licence, kind, text).  Short notices as they stand in headers, and the openings of licence files.
TEMPLATES = [
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "header", "Released under the MIT License."),
    ("MIT", "file", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "header", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
#: Cosine from which a line bears a licence, and from which a whole text is a licence file.
LINE, FILE = 0.80, 0.50


def _line_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line of each word, and the hashes of the words without signs around them (0: nothing is left)."""
    data = w.data
    letter = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    ahead = np.concatenate([[0], np.cumsum(letter)])
    some = ahead[w.ends] > ahead[w.starts]
    places = np.flatnonzero(letter)
    first = places[np.minimum(ahead[w.starts], max(len(places) - 1, 0))] if len(places) else w.starts
    last = places[np.maximum(ahead[w.ends] - 1, 0)] + 1 if len(places) else w.ends
    bare = Words(data, np.where(some, first, w.starts), np.where(some, last, w.ends), w.row, w.first)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    return breaks[w.starts], np.where(some, bare.hashes(), 0)


def _hashes_of(texts: list[str]) -> list[np.ndarray]:
    return [h[h != 0] for t in texts for h in [_line_words(words_of(pa.array([t]), lower=True))[1]]]


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): documents that hold the word, over all whole texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"), lower=True)
                _, h = _line_words(w)
                key = np.sort(w.row.astype(np.uint64) << np.uint64(48) | h & np.uint64((1 << 48) - 1))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                found, _, number = distinct(key & np.uint64((1 << 48) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.bincount(number, minlength=len(found)))], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _short(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << 48) - 1)).astype(np.int64)


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, line_cosine: float = LINE, file_cosine: float = FILE) -> DataFrame:
    """(doc_id, licence, cosine, is_file) of documents with a licence of their own.

    ``docs`` has doc_id and text.  The best template decides, ties by the template's place in the list; is_file says
    that the whole text reaches ``file_cosine``.  Null and empty texts have none, and rows with a null doc_id are left
    out; of rows that repeat a doc_id the best counts.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = settle(frequencies(text))
    n_docs = max(text.count(), 1)
    template_words = [_short(h) for h in _hashes_of([t[2] for t in templates])]
    asked = sorted({int(x) for h in template_words for x in h})
    wanted = local_table(spark, [(x,) for x in asked], "word bigint")  # words of the templates only
    found = {r[0]: r[1] for r in known.join(F.broadcast(wanted), "word").collect()}
    idf = {x: float(np.log((1 + n_docs) / (1 + found.get(x, 0)))) + 1 for x in asked}
    weights, anchors = [], set()
    for number, h in enumerate(template_words):
        word, times = np.unique(h, return_counts=True)
        v = times * np.array([idf[int(x)] for x in word])
        v = v / np.linalg.norm(v)
        weights += [(int(x), number, float(y)) for x, y in zip(word, v, strict=True)]
        order = np.argsort(-v, kind="stable")
        rest = np.sqrt(np.maximum(np.cumsum(v[order][::-1] ** 2)[::-1], 0))  # norm from each place on
        anchors |= {int(x) for x in word[order][rest >= min(line_cosine, file_cosine)]}
    marks = np.array(sorted(anchors), np.int64)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word counts of lines (and of whole texts, as line -1) that hold an anchor."""
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"), lower=True)
                line, h = _line_words(w)
                word = _short(h)
                hit = np.isin(word, marks)
                if not hit.any():
                    continue
                doc, out = np.asarray(part.column("doc_id")), []
                for unit, keep in ((line, np.isin(line, line[hit])), (np.full(len(word), -1), np.isin(w.row, w.row[hit]))):
                    at = np.flatnonzero(keep & (h != 0))
                    order = at[np.lexsort((word[at], unit[at], w.row[at]))]
                    key = np.stack([w.row[order], unit[order], word[order]])
                    new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
                    begin = np.flatnonzero(new)
                    times = np.diff(np.append(begin, len(order)))
                    out.append((doc[key[0][begin]], key[1][begin], key[2][begin], times))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "line", "word", "times"])

    counted = text.mapInArrow(units, "doc_id bigint, line bigint, word bigint, times bigint")
    heavy = local_table(spark, weights, "word bigint, template int, share double").groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("template", "share"))).alias("shares"))
    weighed = counted.join(known.hint("shuffle_hash"), "word").withColumn(
        "v", F.col("times") * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("n"))) + 1)).join(F.broadcast(heavy), "word", "left")
    dots = [F.sum(F.col("v") * F.coalesce(F.element_at("shares", F.lit(k)), F.lit(0.0))).alias(f"dot{k}") for k in range(len(templates))]
    units_ = weighed.groupBy("doc_id", "line").agg(F.sum(F.col("v") * F.col("v")).alias("norm"), *dots)
    best = F.greatest(*[F.struct(F.round(F.col(f"dot{k}") / F.sqrt("norm"), 9).alias("cosine"), F.lit(-k).alias("order")) for k in range(len(templates))])
    units_ = units_.withColumn("best", best).filter(
        F.when(F.col("line") < 0, F.col("best.cosine") >= file_cosine).otherwise(F.col("best.cosine") >= line_cosine))
    names = F.array(*[F.lit(t[0]) for t in templates])
    return units_.groupBy("doc_id").agg(F.max("best").alias("best"), F.max(F.col("line") < 0).alias("is_file")).select(
        "doc_id", F.element_at(names, 1 - F.col("best.order")).alias("licence"), F.col("best.cosine").alias("cosine"), "is_file")


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """``files`` (doc_id, path) with licence, cosine and how it is known.

    how is "file" or "header" for a licence of the file's own, "inherited" for that of the nearest directory above that
    holds a licence file (of several the largest cosine, then the smallest doc_id), or null.  The root counts as a
    directory.  A null path has no directories.
    """
    placed = files.select("doc_id", "path").join(own, "doc_id", "left")
    folder = F.regexp_replace("path", "[^/]*$", "")
    with_folder = placed.withColumn("folder", folder)
    covered = with_folder.filter("is_file and folder is not null").groupBy("folder").agg(
        F.max(F.struct("cosine", (-F.col("doc_id")).alias("least"), "licence")).alias("top")).select("folder", F.col("top.licence").alias("from_above"))
    # Each distinct directory asks all directories above it, itself included; the longest that answers is nearest.
    folders = with_folder.select("folder").filter("folder is not null").distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n - 1), "/"), F.when(n > 1, "/").otherwise("")))
    asked = folders.select("folder", F.explode(above).alias("up"))
    nearest = asked.join(covered.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(
        F.max_by("from_above", F.length("up")).alias("from_above"))
    out = with_folder.join(nearest, "folder", "left")
    return out.select(
        "doc_id", "path", F.coalesce("licence", "from_above").alias("licence"), "cosine",
        F.when(F.col("licence").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header"))
        .when(F.col("from_above").isNotNull(), "inherited").alias("how"))
