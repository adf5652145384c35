"""Near-duplicate join by Jaccard similarity of word n-grams, with several global orders of the n-grams.

Two sets that are similar enough share one of their first few members, whatever order is laid over all members (the
prefix filter).  Each of ORDERS orders puts members that a sketch of the whole corpus holds for rare first and breaks
ties by its own hash.  The first order's prefixes generate candidates; a pair is verified on the whole sets only if its
prefixes meet under every order.

Equal sets are one class.  In a prefix's bucket every class is first held against one hub, the bucket's most typical
class, so that a large group of near copies gives as many pairs as it has members.  Links that the hubs don't show are
then found exactly: near a hub by what classes share of their differences from it (see ``may_link``), far from
it by pairs of the bucket that are still in different components.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.components import components
from concord.llm.words import Words, long_ints, mixed, slices, words_of
from concord.session import scratch_dir, settle

GRAM, PERCENT, ORDERS = 4, 85, 3
#: Counters of the sketch for each order.  They only put members into an order, so they decide speed, not results.
COUNTERS = 1 << 18
#: Counters in one row of a sketch on its way, and partial sketches that one task adds up.
CHUNK, FAN_IN = 1 << 12, 64
#: Share in percent from which a class counts as near its hub.
NEAR = 50
#: So many classes near one hub, at most, are paired with one another; among more, those that share differences from it.
FEW = 16
#: A set of so many members for each bucket in which it meets a hub is held against it.
MEETS = 200
#: Pairs of one class that meet in one place; pairs compared at once (both sides' rows fit into 16 bits).
PAIRS, SLICE_PAIRS = 500, 30_000
_ORDER_COLUMNS = [f"order_{k}" for k in range(1, ORDERS)]
#: 48 bits name a member of a set.
_NAME = np.uint64((1 << 48) - 1)


def sets_of(w: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and name of each member of each row's set, ascending: distinct n-grams, or all words if they are fewer."""
    h = w.hashes()
    at = w.window_starts(gram)
    names, rows = w.window_hashes(h, at, gram), w.row[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < gram))
    if len(few):
        whole = np.array([w.window_hashes(h, w.first[r : r + 1], int(w.counts[r]))[0] for r in few], np.uint64)
        names, rows = np.concatenate([names, whole]), np.concatenate([rows, few])
    key = np.sort(rows.astype(np.uint64) << np.uint64(48) | names & _NAME)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(48)).astype(np.int64), key & _NAME


def class_of(rows: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits that name a set: a sum over its members, mixed with its size."""
    total = np.zeros(len(sizes), np.uint64)
    if len(rows):
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total[rows[begins]] = np.add.reduceat(mixed(names, 7), begins)
    return long_ints(mixed(total + sizes.astype(np.uint64), 8))


def _slots(names: np.ndarray, order: int) -> np.ndarray:
    return (mixed(names, 11 + order) >> np.uint64(20)).astype(np.int64) % COUNTERS


def prefix_size(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Members that a set must show: whoever is similar shares one of them."""
    return sizes - (percent * sizes + 99) // 100 + 1


def prefixes(rows: np.ndarray, names: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Places of the members in the prefixes of all rows, under one order."""
    seen = np.minimum(sketch[order][_slots(names, order)], (1 << 16) - 1).astype(np.uint64)
    key = rows.astype(np.uint64) << np.uint64(48) | seen << np.uint64(32) | mixed(names, 31 + order) >> np.uint64(32)
    ranked = np.argsort(key)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(ranked)) - np.repeat(begin, sizes)
    return ranked[place < np.repeat(prefix_size(sizes, percent), sizes)]


def parities(rows: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each set a bit for each place that a member can fall on, set if an odd number of members does.

    A member that only one of two sets has turns one bit, so two sets differ in at least as many members as bits.  A set
    has as many bits as members, rounded up to a power of two, 64 at least; halves laid over each other (xor) give those
    of half the size.
    """
    words = (2 ** np.ceil(np.log2(np.maximum(sizes, 64) / 64))).astype(np.int64)
    first = np.cumsum(words) - words
    bit = 64 * first[rows] + (mixed(names, 41) >> np.uint64(20)).astype(np.int64) % (64 * words[rows])
    at, held = np.unique(bit, return_counts=True)
    at = at[held % 2 == 1]
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_or.at(out, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return _lists(out.view(np.int64), words)


def _sketch(docs: DataFrame, gram: int) -> np.ndarray:
    """Occurrences of members over the whole corpus, ORDERS rows of COUNTERS counters (their size is fixed)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((ORDERS, COUNTERS), np.int64)
        for batch in batches:
            for part in slices(batch):
                _, names = sets_of(words_of(part.column("text"), lower=True), gram)
                for order in range(ORDERS):
                    own[order] += np.bincount(_slots(names, order), minlength=COUNTERS)
        if own.any():
            rows = own.astype(np.uint32).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([r.tobytes() for r in rows], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for raw in table["counts"].to_pylist():
            total += np.frombuffer(raw, np.uint32)
        return pa.table({"chunk": table["chunk"].slice(0, 1), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    fields = "chunk bigint, counts binary"
    parts = docs.select("text").mapInArrow(count, fields).withColumn("task", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    some = parts.groupBy("task", "chunk").applyInArrow(lambda t: add(t.select(["chunk", "counts"])), fields)
    rows = some.groupBy("chunk").applyInArrow(add, fields).collect()
    out = np.zeros((ORDERS * COUNTERS // CHUNK, CHUNK), np.uint32)
    for chunk, raw in rows:
        out[chunk] = np.frombuffer(raw, np.uint32)
    return out.reshape(ORDERS, COUNTERS)


def _classes(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, names = sets_of(words_of(part.column("text"), lower=True), gram)
                sizes = np.bincount(rows, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes), pa.array(class_of(rows, names, sizes))],
                    ["doc_id", "text_hash", "n_shingles", "class"])

    return run


def _prefix_rows(gram: int, percent: int, sketch):
    """(member, class, size, typical): typical is the share of the set that the corpus repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        usual = np.median(counts[0])
        for batch in batches:
            for part in slices(batch):
                rows, names = sets_of(words_of(part.column("text"), lower=True), gram)
                sizes = np.bincount(rows, minlength=part.num_rows)
                known = class_of(rows, names, sizes)
                common = np.bincount(rows, counts[0][_slots(names, 0)] > 1.5 * usual + 1, part.num_rows)
                typical = (common * 1000 // np.maximum(sizes, 1)).astype(np.int64)
                at = prefixes(rows, names, sizes, counts, 0, percent)
                row = rows[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at].astype(np.int64)), pa.array(known[row]), pa.array(sizes[row]), pa.array(typical[row])],
                    ["member", "class", "size", "typical"])

    return run


def _with_orders(gram: int, percent: int, sketch):
    """(class, text) with its set's size and parities, and the prefixes under the orders after the first, 32 bits of each
    member (they only rule out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, names = sets_of(words_of(part.column("text"), lower=True), gram)
                sizes = np.bincount(rows, minlength=part.num_rows)
                orders = []
                for order in range(1, ORDERS):
                    at = prefixes(rows, names, sizes, sketch.value, order, percent)
                    orders.append(_lists(names[at].astype(np.uint32).view(np.int32), np.bincount(rows[at], minlength=part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), part.column("text"), pa.array(sizes), parities(rows, names, sizes), *orders], ["class", "text", "size", "bits", *_ORDER_COLUMNS])

    return run


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))


def _shared(a_row: np.ndarray, a_name: np.ndarray, b_row: np.ndarray, b_name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which members of side a, and which of side b, the other side of the same pair has.  Members of a pair differ."""
    a = a_row.astype(np.uint64) << np.uint64(48) | a_name
    b = b_row.astype(np.uint64) << np.uint64(48) | b_name
    order = np.argsort(a)
    at = np.minimum(np.searchsorted(a[order], b), max(len(a) - 1, 0))
    in_a = a[order][at] == b if len(a) else np.zeros(len(b), bool)
    in_b = np.zeros(len(a), bool)
    in_b[order[at[in_a]]] = True
    return in_b, in_a


def _compare(gram: int, percent: int, sketch, full: bool):
    """Both texts of each pair as sets: their share, whether they link, and in what they differ if they are near.

    They link if their prefixes meet under every order and the whole sets share enough.  A text that stands in many
    pairs of a slice as ``b`` is cut into words once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "a_text", SLICE_PAIRS):
                n = part.num_rows
                _, first, which = np.unique(np.asarray(part.column("b")), return_index=True, return_inverse=True)
                both = pa.concat_arrays([part.column("a_text"), part.column("b_text").take(pa.array(first))])
                rows, names = sets_of(words_of(both, lower=True), gram)
                sizes = np.bincount(rows, minlength=n + len(first))
                begin = np.cumsum(sizes) - sizes

                def sides(places: np.ndarray, which=which, rows=rows, names=names, n=n, total=len(sizes)):
                    """Pair and name of the members at some places, for a and, once for each of its pairs, for b."""
                    places = np.sort(places)
                    held = np.bincount(rows[places], minlength=total)
                    start = np.cumsum(held) - held
                    a = places[: held[:n].sum()]
                    size = held[n + which]
                    pair = np.repeat(np.arange(n), size)
                    b = places[np.repeat(start[n + which] - (np.cumsum(size) - size), size) + np.arange(len(pair))]
                    return rows[a], names[a], pair, names[b]

                meets = np.ones(n, bool)
                for order in range(ORDERS):
                    a_row, a_name, b_row, b_name = sides(prefixes(rows, names, sizes, sketch.value, order, percent))
                    in_b, _ = _shared(a_row, a_name, b_row, b_name)
                    meets &= np.bincount(a_row[in_b], minlength=n) > 0
                a_row, a_name, b_row, b_name = sides(np.arange(len(rows)))
                in_b, in_a = _shared(a_row, a_name, b_row, b_name)
                common = np.bincount(a_row[in_b], minlength=n)
                union = sizes[:n] + sizes[n + which] - common
                linked = meets & (100 * common >= percent * union)
                if not full:
                    kept = pa.array(linked)
                    yield pa.RecordBatch.from_arrays([part.column("a").filter(kept), part.column("b").filter(kept)], ["a", "b"])
                    continue
                near = 100 * common >= NEAR * union
                lists = []
                for row, name, drop in ((b_row, b_name, in_a), (a_row, a_name, in_b)):
                    stays = ~drop & near[row]
                    found = _lists(name[stays].astype(np.int64), np.bincount(row[stays], minlength=n))
                    lists.append(pc.if_else(pa.array(near), found, pa.nulls(n, found.type)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), part.column("size"), pa.array(100.0 * common / np.maximum(union, 1)), pa.array(linked), *lists],
                    ["class", "hub", "size", "share", "linked", "missing", "extra"])

    return run


@contextmanager
def by_class(df: DataFrame, with_orders, fields: str) -> Iterator[DataFrame]:
    """One row of ``df`` for each class, passed through ``with_orders`` and written to the shared folder in buckets of
    ``class``, so that later joins on it move the other side only.  The session's catalog knows the table meanwhile."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"concord_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, "class").dropDuplicates(["class"]).mapInArrow(with_orders, fields)
    rows.write.bucketBy(buckets, "class").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def with_sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b, ...) with columns of both classes, as a_<column> and b_<column>.

    Only what belongs to ``a`` moves, to where ``b`` is; a ``b`` of many pairs is copied once for each PAIRS of them.
    """
    side = lambda s: table.select(F.col("class").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("copies"))
    dealt = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    b = side("b").join(copies, "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(side("a"), "a").join(b, ["b", "copy"]).drop("copy")


def busier_last(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), each turned so that ``b`` is the class with more pairs."""
    often = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("often"))
    side = lambda s: often.select(F.col("class").alias(s), F.col("often").alias(f"{s}_often"))
    turned = F.col("a_often") > F.col("b_often")
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def compatible(x: str, y: str, percent: int):
    """Sizes that allow a link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def similar_bits(percent: int):
    """Whether the parities (see ``parities``) of pairs ``with_sides`` allow a link; sets of very unlike sizes may."""
    def halved(x: str, y: str):
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    turned = F.zip_with(halved("a_bits", "b_bits"), halved("b_bits", "a_bits"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    few = (100 + percent) * F.aggregate(turned, F.lit(0), lambda total, n: total + n) <= (100 - percent) * (F.col("a_size") + F.col("b_size"))
    return F.coalesce(few, F.lit(True))


def differences(held: DataFrame, percent: int) -> DataFrame:
    """One row for each class near a hub of more than FEW and each difference between them that another component near
    the hub shares.

    ``held`` has (class, hub, size, linked, root, missing, extra): the hub's members that the class lacks, and the class's
    that the hub lacks.  Columns: class, hub, member, size, linked, n differences, weight = 100 * missing + percent *
    extra, hub_size, and the difference's place in the class's list, rare ones first.  Differences of one component alone
    are left out, since links inside it are of no use; so are those that stand too late in their list for any link.
    """
    several = [F.min("root").alias("root_1"), F.max("root").alias("root_2")]
    hubs = held.groupBy("hub").agg(F.count(F.lit(1)).alias("classes"), *several).filter((F.col("classes") > FEW) & (F.col("root_1") != F.col("root_2"))).select("hub")
    rows = held.join(hubs, "hub").select("class", "hub", "size", "linked", "root", F.size("missing").alias("missing"), F.size("extra").alias("extra"),
                                         F.explode(F.concat("missing", "extra")).alias("member"))
    often = rows.groupBy("hub", "member").agg(F.count(F.lit(1)).alias("often"), *several).filter("root_1 <> root_2").select("hub", "member", "often")
    # Two components share no other differences; those come first in a class's list, in as many places.
    own = Window.partitionBy("hub", "class")
    shared = rows.drop("root").join(often, ["hub", "member"]).withColumn("shared", F.count(F.lit(1)).over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy("often", "member")))
    n = F.col("missing") + F.col("extra")
    placed = shared.select(
        "class", "hub", "member", "size", "linked", n.alias("n"), (100 * F.col("missing") + percent * F.col("extra")).alias("weight"),
        (F.col("size") - F.col("extra") + F.col("missing")).alias("hub_size"), (n - F.col("shared") + F.col("rank")).alias("place"))
    # See may_link: weight > (100 - percent) * hub_size for a class that isn't linked to the hub, and one of both isn't.
    least = F.col("weight") - F.when(F.col("linked"), 0).otherwise((100 - percent) * F.col("hub_size"))
    return settle(placed.filter((100 + percent) * (F.col("n") - F.col("place") + 1) >= least))


def may_link(x: str, y: str, percent: int):
    """Whether classes that first meet in this difference from a hub can be linked.

    Let s be the number of differences that both share, and t = percent / 100.  They link only if (1 + t) * s >=
    d(x) + d(y) - (1 - t) * |hub|, with d = missing + t * extra; and of their lists in one order, s is at most what
    stands from the first shared difference on, in either.
    """
    need = F.col(f"{x}.weight") + F.col(f"{y}.weight") - (100 - percent) * F.col(f"{x}.hub_size")
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place")) + 1
    return ((100 + percent) * rest >= need) & compatible(f"{x}.size", f"{y}.size", percent)


def apart_from_hub(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes near one hub, in different components (``root``), that may be linked nevertheless.

    If x is linked to the hub and y is, too, they are in one component; so y is taken not to be.  Then d(y) > (1 - t) *
    |hub|, hence x and y share differences (see ``may_link``) and meet in the first one.
    """
    x, y = met.alias("x"), met.filter("not linked").alias("y")
    return x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.member") == F.col("y.member")) & (F.col("x.root") != F.col("y.root"))
                  & (F.col("x.linked") | (F.col("x.class") < F.col("y.class"))) & may_link("x", "y", percent)).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def apart_among_few(held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes near one hub of at most FEW, in different components; two linked to the hub are in one."""
    hubs = held.groupBy("hub").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes").between(2, FEW)).select("hub")
    near = held.select("class", "hub", "size", "linked", "root").join(hubs, "hub")
    x, y = near.alias("x"), near.filter("not linked").alias("y")
    return x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.linked") | (F.col("x.class") < F.col("y.class")))
                  & compatible("x.size", "y.size", percent)).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))


def near_duplicates(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash (xxhash64 of the text, to find the row again).

    A document's set holds the distinct runs of ``gram`` words, A-Z in lower case (all its words as one if they are
    fewer; none for null, empty and blank texts).  Two documents link if 100 * intersection >= percent * union; empty
    sets link with nothing.  component_id is the smallest doc_id that links reach, the document's own included; null
    ids are never the smallest, and a component of null ids only has null.  Other columns are ignored; repeated rows
    give repeated results.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = settle(text.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _classes(gram), "doc_id bigint, text_hash bigint, n_shingles bigint, class bigint"))
    sketch = spark.sparkContext.broadcast(_sketch(text, gram))
    full = every.filter("n_shingles > 0")
    # A class's text is that of its first document, found by id and text; rows without an id come last.
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("pick")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("first_id"), pick).select("class", "first_id", F.col("pick.text_hash").alias("text_hash"))
    prefix = text.select("text").mapInArrow(_prefix_rows(gram, percent, sketch), "member bigint, class bigint, size bigint, typical bigint")
    # Buckets of at least two classes, each with its most typical class; rows move once.
    bucket = Window.partitionBy("member")
    met = prefix.repartition("member").dropDuplicates(["member", "class"]).withColumns({
        "classes": F.count(F.lit(1)).over(bucket), "top": F.max(F.struct("typical", "class", "size")).over(bucket)}).filter("classes > 1").select(
        "member", "class", "size", F.col("top.class").alias("hub"), F.col("top.size").alias("hub_size"))
    by_size = Window.partitionBy("member").orderBy("size")
    fits = F.coalesce(compatible("size", F.lag("size").over(by_size), percent), F.lit(False)) | F.coalesce(
        compatible("size", F.lead("size").over(by_size), percent), F.lit(False))
    members = settle(met.withColumn("fits", fits))

    # Texts of the classes that share a bucket with one of a fitting size; a class is read from its first document.
    asked = members.filter("fits").select("class").distinct()
    members = members.drop("fits")
    named = text.withColumn("text_hash", F.xxhash64("text"))
    one = named.filter("doc_id is not null").unionByName(named.filter("doc_id is null").distinct()).alias("one")
    wanted = asked.join(classes, "class").alias("wanted")
    chosen = one.join(wanted, F.col("one.doc_id").eqNullSafe(F.col("wanted.first_id")) & (F.col("one.text_hash") == F.col("wanted.text_hash")))
    fields = "class bigint, text string, size bigint, bits array<bigint>, " + ", ".join(f"{c} array<int>" for c in _ORDER_COLUMNS)
    with by_class(chosen.select("class", "text"), _with_orders(gram, percent, sketch), fields) as texts:
        root = _roots(members, texts, gram, percent, sketch)
    ends = classes.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = ends.join(ends.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("class", "component_id")
    return every.join(ids, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")


def _roots(members: DataFrame, texts: DataFrame, gram: int, percent: int, sketch) -> DataFrame:
    """(node, root) for each linked class.  ``members`` has (member, class, size, hub, hub_size), ``texts`` each class's text."""
    def compared(pairs: DataFrame, full: bool = False) -> DataFrame:
        fields = "class bigint, hub bigint, size bigint, share double, linked boolean, missing array<bigint>, extra array<bigint>"
        return with_sides(pairs, texts, ["text"]).mapInArrow(_compare(gram, percent, sketch, full), fields if full else "a bigint, b bigint")

    # Classes against the hub of their bucket: how much they share, and in what they differ if it is half or more.
    # Large sets that meet a hub in very few buckets are left to the pairs below.
    to_hub = settle(members.filter((F.col("class") != F.col("hub")) & compatible("size", "hub_size", percent)).groupBy(
        F.col("class").alias("a"), F.col("hub").alias("b"), "size").agg(F.count(F.lit(1)).alias("meets")).filter(
        F.col("meets") * MEETS >= F.col("size")).drop("meets"))
    held = settle(compared(to_hub, full=True))
    near = F.col("share") >= NEAR
    linked = held.filter("linked").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    root = components(linked)
    rooted = lambda df: df.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    # Others that a hub doesn't join may be near copies of one another: in each difference from the hub that they share,
    # they are held against the one that differs least, which joins large groups by as many pairs as they have members.
    met = differences(rooted(held.filter(near)), percent)
    second = met.filter("not linked").groupBy("hub", "member").agg(
        F.min_by(F.struct("class", "size", "n", "place", "weight", "hub_size"), F.struct("weight", "class")).alias("y"))
    x, y = met.filter("not linked").alias("x"), second.select("hub", "member", "y.*").alias("y")
    again = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.member") == F.col("y.member")) & (F.col("x.class") != F.col("y.class"))
                   & may_link("x", "y", percent)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    linked = settle(linked.unionByName(compared(settle(again.distinct()))))
    root = components(linked)
    near_hub = apart_from_hub(rooted(met), percent).unionByName(apart_among_few(rooted(held.filter(near)), percent))
    # Classes that are far from their hub, or not held against it, are compared with those of their bucket that are in
    # other components.  By the triangle inequality of the distance 1 - share, one that is far has no link to one that
    # is nearer than NEAR + 100 - percent.
    share = F.when(F.col("class") == F.col("hub"), 100.0).otherwise(F.col("share"))
    placed = rooted(members).join(held.select("class", "hub", "share"), ["class", "hub"], "left").withColumn("far", F.coalesce(share < NEAR, F.lit(True))).withColumn(
        "step", F.when(share.isNull(), 0).when(share < NEAR + 100 - percent, 1).otherwise(2).cast("byte"))
    open_ = placed.groupBy("member").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("far").alias("any_far")).filter(
        "x != y and any_far").select("member")
    placed = settle(placed.join(open_, "member").select("member", "class", "size", "root", "step", "far"))
    x, y = placed.filter("far").alias("x"), placed.alias("y")
    reach = (F.col("x.step") == 0) | (F.col("y.step") < 2)
    far = x.join(y, (F.col("x.member") == F.col("y.member")) & (F.col("x.root") != F.col("y.root")) & reach
                 & (~F.col("y.far") | (F.col("x.class") < F.col("y.class"))) & compatible("x.size", "y.size", percent)).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
    # Parities must be similar and prefixes under all orders meet before texts are read.
    apart = busier_last(settle(far.unionByName(near_hub).distinct()))
    apart = settle(with_sides(apart, texts, ["size", "bits"]).filter(similar_bits(percent)).select("a", "b"))
    meet = [F.arrays_overlap(f"a_{c}", f"b_{c}") for c in _ORDER_COLUMNS]
    apart = settle(with_sides(apart, texts, _ORDER_COLUMNS).filter(reduce(and_, meet)).select("a", "b"))
    return components(linked.unionByName(compared(apart)))
