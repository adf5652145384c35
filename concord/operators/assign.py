"""One-to-one matching over scored edges, for all groups at once.

Every operator takes an edge table and returns the chosen edges.  Groups of at most
``cap`` edges are folded into one row and solved there; larger groups, however large,
are solved by rounds of joins and aggregates with the same result.

The optimum is made unique: equal totals are decided by the total of a 20-bit tie value per
edge, equal totals of these by that of a second value.  So a large group may be thinned out
and taken apart before it is solved, and the fold and the rounds agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.pairs import BROADCAST_ROWS
from concord.session import GREEDY_FOLD, OPTIMAL_FOLD, settle


def split_by_size(edges: DataFrame, group: list[str], cap: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of groups with at most ``cap`` edges, and those of larger groups (None when there are none)."""
    large = settle(edges.groupBy(*group).count().filter(F.col("count") > cap).select(*group))
    if large.isEmpty():
        return edges, None
    return edges.join(large, group, "left_anti"), edges.join(large, group, "left_semi")


def greedy(
    edges: DataFrame,
    group: list[str],
    left: str,
    right: str,
    order: list[str],
    descending: bool = True,
    cap: int = GREEDY_FOLD,
    ends: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Walk the edges of a group in ``order``, keeping each whose two ends are both still free.

    ``order`` plus both ends must rank the edges strictly.  With ``descending=False`` and the
    ends themselves as order this is first fit.

    With ``ends`` an edge links two classes of like ends, columns ``_left`` and ``_right``, and stands for all edges
    from the one's ends to the other's: ``ends`` are (group, _left, left) and (group, _right, right).  Only larger
    scores first.  The walk and its result are the same, but the edges between two classes are never formed
    where their number is more than ``cap``.
    """
    if ends is not None:
        if not descending:
            raise ValueError("classes of ends are walked from the largest score on")
        edges, lefts, rights = _single_classes(edges, group, left, right, order, *ends)
        if _number_formed(edges, group, lefts, rights) > max(cap, edges.count()):
            return _greedy_classes(edges, group, left, right, order, lefts, rights)
        edges = _formed_edges(edges, group, lefts, rights).drop("_left", "_right")
    edges = settle(edges)
    ranked = [*order, *[c for c in (left, right) if c not in order]]
    carried = [*ranked, *[c for c in edges.columns if c not in ranked and c not in group]]
    small, large = split_by_size(edges, group, cap)
    chosen = _greedy_folded(small, group, left, right, carried, descending)
    if large is None:
        return chosen
    scores = order[: min([order.index(c) for c in (left, right) if c in order], default=len(order))]
    rounds = _greedy_rounds(large, group, left, right, carried, descending, scores)
    return rounds if small.isEmpty() else chosen.unionByName(rounds)


def _greedy_folded(edges, group, left, right, carried, descending) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct(*carried)), asc=not descending)

    def take(kept: Column, e: Column) -> Column:
        clash = F.exists(kept, lambda k: (k[left] == e[left]) | (k[right] == e[right]))
        return F.when(clash, kept).otherwise(F.array_append(kept, e))

    rows = edges.groupBy(*group).agg(ranked.alias("_edges"))
    kept = F.aggregate("_edges", F.filter("_edges", lambda e: F.lit(False)), take)
    return rows.select(*group, F.inline(kept))


def _greedy_rounds(edges, group, left, right, carried, descending, scores) -> DataFrame:
    """Rounds of mutual best edges: an edge first at both ends is always taken by the walk.

    The best edge per end is a max or min aggregate, combined before the shuffle, so an end
    with very many edges costs no more than one row per input task.  Blocks of equal scores are
    paired whole before that, in every round.
    """
    best = F.max if descending else F.min
    taken = None
    while True:
        paired = _tied_blocks(edges, group, left, right, carried, descending, scores)
        if paired is not None:
            taken = paired if taken is None else taken.unionByName(paired)
            edges = settle(_without_ends(edges, paired, group, left, right))
        edge = F.struct(*carried).alias("_e")
        per_left = edges.groupBy(*group, left).agg(best(edge).alias("_e")).select(*group, "_e")
        per_right = edges.groupBy(*group, right).agg(best(edge).alias("_e")).select(*group, "_e")
        mutual = settle(per_left.join(per_right, [*group, "_e"], "left_semi").select(*group, "_e.*"))
        if mutual.isEmpty():
            return taken if taken is not None else edges.select(*group, *carried)
        taken = mutual if taken is None else taken.unionByName(mutual)
        edges = settle(_without_ends(edges, mutual, group, left, right))


def _single_classes(edges, group, left, right, order, lefts, rights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and ends, settled, with each end in one class: one that several classes name becomes a class of its own."""
    def single(ends: DataFrame, side: str, end: str) -> tuple[DataFrame, DataFrame | None]:
        """Ends with the class that each is in, as text, and the classes' new names where there are any."""
        ends = settle(ends.select(*group, F.col(side).cast("string").alias(side), end).filter(F.col(side).isNotNull()).distinct())
        several = settle(ends.filter(F.col(end).isNotNull()).groupBy(*group, end).count().filter("count > 1").select(*group, end))
        if several.isEmpty():
            return ends, None
        own = F.concat(F.lit("own "), F.col(end).cast("string"))
        named = settle(ends.join(_few(several.withColumn("_own", own)), [*group, end], "left"))
        renamed = named.select(*group, side, F.coalesce("_own", F.concat(F.lit("all "), F.col(side))).alias("_to")).distinct()
        return settle(named.select(*group, F.coalesce("_own", F.concat(F.lit("all "), F.col(side))).alias(side), end).distinct()), settle(renamed)

    (lefts, a), (rights, b) = single(lefts, "_left", left), single(rights, "_right", right)
    edges = edges.select(*group, F.col("_left").cast("string").alias("_left"), F.col("_right").cast("string").alias("_right"), *order)
    for side, renamed in (("_left", a), ("_right", b)):
        if renamed is not None:
            edges = edges.join(renamed, [*group, side]).drop(side).withColumnRenamed("_to", side)
    # of several edges between two classes only the best can be taken
    best = edges.groupBy(*group, "_left", "_right").agg(F.max(F.struct(*order)).alias("_s")).select(*group, "_left", "_right", "_s.*")
    held = [df.select(*group, side).distinct() for side, df in (("_left", lefts), ("_right", rights))]
    return settle(best.join(held[0], [*group, "_left"], "left_semi").join(held[1], [*group, "_right"], "left_semi")), lefts, rights


def _formed_edges(edges, group, lefts, rights) -> DataFrame:
    """All edges that edges between classes stand for."""
    return edges.join(lefts, [*group, "_left"]).join(rights, [*group, "_right"])


def _number_formed(edges, group, lefts, rights) -> int:
    """Their number, without forming them."""
    a = lefts.groupBy(*group, "_left").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("_a"))
    b = rights.groupBy(*group, "_right").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("_b"))
    n = edges.join(a, [*group, "_left"]).join(b, [*group, "_right"]).agg(F.sum((F.col("_a") * F.col("_b")).cast("decimal(38,0)"))).first()[0]
    return int(n or 0)


def _greedy_classes(edges, group, left, right, order, lefts, rights) -> DataFrame:
    """``_greedy_rounds`` over edges between classes of like ends, larger scores first.

    Of the edges between two classes the walk comes first to that of the largest free ends, so these alone stand for
    both classes when the best edge per class is looked for.  Whole blocks of equal scores are classes here;
    their free ends are ranked together and paired by rank.  A null end is never used up, as no edge clashes with it.
    """
    scored, taken = [*order, left, right], None
    while True:
        heads = [settle(df.groupBy(*group, side).agg(F.max(end).alias(end))) for df, side, end in ((lefts, "_left", left), (rights, "_right", right))]
        edges = settle(edges.join(heads[0].drop(left), [*group, "_left"], "left_semi").join(heads[1].drop(right), [*group, "_right"], "left_semi"))
        at, to, block = _block_sides(edges, group, "_left", "_right", True, order)
        first = {end: Window.partitionBy(*block).orderBy(F.desc(end)) for end in (left, right)}
        a, b = (
            members.join(df.filter(F.col(end).isNotNull()), [*group, side]).select(*block, end, F.row_number().over(first[end]).alias("_rank"))
            for members, df, side, end in ((at, lefts, "_left", left), (to, rights, "_right", right))
        )
        found = settle(a.join(b, [*block, "_rank"]).select(*group, *scored))
        if found.isEmpty():
            tops = _formed_edges(edges, group, *heads).filter(F.col(left).isNotNull() | F.col(right).isNotNull())
            tops = settle(tops.select(*group, "_left", "_right", F.struct(*scored).alias("_e")))
            per_left, per_right = (tops.groupBy(*group, side).agg(F.max("_e").alias("_e")) for side in ("_left", "_right"))
            found = settle(per_left.join(per_right, [*group, "_e"], "left_semi").select(*group, "_e.*"))
            if found.isEmpty():
                return taken if taken is not None else found
        taken = found if taken is None else taken.unionByName(found)
        lefts, rights = (settle(df.join(_few(found.select(*group, end)), [*group, end], "left_anti")) for df, end in ((lefts, left), (rights, right)))


def _few(df: DataFrame) -> DataFrame:
    """A settled table, sent to every task if it is small, so that the edges it is joined with stay where they are."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _without_ends(edges, taken, group, left, right) -> DataFrame:
    """Edges with both ends free; ``taken`` is a settled table of chosen edges."""
    taken = _few(taken.select(*group, left, right))
    for end in (left, right):
        edges = edges.join(taken.select(*group, end), [*group, end], "left_anti")
    return edges


def _tied_blocks(edges, group, left, right, carried, descending, scores) -> DataFrame | None:
    """What the walk takes from complete blocks of equal scores, all at once, as a settled table; None without any.

    Nothing outside a block can come between, so the walk takes the first left end with the first right end, the
    second with the second, and so on.
    """
    lefts, rights, block = _block_sides(edges, group, left, right, descending, scores)

    def ranked(members: DataFrame, end: str) -> DataFrame:
        first = Window.partitionBy(*block).orderBy(F.desc(end) if descending else F.asc(end))
        return members.select(*block, end, F.row_number().over(first).alias("_rank"))

    found = settle(ranked(lefts, left).join(ranked(rights, right), [*block, "_rank"]).select(*group, *scores, left, right))
    if found.isEmpty():
        return None
    if set(carried) == {*scores, left, right}:
        return found.select(*group, *carried)
    return settle(edges.join(_few(found), [*group, *scores, left, right], "left_semi").select(*group, *carried))


def _block_sides(edges, group, left, right, descending, scores) -> tuple[DataFrame, DataFrame, list[str]]:
    """Left and right ends in complete blocks of equal scores, each with its block, and the columns that name a block.

    A block is a set of left and a set of right ends, each linked with all of the other side by an edge of one score, the best
    that any of them has, and with no one else by such an edge.  A set of ends is known by its
    count and two combined hashes: ends that are linked with the same set by their best score are one side of a block if
    that set is linked by the same score with just them.  Edges are only counted and hashed per end, before any shuffle.
    """
    best = F.max if descending else F.min
    seen, own = ["_n", "_x", "_y"], ["_own_n", "_own_x", "_own_y"]

    def named(end: str, out: list[str]) -> list[Column]:
        hashes = F.xxhash64(end), F.xxhash64(F.lit("second"), end)
        return [F.count(F.lit(1)).alias(out[0]), *[F.bit_xor(h).alias(o) for h, o in zip(hashes, out[1:])]]

    def linked_best(end: str, other: str) -> DataFrame:
        """Each end with its best score and the name of the set that it is linked with by that score."""
        by_score = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*group, end, *scores).agg(*named(other, seen))
        return settle(by_score.groupBy(*group, end).agg(best(F.struct(*scores, *seen)).alias("_top")).select(*group, end, "_top.*"))

    def sides(ends: DataFrame, end: str) -> DataFrame:
        return ends.groupBy(*group, *scores, *seen).agg(*named(end, own))

    lefts, rights = linked_best(left, right), linked_best(right, left)
    block = [*group, *scores, *seen, *own]

    def turned(df: DataFrame) -> DataFrame:
        """The same from the other side: what an end is linked with, and its own set, change places."""
        other = dict(zip([*seen, *own], [*own, *seen]))
        return df.select(*[F.col(c).alias(other.get(c, c)) for c in df.columns])

    blocks = sides(lefts, left).join(turned(sides(rights, right)), block)

    by = [*group, *scores, *seen]
    others = turned(rights.join(turned(blocks), by))
    return lefts.join(blocks, by).select(*block, left), others.select(*block, right), block


# Bits of an edge's first and second tie value.
TIE_BITS, SECOND_BITS = 20, 16


def _tie(left: str, right: str) -> tuple[Column, Column]:
    """An edge's two tie values, from the hexadecimal md5 of left|right."""
    digest = F.md5(F.concat_ws("|", F.col(left).cast("string"), F.col(right).cast("string")))

    def bits(start: int, digits: int) -> Column:
        return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")

    return bits(1, TIE_BITS // 4), bits(1 + TIE_BITS // 4, SECOND_BITS // 4)


def _solver():
    """The per-group solver; nested so that tasks receive it by value."""
    import hashlib
    import heapq

    digits, more, second_bits, tie_bits = TIE_BITS // 4, SECOND_BITS // 4, SECOND_BITS, TIE_BITS

    def ties(a, b) -> tuple[int, int]:
        digest = hashlib.md5(f"{a}|{b}".encode()).hexdigest()
        return int(digest[:digits], 16), int(digest[digits : digits + more], 16)

    def solve(lefts, rights, weights) -> list[int]:
        """Positions of the chosen edges: largest total weight, then largest totals of the tie values."""
        step = (len(weights) + 1) << second_bits
        unit = step * (len(weights) + 1) << tie_bits
        number = {r: j for j, r in enumerate(dict.fromkeys(rights))}
        arcs: dict = {}
        for pos, (a, b, w) in enumerate(zip(lefts, rights, weights)):
            first, second = ties(a, b)
            arcs.setdefault(a, []).append((number[b], -(int(w) * unit + first * step + second), pos))
        owner: dict = {}
        price: dict = {}
        base: dict = {}
        chosen: dict = {}
        for k, start in enumerate(arcs):
            arcs[start].append((len(number) + k, 0, -1))  # staying single costs nothing
            base[start] = min(c - price.get(j, 0) for j, c, _ in arcs[start])
            dist, via, closed = {}, {}, {}
            heap, here, reached = [], start, {start: 0}
            while True:
                for j, c, pos in arcs[here]:
                    if j not in closed:
                        d = reached[here] + c - base[here] - price.get(j, 0)
                        if j not in dist or d < dist[j]:
                            dist[j], via[j] = d, (here, pos)
                            heapq.heappush(heap, (d, j))
                d, j = heapq.heappop(heap)
                while j in closed:
                    d, j = heapq.heappop(heap)
                closed[j] = d
                if j not in owner:
                    break
                here = owner[j]
                reached[here] = d
            for a, at in reached.items():
                base[a] += d - at
            for b, at in closed.items():
                price[b] = price.get(b, 0) - (d - at)
            while True:
                a, pos = via[j]
                owner[j] = a
                before = chosen.get(a)
                chosen[a] = (j, pos)
                if before is None:
                    break
                j = before[0]
        return sorted(pos for _, pos in chosen.values() if pos >= 0)

    return solve


def optimal(
    edges: DataFrame, group: list[str], left: str, right: str, weight: str, cap: int = OPTIMAL_FOLD
) -> DataFrame:
    """The set of edges with the largest total ``weight`` (BIGINT, above 0) that uses each end once.

    Equal totals are decided by the larger total of a 20-bit md5 value per edge, then of a second
    such value; so there is one answer, whichever way a group is solved.  A group over ``cap`` edges
    loses the edges that cannot be in the optimum and falls apart into connected components; only
    components that are still over ``cap`` go through rounds.  (Open: where more than
    ``OPTIMAL_FOLD`` edges of one component could each be in an optimum, say a block of over a
    hundred ends a side with one weight, the bids decide equal totals.)
    """
    edges = settle(edges)
    small, large = split_by_size(edges, group, cap)
    chosen = _optimal_folded(small, group, left, right, weight)
    if large is None:
        return chosen
    parts = _components(settle(_contenders(large, group, left, right, weight)), group, left, right)
    by = [*group, "_part"]
    small, large = split_by_size(parts, by, cap)
    chosen = chosen.unionByName(_optimal_folded(small, by, left, right, weight).drop("_part"))
    if large is not None:
        chosen = chosen.unionByName(_optimal_rounds(large, by, left, right, weight).drop("_part"))
    return chosen


def _contenders(edges: DataFrame, group: list[str], left: str, right: str, weight: str, salts: int = 16) -> DataFrame:
    """Edges that can be in the optimum: of each end of a group's smaller side its k best, k being the number of such ends.

    The other ends of that side take at most k - 1 of these, so a worse edge could be exchanged for a free better one.
    The best are ranked within ``salts`` shares of an end's edges first, so an end with very many edges is not one task.
    """
    def ends(side: str, out: str) -> DataFrame:
        return edges.select(*group, side).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(out))

    sizes = ends(left, "_nl").join(ends(right, "_nr"), group)
    first, second = _tie(left, right)
    by_left = F.col("_nl") <= F.col("_nr")
    marked = edges.join(sizes, group).withColumns({
        "_k": F.least("_nl", "_nr"), "_end": F.when(by_left, F.col(left).cast("string")).otherwise(F.col(right).cast("string")),
        "_t": first, "_u": second}).withColumn("_share", F.pmod("_t", F.lit(salts)))
    for keys in ([*group, "_end", "_share"], [*group, "_end"]):
        best = Window.partitionBy(*keys).orderBy(F.desc(weight), F.desc("_t"), F.desc("_u"), left, right)
        marked = marked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= F.col("_k"))
    return marked.select(*edges.columns)


def _components(edges: DataFrame, group: list[str], left: str, right: str, out: str = "_part") -> DataFrame:
    """``edges`` with a column ``out``: the least left end that is connected with the edge.

    Labels go over to the right ends and back, then each is replaced by its own label's label, until none changes.
    """
    edges = settle(edges)
    labels = edges.select(*group, left, F.col(left).alias("_label")).distinct()
    while True:
        there = edges.join(labels, [*group, left]).groupBy(*group, right).agg(F.min("_label").alias("_label"))
        here = settle(edges.join(there, [*group, right]).groupBy(*group, left).agg(F.min("_label").alias("_label")))
        again = here.select(*group, F.col(left).alias("_label"), F.col("_label").alias("_least"))
        before = labels.withColumnRenamed("_label", "_old")
        moved = settle(here.join(again, [*group, "_label"]).join(before, [*group, left]).select(
            *group, left, F.col("_least").alias("_label"), (F.col("_least") != F.col("_old")).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return edges.join(labels.withColumnRenamed("_label", out), [*group, left])


def _optimal_folded(edges, group, left, right, weight) -> DataFrame:
    carried = [left, right, weight, *[c for c in edges.columns if c not in (*group, left, right, weight)]]
    solve = _solver()

    @F.pandas_udf("array<int>")
    def chosen_positions(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # submissions repeat, so each distinct edge list is solved once per task
        known: dict = {}
        for lefts, rights, weights in batches:
            out = []
            for row in zip(lefts, rights, weights):
                key = tuple(tuple(x) for x in row)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = solve(*key)
                out.append(known[key])
            yield pd.Series(out)

    rows = edges.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*carried))).alias("_edges"))
    picks = rows.withColumn(
        "_at",
        chosen_positions(
            F.col(f"_edges.{left}").cast("array<string>"),
            F.col(f"_edges.{right}").cast("array<string>"),
            F.col(f"_edges.{weight}"),
        ),
    )
    return picks.select(*group, F.inline(F.transform("_at", lambda i: F.get("_edges", i))))


def _optimal_rounds(edges, group, left, right, weight) -> DataFrame:
    """Auction rounds with falling bid increments, all groups together, then ties among what is left.

    Both ends bid: a left end for its right ends or for itself (staying single), a right end
    likewise with nothing to gain, which makes a complete assignment always possible.  With
    weights scaled by more than the number of bidders and a last increment of one, the
    assignment is optimal.  Its prices show which edges can be in any optimum: those that cost
    their left end no more than the number of bidders against its best offer.  These few are
    folded once more, component by component, for the tie values; only a component of more than
    ``OPTIMAL_FOLD`` such edges keeps what the bids decided.
    """
    money = "decimal(38,0)"
    a, b = F.concat(F.lit("L"), F.col(left)), F.concat(F.lit("R"), F.col(right))
    zero = F.lit(0).cast(money)
    ends = edges.select(*group, a.alias("bidder")).union(edges.select(*group, b.alias("bidder"))).distinct()
    ends = settle(ends)
    n = ends.groupBy(*group).count().agg(F.max("count")).first()[0]
    arcs = settle(
        edges.select(*group, a.alias("bidder"), b.alias("item"), (F.col(weight).cast(money) * (n + 1)).cast(money).alias("worth"))
        .unionByName(edges.select(*group, b.alias("bidder"), a.alias("item"), zero.alias("worth")))
        .unionByName(ends.select(*group, "bidder", F.col("bidder").alias("item"), zero.alias("worth")))
    )
    step = max(1, int(arcs.agg(F.max("worth")).first()[0]) // 4)
    state = ends.select(
        *group, F.col("bidder").alias("item"), zero.alias("price"), F.lit(None).cast("string").alias("owner")
    )
    while True:
        state = state.withColumn("owner", F.lit(None).cast("string"))
        while True:
            held = state.filter("owner is not null").select(*group, F.col("owner").alias("bidder"))
            idle = ends.join(held, [*group, "bidder"], "left_anti")
            offers = (
                arcs.join(idle, [*group, "bidder"], "left_semi")
                .join(state.drop("owner"), [*group, "item"])
                .select(*group, "bidder", "item", "price", (F.col("worth") - F.col("price")).alias("gain"))
            )
            first = offers.groupBy(*group, "bidder").agg(F.max(F.struct("gain", "item", "price")).alias("top"))
            second = (
                offers.join(first, [*group, "bidder"])
                .filter(F.col("item") != F.col("top.item"))
                .groupBy(*group, "bidder").agg(F.max("gain").alias("next"), F.first("top").alias("top"))
            )
            bids = second.select(
                *group, "bidder", F.col("top.item").alias("item"),
                (F.col("top.price") + F.col("top.gain") - F.col("next") + F.lit(step).cast(money)).cast(money).alias("bid"),
            )
            won = bids.groupBy(*group, "item").agg(F.max(F.struct("bid", "bidder")).alias("w"))
            state = settle(
                state.join(won, [*group, "item"], "left").select(
                    *group, "item", F.coalesce("w.bid", "price").cast(money).alias("price"),
                    F.coalesce("w.bidder", "owner").alias("owner"),
                )
            )
            if state.filter("owner is null").isEmpty():
                break
        if step == 1:
            break
        step = max(1, step // 6)
    offers = arcs.join(state.drop("owner"), [*group, "item"]).select(
        *group, "bidder", "item", (F.col("worth") - F.col("price")).alias("gain"))
    best = offers.groupBy(*group, "bidder").agg(F.max("gain").alias("most"))
    tight = offers.filter("bidder like 'L%' and item like 'R%'").join(best, [*group, "bidder"]).filter(
        F.col("most") - F.col("gain") <= n).select(*group, F.expr("substr(bidder, 2)").alias("_l"), F.expr("substr(item, 2)").alias("_r"))
    named = edges.withColumn("_l", F.col(left).cast("string")).withColumn("_r", F.col(right).cast("string"))
    left_over = _components(named.join(tight, [*group, "_l", "_r"], "left_semi"), group, left, right, "_tight")
    by = [*group, "_tight"]
    small, large = split_by_size(left_over, by, OPTIMAL_FOLD)
    chosen = _optimal_folded(small, by, left, right, weight)
    if large is not None:
        picks = state.filter("owner like 'L%' and item like 'R%'").select(
            *group, F.expr("substr(owner, 2)").alias("_l"), F.expr("substr(item, 2)").alias("_r"))
        chosen = chosen.unionByName(large.join(picks, [*group, "_l", "_r"], "left_semi"))
    return chosen.drop("_l", "_r", "_tight")
