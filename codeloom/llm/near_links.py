"""From band keys to verified links, without emitting all pairs of a bucket.

Jaccard distance is a metric, and only connected groups are asked for. So each bucket first compares its members
with one of them, its pivot: a bucket of n near copies costs n comparisons. From then on buckets are forgotten: two
nodes of one bucket have its pivot in common, so a row per node and pivot holds all that is left to compare, however
many keys two near copies share.

Where sketches are made early, pairs of a node and a pivot whose sketches rule out a link are never given
their texts, and the others are compared in two steps: each node with one of its pivots first, and then the pairs
that this hasn't joined. So a group of near copies costs about a comparison a member, however many pivots it has.

A bucket of two has nothing left to compare then. In others there are the outsiders, members that the pivot doesn't link. An outsider x needs comparing with another
member y only if the two aren't joined already, ``|d(x, pivot) - d(y, pivot)|`` is within the limit, as the triangle
inequality asks of every link, and the two's sketches agree nearly as often as a link's must; the join itself tests
all three, so it makes few pairs besides the links. While pivots would still have many more pairs to test than
members, an outsider of each becomes a further pivot, for as long as that joins what it meets. What is left then are
often large components with many links to others, of which one is enough: so a few members of each large component of
a group are compared with a few of each other one, before all are. No group is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch
from codeloom.llm.union_find import components

#: Further pivots are tried while there are more than so many open pairs a member.
PAIRS_A_MEMBER = 2
#: And while one member of so many, at least, is joined by them.
SHARE = 50
#: So many members stand for a component in a group, if it has more, before all are compared with other components.
STAND = 24
#: Up to so many pairs are sent to the texts; of more, the texts are dealt out to meet them.
FEW = 50_000


def near_links(
    entries: DataFrame | list[DataFrame],
    texts_of: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame], DataFrame],
    limit: float,
    scratch: Scratch,
    sketch: Callable[[DataFrame], DataFrame],
    alike: Callable[[Column, Column], Column],
    early: bool = False,
) -> DataFrame:
    """The links among nodes that share a key.

    ``entries``: (key, node), or several such tables without a common key, dealt one after the other. ``texts_of``
    takes (node) and returns (node, text). ``compare`` takes (a, b, ta, tb) and returns (a, b, link boolean, dist double, ...): the exact verdict on each pair. ``limit`` is the largest
    distance of a link. ``sketch`` takes (node, text) and returns (node, sketch); ``alike`` takes two sketches and says
    whether their texts may be a link. With ``early`` the sketches are made before anything is compared, and rule out
    pairs from the start. Returns the rows of ``compare`` that are links.
    """
    def around_pivots(dealt: DataFrame) -> DataFrame:
        """(a, b, more) of a pivot, another member and whether there are more; one exchange of the keys.

        A node has some tens of keys at most, so no key has more rows than there are nodes.
        """
        bucket = Window.partitionBy("key")
        met = dealt.where("key is not null and node is not null").select("node", F.min("node").over(bucket).alias("a"), (F.count(F.lit(1)).over(bucket) > 2).alias("more"))
        return met.where("node != a").groupBy("a", F.col("node").alias("b")).agg(F.max("more").alias("more"))

    parts = [scratch.keep(around_pivots(dealt)) for dealt in (entries if isinstance(entries, list) else [entries])]
    star = parts[0]
    if len(parts) > 1:
        star = scratch.keep(reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.max("more").alias("more")))
        scratch.drop(*parts)
    texts = scratch.keep(texts_of(star.select(F.explode(F.array("a", "b")).alias("node")).distinct()))

    def verify(pairs: DataFrame) -> DataFrame:
        some = texts
        if early:  # without them, most pairs are verified at once
            pairs = scratch.keep(pairs)
            if pairs.count() <= FEW:
                some = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
        with_b = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        out = scratch.keep(compare(with_b.join(some.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")))
        if early:
            scratch.drop(pairs)
        return out

    def unjoined(pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """The pairs (a, b) whose nodes aren't of one component."""
        named = pairs.join(joined.toDF("a", "ca"), "a", "left").join(joined.toDF("b", "cb"), "b", "left")
        return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    if early:
        sketches = scratch.keep(sketch(texts))
        sa, sb = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        may = scratch.keep(star.join(sb, "b").join(sa, "a").where(alike(F.col("sa"), F.col("sb"))).select("a", "b"))
        one = verify(may.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        joined = components(one.where("link").select("a", "b"), scratch)
        first = one.unionByName(verify(unjoined(may, joined).join(one.select("a", "b"), ["a", "b"], "left_anti")))
        scratch.drop(may)
    else:
        first = verify(star.select("a", "b"))
    joined = components(first.where("link").select("a", "b"), scratch)
    told = first.groupBy("a", "b").agg(F.max("link").alias("near"), F.min("dist").alias("d"))
    known = star.where("more").join(told, ["a", "b"], "left").select(F.col("a").alias("p"), F.col("b").alias("node"), F.coalesce("near", F.lit(False)).alias("near"), "d")
    known = known.join(joined, "node", "left").select("p", "node", "near", "d", F.coalesce("component", "node").alias("c"))
    if early:  # some pairs weren't compared, as both are of one component
        known = known.join(joined.toDF("p", "cp"), "p", "left").select("p", "node", (F.col("c") == F.coalesce("cp", "p")).alias("near"), "d", "c")
    held = scratch.keep(known)
    scratch.drop(star)
    left = held.groupBy("p").agg(F.min("near").alias("all"), F.min("c").alias("c0"), F.max("c").alias("c1")).where(~F.col("all") & (F.col("c0") != F.col("c1"))).select("p")
    before, held = held, scratch.keep(held.join(left, "p", "left_semi"))
    if not early:
        sketches = sketch(texts.join(held.select("node").distinct(), "node", "left_semi"))
    wide, held = held, scratch.keep(held.join(sketches, "node").select("p", "node", "near", "d", "c", "sketch"))
    scratch.drop(before, wide)

    def merge(held: DataFrame, found: DataFrame) -> DataFrame:
        """``held`` with the components that new links join."""
        label = held.select("node", "c").distinct()
        merged = found.where("link").select("a", "b").join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select("ca", "cb")
        merged = components(merged, scratch).toDF("c", "to")
        out = scratch.keep(held.join(merged, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to"))
        scratch.drop(held)
        return out

    links, done, turn = [first], first.select("a", "b"), 0
    while True:
        parts = held.groupBy("p", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max("n").alias("most"))
        pairs, members, largest = parts.agg(F.sum(F.col("n") * F.col("n") - F.col("same")), F.sum("n"), F.max("most")).first()
        if not pairs or pairs <= 2 * PAIRS_A_MEMBER * members:
            break
        # the pivot comes from the group's outsiders, another one in each turn
        pick = F.min_by(F.struct("node", "c", "sketch"), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("pivot")
        pivots = held.where(~F.col("near")).groupBy("p").agg(pick)
        met = held.select("p", "node", "c", "sketch").join(pivots, "p").where((F.col("c") != F.col("pivot.c")) & alike(F.col("sketch"), F.col("pivot.sketch")))
        near = met.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
        found = verify(near.join(done, ["a", "b"], "left_anti"))
        links.append(found)
        done, turn = done.unionByName(found.select("a", "b")), turn + 1
        held = merge(held, found)
        if found.where("link").count() < members / SHARE:
            break  # further pivots join few: what is left is unlike, and the sketches tell that

    def outsiders(held: DataFrame) -> DataFrame:
        """(a, b) of an outsider and another member of its group, repeated for each group they share."""
        x = held.where(~F.col("near")).select("p", F.col("node").alias("x"), F.col("d").alias("dx"), F.col("c").alias("cx"), F.col("sketch").alias("sx"))
        y = held.select(F.col("p").alias("own"), F.col("node").alias("y"), F.col("near").alias("ny"), F.col("d").alias("dy"), F.col("c").alias("cy"), F.col("sketch").alias("sy"))
        new = (F.col("cx") != F.col("cy")) & (F.col("ny") | (F.col("x") < F.col("y")))
        within = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= limit + 1e-9, F.lit(True))
        return x.join(y, (F.col("p") == F.col("own")) & new & within & alike(F.col("sx"), F.col("sy"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    if pairs and pairs > 2 * PAIRS_A_MEMBER * members and largest > STAND:
        part = Window.partitionBy("p", "c")
        few = held.select("p", "node", "d", "c", "sketch", F.count(F.lit(1)).over(part).alias("n"), F.row_number().over(part.orderBy(F.xxhash64("node"), "node")).alias("at")).where(F.col("at") <= STAND)
        x = few.select("p", F.col("node").alias("x"), F.col("d").alias("dx"), F.col("c").alias("cx"), F.col("sketch").alias("sx"))
        y = few.where(F.col("n") > STAND).select(F.col("p").alias("own"), F.col("node").alias("y"), F.col("d").alias("dy"), F.col("c").alias("cy"), F.col("sketch").alias("sy"))
        within = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= limit + 1e-9, F.lit(True))
        met = x.join(y, (F.col("p") == F.col("own")) & (F.col("cx") != F.col("cy")) & within & alike(F.col("sx"), F.col("sy")))
        found = verify(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        links.append(found)
        done = done.unionByName(found.select("a", "b"))
        held = merge(held, found)

    rest = outsiders(held).distinct().join(done, ["a", "b"], "left_anti")
    if early:  # one partner each first; then what this hasn't joined
        rest = scratch.keep(rest)
        found = verify(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        links.append(found)
        joined = components(reduce(DataFrame.unionByName, [part.where("link").select("a", "b") for part in links]), scratch)
        open_pairs = unjoined(rest, joined).join(found.select("a", "b"), ["a", "b"], "left_anti")
        links.append(verify(open_pairs))
        scratch.drop(rest)
    else:
        links.append(verify(rest))
    scratch.drop(held, texts, *([sketches] if early else []))
    return reduce(DataFrame.unionByName, [found.where("link") for found in links])
