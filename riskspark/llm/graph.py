"""Links inside buckets, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import checkpointed, dropped, stored

#: Rounds of pivots at most, pivots of a bucket in all rounds but the first and last, and
#: how many partners the members of buckets have, on average, where no more rounds are needed.
ROUNDS, PIVOTS, FEW = 2, 32, 100
#: Pairs of a bucket that are verified, and whose marks are compared, at most (about) before
#: it is split, and how often that is done.
HOT_PAIRS, MOST_PAIRS, DEEPEST = 2_000_000, 100_000_000, 8
#: Links whose ends (two short keys each) are broadcast at most; more are joined by a shuffle.
BROADCAST_LINKS = 200_000


#: Of ``bucket, node`` of buckets to split: ``bucket, node, lead`` of smaller ones, and how to split these.
Split = Callable[[DataFrame], "tuple[DataFrame, Split]"]


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` of every key that has a link; a component is named by its
    least key. Each step points every node's larger neighbours, and then its smaller
    ones, to its least neighbour, so a hub's links become links of others. The number
    of steps grows with the logarithm of the longest path. Null ends are left out."""
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna().where("u != v")
    pairs = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # Steps never add links.
    sent = F.broadcast if pairs.count() <= BROADCAST_LINKS else lambda df: df
    done = False
    while not done:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Smaller neighbours (and the node) go to the least of them.
        large = large.where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(sent(small_least), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))
        )
        last, pairs = pairs, stored(small.where("u != v").distinct())
        dropped(last)
        # Stars are left when every node has one link, and none to a node that has one itself.
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("from"), F.lit(0).alias("to"))
        ends = ends.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("from"), F.lit(1).alias("to")))
        ends = ends.groupBy("node").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
        done = ends.where("from > 1 or (from = 1 and to = 1)").isEmpty()
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    nodes = checkpointed(nodes)
    dropped(pairs)
    return nodes


def bucket_links(
    members: DataFrame,
    marks: DataFrame,
    may_link: Callable[[Column, Column], Column],
    verified: Callable[[DataFrame], DataFrame],
    split: Split | None = None,
    depth: int = 0,
) -> DataFrame:
    """Links that connect all nodes that any links inside the buckets connect.

    ``members`` has distinct ``bucket, node, lead``; a pair counts if one of its ends is
    a ``lead`` there. ``marks`` has each ``node`` and its ``mark``; ``may_link`` of two
    marks is false only for pairs that certainly are no link. ``verified`` keeps of
    distinct pairs ``a, b`` (``a < b``) and their other columns those that are links,
    and may add columns.

    In each bucket all nodes meet the bucket's pivot first: the lead that is with the
    most others in its buckets. A node in its pivot's component is settled there. While
    the others have too many partners left (``FEW``), they meet about ``PIVOTS`` nodes
    of the bucket, chosen by a hash, that are in other components. At last every
    unsettled node meets those nodes of the bucket that are in other components than its
    own and that may link. So a pair of a bucket is left unverified only where it cannot
    link, or where both ends are connected already, and a large group of links is not
    paired out. With ``split``, buckets of which about ``HOT_PAIRS`` such pairs would have to be
    verified (or the marks of ``MOST_PAIRS`` compared) are not paired out either: ``split``
    of their ``bucket, node`` gives members of smaller buckets, in one of which every link of
    a hot one lies again, and the way to split those.
    """
    # Of buckets with the same members one is enough.
    digest = F.xxhash64("node", "lead")
    same = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(digest.cast("decimal(38,0)")).alias("total"), F.bit_xor(digest).alias("odd"))
    sizes = same.groupBy("size", "total", "odd").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    members = stored(members.join(sizes.select("bucket"), "bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    with_sizes = members.join(sizes, "bucket")
    # Whole numbers: their sum does not depend on the order of the rows.
    weight = F.round(F.log2("size") * 256).cast("long")
    central = with_sizes.groupBy("node").agg(F.sum(weight).alias("central"))
    leads = members.where("lead").join(central, "node")
    pivots = leads.groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("top"))
    pivots = stored(pivots.select("bucket", F.col("top.node").alias("pivot")))
    pairs = members.join(pivots, "bucket").where("node != pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    mark_a, mark_b = (marks.select(F.col("node").alias(c), F.col("mark").alias(f"mark_{c}")) for c in "ab")
    pairs = pairs.join(mark_a, "a").join(mark_b, "b").where(may_link(F.col("mark_a"), F.col("mark_b")))
    links = checkpointed(verified(pairs.select("a", "b")))
    for number in range(1, ROUNDS + 1):
        # A bucket that is settled stays so: the next round looks at the others alone.
        before, rest = members, stored(_unsettled_buckets(members, pivots, links).join(marks, "node"))
        members = rest.select("bucket", "node", "lead")
        members.stored_at = rest.stored_at
        dropped(before)
        left = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("settled")).alias("k"))
        pairs = F.col("n").cast("double") * F.col("k")
        work, rows, largest = left.agg(F.sum(pairs), F.sum("n"), F.max(pairs)).first()
        if not rows:
            break
        u, r, last = rest.where("not settled"), rest, number == ROUNDS or work <= FEW * rows
        if not last:
            chance = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(1 << 20)) * F.col("n") < PIVOTS << 20
            r = rest.join(left.select("bucket", "n"), "bucket").where(chance)
        once = (F.col("r.settled") | (F.col("u.node") < F.col("r.node"))) if last else F.lit(True)
        if last and split is not None and depth < DEEPEST and largest > HOT_PAIRS:
            hot = stored(_hot_buckets(left.where(pairs > HOT_PAIRS), u, rest, may_link))
            if not hot.isEmpty():
                inside, deeper = split(stored(rest.join(hot, "bucket", "left_semi").select("bucket", "node")))
                links = links.unionByName(bucket_links(inside, marks, may_link, verified, deeper, depth + 1).select(links.columns))
                u, r = (side.join(hot, "bucket", "left_anti") for side in (u, r))
        links = links.unionByName(_links_between(u.alias("u"), r.alias("r"), once, may_link, verified, links.columns))
        if last:
            break
    dropped(pivots, members)
    return links


def _hot_buckets(left: DataFrame, u: DataFrame, rest: DataFrame, may_link: Callable[[Column, Column], Column]) -> DataFrame:
    """Of large buckets (``bucket, n, k``) those of which too many pairs may link: as many
    as of their unsettled nodes and about ``PIVOTS`` others that a hash chooses."""
    left = left.select("bucket", "n", "k")
    chance = F.pmod(F.xxhash64("node", F.lit(77)), F.lit(1 << 20)) * F.col("n") < PIVOTS << 20
    some = rest.join(left, "bucket").where(chance).select("bucket", "node", "mark")
    asked = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    pairs = u.alias("u").join(some.alias("r"), (F.col("u.bucket") == F.col("r.bucket")) & (F.col("u.node") != F.col("r.node")) & may_link(F.col("u.mark"), F.col("r.mark")))
    passed = pairs.groupBy(F.col("u.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("passed"))
    known = left.join(asked, "bucket", "left").join(passed, "bucket", "left")
    all_pairs = F.col("n").cast("double") * F.col("k")
    share = F.coalesce(F.col("passed") / (F.col("k") * F.col("m")), F.lit(0.0))
    return known.where((all_pairs > MOST_PAIRS) | (all_pairs * share > HOT_PAIRS)).select("bucket")


def _unsettled_buckets(members: DataFrame, pivots: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets that are not all in their pivot's component, with each
    node's ``component`` and whether that is the pivot's (``settled``)."""
    if links.isEmpty():
        state = members.join(pivots, "bucket").withColumns({"component": F.col("node"), "c": F.col("pivot")})
    else:
        found = components(links, "a", "b")
        of_pivot = pivots.join(found.select(F.col("node").alias("pivot"), F.col("component").alias("c")), "pivot", "left")
        state = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        state = state.join(of_pivot.select("bucket", F.coalesce("c", "pivot").alias("c")), "bucket")
    state = state.select("bucket", "node", "lead", "component", (F.col("component") == F.col("c")).alias("settled"))
    unsettled = state.where("not settled").select("bucket").distinct()
    return state.join(unsettled, "bucket", "left_semi")


def _links_between(u: DataFrame, r: DataFrame, once: Column, may_link: Callable, verified: Callable, columns: list[str]) -> DataFrame:
    """One link of each two components that a row of ``u`` and one of ``r`` link in a bucket."""
    apart = (F.col("u.component") != F.col("r.component")) & (F.col("u.lead") | F.col("r.lead")) & once
    pairs = u.join(r, (F.col("u.bucket") == F.col("r.bucket")) & apart & may_link(F.col("u.mark"), F.col("r.mark")))
    swap = F.col("u.node") > F.col("r.node")
    ends = {"a": "node", "b": "node", "in_a": "component", "in_b": "component"}
    ends = [F.when(swap == F.lit("a" in k), F.col(f"r.{c}")).otherwise(F.col(f"u.{c}")).alias(k) for k, c in ends.items()]
    found = verified(pairs.select(*ends).distinct())
    link = F.min(F.struct(*columns)).alias("link")
    found = found.groupBy(F.least("in_a", "in_b").alias("in_a"), F.greatest("in_a", "in_b").alias("in_b")).agg(link)
    return checkpointed(found.select("link.*"))
