"""Exact set-similarity join by prefix filtering.

Two sets with Jaccard >= t share a token among the rarest ``n - ceil(t*n) + 1``
tokens of each, under *any* fixed order of tokens.  Joining on these prefixes
alone finds every pair; common tokens hardly ever enter a prefix, so a token that
occurs in a third of all rows does not become a join key for them.

The order uses token counts kept in a fixed number of hash buckets: one array of
``BUCKETS`` numbers whatever the data size, which a scalar subquery gives to every
task, so tokens are ranked inside their row.  Collisions change only the order, never
the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BUCKETS = 262144
#: numbers of 64 bits in the parity sketch of a set, and in that of long sets, made for those in pairs only
SKETCH, LONG_SKETCH = 8, 64


def set_key(tokens: Column) -> Column:
    """Identifier of a token set, independent of order: 128 bits as a short text.

    Never null, so joins on it need no null filter that would compute the tokens twice.
    """
    digest = F.sha2(F.array_join(F.sort_array(tokens), "\u0001"), 256)
    return F.coalesce(F.base64(F.substring(F.unhex(digest), 1, 16)), F.lit(""))


def distinct_sets(df: DataFrame, tokens: str) -> DataFrame:
    """(set_id, tokens): one row per different set (the empty set never matches)."""
    return (
        df.select(F.sort_array(F.array_distinct(F.col(tokens))).alias("tokens"))
        .select(set_key(F.col("tokens")).alias("set_id"), "tokens")
        .groupBy("set_id")
        .agg(F.first("tokens").alias("tokens"))
    )


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def token_order(sets: DataFrame) -> DataFrame:
    """One row with the occurrences per hash bucket: an array of ``BUCKETS`` counts."""
    counted = (
        sets.select(F.explode("tokens").alias("token"))
        .groupBy(_bucket(F.col("token")).alias("bucket"))
        .agg(F.count("*").alias("uses"))
    )
    every = sets.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    filled = every.join(counted, "bucket", "left").select(F.struct("bucket", F.coalesce("uses", F.lit(0)).alias("uses")).alias("b"))
    return filled.agg(F.sort_array(F.collect_list("b"))["uses"].alias("uses"))


def _needed(size: Column, threshold: float) -> Column:
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9))


def _prefixes(sets: DataFrame, uses: Column, threshold: float, side: str) -> DataFrame:
    """(set_id, size, place, token) for the prefix tokens of each set, ranked inside the row.

    ``token`` is a hash: two tokens that share one add a candidate, which is compared in full.
    """
    ranked = F.sort_array(
        F.transform(F.array_distinct("tokens"), lambda t: F.struct(F.get(F.col("_uses"), _bucket(t).cast("int")).alias("uses"), t.alias("token")))
    )
    df = sets.select("set_id", "tokens", uses.alias("_uses")).select("set_id", ranked.alias("ranked"))
    size = F.size("ranked")
    kept = F.slice("ranked", F.lit(1), (size - _needed(size, threshold) + 1).cast("int"))
    return (
        df.select("set_id", size.alias("size"), F.posexplode(kept).alias("place", "entry"))
        .select("set_id", "size", "place", F.xxhash64("entry.token").alias("token"))
        .select(*[F.col(c).alias(c if c == "token" else f"{side}_{c}") for c in ("set_id", "size", "place", "token")])
    )


def _able(threshold: float) -> Column:
    """Whether two prefix entries with one token can belong to a qualifying pair."""
    overlap_needed = F.ceil(
        F.lit(threshold / (1 + threshold)) * (F.col("l_size") + F.col("r_size")) - F.lit(1e-9)
    )
    reachable = 1 + F.least(
        F.col("l_size") - F.col("l_place") - 1, F.col("r_size") - F.col("r_place") - 1
    )
    return (
        (F.col("r_size") >= F.col("l_size") * F.lit(threshold) - F.lit(1e-9))
        & (F.col("l_size") >= F.col("r_size") * F.lit(threshold) - F.lit(1e-9))
        # holds at the first shared token of every qualifying pair
        & (reachable >= overlap_needed)
    )


def _sketches(sets: DataFrame, numbers: int = SKETCH) -> DataFrame:
    """(set_id, size, s0..): every token of a set turns one of 64 * ``numbers`` bits over."""
    h = F.xxhash64("token")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    place = F.pmod(F.shiftright(F.col("h"), 6), F.lit(numbers))
    flat = sets.select("set_id", F.explode(F.array_distinct("tokens")).alias("token")).select("set_id", h.alias("h"))
    return flat.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.when(place == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"s{i}") for i in range(numbers)]
    )


def _close(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, numbers: int = SKETCH) -> DataFrame:
    """The (a, b) that may reach ``threshold``; no pair that does is lost.

    Sets that differ in d tokens have sketches that differ in at most d bits, and similar sets
    differ in a bounded share of their tokens.  Only what is left has its tokens sent around.
    """
    x = left.select(F.col("set_id").alias("a"), F.col("size").alias("n"), *[F.col(f"s{i}").alias(f"x{i}") for i in range(numbers)])
    y = right.select(F.col("set_id").alias("b"), F.col("size").alias("m"), *[F.col(f"s{i}").alias(f"y{i}") for i in range(numbers)])
    bits = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(numbers)), F.lit(0))
    most = (F.col("n") + F.col("m")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9)
    return stored(pairs.join(x, "a").join(y, "b").filter(bits <= most).select("a", "b"), "close")


def similar_sets(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    right_rows: DataFrame | None = None,
) -> DataFrame:
    """(left_set, right_set, similarity) for all pairs with Jaccard >= ``threshold``.

    Inputs have one row per set, as from :func:`distinct_sets`; ``right=None`` is a
    self join that returns each unordered pair once.  ``right_rows`` may hold several
    rows per right set with further columns, which are then kept in the result.
    """
    other = left if right is None else right
    rows = other.select("set_id", "tokens") if right_rows is None else right_rows
    uses = token_order(left.select("tokens") if right is None else left.select("tokens").union(right.select("tokens"))).scalar()
    a = _prefixes(left, uses, threshold, "l")
    b = _prefixes(other, uses, threshold, "r")
    able = _able(threshold)
    pairs = a.join(b, "token").filter(able)
    if right is None:
        pairs = pairs.filter(F.col("l_set_id") < F.col("r_set_id"))
    pairs = pairs.select(F.col("l_set_id").alias("a"), F.col("r_set_id").alias("b")).distinct()
    sketches = stored(_sketches(left), "sketches")
    pairs = _close(pairs, sketches, sketches if right is None else _sketches(right), threshold).withColumnsRenamed({"a": "left_set", "b": "right_set"})
    l = left.select(F.col("set_id").alias("left_set"), F.col("tokens").alias("l_tokens"))
    r = rows.withColumnsRenamed({"set_id": "right_set", "tokens": "r_tokens"})
    both = F.size(F.array_intersect("l_tokens", "r_tokens"))
    union = F.size("l_tokens") + F.size("r_tokens") - both
    return (
        pairs.join(l, "left_set")
        .join(r, "right_set")
        .withColumn("similarity", both / union.cast("double"))
        .filter(F.col("similarity") >= threshold)
        .drop("l_tokens", "r_tokens")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label): nodes of links (a, b) with the smallest node that links reach.

    Every round a label moves to the smallest of its neighbours and links inside a label
    go; what remains are links between labels, which at least halve in long chains of
    growing labels only after jumps, so moves are followed one step further each round.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        near = edges.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("to"))
        further = near.select(F.col("old").alias("to"), F.col("to").alias("beyond"))
        moves = stored(near.join(further, "to", "left").select("old", F.coalesce("beyond", "to").alias("new")), "moves")
        labels = stored(labels.join(moves, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        for side in ("a", "b"):
            edges = edges.join(moves, F.col(side) == F.col("old"), "left").withColumn(side, F.coalesce("new", side)).drop("old", "new")
        edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    return labels


#: rounds in which buckets are compared with one leader only, before the rest of the pairs
LEADER_ROUNDS = 1
#: most sets whose numbers are sent to every task to pick their words; for more, all words are shuffled
PICKED = 2_000_000


def _short_sets(named: DataFrame, threshold: float) -> DataFrame:
    """(set_id, copies, first, node, size, prefix): one row per set without its words.

    ``node`` is the ``row`` that stands for the set.  ``prefix`` has the hashes of the prefix
    tokens in their places; a token that no other row can hold is null, as it finds nothing.
    """
    uses = token_order(named.select(F.col("words").alias("tokens"))).scalar()
    ranked = F.sort_array(
        F.transform(F.array_distinct("words"), lambda t: F.struct(F.get(F.col("_uses"), _bucket(t).cast("int")).alias("uses"), t.alias("token")))
    )
    size = F.size("ranked")
    kept = F.slice("ranked", F.lit(1), (size - _needed(size, threshold) + 1).cast("int"))
    rows = named.select("id", "row", "set_id", "words", uses.alias("_uses")).select("id", "row", "set_id", ranked.alias("ranked")).select(
        "id", "row", "set_id", size.alias("size"), F.transform(kept, lambda e: F.when(e["uses"] > 1, F.xxhash64(e["token"]))).alias("prefix")
    )
    sets = rows.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.min_by(F.struct("row", "size", "prefix"), "row").alias("e")
    )
    return sets.select("set_id", "copies", "first", F.col("e.row").alias("node"), "e.size", "e.prefix")


def _linked(pairs: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose words have a Jaccard similarity of ``threshold``; only their words are shuffled.

    Longer sketches come first: a short one has all its bits at random for a set of a thousand words.
    """

    def of(pairs: DataFrame) -> DataFrame:
        nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "nodes")
        few = nodes.count() <= PICKED
        return named.select("row", "words").join(F.broadcast(nodes) if few else nodes, "row", "left_semi")

    sketches = stored(_sketches(of(pairs).select(F.col("row").alias("set_id"), F.col("words").alias("tokens")), LONG_SKETCH), "sketches")
    pairs = _close(pairs, sketches, sketches, threshold, LONG_SKETCH)
    words = of(pairs)
    named_as = lambda c, t: words.select(F.col("row").alias(c), F.col("words").alias(t))
    both = F.size(F.array_intersect("x", "y"))
    alike = both / (F.size("x") + F.size("y") - both).cast("double") >= threshold
    return pairs.join(named_as("a", "x"), "a").join(named_as("b", "y"), "b").filter(alike).select("a", "b")


def similar_groups(named: DataFrame, threshold: float) -> DataFrame:
    """(set_id, copies, first, label): sets that links of Jaccard >= ``threshold`` connect have one label.

    ``named``: stored rows (id, row, set_id, words) with different words in ``words`` and a
    number of their own in ``row``; rows with equal words share a ``set_id``.  Exact, without
    the pairs of a group: in a few rounds every bucket (a prefix token and a range of sizes)
    is compared with one leader, and what is linked becomes one label.  Then all pairs of
    prefixes whose labels still differ are compared, so a link between two groups is never
    missed, while a group of near copies costs a few links for each member.  Texts that are
    alike but less than ``threshold`` stay apart and are compared pair by pair.  Words travel
    for the pairs alone that sketches leave.
    """
    sets = stored(_short_sets(named, threshold), "sets")
    sketches = stored(_sketches(named.select(F.col("row").alias("set_id"), F.col("words").alias("tokens"))), "sketches")
    band = F.floor(F.log(F.col("l_size")) * F.lit(-1 / math.log(threshold)))
    fields = ["l_set_id", "l_size", "l_place", "l_label"]
    others = lambda df: df.withColumnsRenamed({c: c.replace("l_", "r_", 1) for c in fields})
    labels = links = None
    for turn in range(LEADER_ROUNDS + 1):
        mine = sets.withColumn("label", F.col("node"))
        if labels is not None:
            mine = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mine = mine.select(F.col("node").alias("l_set_id"), F.col("size").alias("l_size"), F.col("label").alias("l_label"), F.posexplode("prefix").alias("l_place", "token"))
        mine = mine.filter(F.col("token").isNotNull()).select("token", *fields)
        if turn < LEADER_ROUNDS:
            mine = mine.withColumn("band", band)
            best = F.min_by(F.struct(*fields), F.struct(F.xxhash64("l_label", F.lit(turn)), "l_set_id"))
            leaders = mine.groupBy("token", "band").agg(best.alias("x")).select("token", "band", "x.*")
            met = mine.join(others(leaders), ["token", "band"])
        else:
            met = mine.join(others(mine), "token").filter(F.col("l_set_id") < F.col("r_set_id"))
        pairs = met.filter((F.col("l_label") != F.col("r_label")) & _able(threshold)).select(
            F.least("l_set_id", "r_set_id").alias("a"), F.greatest("l_set_id", "r_set_id").alias("b")
        ).distinct()
        pairs = _close(pairs, sketches, sketches, threshold)
        found = stored(_linked(pairs, named, threshold), "links")
        links = found if links is None else links.unionByName(found)
        if turn == 0 or not found.isEmpty():
            labels = components(links)
    return sets.join(labels, "node", "left").select("set_id", "copies", "first", F.coalesce("label", "node").alias("label"))
