"""A trie of rebuilt conversations: which share how much of their beginning.

A conversation is rebuilt as a head of some base conversation followed by its own turns
after the first h.  Its text is never put together: turns are hashed once, heads and
suffixes are monoid elements (`turn_order`), and a rebuilt prefix is a product of the two,
s_base(k) + B^(k - h) (s_own(i) - s_own(h)).  A node of the trie is a depth and such a
product; rows carry a reference to the stored turn that is their last.

Equality is verified, not assumed.  Stored turns with one hash must be the same bytes,
and the members of a node must refer to turns of one hash: then, a product being a sum,
their prefixes before that turn agree as well, and so on to the root.  If either fails,
everything is done again with other bases and seeds.

Sums over subtrees need no walk of the tree.  Each node belongs to its smallest member;
the nodes of a conversation are those deeper than some depth `a`, since members only
become fewer.  So a subtree's leaves are its members that own a leaf, and its saved words
are those that its members have from this depth down to their `a`.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch, sha256_hex
from kgweave.llm.turn_order import Hash, chained_sha256, in_order

PRIME = (1 << 31) - 1
#: Prime and seed of each attempt; a prime of 31 bits in three lanes gives 93 bits.
ATTEMPTS = tuple((PRIME, seed) for seed in range(3))
LANES = ("t0", "t1", "t2")
MARKS = ("f0", "f1", "f2")
FAMILY, HEAD = 20, 4
#: Conversation ids that one chunk of a node's list holds at most: 2 to this power.
CHUNK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


class Collision(Exception):
    """Two contents with one fingerprint."""


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % F.lit(FAMILY)


def head_turns(conv_id: Column) -> Column:
    """How many turns of its base a conversation begins with: crc32 of its decimal id, modulo HEAD."""
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(HEAD)


def _hashing(prime: int, seed: int) -> Hash:
    rng = random.Random(seed)
    return Hash(prime, tuple(rng.randrange(prime // 2, prime) for _ in LANES))


def _turns(conversations: DataFrame, prime: int, seed: int) -> DataFrame:
    text = {c: F.coalesce(c, F.lit("")) for c in ("role", "text")}
    clean = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), "turn", *(v.alias(c) for c, v in text.items()))
    lanes = {c: F.pmod(F.xxhash64(F.lit(len(LANES) * seed + i), "role", "text"), F.lit(prime)) for i, c in enumerate(LANES)}
    return clean.withColumns({**lanes, "w": F.regexp_count("text", F.lit(WORD)).cast("bigint")})


def _rebuilt(turns: DataFrame, scratch: Scratch, hashing: Hash) -> DataFrame:
    """A row per rebuilt conversation and depth: c, d, MARKS, LANES, w, words (up to d), size, src and src_pos."""
    marks = [F.col(f"mark_{lane}").alias(mark) for lane, mark in zip(LANES, MARKS, strict=True)]
    stored = scratch.save(turns.select(F.col("conv_id").alias("c"), "pos", *LANES, *marks, "w", F.col("sum_w").alias("words")), "stored")
    entry = F.when(F.col("pos") < HEAD, F.struct("pos", *MARKS, *LANES, "w", "words"))
    convs = scratch.save(stored.groupBy("c").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(entry)).alias("head")), "convs")
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    met = convs.withColumn("h", head_turns(F.col("c"))).join(bases, base_of(F.col("c")) == F.col("base"), "left")
    met = met.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))

    def of(head: str, turns: Column, name: str) -> Column:
        """Of the first `turns` turns of a head."""
        return F.coalesce(F.get(head, turns.cast("int") - 1)[name], F.lit(0))

    own = F.least("h", "n")
    joined = scratch.save(
        met.select(
            "c",
            "h",
            "k",
            (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"),
            "base",
            F.slice(F.coalesce("base_head", F.slice("head", 1, 0)), F.lit(1), F.col("k").cast("int")).alias("base_head"),
            *(of("base_head", F.col("k"), x).alias(f"k_{x}") for x in (*MARKS, "words")),
            *(of("head", own, x).alias(f"h_{x}") for x in (*MARKS, "words")),
        ),
        "joined",
    )
    nothing = [F.lit(0).cast("bigint").alias(x) for x in (*MARKS, *LANES, "w", "words")]
    root = joined.select("c", F.lit(0).cast("bigint").alias("d"), *nothing, "size", F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("src_pos"))
    heads = joined.select("c", "base", "size", F.inline("base_head")).select(
        "c", F.col("pos").alias("d"), *MARKS, *LANES, "w", "words", "size", F.col("base").alias("src"), F.col("pos").alias("src_pos")
    )
    prime = F.lit(hashing.prime)

    def product(lane: int) -> Column:
        mark, base = MARKS[lane], hashing.bases[lane]
        shift = F.get(F.array(*(F.lit(pow(base, -i, hashing.prime)) for i in range(HEAD))), (F.col("h") - F.col("k")).cast("int"))
        return F.pmod(F.col(f"k_{mark}") + shift * F.pmod(F.col(mark) - F.col(f"h_{mark}"), prime), prime)

    rest = stored.join(joined.drop("base_head"), "c").filter(F.col("pos") > F.col("h"))
    own_rows = rest.select(
        "c",
        (F.col("k") + F.col("pos") - F.col("h")).alias("d"),
        *(product(i).alias(mark) for i, mark in enumerate(MARKS)),
        *LANES,
        "w",
        (F.col("k_words") + F.col("words") - F.col("h_words")).alias("words"),
        "size",
        F.col("c").alias("src"),
        F.col("pos").alias("src_pos"),
    )
    rows = scratch.save(root.unionByName(heads).unionByName(own_rows), "rebuilt")
    scratch.drop("in-order", "stored", "convs", "joined")
    return rows


def _verify_turns(turns: DataFrame) -> None:
    """Raises Collision if two stored turns of one hash differ in role or text."""
    contents = turns.select(*LANES, "role", "text").distinct()
    if contents.groupBy(*LANES).count().filter("count > 1").take(1):
        raise Collision("turns")


def _attempt(conversations: DataFrame, scratch: Scratch, prime: int, seed: int) -> DataFrame:
    hashing = _hashing(prime, seed)
    turns = _turns(conversations, prime, seed)
    _verify_turns(turns)
    ordered = in_order(turns, "conv_id", ["turn", "role", "text"], scratch, ("w",), LANES, hashing, keep=["conv_id", *LANES, "w"])
    rows = _rebuilt(ordered, scratch, hashing)
    key = ["d", *MARKS]
    apart = F.lit(False)
    for lane in LANES:
        apart = apart | (F.min(lane) != F.max(lane))
    nodes = scratch.save(rows.groupBy(*key).agg(F.min("c").alias("owner"), F.max("size").alias("deepest"), apart.alias("apart")), "nodes")
    if nodes.filter("apart").take(1):
        raise Collision("prefixes")
    owned = F.col("owner") == F.col("c")
    seen = rows.select("c", "size", "words", *key).join(nodes, key)
    told = seen.filter(~owned | (F.col("d") == F.col("size"))).groupBy("c")
    shared = F.max(F.when(~owned, F.struct("d", "words", "owner")))
    leaf = F.max(owned & (F.col("d") == F.col("size")) & (F.col("deepest") == F.col("d")))
    facts = scratch.save(told.agg(shared.alias("shared"), leaf.alias("leaf")), "facts").select(
        "c", F.coalesce("shared.d", F.lit(-1)).alias("a"), F.coalesce("shared.words", F.lit(0)).alias("a_words"), F.col("shared.owner").alias("a_owner"), "leaf"
    )
    d, a = F.col("d"), F.col("a")
    saved = F.when(d <= a, F.col("a_words") - (F.col("words") - F.col("w"))).otherwise(0)
    parent = F.when(d == 0, None).when(d - 1 > a, F.col("c")).otherwise(F.col("a_owner"))
    member = rows.select("c", "size", "w", "words", *key).join(facts, "c").select("c", *key, "leaf", parent.alias("parent"), saved.alias("saved"), ((a <= d) & (d < F.col("size"))).alias("child"))
    tree = member.groupBy(*key).agg(
        F.min("c").alias("conv_id"),
        F.min_by("parent", "c").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("child").cast("bigint")).alias("n_children"),
        F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    # Each chunk holds the ids of one range of 2^CHUNK_BITS, so a node's list is never gathered.
    chunk = F.shiftright("c", CHUNK_BITS)
    ends = rows.filter("d = size").groupBy(*key, chunk.alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    digests = chained_sha256(ends, key, "chunk", "ids", ",")
    return tree.join(digests, key, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(sha256_hex(""))).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, attempts: tuple[tuple[int, int], ...] = ATTEMPTS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from `conversations` (conv_id, turn, role, text).

    Turns stand by turn number, nulls first, ties by role, then text; a null role or text
    is empty, and rows without conv_id belong to no conversation.  Repeated rows are turns
    of their own.  conv_id is a whole number.  An empty table has no node, not even a root.
    A conversation without rebuilt turns is a member of the root.  Other columns are left
    out.  No task holds a conversation or a node's members: a conversation may have any
    number of turns and a node any number of members; only the digest of a node's list of
    ids is computed by one task, as a stream of chunks.  Texts are shuffled to be put in
    order and to verify that turns of one hash are equal, and take no part afterwards.

    Returns conv_id (the smallest member), depth, parent_conv_id (root: null), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    for prime, seed in attempts:
        try:
            return _attempt(conversations, scratch, prime, seed)
        except Collision:
            continue
    raise Collision(f"fingerprints collided {len(attempts)} times")
