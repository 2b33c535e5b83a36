"""Jaccard join of documents on word n-grams by filters under several global orders.

If two sets of sizes m and n have Jaccard similarity t or more, they share at
least ceil(t * n) tokens of each.  Under any one order of all tokens, the first
n - ceil(t * n) + e tokens of each then have at least e tokens in common.  That
holds for every order, so the filters of several orders intersect:

1. a plain hash order, e = n / 8.  It only asks, per document, whether enough of
   its prefix occurs in any other document; most documents end here.  A token
   that two documents of one batch share is settled where it is read, and one row
   of it moves on, so a frequent token costs a row per batch.  Tokens are read in
   order, so that a task holds one token's last row and what it has counted;
2. two orders by rarity (document frequency, ties by hash), with different ties,
   over the documents left.  A pair must share a prefix token under both, and
   must fit in size, before its sets are intersected.

Equal sets are one class from the start.  Only classes of links are wanted, so
pairs already connected need no verification: each token's documents are first
held against one pivot, and what that connects is merged.  A token of one class
alone cannot link classes any more, so frequencies, prefixes and the sets still in
play are made anew, under new orders, and other pivots follow.  At last every pair
that is still apart and passes the filters is verified; there a bitmap of each set
bounds from above what two sets can share, within the join, so that sets with a
passage in common but too little else never become a row.  Nothing is capped, and no
pair that could link two classes is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.sizing import MOST_BITS, bitmap, has_bit, one_row, slot
from kgweave.llm.common import Scratch, Words, components, mix, text_chunks, windows

SHINGLE = 5
#: Jaccard similarity in hundredths.
THRESHOLD = 75
#: One more prefix token asked for per so many tokens, in the first order.
EXTRA = 8
PIVOT_ROUNDS = 2
#: 64-bit words of the bitmap that bounds a pair's overlap.
WORDS = 8
#: Counts that a task holds before it sends them on.
HELD = 1 << 20
#: Tokens before a shared one that the last join looks at to name a pair once.
RECENT = 16


def _overlap(n: np.ndarray, threshold: int) -> np.ndarray:
    """Tokens that a set of n shares with any set it links with."""
    return -(-n * threshold // 100)


class _Sets:
    """Distinct shingle hashes of a chunk's documents, sorted within each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        words = Words(data, offsets)
        hashes = words.hashes(fold=True)
        token, at = windows(hashes, words.doc, k)
        doc = words.doc[at]
        short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < k))
        if len(short):
            first = np.searchsorted(words.doc, short)
            whole = [mix(np.array([n], np.uint64) + windows(hashes[f : f + n], words.doc[f : f + n], n)[0])[0] for f, n in zip(first, words.per_doc[short], strict=True)]
            token, doc = np.append(token, np.array(whole, np.uint64)), np.append(doc, short)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.token, self.doc = token[new], doc[new]
        self.n = np.bincount(self.doc, minlength=words.docs)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.token + np.uint64(1)))))
        self.sig = mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(np.uint64))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.uint64).view(np.int64))


def set_sizes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """`docs` without its text, with n (set size) and sig (the set's 64-bit signature)."""

    def run(batches):
        for batch in batches:
            sets = [_Sets(d, o, k) for *_, d, o in text_chunks(batch.column("text"))]
            n = np.concatenate([s.n for s in sets] or [np.zeros(0, np.int64)])
            sig = np.concatenate([s.sig for s in sets] or [np.zeros(0, np.uint64)])
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), _long(sig)], names=[*keep, "n", "sig"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{columns}, n bigint, sig bigint")


def _filter_key(sig):
    """32 bits of a signature: sets that meet in one only pass the filter more easily."""
    return F.col(sig).bitwiseAND(0x7FFFFFFF).cast("int")


def _first_order(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """key, shared: prefix tokens (hash order) per set that some other document has too."""

    def prefixes(batches):
        def rows(token, key):
            return pa.RecordBatch.from_arrays([_long(token), pa.array(key, pa.int32())], names=["token", "key"])

        for batch in batches:
            tokens, keys = [], []
            for *_, data, offsets in text_chunks(batch.column(0)):
                s = _Sets(data, offsets, k)
                size = s.n - _overlap(s.n, threshold) + np.maximum(1, s.n // EXTRA)
                inside = np.arange(len(s.token)) - s.first[s.doc] < size[s.doc]
                tokens.append(s.token[inside])
                keys.append((s.sig & np.uint64(0x7FFFFFFF)).astype(np.int32)[s.doc[inside]])
            if not tokens:
                continue
            token, key = np.concatenate(tokens), np.concatenate(keys)
            order = np.lexsort((key, token))
            token, key = token[order], key[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key = token[new], key[new]
            # Shared within the batch: count it here, send one row marked as shared.
            lead = np.ones(len(token), bool)
            lead[1:] = token[1:] != token[:-1]
            run = np.cumsum(lead) - 1
            many = np.bincount(run)[run] > 1
            yield rows(token[lead], np.where(many, -1, key)[lead])
            own, count = np.unique(key[many], return_counts=True)
            # Settled counts travel in the same rows: no token, -2 - count.
            yield rows(own.astype(np.uint64), -2 - count.astype(np.int32))

    def shared(batches):
        """Counts of shared tokens by set, packed by the task that sums them; rows come in order."""
        held, size = [], 0
        # The last row, and whether it still waits for another of its token.
        last_token = last_key = None
        waits = False

        def packed():
            own, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            count = np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)
            order = np.argsort(own % folds, kind="stable")
            own, count = own[order], count[order]
            fold, first = np.unique(own % folds, return_index=True)
            edges = pa.array(np.append(first, len(own)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (own.astype(np.int32), count)]
            return pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), *lists], names=["fold", "keys", "counts"])

        for batch in batches:
            token, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            settled = key < -1
            more = [(token[settled].astype(np.int64), -2 - key[settled].astype(np.int64))]
            token, key = token[~settled], key[~settled].astype(np.int64)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            new[:1] = len(token) > 0 and (token[0] != last_token or key[0] != last_key)
            token, key = token[new], key[new]
            if len(token):
                run = np.cumsum(np.append(False, token[1:] != token[:-1]))
                weight = np.bincount(run, weights=np.where(key == -1, 2, 1))
                if token[0] == last_token:
                    weight[0] += 1
                    if waits:
                        more.append((np.array([last_key]), np.ones(1, np.int64)))
                # Two documents, or one row that says so.
                hits = weight[run] > 1
                found = key[hits & (key >= 0)]
                more.append((found, np.ones(len(found), np.int64)))
                last_token, last_key, waits = token[-1], key[-1], not hits[-1]
            held += more
            size += sum(len(k) for k, _ in more)
            if size > HELD:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def summed(batches):
        held = [(b.column("keys").flatten().to_numpy(), b.column("counts").flatten().to_numpy()) for b in batches]
        if held:
            own, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            count = np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count)], names=["key", "shared"])

    folds = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("text").mapInArrow(prefixes, "token bigint, key int").repartition("token").sortWithinPartitions("token", "key")
    counted = sent.mapInArrow(shared, "fold int, keys array<int>, counts array<bigint>")
    return counted.repartition("fold").mapInArrow(summed, "key int, shared bigint")


def _all_tokens(texts: DataFrame, k: int) -> DataFrame:
    """sig, n, token for every token of the sets whose text has the signature named beside it."""

    def run(batches):
        for batch in batches:
            wanted = batch.column("sig").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                s = _Sets(data, offsets, k)
                right = (s.sig == wanted[lo:hi])[s.doc]
                doc = s.doc[right]
                yield pa.RecordBatch.from_arrays([_long(s.sig[doc]), pa.array(s.n[doc], pa.int64()), _long(s.token[right])], names=["sig", "n", "token"])

    return texts.select("sig", "text").mapInArrow(run, "sig bigint, n bigint, token bigint")


def _need(n, threshold: int):
    """ceil(threshold * n / 100)"""
    return F.ceil(n * threshold / F.lit(100)).cast("int")


def _records(ranked: DataFrame, threshold: int, turn: int) -> DataFrame:
    """sig, n, comp, toks (tokens that other classes share), pre_a, pre_b (their prefixes under two orders).

    `ranked` holds sig, n, comp and the shared tokens with their frequencies.
    Tokens of one class alone come first in both orders and take their places of
    the prefix; a set whose prefix they fill links with nothing more.
    """
    left = (F.size("ranked") - _need(F.col("n"), threshold) + 1).cast("int")

    def prefix(seed: int):
        keyed = F.transform("ranked", lambda x: F.struct(x["df"], F.xxhash64(F.lit(seed), x["token"]), x["token"].alias("token")))
        return F.slice(F.array_sort(keyed), F.lit(1), F.greatest(left, F.lit(0))).getField("token")

    return ranked.filter(left > 0).select(
        "sig", F.col("n").cast("int").alias("n"), "comp", F.col("ranked.token").alias("toks"), prefix(2 * turn).alias("pre_a"), prefix(2 * turn + 1).alias("pre_b")
    )


def _first_records(tokens: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    df = scratch.save(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequencies")
    ranked = tokens.join(df, "token").groupBy("sig", "n").agg(F.collect_set(F.struct("df", "token")).alias("ranked"))
    return _records(ranked.withColumn("comp", F.col("sig")), threshold, 0)


def _next_records(records: DataFrame, comps: DataFrame, scratch: Scratch, threshold: int, turn: int) -> DataFrame:
    """The records of sets that may still link with another class, by the tokens that several classes share."""
    placed = records.join(comps.withColumnRenamed("comp", "c"), F.col("sig") == F.col("v"), "left")
    placed = placed.select("sig", "n", F.coalesce("c", "sig").alias("comp"), F.explode("toks").alias("token"))
    spread = placed.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    spread = scratch.save(spread.filter("lo < hi").select("token", "df"), "spread")
    ranked = placed.join(spread, "token").groupBy("sig", "n", "comp").agg(F.collect_list(F.struct("df", "token")).alias("ranked"))
    return _records(ranked, threshold, turn)


def _verified(pairs: DataFrame, records: DataFrame, threshold: int) -> DataFrame:
    """Those of `pairs` (a, b) that pass the second order's filter and link."""
    side = lambda x: records.select(*[F.col(c).alias(f"{c}_{x}") for c in ("sig", "n", "toks", "pre_b")])
    both = pairs.join(side("x"), F.col("a") == F.col("sig_x")).join(side("y"), F.col("b") == F.col("sig_y"))
    common = F.size(F.array_intersect("toks_x", "toks_y"))
    return (
        both.filter(F.arrays_overlap("pre_b_x", "pre_b_y"))
        .withColumn("common", common)
        .filter(100 * F.col("common") >= threshold * (F.col("n_x") + F.col("n_y") - F.col("common")))
        .select("a", "b")
    )


def _fits(threshold: int):
    """Whether two postings can be of a linking pair: by sizes, shared tokens and places.

    Before the common token at most the smaller place are common, after it at
    most what the shorter rest holds.
    """
    n, m = F.col("n"), F.col("m")
    most = F.least("at", "p_at") + 1 + F.least(F.col("k") - F.col("at"), F.col("p_k") - F.col("p_at")) - 1
    sizes = (n * threshold <= m * 100) & (m * threshold <= n * 100)
    return sizes & ((100 + threshold) * most >= threshold * (n + m))


def _with_bits(records: DataFrame) -> DataFrame:
    """sig, n, comp, pre_a, k (number of toks), and w0 ... : WORDS words with the bits of the toks' hashes."""

    def run(batches):
        for batch in batches:
            toks = batch.column("toks")
            sizes = np.diff(toks.offsets.to_numpy())
            slot = mix(toks.flatten().to_numpy().view(np.uint64)) % np.uint64(64 * WORDS)
            words = np.zeros(len(sizes) * WORDS, np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            np.bitwise_or.at(words, row * WORDS + (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
            columns = [*(batch.column(c) for c in ("sig", "n", "comp", "pre_a")), pa.array(sizes.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(_long(words.reshape(-1, WORDS)[:, i]) for i in range(WORDS))], names=["sig", "n", "comp", "pre_a", "k", *(f"w{i}" for i in range(WORDS))]
            )

    words = ", ".join(f"w{i} bigint" for i in range(WORDS))
    return records.select("sig", "n", "comp", "pre_a", "toks").mapInArrow(run, f"sig bigint, n int, comp bigint, pre_a array<bigint>, k int, {words}")


def _may_overlap(threshold: int):
    """Whether two sets may share enough, by their bitmaps: a bit that one alone has is a token that one alone has."""
    apart = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"p_w{i}"))) for i in range(WORDS)), F.lit(0))
    most = F.col("k") + F.col("p_k") - apart
    return (100 + threshold) * most >= 2 * threshold * (F.col("n") + F.col("m"))


def _classes(records: DataFrame, scratch: Scratch, threshold: int) -> DataFrame | None:
    """sig, comp for the sets that link with another set; None if there are none."""
    links = comps = None
    pair = (F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b"))
    turn, last = 0, False
    while True:
        records = scratch.save(records, f"records-{turn}")
        # What they were made of is not read again.
        scratch.drop("tokens", "frequencies", f"records-{turn - 1}", "spread", "postings", "pivots", "pairs")
        if not records.take(1):
            return comps
        # `at`: how many shared tokens stand before one; `k`: how many there are.
        one = F.struct(F.col("sig").alias("other"), F.col("n").alias("m"), F.col("comp").alias("pc"), F.col("at").alias("p_at"), F.col("k").alias("p_k"))
        if last:
            # Every pair that is still apart and passes the filters, at the first token that it
            # shares: not where one of the RECENT tokens before is shared as well.
            begin = F.greatest(F.col("at") - RECENT, F.lit(0))
            words = [f"w{i}" for i in range(WORDS)]
            placed = _with_bits(records).select("sig", "n", "comp", "pre_a", "k", *words, F.posexplode("pre_a").alias("at", "token"))
            placed = scratch.save(placed.select("sig", "n", "comp", "k", *words, "at", "token", F.slice("pre_a", begin + 1, F.col("at") - begin).alias("recent")), "placed")
            other = placed.select("token", one.alias("p"), F.col("recent").alias("p_recent"), *(F.col(w).alias(f"p_{w}") for w in words))
            other = other.select("token", "p.*", "p_recent", *(f"p_{w}" for w in words))
            first = ~F.arrays_overlap("recent", "p_recent")
            near = placed.join(other, "token").filter((F.col("comp") < F.col("pc")) & _fits(threshold) & _may_overlap(threshold) & first)
        else:
            postings = records.select("sig", "n", "comp", F.size("toks").alias("k"), F.posexplode("pre_a").alias("at", "token"))
            postings = scratch.save(postings, "postings")
            # At first one pivot for all its tokens; later tokens of one set have many.
            seed = [F.col("sig"), F.lit(turn), *([F.col("token")] if turn else [])]
            pivots = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(one, F.xxhash64(*seed)).alias("p"))
            pivots = scratch.save(pivots.filter("lo < hi").select("token", "p.*"), "pivots")
            near = postings.join(pivots, "token").filter((F.col("comp") != F.col("pc")) & _fits(threshold))
        near = scratch.save(near.select(*pair).distinct(), "pairs")
        found = scratch.save(_verified(near, records, threshold), "links")
        fresh = bool(found.take(1))
        if fresh:
            links = found if links is None else links.union(found)
            comps = components(links, scratch)
        if last:
            return comps
        turn += 1
        last = not fresh or turn == PIVOT_ROUNDS
        records = _next_records(records, comps, scratch, threshold, turn) if comps is not None else records


def _sifted(docs: DataFrame, live: DataFrame) -> DataFrame:
    """`docs` without most of those that are not `live`, so that their texts are not shuffled.

    By a bitmap of the ids' hashes, at most 16 MB; for more live documents than it can
    tell apart all stay.  The join with `live` decides.
    """
    bits = 1 << (16 * max(live.count(), 1 << 12) - 1).bit_length()
    if bits > MOST_BITS:
        return docs
    return docs.filter(has_bit(one_row(bitmap(live, "doc_id", bits)), slot("doc_id", bits)))


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, n_shingles, component_id: the smallest doc_id that links reach.

    Null or empty texts have an empty set and link with nothing, not even each
    other.  Rows with equal sets are one class, repeated rows and doc_ids
    included.  Null doc_ids link like others but name no component unless all of
    it are null.  Other columns are not read.  Texts are taken whole.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    plain = docs.select("doc_id", "text")
    sizes = scratch.save(set_sizes(plain, k), "sizes")
    distinct = sizes.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"))
    shared = scratch.save(_first_order(plain, k, threshold), "shared")
    # The least that a partner, at most so much smaller, makes a set share in the prefix.
    least = F.greatest(F.lit(1), F.floor(_need(F.col("n"), threshold) / EXTRA))
    live = distinct.withColumn("key", _filter_key("sig")).join(shared, "key").filter(F.col("shared") >= least)
    live = scratch.save(live.select("doc_id", "sig"), "live")
    near = _sifted(plain, live)
    texts = near.join(live.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).select("sig", "text")
    tokens = scratch.save(_all_tokens(texts, k), "tokens")
    comps = _classes(_first_records(tokens, scratch, threshold), scratch, threshold)
    placed = sizes.withColumn("comp", F.col("sig"))
    if comps is not None:
        placed = sizes.join(comps, F.col("sig") == F.col("v"), "left").select("doc_id", "n", "sig", F.coalesce("comp", "sig").alias("comp"))
    placed = scratch.save(placed, "placed")
    least_id = scratch.save(placed.filter("n > 0").groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("least")), "least")
    return placed.join(least_id, (F.col("comp") == F.col("c")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_per_class(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class: the one with the smallest doc_id.

    Documents with an empty set all stay.  Of rows equal in doc_id and text one
    stays; all columns are kept.
    """
    classes = jaccard_classes(docs, k, threshold)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")
