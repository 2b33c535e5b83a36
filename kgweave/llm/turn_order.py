"""Rows of conversations in order, numbered and summed up however long a conversation is.

Rows are dealt out by ranges of (conversation, order), so a conversation with a third of
all rows lies in many tasks.  Each task numbers its rows within each conversation and
keeps running sums and a running fingerprint; what a conversation had before a task's
share is composed from the totals of the tasks before.  At most one conversation runs on
from one task into the next, so there are fewer such totals than twice the tasks.

Fingerprints are elements (n, s) of a monoid: n turns, and s the sum of B^i t_i for their
hashes t_1 ... t_n modulo a prime.  (n, s) followed by (m, r) is (n + m, s + B^n r).
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch


class Hash(NamedTuple):
    """A prime under 2^31, and the base B of each lane."""

    prime: int
    bases: tuple[int, ...]

    def powers(self, lane: int, n: int) -> np.ndarray:
        """B^0 ... B^(n - 1)."""
        out = np.ones(max(n, 1), np.uint64)
        have, step = 1, self.bases[lane]
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(self.prime)
            have, step = have + more, step * step % self.prime
        return out


def _numbered(key: str, sums: tuple[str, ...], lanes: tuple[str, ...], hashing: Hash | None):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, before, totals, marks = None, 0, [0] * len(sums), [0] * len(lanes)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            fresh = np.ones(n, bool)
            if n > 1:
                a, b = keys.slice(1), keys.slice(0, n - 1)
                other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                fresh[1:] = other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
            same = last is not None and last[0] == keys[0].as_py()
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(fresh, at, 0))
            run_on = (start == 0) & same
            k = at - start + 1
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(k + np.where(run_on, before, 0))]
            for i, name in enumerate(sums):
                value = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(value)
                total = total - (total - value)[start] + np.where(run_on, totals[i], 0)
                totals[i] = int(total[-1])
                columns.append(pa.array(total))
            for i, name in enumerate(lanes):
                prime = np.uint64(hashing.prime)
                power = hashing.powers(i, n + 1)
                term = batch.column(name).to_numpy(zero_copy_only=False).astype(np.uint64) * power[k] % prime
                total = np.cumsum(term)
                total = (total - (total - term)[start]) % prime
                shift = np.uint64(pow(hashing.bases[i], before, hashing.prime))
                total = np.where(run_on, (total * shift + np.uint64(marks[i])) % prime, total).astype(np.int64)
                marks[i] = int(total[-1])
                columns.append(pa.array(total))
            before = int(k[-1]) + (before if run_on[-1] else 0)
            last = (keys[n - 1].as_py(),)
            names = [*batch.schema.names, "part", "k", *(f"sum_{c}" for c in sums), *(f"mark_{c}" for c in lanes)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def in_order(
    rows: DataFrame,
    key: str,
    order: list[str],
    scratch: Scratch,
    sums: tuple[str, ...] = (),
    lanes: tuple[str, ...] = (),
    hashing: Hash | None = None,
    keep: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The columns `keep` (all but for `lanes`' inputs by default) with `pos`, 1 for a conversation's first row.

    Adds sum_<c> for each of `sums` and mark_<c> for each of `lanes`: of the rows up to
    and with this one.  Nulls come first; rows equal in `order` stand in any order.  A
    null key is a conversation of its own.
    """
    keep = keep or rows.columns
    dealt = rows.repartitionByRange(parts, key, *order) if parts else rows.repartitionByRange(key, *order)
    sorted_rows = dealt.sortWithinPartitions(key, *order).select(*keep)
    added = ["part int", "k bigint", *(f"sum_{c} bigint" for c in sums), *(f"mark_{c} bigint" for c in lanes)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields), *added])
    held = scratch.save(sorted_rows.mapInArrow(_numbered(key, sums, lanes, hashing), schema), "in-order")
    state = [*(f"sum_{c}" for c in sums), *(f"mark_{c}" for c in lanes)]
    ends = held.groupBy(key, "part").agg(F.max("k").alias("n"), *(F.max_by(c, "k").alias(c) for c in state))
    spread = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "n", *state))).alias("ends")).filter(F.size("ends") > 1)
    # Fewer rows than twice the tasks: a task shares its first and its last conversation only.
    carried = _carried(spread.collect(), sums, lanes, hashing)
    shifts = [f"shift_{c}" for c in lanes]
    kind = rows.schema[key].dataType.simpleString()
    names = ["before", *(f"before_{c}" for c in state), *shifts]
    carry = rows.sparkSession.createDataFrame(carried, ", ".join([f"_key {kind}", "_part int", *(f"{c} bigint" for c in names)]))
    met = held.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    out = {"pos": F.col("k") + F.coalesce("before", F.lit(0))}
    for c in sums:
        out[f"sum_{c}"] = F.col(f"sum_{c}") + F.coalesce(f"before_sum_{c}", F.lit(0))
    for c in lanes:
        moved = F.col(f"before_mark_{c}") + F.col(f"mark_{c}") * F.col(f"shift_{c}")
        out[f"mark_{c}"] = F.coalesce(F.pmod(moved, F.lit(hashing.prime)), f"mark_{c}")
    return met.select(*keep, *(column.alias(name) for name, column in out.items()))


def _carried(spread, sums, lanes, hashing) -> list[tuple]:
    """State before each part of the conversations that lie in several, but for their first."""
    out = []
    for key, ends in spread:
        before, totals = 0, defaultdict(int)
        for end in ends:
            if before:
                shifts = [pow(base, before, hashing.prime) for base in hashing.bases] if lanes else []
                out.append((key, end["part"], before, *(totals[f"sum_{c}"] for c in sums), *(totals[f"mark_{c}"] for c in lanes), *shifts))
            for c in sums:
                totals[f"sum_{c}"] += end[f"sum_{c}"]
            for i, c in enumerate(lanes):
                shift = pow(hashing.bases[i], before, hashing.prime)
                totals[f"mark_{c}"] = (totals[f"mark_{c}"] + shift * end[f"mark_{c}"]) % hashing.prime
            before += end["n"]
    return out


def chained_sha256(rows: DataFrame, keys: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """keys and `sha256`: lowercase hex of each group's texts in order, joined by the separator.

    A digest is sequential, so one task reads a group's texts, one batch at a time, and
    holds the digest's state only.  Null texts are skipped.
    """
    dealt = rows.filter(F.col(text).isNotNull()).select(*keys, order, text)
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, text)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}

    def run(batches):
        import hashlib

        last = digest = None

        def row(key, digest):
            return pa.RecordBatch.from_arrays(
                [*(pa.array(list(c), batch.schema.field(i).type) for i, c in enumerate(zip(*key, strict=True))), pa.array(digest)],
                names=[*keys, "sha256"],
            )

        for batch in batches:
            done, hexes = [], []
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for key, piece in zip(zip(*columns, strict=True), batch.column(len(keys)).to_pylist(), strict=True):
                if digest is None or key != last:
                    if digest is not None:
                        done.append(last)
                        hexes.append(digest.hexdigest())
                    last, digest = key, hashlib.sha256(piece.encode())
                else:
                    digest.update(separator.encode() + piece.encode())
            if done:
                yield row(done, hexes)
        if digest is not None:
            yield row([last], [digest.hexdigest()])

    return ordered.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sha256 string"]))
