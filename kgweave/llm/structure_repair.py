"""Repair of conversations: the cheapest edits that give alternating turns, audited.

Rows are first damaged on purpose, by a hash of their place, so that there is something
to find.  Then each row has one letter for its role's initial and its first fault, the
letters of a conversation stand in one string, and a dynamic program over it finds the
cheapest edits whose roles read (s?(ua)+)?.

The program keeps, for each state of that pattern, one audit: a node that points back to
the node it grew from, so audits share their beginnings.  Every node has ancestors at
distances 1, 2, 4, ... and a rolling hash of its audit.  Audits of one cost are told apart
at the end of their longest common prefix, which a search over the ancestors' hashes
finds; where hashes agree the nodes are the same or their letters are compared.  Two
audits of one state and cost are never one the beginning of the other, since the rest
would be insertions and cost more; so the lesser one stays the lesser, whatever follows.

Texts take no part in this.  They meet the edits again by conversation and position, and
the repaired conversation is hashed as a stream.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch, sha256_hex
from kgweave.llm.turn_order import chained_sha256, in_order

#: Fixed values of the damage: the hash's modulus and what its first remainders do.
MODULUS, DROP, EMPTY, UNENDED, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4
VISIBLE, LAST_STOP, STOPS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z", "[.!?]"
#: What the edits cost, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

INITIALS = "sua"
FINE, CUT, BLANK, DUPLICATE = range(4)
#: The state after a role's initial in each state (start, s, u, a), and the roles that edits give.
LEGAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
#: Letters of a plan: K and D keep and delete a row, u and a rerole it, U and A insert one.
AUDIT = {"K": "K", "D": "D", "u": "R", "a": "R", "U": "I", "A": "I"}

CHUNK_BITS = 12
#: Rows after which the beginning that all audits share is written out.
BLOCK = 1 << 12
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """An audit: its last letter, its length, its hash, and its ancestors at distances 1, 2, 4, ..."""

    __slots__ = ("letter", "depth", "hash", "ups")

    def __init__(self, letter: str = "", parent: Node | None = None):
        self.letter, self.depth, self.hash, self.ups = letter, 0, 0, []
        if parent is not None:
            self.depth = parent.depth + 1
            self.hash = (parent.hash * _BASE + ord(AUDIT[letter])) % _PRIME
            while parent is not None:
                self.ups.append(parent)
                rank = len(self.ups) - 1
                parent = parent.ups[rank] if rank < len(parent.ups) else None

    def at(self, depth: int) -> Node:
        """The ancestor of this depth."""
        node, rest = self, self.depth - depth
        while rest:
            rank = rest.bit_length() - 1
            node, rest = node.ups[rank], rest - (1 << rank)
        return node

    def letters(self, above: int = 0) -> str:
        out, node = [], self
        while node.depth > above:
            out.append(node.letter)
            node = node.ups[0]
        return "".join(reversed(out))


def _same(a: Node, b: Node) -> bool:
    """Whether two audits of one length are equal: by hash, then by their letters up to a shared node."""
    if a.hash != b.hash:
        return False
    while a is not b:
        if AUDIT[a.letter] != AUDIT[b.letter]:
            return False
        a, b = a.ups[0], b.ups[0]
    return True


def common_prefix(a: Node, b: Node) -> int:
    """Length of the longest common prefix of two audits."""
    size = min(a.depth, b.depth)
    a, b = a.at(size), b.at(size)
    if _same(a, b):
        return size
    for rank in reversed(range(len(a.ups))):
        if rank < len(a.ups) and not _same(a.ups[rank], b.ups[rank]):
            a, b = a.ups[rank], b.ups[rank]
    return a.depth - 1


def before(a: Node, b: Node) -> bool:
    """Whether audit a stands before audit b in ASCII order."""
    shared = common_prefix(a, b)
    if shared in (a.depth, b.depth):
        return a.depth < b.depth
    return AUDIT[a.at(shared + 1).letter] < AUDIT[b.at(shared + 1).letter]


def _least(offers: list[tuple[int, Node, str]]) -> tuple[int, Node]:
    """The cheapest offer (cost, audit, letter to add), of equal ones the ASCII-least."""
    cost = min(offer[0] for offer in offers)
    ties = [Node(letter, node) if letter else node for at, node, letter in offers if at == cost]
    best = ties[0]
    for node in ties[1:]:
        if before(node, best):
            best = node
    return cost, best


def _with_insertions(live: dict) -> dict:
    """The states after any number of inserted rows; more than two never pay.

    Of the start and of "s" nothing comes that does not come of "a", but for one kept
    "s", which can be deleted instead; so they go once that is cheaper.
    """
    for _ in range(2):
        for state, (cost, node) in sorted(live.items()):
            to, letter = LEGAL[state][GIVEN[state]], GIVEN[state].upper()
            if to not in live or cost + INSERT <= live[to][0]:
                live[to] = _least([(cost + INSERT, node, letter), *([(*live[to], "")] if to in live else [])])
    for state, more in ((0, DELETE), (1, 0)):
        if state in live and live[state][0] > live[3][0] + more:
            del live[state]
    return live


def _settled(live: dict) -> tuple[str, dict]:
    """The beginning that all audits share, and the audits without it, still sharing their nodes."""
    nodes = [node for _, node in live.values()]
    shared = min(common_prefix(nodes[0], node) for node in nodes)
    done = nodes[0].at(shared).letters()
    fresh = {id(nodes[0].at(shared)): Node()}
    root = fresh[id(nodes[0].at(shared))]

    def moved(node: Node) -> Node:
        path = []
        while node.depth > shared and id(node) not in fresh:
            path.append(node)
            node = node.ups[0]
        new = fresh.get(id(node), root)
        for old in reversed(path):
            new = fresh[id(old)] = Node(old.letter, new)
        return new

    return done, {state: (cost, moved(node)) for state, (cost, node) in live.items()}


def repair(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and plan of the cheapest edits, of equal ones the ASCII-least audit; `codes` as `code_letter` makes them.

    Memory grows with the length only as far as the audits of the four states differ.
    """
    live, done = _with_insertions({0: (0, Node())}), []
    for place, code in enumerate(codes, 1):
        initial, fault = divmod(ord(code) - 65, 4)
        offers: dict[int, list[tuple[int, Node, str]]] = defaultdict(list)
        for state, (cost, node) in live.items():
            offers[state].append((cost + DELETE, node, "D"))
            if fault in (FINE, CUT):
                stays = cost + (TRUNCATED if fault == CUT else 0)
                following = LEGAL[state].get(INITIALS[initial]) if initial < len(INITIALS) else None
                if following is not None:
                    offers[following].append((stays, node, "K"))
                offers[LEGAL[state][GIVEN[state]]].append((stays + REROLE, node, GIVEN[state]))
        live = _with_insertions({state: _least(some) for state, some in offers.items()})
        if place % block == 0:
            settled, live = _settled(live)
            done.append(settled)
    cost, node = _least([(*live[state], "") for state in (0, 3) if state in live])
    return cost, "".join(done) + node.letters()


_short = lru_cache(1 << 16)(repair)


def tally(codes: str) -> tuple[int, int, int, int]:
    """Blank, duplicate, truncated and illegal of a conversation."""
    initials = [(INITIALS + "x")[(ord(c) - 65) // 4] for c in codes]
    faults = [(ord(c) - 65) % 4 for c in codes]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal


def code_letter(role: Column, text: Column, repeated: Column) -> Column:
    """One letter for a row's initial (s, u, a, other) and its first fault."""
    initial = F.left(role, F.lit(1))
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.rlike(text, F.lit(VISIBLE)), BLANK).when(repeated, DUPLICATE).when(~F.rlike(text, F.lit(LAST_STOP)), CUT).otherwise(FINE)
    return F.char(F.lit(65) + F.lit(4) * which + fault)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; null role and text are one space."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(place.cast("binary")) % F.lit(MODULUS)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).filter(F.col("fate") != DROP)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == AS_USER, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == EMPTY, F.lit("")).when(F.col("fate") == UNENDED, F.regexp_replace("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == REPEAT, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _plans(batches):
    for batch in batches:
        rows = []
        for codes in batch.column(1).to_pylist():
            cost, plan = _short(codes) if len(codes) <= 64 else repair(codes)
            rows.append((*tally(codes), cost, plan))
        columns = [pa.array(x) for x in zip(*rows, strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "plan"])


def _lines(piece: Column, role: Column, text: Column) -> Column:
    """Lines of one piece of a plan, inserted rows and then the row itself; null if it has none."""
    letters = F.filter(F.split(piece, ""), lambda x: x != "")
    line = (
        lambda x: F.when(x == "K", F.concat(role, F.lit(":"), text))
        .when(x.isin(*ROLES), F.concat(F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]), F.lit(":"), text))
        .when(x == "U", F.lit(ROLES["u"] + ":"))
        .when(x == "A", F.lit(ROLES["a"] + ":"))
    )
    lines = F.filter(F.transform(letters, line), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def repair_conversations(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """Audit of the repair of every damaged conversation, from `conversations` (conv_id, turn, role, text).

    Rows stand by turn, nulls first, ties by role, then text.  Null role and text are one
    space, also in the hash of a row's place.  Rows with a null conv_id are one
    conversation, with a null id.  Repeated rows are rows of their own, so all but the
    first are duplicates.  A conversation without rows after the damage has zeros, an
    empty audit and the empty text's hash; an empty table gives an empty table.  Other
    columns are left out.  Two texts count as equal if their sha-256 does.

    A task holds one letter per row of a conversation at a time, never its texts: an audit
    is one value of that length, so a conversation may have at most 2^31 rows.  The
    repaired text is hashed as a stream.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    """
    scratch = Scratch(conversations.sparkSession, "structure-repair")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = scratch.save(in_order(damaged(conversations), "conv_id", ["turn", "role", "text"], scratch, parts=parts).withColumn("digest", digest), "rows")
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("pos").alias("first_pos")).select(F.col("conv_id").alias("_conv"), "first_pos")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("first_pos")), "left")
    letters = met.select("conv_id", "pos", code_letter(F.col("role"), F.col("text"), F.col("first_pos").isNull()).alias("code"))

    def joined(grouped, order: str, text: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(order, text)))
        return grouped.agg(F.array_join(F.transform(ordered, lambda x: x[text]), "").alias("codes"))

    chunks = joined(letters.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")), "pos", "code")
    codes = joined(chunks.groupBy("conv_id"), "chunk", "codes")
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("blank", "duplicate", "truncated", "illegal", "cost"))
    plans = scratch.save(codes.select("conv_id", "codes").mapInArrow(_plans, f"conv_id {kind}, {counts}, plan string"), "plans")
    pieces = plans.select(F.col("conv_id").alias("_conv"), F.posexplode(F.regexp_extract_all("plan", F.lit("([UA]*[KDua]|[UA]+$)"), 1)).alias("at", "piece"))
    edited = pieces.join(rows, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("at") + 1 == F.col("pos")), "left")
    lines = edited.select(F.col("_conv").alias("conv_id"), "at", _lines(F.col("piece"), F.col("role"), F.col("text")).alias("line"))
    hashed = chained_sha256(lines, ["conv_id"], "at", "line", "\n")
    turns = rows.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    out = conversations.select("conv_id").distinct()
    for part, name in ((turns.select("conv_id", gaps.alias("gaps")), "g"), (plans, "p"), (hashed, "h")):
        out = out.join(part.withColumnRenamed("conv_id", f"_{name}"), F.col("conv_id").eqNullSafe(F.col(f"_{name}")), "left").drop(f"_{name}")
    zeros = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    audit = F.translate(F.coalesce("plan", F.lit("")), "".join(AUDIT), "".join(AUDIT.values()))
    return out.select("conv_id", *(v.alias(c) for c, v in zeros.items()), audit.alias("audit"), F.coalesce("sha256", F.lit(sha256_hex(""))).alias("repaired_sha256"))
