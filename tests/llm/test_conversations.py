"""Prefix trie and structure repair against brute force, on hand rows and random ones."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from kgweave.llm import prefix_trie, structure_repair
from kgweave.llm.common import Scratch
from kgweave.llm.turn_order import Hash, chained_sha256, in_order

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EXTRA = ", pos int, k string, cost string, d int, w string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def in_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_rows(seed, families=3, extra=()):
    """Conversations with few distinct turns, nulls, repeated rows, gaps and ties."""
    rng = random.Random(seed)
    rows = [(None, 1, "user", "no conversation.")]
    for family in range(families):
        for c in rng.sample(range(family * 20, family * 20 + 20), 14):
            for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
                role = rng.choice(["user", "assistant", "system", "tool", None, ""])
                text = rng.choice(["hello there.", "yes", "why so?", "", None, " \t", "a b c!"])
                rows.append((c, rng.choice([turn, turn, turn * 2, None]), role, text))
    rows += rng.sample(rows, 10)
    return rows + list(extra)


# --- order -------------------------------------------------------------------------------------


def test_order_of_a_conversation_over_many_tasks(spark):
    """Numbers, sums and fingerprints run on over the borders of tasks."""
    rng = random.Random(4)
    rows = [(7, t, rng.randrange(50), rng.randrange(1000)) for t in range(900)] + [(c, t, 1, 2) for c in (3, None, 9) for t in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "c bigint, turn int, w bigint, t bigint").repartition(5)
    hashing = Hash(1009, (10,))
    got = in_order(df, "c", ["turn"], Scratch(spark, "test"), ("w",), ("t",), hashing, parts=8).collect()
    seen = {(r.c, r.turn): r for r in got}
    assert len(seen) == len(rows) == len(got)
    for c in (7, 3, None, 9):
        total = mark = 0
        for pos, (_, turn, w, t) in enumerate(sorted(r for r in rows if r[0] == c), 1):
            total += w
            mark = (mark + pow(10, pos, 1009) * t) % 1009
            r = seen[c, turn]
            assert (r.pos, r.sum_w, r.mark_t) == (pos, total, mark)


def test_digest_of_a_stream(spark):
    rows = [(i % 3 if i % 3 else None, i, f"t{i}" if i % 5 else None) for i in range(50)]
    got = chained_sha256(spark.createDataFrame(rows, "g int, at int, text string").repartition(4), ["g"], "at", "text", "|")
    want = {g: sha("|".join(t for k, _, t in rows if k == g and t)) for g in (None, 1, 2)}
    assert {r.g: r.sha256 for r in got.collect()} == want


# --- 11: prefix trie ---------------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for r in in_turn([(c, t, a or "", b or "") for c, t, a, b in rows if c is not None]):
        turns.setdefault(r[0], []).append(r[2:])
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        leaves, saved = 0 if kids.get(node) else 1, (len(members[node]) - 1) * (words(node[-1][1]) if node else 0)
        for kid in kids.get(node, []):
            more = below(kid)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, inside in members.items():
        ends = sorted(c for c in inside if len(built[c]) == len(node))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(kids.get(node, [])), *below(node), sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed):
    rows = random_rows(seed, extra=[(40, t, "user", "same") for t in range(30)] + [(c, t, "user", "same") for c in (45, 46) for t in range(30)])
    wide = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], SCHEMA + EXTRA).repartition(5)
    assert trie_rows(prefix_trie.prefix_trie(wide)) == plain_trie(rows)


def test_trie_of_many_copies_and_of_ids_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = [(c, t, "user", f"hot {t}") for c in range(0, 300, 3) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_collisions_are_found_and_mended(spark):
    """A prime of 3 makes unlike turns and prefixes collide; the next attempt is right."""
    rows = random_rows(9)
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(prefix_trie.Collision):
        prefix_trie.prefix_trie(df, attempts=((3, 0),))
    assert trie_rows(prefix_trie.prefix_trie(df, attempts=((3, 0), (prefix_trie.PRIME, 1)))) == plain_trie(rows)


def test_prefix_collisions_are_found(spark):
    """Unlike turns with hashes of their own, but products that agree: B = -1, and turns in another order."""
    texts = ["p", "q", "r"]
    rows = [(21, i, "user", t) for i, t in enumerate(texts)] + [(25, i, "user", t) for i, t in enumerate(reversed(texts))]
    same = Hash(prefix_trie.PRIME, (prefix_trie.PRIME - 1,) * 3)
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(prefix_trie, "_hashing", lambda prime, seed: same)
        patch.setattr(prefix_trie, "head_turns", lambda c: c * 0)
        with pytest.raises(prefix_trie.Collision):
            prefix_trie.prefix_trie(df)


# --- 12: structure repair ----------------------------------------------------------------------


@lru_cache(None)
def plain_repair(codes):
    """Cost and audit by recursion over the rest of the rows, with whole strings."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []
        then = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
        to = structure_repair.LEGAL[state][structure_repair.GIVEN[state]]
        if inserted < 3:
            then(2, "I", best(i, to, inserted + 1))
        if i < len(codes):
            initial, fault = divmod(ord(codes[i]) - 65, 4)
            then(3, "D", best(i + 1, state, 0))
            if fault < 2:
                kept = structure_repair.LEGAL[state].get("suax"[initial])
                if kept:
                    then(fault, "K", best(i + 1, kept, 0))
                then(2 + fault, "R", best(i + 1, to, 0))
        return min(found) if found else None

    return best(0, 0, 0)


def random_codes(rng, n):
    return "".join(chr(65 + 4 * rng.choice([0, 1, 1, 2, 2, 3]) + rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n))


def audit_of(plan):
    return plan.translate(str.maketrans(structure_repair.AUDIT))


def test_cheapest_audit_against_recursion():
    rng = random.Random(12)
    for _ in range(800):
        codes = random_codes(rng, rng.randint(0, 14))
        for block in (2, 3, 1 << 12):
            cost, plan = structure_repair.repair(codes, block)
            assert (cost, audit_of(plan)) == plain_repair(codes)


def test_long_conversation_is_settled_in_blocks():
    codes = random_codes(random.Random(3), 6000)
    assert structure_repair.repair(codes, 64) == structure_repair.repair(codes, 1 << 20)


def test_common_prefix_of_audits(monkeypatch):
    rng = random.Random(1)
    for prime in (structure_repair._PRIME, 5):  # a small prime makes hashes collide
        monkeypatch.setattr(structure_repair, "_PRIME", prime)
        for _ in range(200):
            shared = "".join(rng.choice("KD") for _ in range(rng.randint(0, 20)))
            one, two = (shared + "".join(rng.choice("KDUu") for _ in range(rng.randint(0, 6))) for _ in range(2))
            nodes, root = [], structure_repair.Node()
            for text in (one, two):
                node = root
                for letter in text:
                    node = structure_repair.Node(letter, node)
                nodes.append(node)
            a, b = audit_of(one), audit_of(two)
            assert structure_repair.common_prefix(*nodes) == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert structure_repair.before(*nodes) == (a < b)


def plain_repaired(rows):
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            role, text = "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            groups[c] += [(c, turn, role, text)] * (2 if fate == 3 else 1)
    out = []
    for c, some in groups.items():
        some = in_turn(some)
        codes, seen, faults = "", set(), [0] * 4
        for _, _, role, text in some:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 2 if not visible else 3 if (role, text) in seen else 1 if visible[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes += chr(65 + 4 * ("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3) + fault)
        turns = [t for _, t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(some, some[1:], strict=False)]
        cost, audit = plain_repair(codes)
        state, left, lines = 0, iter(some), []
        for edit in audit:
            given = structure_repair.GIVEN[state]
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            role = row[2] if edit == "K" else structure_repair.ROLES[given]
            lines.append(f"{role}:{row[3] if row else ''}")
            state = structure_repair.LEGAL[state][role[0]]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((c, gaps, faults[2], faults[3], faults[1], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repair_against_brute_force(spark, seed):
    rows = random_rows(seed + 50, extra=[(None, None, None, None), (99, None, "user", "again."), (99, None, "user", "again.")])
    wide = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], SCHEMA + EXTRA).repartition(5)
    assert sorted((tuple(r) for r in structure_repair.repair_conversations(wide).collect()), key=repr) == plain_repaired(rows)


def test_repair_of_a_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "CHUNK_BITS", 4)
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t // 40}.") for t in range(120)] + [(2, 1, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = structure_repair.repair_conversations(df, parts=9)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_repaired(rows)


def test_repair_of_nothing(spark):
    assert structure_repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = structure_repair.repair_conversations(spark.createDataFrame([(5, gone, "user", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_powers():
    assert Hash(101, (7,)).powers(0, 12).tolist() == [pow(7, i, 101) for i in range(12)]
    assert np.asarray(Hash(101, (7,)).powers(0, 1)).tolist() == [1]
