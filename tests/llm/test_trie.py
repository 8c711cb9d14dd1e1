"""Prefix trie against a plain one, and balanced parentheses against a stack."""

import hashlib
import random

import numpy as np
import pytest

from tenurekit.llm import parentheses, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, path string, run int"


def _table(spark, rows):
    return spark.createDataFrame([(*row, "d", "p", 3) for row in rows], SCHEMA)


def _plain(rows):
    by_id = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by_id.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [(role, text) for *_, role, text in sorted(own)] for c, own in by_id.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = prefix_trie.shared_turns(c)
        base = c - int(np.fmod(c, 100))
        rebuilt = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], set()).add(c)
        ends.setdefault(rebuilt, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        own = [below(x) for x in children.get(node, [])]
        size = len(node[-1][1]) if node else 0
        return sum(x for x, _ in own) or 1, sum(y for _, y in own) + (len(members[node]) - 1) * size

    out = set()
    for node, own in members.items():
        leaves, saved = below(node)
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return out


def _rows(seed, n=400):
    r = random.Random(seed)
    out = []
    for c in [*range(0, n), -1, -5, -100, -142, 10**12 + 3]:
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([1, 2, 3, 3, 4, 9])):
            out.append((c, r.choice([turn, turn, turn, None]), r.choice(["u", "a", None]), r.choice(["x", "y", "", None, "é漢", "a longer text"]) if r.random() < 0.7 else "first"))
    out += [(300 + i, t, "u", f"same {t}") for i in range(60) for t in range(6)]  # further turns of many conversations
    out += out[:7] + [(None, 0, "u", "nobody's")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("nodes", "seed"), [(1 << 16, 1), (40, 2), (3, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, nodes, seed):
    """Runs of few nodes: seams through the root, through inner nodes and at the end of conversations."""
    monkeypatch.setattr(prefix_trie, "RUN_NODES", nodes)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    rows = _rows(seed, 400 if nodes > 3 else 60)
    got = [tuple(x) for x in prefix_trie.prefix_trie(_table(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _plain(rows)


def test_long_conversation_and_copies(spark):
    rows = [(c, t, "u", f"t{t}") for c in (0, 1, 50) for t in range(3000)]
    got = {x.depth: x for x in prefix_trie.prefix_trie(_table(spark, rows)).collect()}
    assert len(got) == 3001 and all(x.n_convs == 3 and x.n_leaves == 1 for x in got.values())
    assert got[0].saved_tokens == 2 * sum(len(f"t{t}") for t in range(3000)) and got[3000].ends_sha256 == hashlib.sha256(b"0,1,50").hexdigest()


def test_conversation_left_without_turns(spark):
    alone = next(c for c in range(700, 800) if prefix_trie.shared_turns(c) == 5)
    rows = [(alone, 0, "u", "hello")]
    got = [tuple(x) for x in prefix_trie.prefix_trie(_table(spark, rows)).collect()]
    assert got == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(_table(spark, [(None, None, None, None)])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_findclose(seed):
    r = random.Random(seed)
    steps, depth = [1], 1
    while depth:
        up = len(steps) < 3000 and r.random() < (0.5, 0.7, 0.5, 0.55, 0.9, 0.3)[seed]
        if depth == 1 and len(steps) < 1000:
            up = True
        steps.append(1 if up else -1)
        depth += steps[-1]
    want, stack = {}, []
    for i, s in enumerate(steps):
        if s > 0:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opened = np.array(sorted(want))
    assert parentheses.Parentheses(np.array(steps, np.int8)).findclose(opened).tolist() == [want[i] for i in opened.tolist()]


def test_range_least():
    values = np.random.default_rng(1).integers(0, 1000, 500)
    bounds = sorted((a, b) for a in range(0, 500, 7) for b in range(a + 1, 501, 11))
    lo, hi = map(np.array, zip(*bounds, strict=True))
    assert parentheses.range_least(values, lo, hi).tolist() == [values[a:b].min() for a, b in bounds]
