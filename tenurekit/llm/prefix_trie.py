"""The prefix trie of conversations, by balanced parentheses in shards of the sorted paths.

A conversation's path is the row of its nodes' keys; a node's key is a digest of its parent's and of its own turn. Equal
paths are folded. Distinct paths are sorted and cut into runs; in each run the trie is a row of balanced parentheses:
a node's closing parenthesis delimits its subtree, ranks count nodes and leaves in it, and cumulative sums in preorder
give its members and what its texts would save. Nodes on the seam of two runs appear in both. Each run knows the paths
next to it, so it counts a seam's node, child or leaf only where it comes first or is final, and seams merge by sums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.batches import rows
from tenurekit.llm.parentheses import Parentheses, range_least
from tenurekit.llm.scratch import staged

#: Conversations of which one lends the others its first turns, and the most turns it lends.
FAMILY, MOST_SHARED = 100, 5
#: Nodes of a run of paths.
RUN_NODES = 1 << 16
#: Bits of a conversation's number within a piece of a list of members.
PIECE_BITS = 10
#: Bytes of a node's key, and of paths that a task gathers before it passes them on.
KEY, GATHERED = 16, 1 << 23

_PATHS = "path binary, sizes binary, conv_id bigint"
_FOLDED = "path binary, sizes binary, n_ends bigint, conv_id bigint, ends_sha256 string"
_NODES = "key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, weighted bigint, once bigint, seam boolean, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its family's first one."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


def _turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, digest, size): each turn without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.length(text).alias("size"))
    return own.where("conv_id is not null").withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of conversations from sorted turns; in each family the lending conversation comes first."""
    done: list[tuple[bytes, bytes, int]] = []
    gathered = 0
    family, lent, conv, place, shared = None, [], None, 0, 0
    path, sizes, last = bytearray(), [], b""

    def take(digest: bytes, size: int) -> None:
        nonlocal last
        last = hashlib.md5(last + digest, usedforsecurity=False).digest()
        path.extend(last)
        sizes.append(size)

    def batch() -> pa.RecordBatch:
        out = rows(_PATHS, path=[p for p, _, _ in done], sizes=[s for _, s, _ in done], conv_id=[c for _, _, c in done])
        done.clear()
        return out

    for part in batches:
        for of, c, digest, size in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if c != conv or of != family:
                if conv is not None:
                    done.append((bytes(path), np.array(sizes, np.int64).tobytes(), conv))
                    gathered += len(path)
                    if len(done) >= 4096 or gathered > GATHERED:
                        yield batch()
                        gathered = 0
                if of != family:
                    family, lent = of, []
                conv, place, shared, last = c, 0, shared_turns(c), b""
                path, sizes = bytearray(), []
                if conv != family:
                    for turn in lent[:shared]:
                        take(*turn)
            digest = bytes.fromhex(digest)
            if conv == family and place < MOST_SHARED:
                lent.append((digest, size))
            if conv == family or place >= shared:
                take(digest, size)
            place += 1
    if conv is not None:
        done.append((bytes(path), np.array(sizes, np.int64).tobytes(), conv))
    if done:
        yield batch()


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(path, sizes, conv_id) of each rebuilt conversation: 16 bytes a node, and 8 a size in code points."""
    turns = _turns(conversations).withColumn("lends", F.col("conv_id") == F.col("family"))
    ordered = turns.repartition("family").sortWithinPartitions("family", F.desc("lends"), "conv_id", F.asc_nulls_first("turn"), "digest")
    return ordered.select("family", "conv_id", "digest", "size").mapInArrow(_rebuilt, _PATHS)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path from its sorted pieces: members in all, the smallest, and the digest of their list."""
    done: list[tuple] = []
    known, digest = None, None
    for part in batches:
        for path, sizes, n, conv, ids in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
            if known and known[0] == path:
                known = (path, sizes, known[2] + n, known[3])
                digest.update(b"," + ids.encode())
                continue
            if known:
                done.append((*known, digest.hexdigest()))
            known, digest = (path, sizes, n, conv), hashlib.sha256(ids.encode())
        if done:
            yield _fold_rows(done)
            done = []
    if known:
        yield _fold_rows([(*known, digest.hexdigest())])


def _fold_rows(done: list[tuple]) -> pa.RecordBatch:
    return rows(_FOLDED, **dict(zip(("path", "sizes", "n_ends", "conv_id", "ends_sha256"), map(list, zip(*done, strict=True)), strict=True)))


def folded_paths(paths: DataFrame) -> DataFrame:
    """(path, sizes, n_ends, conv_id, ends_sha256): distinct paths with their members. Lists of members are sorted and
    written in pieces of bounded length, so a path with very many members is one task only for the digest over its pieces."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = paths.groupBy("path", "sizes", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), listed.alias("ids"))
    ordered = pieces.repartition("path").sortWithinPartitions("path", "piece")
    return staged(ordered.select("path", "sizes", "n", "conv_id", "ids").mapInArrow(_folded, _FOLDED), "trie-paths")


def _common(one: bytes, other: bytes) -> int:
    """Nodes at the start of both paths."""
    n = min(len(one), len(other))
    x, y = (np.frombuffer(p, np.uint8, n).reshape(-1, KEY) for p in (one, other))
    differs = (x != y).any(axis=1)
    return int(differs.argmax()) if differs.any() else n // KEY


def trie(paths: list[tuple[bytes, bytes, int, int, str]], before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """Nodes of one run of sorted paths. before, after: the paths next to the run; nodes that it shares with them are on a seam.

    once: sizes of the subtree's nodes that no earlier run has; weighted: sizes times members.
    """
    keys, parent, depth, size, steps, opened = [b""], [0], [0], [0], [1], [0]
    ends: list[tuple[int, int, int, str]] = []
    stack, last = [0], b""
    for path, sizes, n, conv, digest in paths:
        same = _common(last, path)
        steps.extend([-1] * (len(stack) - 1 - same))
        del stack[same + 1 :]
        own = np.frombuffer(sizes, np.int64)
        for d in range(same, len(own)):
            parent.append(stack[-1])
            stack.append(len(keys))
            opened.append(len(steps))
            steps.append(1)
            keys.append(path[d * KEY : (d + 1) * KEY])
            depth.append(d + 1)
            size.append(int(own[d]))
        ends.append((stack[-1], n, conv, digest))
        last = path
    steps.extend([-1] * len(stack))
    n_nodes, node = len(keys), np.arange(len(keys))
    parent, depth, size, opened = (np.array(x, np.int64) for x in (parent, depth, size, opened))
    own_ends, own_conv = np.zeros(n_nodes, np.int64), np.full(n_nodes, _NONE)
    digests: list[str | None] = [None] * n_nodes
    for at, n, conv, digest in ends:
        own_ends[at], own_conv[at], digests[at] = n, conv, digest

    tree = Parentheses(np.array(steps, np.int8))
    closed = tree.findclose(opened)
    end = tree.rank[closed]  # one past the subtree's last node in preorder

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[end] - total[node]

    members = below(own_ends)
    seam, seen_before = np.zeros(n_nodes, bool), np.zeros(n_nodes, bool)
    if before is not None:
        seen_before[: _common(before, paths[0][0]) + 1] = True  # the first path's nodes come first in preorder
        seam |= seen_before
    leaves = tree.leaf_rank[closed] - tree.leaf_rank[opened]
    if after is not None:
        shared = _common(last, after)
        seam[stack[: shared + 1]] = True
        if shared == len(stack) - 1:  # the last path goes on in the next run: its end is no leaf
            leaves[stack] -= 1
    own = ~seen_before
    own[0] = False
    conv = range_least(own_conv, node, end)
    return rows(
        _NODES, key=keys, parent=[keys[i] for i in parent.tolist()], depth=depth, conv_id=conv, parent_conv_id=conv[parent], n_convs=members,
        n_children=np.bincount(parent[own], minlength=n_nodes), n_leaves=leaves, weighted=below(members * size), once=below(np.where(seen_before, 0, size)), seam=seam, ends_sha256=digests,
    )


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted paths, each after a row that names its neighbours."""
    run, held, sides = None, [], (None, None)
    for part in batches:
        for number, is_path, path, sizes, n, conv, digest, before, after in zip(*(part.column(i).to_pylist() for i in range(9)), strict=True):
            if number != run:
                if held:
                    yield from _sliced(trie(held, *sides))
                run, held = number, []
            if is_path:
                held.append((path, sizes, n, conv, digest))
            else:
                sides = (before, after)
    if held:
        yield from _sliced(trie(held, *sides))


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 1 << 13):
        yield batch.slice(at, 1 << 13)


def trie_nodes(folded: DataFrame) -> DataFrame:
    """The nodes of all runs (_NODES); those on a seam stand in each run that has them."""
    n_nodes = folded.agg(F.sum(F.length("path") / KEY)).first()[0] or 0
    n_runs = max(1, -(-int(n_nodes) // RUN_NODES))
    runs = staged(folded.repartitionByRange(n_runs, "path").withColumn("run", F.spark_partition_id()), "trie-runs")
    in_order = Window.orderBy("run")  # a row a run
    sides = runs.groupBy("run").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    sides = sides.select("run", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after"))
    marked = runs.withColumns({"is_path": F.lit(True)}).unionByName(sides.withColumn("is_path", F.lit(False)), allowMissingColumns=True)
    ordered = marked.repartition("run").sortWithinPartitions("run", "is_path", "path")
    found = ordered.select("run", "is_path", "path", "sizes", "n_ends", "conv_id", "ends_sha256", "before", "after").mapInArrow(_encoded, _NODES)
    return staged(found, "trie-nodes", "zstd")


def _merged(nodes: DataFrame) -> DataFrame:
    """Seams, one row for each node."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "once")]
    return staged(nodes.where("seam").groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256")), "trie-seams")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct start of a rebuilt conversation, the root (no turns) included: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first; equal ones by a digest of role and text. Null roles and texts are empty; rows
    without conv_id belong to no conversation; repeated rows are turns of their own; extra columns do not matter; an empty
    table gives no rows. Texts of any length are reduced to digests before they are shuffled; a conversation of any length
    is streamed, and its path (24 bytes a turn) is one row.
    """
    nodes = trie_nodes(folded_paths(conversation_paths(conversations)))
    seams = _merged(nodes)
    of_parent = seams.select(F.col("key").alias("parent"), F.col("conv_id").alias("seam_conv_id"))
    every = nodes.where("not seam").drop("seam").unionByName(seams.withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    linked = every.join(of_parent, "parent", "left")
    above: Column = F.when(F.col("depth") > 0, F.coalesce("seam_conv_id", "parent_conv_id"))
    return linked.select(
        "conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("weighted") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
