"""N-gram Jaccard join of whole texts by count-vector R-trees.

Method. A document is its set of distinct 5-word shingles; two link when their Jaccard similarity is 0.8 or more.

1. Equal sets fold to one class before anything is compared, so groups of copies cost one row.
2. Sets that link share one of their first ``n // 5 + 1`` tokens in any common order of tokens. The order puts tokens
   that many documents hold last, so a shared passage hardly ever brings documents together.
3. Tokens are hashed into groups; a set is the point of its group counts. The summed coordinate minima of two points
   bound their overlap from above. Sets that meet at a leading token and pass the bound form candidate clusters
   (connected components of a spanning forest for each token; no pairs are listed). Where very many sets meet, they
   are joined without the bound.
4. A cluster is dealt out in tiles of bounded size. In a tile the points are packed by size into the leaves of an
   R-tree, whose upper corners bound the overlap with any point of the leaf; what survives the bounds of leaf and point
   is verified on the sets. Pairs already known to be connected are skipped, so a group of m near copies takes about
   m checks.
5. Clusters of several tiles: the cluster's first set visits every tile, which joins near copies across tiles.
   Members that stay outside its component then visit all tiles, in bounded chunks; so no pair is left out.

Nothing is capped: sizes and frequencies only decide the order of tokens and the layout of tiles.
Shingles are compared by 64-bit hashes, sets by 128-bit keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.batches import ids_and_texts, rows
from tenurekit.llm.bits import bit_table, in_table
from tenurekit.llm.components import components
from tenurekit.llm.scratch import staged
from tenurekit.llm.words import mixed, set_key, shingle_sets

#: Two sets link when 100 * overlap >= PERCENT * union.
PERCENT = 80
SHINGLE = 5
#: Sets that make a token common, as tasks tally them. Only the order of tokens rests on it.
COMMON = 24
#: Sets that may meet at a token and still be compared one by one.
BLOCK = 256
#: Bits of the table of common tokens that every task gets (1 MB).
COMMON_BITS = 23
#: Tokens whose hashes a task gathers before it reports the repeated ones.
TALLY = 4_000_000
#: Shares into which the block of a common token is dealt.
SALTS = 64
#: Shingles and documents in one tile of a cluster.
TILE_SHINGLES = 400_000
TILE_DOCS = 512
LEAF = 16


def _member(key: bytes) -> int:
    """The number that stands for a set among candidates."""
    return int.from_bytes(key[:8], "little", signed=True)


def _point(items: np.ndarray) -> bytes:
    """Group counts of a set, behind a byte that tells the bytes of a count. The number of groups is a power of two."""
    n = len(items)
    groups = 1 << max(5, math.ceil(math.log2(n / (8 if n <= 2048 else 16))))
    counts = np.bincount((mixed(items) >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    width = 1 if counts.max() < 256 else 4
    return bytes([width]) + counts.astype(np.uint8 if width == 1 else np.uint32).tobytes()


def _counts(point: bytes) -> np.ndarray:
    return np.frombuffer(point, np.uint8 if point[0] == 1 else np.uint32, offset=1).astype(np.int64)


def _may_link(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether the summed minima allow a link: 0.8 of the union is 4/9 of both sizes together."""
    while len(p) > len(q):
        p = p.reshape(2, -1).sum(0)
    while len(q) > len(p):
        q = q.reshape(2, -1).sum(0)
    return 9 * int(np.minimum(p, q).sum()) >= 4 * int(p.sum() + q.sum())


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for ids, texts in ids_and_texts(batches):
        yield ids, shingle_sets(texts, SHINGLE)


_PROFILE = "doc_id bigint, n bigint, key binary, member bigint, point binary, token bigint, found bigint"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n, key) for each document, and rows (token, found) for tokens that several sets of this task hold."""
    held: list[np.ndarray] = []
    seen: set[bytes] = set()

    def tally() -> Iterator[pa.RecordBatch]:
        if held:
            tokens, found = np.unique(np.concatenate(held), return_counts=True)
            some = found > 1
            yield rows(_PROFILE, token=tokens[some].view(np.int64), found=found[some])
        held.clear()
        seen.clear()

    for ids, sets in _with_sets(batches):
        keys = [set_key(s) if len(s) else None for s in sets]
        yield rows(_PROFILE, doc_id=ids, n=[len(s) for s in sets], key=keys, member=[key and _member(key) for key in keys], point=[_point(s) if len(s) else None for s in sets])
        for key, items in zip(keys, sets, strict=True):
            if key is not None and key not in seen:
                seen.add(key)
                held.append(items)
        if sum(map(len, held)) > TALLY:
            yield from tally()
    yield from tally()


_EMITTED = "token bigint, share int, member bigint"


def _leading(table: object) -> Callable:
    """Rows (token, share, member) of each set's leading tokens; common tokens come last and their rows are dealt into shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, sets in _with_sets(batches):
            tokens, shares, members = [], [], []
            for items in sets:
                if not len(items) or (key := set_key(items)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                common = in_table(items, table.value)
                first = np.argsort(common, kind="stable")[: len(items) // 5 + 1]
                member = _member(key)
                tokens.append(items[first].view(np.int64))
                shares.append(np.where(common[first], member % SALTS, -1))
                members.append(np.full(len(first), member))
            if tokens:
                yield rows(_EMITTED, token=np.concatenate(tokens), share=np.concatenate(shares), member=np.concatenate(members))

    return run


_MET = "a bigint, b bigint"


def _block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what may link in each block. Rows (block, member, point) come in the order of blocks."""
    above: dict[int, int] = {}  # a forest of what this task has connected
    points: dict[int, np.ndarray] = {}
    apart: set[tuple[int, int]] = set()

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    def joined(block: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        found = []
        bounded = len(block) <= BLOCK
        if len(above) + len(points) + len(apart) > 1_000_000:
            above.clear()
            points.clear()
            apart.clear()
        for i in range(1, len(block)):
            b, point = block[i]
            for j in range(i if bounded else 1):
                a = block[j][0]
                if (x := root(a)) == (y := root(b)) or (a, b) in apart:
                    continue
                if bounded:
                    for own, raw in ((a, block[j][1]), (b, point)):
                        if own not in points:
                            points[own] = _counts(raw)
                    if not _may_link(points[a], points[b]):
                        apart.add((a, b))
                        continue
                above[max(x, y)] = min(x, y)
                found.append((a, b))
        return found

    token, block = None, []
    for batch in batches:
        found = []
        for own, member, point in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != token:
                found += joined(block)
                token, block = own, []
            block.append((member, point))
        if found:
            yield rows(_MET, a=[a for a, _ in found], b=[b for _, b in found])
    if found := joined(block):
        yield rows(_MET, a=[a for a, _ in found], b=[b for _, b in found])


def _tree_links(sets: list[np.ndarray], asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (distinct, sorted hashes). asking: only links with one of these count."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    groups = 1 << min(10, max(5, math.ceil(math.log2(max(1, size.max()) / 3))))
    points = np.zeros((len(order), groups), np.int32)
    for row, i in enumerate(order):
        points[row] = np.bincount((mixed(sets[i]) >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    cuts = np.arange(0, len(order), LEAF)
    corner, smallest = np.maximum.reduceat(points, cuts), size[cuts]
    label = np.arange(len(order))
    asks = np.ones(len(order), bool) if asking is None else asking[order]
    links = []
    for a in range(len(order) - 1):
        # overlap >= 0.8 * union is overlap >= 4/9 of both sizes together
        reach = np.flatnonzero((smallest * 4 <= size[a] * 5) & (cuts + LEAF > a + 1) & (np.minimum(corner, points[a]).sum(1) * 9 >= 4 * (size[a] + np.maximum(smallest, size[a]))))
        for leaf in reach:
            near = np.arange(max(a + 1, cuts[leaf]), min(len(order), cuts[leaf] + LEAF))
            near = near[(label[near] != label[a]) & (asks[near] | asks[a])]
            near = near[np.minimum(points[near], points[a]).sum(1) * 9 >= 4 * (size[a] + size[near])]
            for b in near.tolist():
                if label[b] == label[a]:
                    continue
                both = len(np.intersect1d(sets[order[a]], sets[order[b]], assume_unique=True))
                if 100 * both >= PERCENT * (size[a] + size[b] - both):
                    label[label == label[b]] = label[a]
                    links.append((order[a], order[b]))
    return links


_LINKS = "a binary, b binary"


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    """Links among the texts of one tile; with an ``asks`` column that is not all true, only those of asking texts."""
    asks_by_key: dict[bytes, bool] = {}
    sets: dict[bytes, np.ndarray] = {}
    texts, asks = table.column("text").cast(pa.large_binary()), table.column("asks").to_pylist()
    for at in range(0, table.num_rows, 256):
        for k, items in enumerate(shingle_sets(texts.slice(at, 256).to_pylist(), SHINGLE)):
            if len(items):
                sets.setdefault(own := set_key(items), items)
                asks_by_key[own] = asks_by_key.get(own, False) or asks[at + k]
    keys = list(sets)
    links = _tree_links(list(sets.values()), np.array([asks_by_key[k] for k in keys])) if len(keys) > 1 else []
    return pa.table({"a": pa.array([keys[a] for a, _ in links], pa.binary()), "b": pa.array([keys[b] for _, b in links], pa.binary())})


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) of every row: component_id is the smallest doc_id reachable by links.

    Null, empty and blank texts have no shingles and link with nothing: component_id is their own doc_id. Repeated rows
    come back as often as they are. Rows without doc_id take part; a component of such rows alone has a null id.
    n_copies counts the rows with the same set. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = staged(docs.mapInArrow(_profile, _PROFILE), "jaccard-profile")
    documents = profile.where("n is not null").select("doc_id", "n", "key")
    held = profile.where("key is not null").groupBy("key")
    classes = held.agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("member").alias("member"), F.max("point").alias("point"), F.count("*").alias("n_copies"))
    classes = staged(classes, "jaccard-classes")
    clusters = _candidate_clusters(docs, profile, classes)
    links = _verified_links(docs, classes, clusters)
    roots = components(links, "jaccard-links")
    labelled = classes.join(roots, classes.key == roots.node, "left").select("key", "rep", "n_copies", F.coalesce("root", "key").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    # written, so that both sides of the last join are exchanged for it and AQE can split the rows of a hot class
    found = staged(labelled.join(least, "root").select("key", "component_id", "n_copies"), "jaccard-found")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return documents.join(found, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with its smallest doc_id, with all its columns.

    Rows that repeat an id and a text are one document. Rows without doc_id, which no component can name, all stay.
    """
    found = staged(jaccard_components(docs).select("doc_id", "component_id"), "jaccard-kept")
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    kept = packed.join(keep.hint("merge"), "doc_id", "left_semi")  # alike at every size
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        kept = kept.withColumn("t", F.xxhash64("row.text")).dropDuplicates(["doc_id", "t"])
    return kept.select("row.*").union(docs.where("doc_id is null"))


def _candidate_clusters(docs: DataFrame, profile: DataFrame, classes: DataFrame) -> DataFrame:
    """(member, root): sets that may link, directly or through others."""
    spark = docs.sparkSession
    common = profile.where("token is not null").groupBy("token").agg(F.sum("found").alias("found")).where(F.col("found") >= COMMON)
    table = spark.sparkContext.broadcast(bit_table(common, "token", COMMON_BITS))
    block = Window.partitionBy("token", "share")
    met = (
        docs.select("doc_id", "text").mapInArrow(_leading(table), _EMITTED)
        .withColumns({"hub": F.min("member").over(block), "last": F.max("member").over(block), "block": F.bit_xor(F.xxhash64("member")).over(block)})
        .where("hub < last or share >= 0")
    )
    met = staged(met.select("token", "share", "member", "hub", "block"), "jaccard-met")
    # tokens with the same members are one block, told by the members' hashes
    few = met.where("share < 0").select("block", "member").distinct().join(classes.select("member", "point"), "member")
    few = few.select("block", "member", "point").repartition("block").sortWithinPartitions("block", "member").mapInArrow(_block_edges, _MET)
    within = met.where("share >= 0 and member <> hub").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    hubs = met.where("share >= 0").groupBy("token", "share").agg(F.min("hub").alias("hub"))
    least = hubs.groupBy("token").agg(F.min("hub").alias("a"))
    across = hubs.join(least, "token").where("a <> hub").select("a", F.col("hub").alias("b"))
    return components(few.union(within).union(across), "jaccard-candidates").select(F.col("node").alias("member"), "root")


def _pieces(n: str, docs: str) -> F.Column:
    return F.greatest(F.ceil(F.col(n) / TILE_SHINGLES), F.ceil(F.col(docs) / TILE_DOCS)).cast("int")


def _share(pieces: str) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.col(pieces)).cast("int")


def _verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): keys of sets that link; enough of them to connect all that is connected."""
    clustered = staged(classes.join(clusters, "member").select("root", "key", "rep", "n", "member"), "jaccard-clustered")
    sizes = clustered.groupBy("root").agg(F.sum("n").alias("all_n"), F.count("*").alias("all_docs"), F.min("member").alias("leader"))
    sizes = staged(sizes.select("root", "leader", _pieces("all_n", "all_docs").alias("tiles")), "jaccard-sizes")
    placed = clustered.join(sizes, "root").withColumns({"tile": _share("tiles"), "leads": F.col("member") == F.col("leader")})
    placed = staged(placed.select("root", "key", "rep", "n", "tiles", "tile", "leads"), "jaccard-placed")

    def with_text(members: DataFrame) -> DataFrame:
        return members.join(docs, members.rep.eqNullSafe(docs.doc_id)).drop("doc_id", "rep")

    everywhere = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    own = with_text(placed.select("root", "rep", everywhere.alias("places"))).select("root", F.explode("places").alias("tile"), F.lit(True).alias("asks"), "text")
    links = staged(own.groupBy("root", "tile").applyInArrow(_verify, _LINKS), "jaccard-tiles")

    large = placed.where("tiles > 1")
    if not large.take(1):
        return links
    roots = components(links, "jaccard-large").withColumnRenamed("root", "label")
    large = large.join(roots, large.key == roots.node, "left").withColumn("label", F.coalesce("label", "key")).drop("node")
    main = large.where("leads").select("root", F.col("label").alias("main"))
    large = staged(large.join(main, "root").withColumn("outside", F.col("label") != F.col("main")), "jaccard-outside")
    left = large.where("outside").groupBy("root").agg(F.sum("n").alias("out_n"), F.count("*").alias("out_docs"))
    large = large.join(left.select("root", _pieces("out_n", "out_docs").alias("chunks")), "root")
    visits = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(t.alias("tile"), _share("chunks").alias("chunk"), F.lit(True).alias("asks"))))
    stays = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("tile"), c.alias("chunk"), F.lit(False).alias("asks")))
    spots = F.when(F.col("outside"), F.concat(visits, stays)).otherwise(stays)
    met = with_text(large.select("root", "rep", spots.alias("spots"))).select("root", F.explode("spots").alias("spot"), "text")
    met = met.select("root", "spot.tile", "spot.chunk", "spot.asks", "text")
    return links.union(met.groupBy("root", "tile", "chunk").applyInArrow(_verify, _LINKS))
