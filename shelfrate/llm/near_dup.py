"""MinHash near-duplicates with an LSH forest.

Documents with one shingle set are one node (128-bit digest of the set).
Every node gets ``TREES * DEPTH`` minhash values; each tree sorts the nodes
by its own ``DEPTH`` values, equal ones by a hash of tree and node. A region
is the nodes with one prefix, of any depth: one of up to ``FULL`` nodes is
compared in full, in a larger one a node's candidates are its ``REACH``
predecessors in the order. There the deepest prefixes stand next to each
other: the depth adapts by itself. Sorting is by range over the whole key
and the node, so a region of any size spreads over tasks.

In a region beyond that the order cannot show a node all that it is close
to: variants of one text may each be near the text only and not near each
other. So every component of more than ``DENSE`` nodes gets hubs, chosen among the members that agree most with the component's most
frequent minhash values, and all other nodes of the regions that the
component dominates are compared with them.

Candidates are confirmed on full shingle sets in rounds. The first takes each
node's direct predecessors in the trees, which joins most of a group. The
second sorts the same rows again, each with the component of its node, and
only then makes the candidates of whole regions, and only between
components: what is connected already makes none, nor do two nodes of which
too few of all minhash values agree. Hubs come third. So no
component is lost, and a dense group of n nodes costs some candidates for
each node instead of all that its regions hold. What larger regions hold
beyond that is settled last and exactly: nodes of such regions that share
three values of a tree with a node of another component
(``crowded_blocks``) are joined by their rarest shingles (``rest_pairs``).
Two sets of the similarity share one among the first of each in an order of
all shingles, rare ones first, and so early that enough can follow in both;
a shingle that many texts hold comes late. So variants of one text that are
not near each other make hardly any pair, however many they are. The order
and the hubs only save work. A pair of similarity ``percent`` escapes all
trees with probability below 1e-10 (``MIN_AGREE``, ``shared_values``). The
nodes of a shingle are cut into cells of ``TILE`` by ``TILE``, so no task
holds a whole group, and a group's largest component is not paired with
itself.

Edge cases: a null, empty or wordless text has no shingles, is linked with
nothing and forms its own component; exact copies of any number are one
node, and no pairs of copies are made; rows that repeat an id are judged by
their own texts, and two unrelated texts of one id are two components of
that id; a row with a null id is linked
only with rows of the same shingle set and never names a component that has
another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrate.llm.common import drop_written, written
from shelfrate.llm.components import components
from shelfrate.llm.tokens import hashed_words, mix, shingles, utf8

TREES, DEPTH, REACH, FULL = 16, 6, 4, 33
# Candidates of each node that a round of confirmation takes; with three, the members of a large group join at once.
BEST = 3
# Values of DEPTH that must agree (the first one among them) in some tree for a candidate, and for a node to be
# compared with the hubs of its regions; with similarity 0.8 a pair fails this in all trees with probability below 1e-10.
MIN_AGREE = 3
# Nodes of a component beyond which it gets hubs; half of FULL, as the neighbours may have shown only a part of it.
DENSE = FULL // 2
# Nodes of a cell's side, expected.
TILE = 512
# Places after a tree's first value that a block takes; ``shared_values`` says how many of these it needs.
_PLACES = ((1, 2), (4, 5), (2, 3), (1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5))
# Hubs of a large component, and the members they are chosen from.
HUBS, CENTRAL = 4, 24
_rng = np.random.default_rng(77)
_MULT = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_TIE = _rng.integers(0, 2**63, TREES, dtype=np.uint64)
# Bytes of a key: tree, values, and values with the hash that orders equal ones.
_VALUES = 1 + 4 * DEPTH
_KEY = _VALUES + 8


def _sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    words, at = hashed_words([utf8(t).lower() for t in texts])
    return [shingles(words[at[i]:at[i + 1]], size) for i in range(len(texts))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash values, big-endian, one row of TREES * DEPTH for each non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out = np.empty((len(sets), TREES * DEPTH), ">u4")
    for k in range(TREES * DEPTH):
        out[:, k] = np.minimum.reduceat((flat * _MULT[k] + _ADD[k]) >> np.uint64(32), at)
    return out


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b.column(1).to_pylist(), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                rows = signatures([sets[i] for i in full])
                for i, row in zip(full, rows, strict=True):
                    nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())],
                names=["id", "mark", "n_shingles", "node", "sig"])
    return run


def least_agreement(percent: int) -> int:
    """So many of all values agree at least, but for a probability of 1e-10, in a pair of that similarity."""
    n, p, tail, k = TREES * DEPTH, percent / 100, 0.0, 0
    while tail + math.comb(n, k) * p**k * (1 - p)**(n - k) <= 1e-10:
        tail += math.comb(n, k) * p**k * (1 - p)**(n - k)
        k += 1
    return k


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, root, sketch) for each tree: one byte of tree number, the tree's values, a hash of tree and node."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, TREES, 4 * DEPTH)
        keys = np.empty((TREES, b.num_rows, _KEY), np.uint8)
        keys[:, :, 0] = np.arange(TREES, dtype=np.uint8)[:, None]
        keys[:, :, 1:_VALUES] = sig.transpose(1, 0, 2)
        digests = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(b.num_rows, 2)[:, 0]
        ties = mix(digests[None, :] ^ _TIE[:, None]).astype(">u8")
        keys[:, :, _VALUES:] = ties[:, :, None].view(np.uint8)
        flat = keys.tobytes()
        rows = [flat[i:i + _KEY] for i in range(0, len(flat), _KEY)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), *[pa.array(b.column(i).to_pylist() * TREES, pa.binary()) for i in (0, 2, 3)]],
            names=["key", "node", "root", "sketch"])


_NEIGHBOURS = "a binary, b binary, agree int, key binary, root binary, sketch binary"


def _neighbours(across: bool, least: int):
    """Near rows of one sorted partition.

    ``across=False``: the pairs of a row and its predecessor, and every node
    (a, without b) that has any near row. ``across=True``: all near rows with
    another root whose sketches (the last byte of all values) agree in
    ``least`` places. The first and last FULL - 1 rows also come back with their
    key. A region cut by a batch or partition looks smaller than it is, so a
    cut only adds pairs.
    """
    edge = FULL - 1

    def out(a, b=None, agree=None, key=None, root=None, sketch=None):
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(b or none, pa.binary()), pa.array(agree or none, pa.int32()),
             pa.array(key or none, pa.binary()), pa.array(root or none, pa.binary()),
             pa.array(sketch or none, pa.binary())], names=["a", "b", "agree", "key", "root", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, first = ([], [], [], []), True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i).to_pylist() for i in range(4)]
            if first:
                yield out(own[1][:edge], key=own[0][:edge], root=own[2][:edge], sketch=own[3][:edge])
                first = False
            before = len(tail[0])
            keys, nodes, roots, sketches = (t + o for t, o in zip(tail, own, strict=True))
            values = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), _KEY)
            numbers = np.ascontiguousarray(values[:, 1:_VALUES]).view(">u4")
            sketch = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), -1)
            # rows with the row's prefix of each depth
            sizes = np.empty((len(keys), DEPTH), np.int64)
            fresh = np.append(True, values[1:, 0] != values[:-1, 0])
            for d in range(DEPTH):
                fresh[1:] |= numbers[1:, d] != numbers[:-1, d]
                region = np.cumsum(fresh) - 1
                sizes[:, d] = np.bincount(region)[region]
            a, b, agree, wanted = [], [], [], set()
            for j in range(1, min(edge, len(keys) - 1) + 1):
                same = (numbers[j:] == numbers[:-j])
                together = (values[j:, 0] == values[:-j, 0]) & same[:, 0]
                if not together.any():
                    break  # nor are rows farther apart
                score = same.sum(1)
                near = together & (score >= MIN_AGREE)
                if j > REACH:
                    shared = np.logical_and.accumulate(same, axis=1).sum(1)
                    near &= sizes[np.arange(len(shared)), shared - 1] <= FULL
                near[:max(0, before - j)] = False  # both ends were in the last batch
                some = np.flatnonzero(near)
                if across:
                    some = some[(sketch[some] == sketch[some + j]).sum(1) >= least]
                for i in some:
                    x, y = nodes[i], nodes[i + j]
                    if x == y or (across and roots[i] == roots[i + j]):
                        continue
                    if not across:
                        wanted.update((x, y))
                    if across or j == 1:
                        a.append(min(x, y))
                        b.append(max(x, y))
                        agree.append(int(score[i]))
            if a:
                yield out(a, b, agree)
            if wanted:
                yield out(sorted(wanted))
            tail = (keys[-edge:], nodes[-edge:], roots[-edge:], sketches[-edge:])
        yield out(tail[1], key=tail[0], root=tail[2], sketch=tail[3])
    return run


def candidate_pairs(nodes: DataFrame, across: bool, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) from nodes (node, sig, root), and all nodes that have a near one (``across=False``).

    Near rows of any tree, their agreeing values added up.
    """
    last = F.concat(*[F.substring("sig", 4 * k + 4, 1) for k in range(TREES * DEPTH)])
    trees = nodes.select("node", "sig", "root", (last if across else F.lit(b"\0")).alias("sketch")).mapInArrow(
        _tree_rows, "key binary, node binary, root binary, sketch binary")
    near = _neighbours(across, least_agreement(percent))
    found = written(trees.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
                    .mapInArrow(near, _NEIGHBOURS), "neighbours")
    # Rows at the ends of partitions (2 * (FULL - 1) of each) are neighbours across partitions.
    ends = (found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node"), "root", "sketch").distinct()
            .coalesce(1).sortWithinPartitions("key", "node").mapInArrow(near, _NEIGHBOURS))
    every = found.unionByName(ends).where(F.col("key").isNull())
    pairs = every.where(F.col("b").isNotNull()).groupBy("a", "b").agg(F.sum("agree").alias("score"))
    return pairs, every.where(F.col("b").isNull()).select(F.col("a").alias("node")).distinct()


def hub_pairs(known: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): nodes of regions with the hubs of the large component that dominates the region.

    Only pairs of which enough values agree (``least_agreement``).

    ``known`` is (node, sig); ``roots`` the components so far. Of the
    ``CENTRAL`` members that agree most with the usual values, which many
    may do equally well, the hubs are the most similar to the others.
    """
    count = TREES * DEPTH
    values = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.substring("sig", k * 4 + 1, F.lit(4)))
    rows = written(known.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), values.alias("values")), "rooted")
    large = rows.groupBy("root").count().where(F.col("count") > DENSE).select("root")
    members = rows.join(large, "root", "left_semi")
    usual = (members.select("root", F.posexplode("values").alias("pos", "value")).groupBy("root", "pos", "value").count()
             .groupBy("root", "pos").agg(F.max(F.struct("count", "value"))["value"].alias("value"))
             .groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("usual")))
    agree = F.size(F.filter(F.zip_with("values", "usual", lambda a, b: a == b), lambda same: same))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("agree").desc(), "node"))
    central = written(members.join(usual, "root").select("root", "node", agree.alias("agree")).withColumn("rank", rank)
                      .where(F.col("rank") <= CENTRAL).select("root", "node"), "central")
    few = central.select("root", F.col("node").alias("a")).join(central.select("root", F.col("node").alias("b")), "root")
    alike = compare(few.where(F.col("a") < F.col("b")), texts, size).select("a", "b", (F.col("both") / F.col("either")).alias("s"))
    mean = (alike.select(F.col("a").alias("node"), "s").union(alike.select("b", "s")).groupBy("node")
            .agg(F.avg("s").alias("agree")))
    hubs = (central.join(mean, "node").withColumn("rank", rank).where(F.col("rank") <= HUBS).join(
        rows.select("node", F.col("values").alias("usual")), "node").select(F.col("root").alias("main"), F.col("node").alias("hub"), "usual"))
    first = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)),
                        lambda t: F.xxhash64(t, F.element_at("values", (t * DEPTH + 1).cast("int"))))
    regions = rows.select("node", "root", F.explode(first).alias("region"))
    top = (regions.join(large, "root", "left_semi").groupBy("region", "root").count().groupBy("region")
           .agg(F.max(F.struct("count", "root"))["root"].alias("main")))
    found = (regions.join(top, "region").where(F.col("root") != F.col("main")).select("node", "main").distinct()
             .join(rows.select("node", "values"), "node").join(hubs, "main").where(agree >= least_agreement(percent)))
    return found.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def shared_values(percent: int) -> tuple[tuple[int, int], ...]:
    """So many of ``_PLACES`` that a pair of the similarity shares, with a probability above 1 - 1e-10, a tree's first value
    and one of these pairs of values."""
    p, others = percent / 100, range(1, DEPTH)
    same = [set(x) for k in range(DEPTH) for x in itertools.combinations(others, k)]
    for n in range(1, len(_PLACES)):
        hit = sum(p**len(x) * (1 - p)**(len(others) - len(x)) for x in same if any(x.issuperset(y) for y in _PLACES[:n]))
        if (1 - p * hit)**TREES <= 1e-10:
            return _PLACES[:n]
    return _PLACES


def crowded_blocks(nodes: DataFrame, percent: int) -> DataFrame:
    """(block, node): nodes of regions of more than ``FULL``, with those that share ``MIN_AGREE`` values of the tree."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("tree"), F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("values")))
    value = lambda k: F.substring("values", 4 * k + 1, 4)
    regions = nodes.select("node", F.explode(trees).alias("x")).select("node", "x.*").withColumn(
        "region", F.xxhash64("tree", value(0)))
    large = regions.groupBy("region").count().where(F.col("count") > FULL).select("region")
    shared = [F.xxhash64("region", *[x for k in some for x in (F.lit(k), value(k))]) for some in shared_values(percent)]
    blocks = written(regions.join(large, "region", "left_semi").select("node", F.explode(F.array(*shared)).alias("block")), "blocks")
    several = blocks.groupBy("block").count().where(F.col("count") > 1).select("block")
    out = written(blocks.join(several, "block", "left_semi").select("block", "node"), "crowded-blocks")
    drop_written(blocks)
    return out


def _shingled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b.column(2).to_pylist(), size)
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(tokens))],
                                             names=["node", "root", "tokens"])
    return run


def beside_others(rooted: DataFrame) -> DataFrame:
    """(node, root): all nodes of the components that share a block with another one, of rows (block, node, root, linked).

    Every block holds several nodes, so a node that is linked with none is beside others in all of its blocks. The
    other components (``linked``) are looked up by block, once for all members that they have in it.
    """
    several = rooted.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("block")
    linked = rooted.where("linked")
    beside = linked.select("block", "root").distinct().join(several, "block", "left_semi").select("root").distinct()
    members = linked.select("node", "root").distinct().join(beside, "root", "left_semi")
    return rooted.where("not linked").select("node", "root").distinct().unionByName(members)


def rest_pairs(blocks: DataFrame, texts: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): all pairs in different components, among the components that share a block with another, whose full
    shingle sets can reach the similarity.

    All shingles have one order, rare ones first. ``rest`` counts a node's
    shingles from one of them on: the first that two sets share leaves room
    for no more than the smaller ``rest`` in their intersection. A node's
    shingles with too few behind them, and those that no other component
    has, join nothing.
    """
    rooted = written(blocks.join(roots, "node", "left").select(
        "block", "node", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "rooted-blocks")
    nodes = beside_others(rooted)
    sets = written(texts.join(nodes, "node").select("node", "root", "text").mapInArrow(
        _shingled(size), "node binary, root binary, tokens array<long>"), "shingles")
    held = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > 1)
    order = Window.partitionBy("node").orderBy(F.col("count").desc(), F.col("token").desc())
    first = written(sets.select("node", "root", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(held, "token")
                    .withColumn("rest", F.row_number().over(order)).where(100 * F.col("rest") >= percent * F.col("n"))
                    .select("token", "node", "root", "n", "rest"), "rare-shingles")
    tiles = lambda rows: F.ceil(rows / TILE).cast("int")
    groups = (first.groupBy("token", "root").count().groupBy("token")
              .agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("rows"))
              .where(F.col("most.count") < F.col("rows"))
              .select("token", F.col("most.root").alias("main"), tiles(F.col("rows") - F.col("most.count")).alias("high"),
                      tiles(F.col("rows")).alias("wide")))
    rows = written(first.join(groups, "token"), "mixed")
    tile = lambda side: F.pmod(F.xxhash64("node"), side).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    left = rows.where(F.col("root") != F.col("main")).select(
        "token", tile("high").alias("i"), every("wide").alias("j"), F.col("node").alias("a"), F.col("root").alias("ra"),
        F.col("n").alias("na"), F.col("rest").alias("sa"))
    right = rows.select("token", every("high").alias("i"), tile("wide").alias("j"), F.col("node").alias("b"),
                        F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("rest").alias("sb"), "main")
    once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))
    room = (100 + percent) * F.least("sa", "sb") >= percent * (F.col("na") + F.col("nb"))
    met = left.join(right, ["token", "i", "j"]).where((F.col("ra") != F.col("rb")) & once & room)
    pairs = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    for used in (rooted, sets, first, rows):
        drop_written(used)
    return pairs


def _compared(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sets = _sets(batch.column(2).to_pylist() + batch.column(3).to_pylist(), size)
            both = [len(np.intersect1d(sets[i], sets[n + i], assume_unique=True)) for i in range(n)]
            either = [len(sets[i]) + len(sets[n + i]) - both[i] for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()),
                                              pa.array(either, pa.int64())], names=["a", "b", "both", "either"])
    return run


def compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of the full shingle sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(_compared(size), "a binary, b binary, both long, either long"))


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    return compare(pairs, texts, size).where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")


def _best(pairs: DataFrame) -> DataFrame:
    """Each node's ``BEST`` best candidates; a node has at most 2 * FULL * TREES."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    ranked = both.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("score", "b")), asc=False).alias("m"))
    top = ranked.select("a", F.explode(F.slice("m", 1, BEST)).alias("m")).select("a", F.col("m.b").alias("b"))
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_further(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components ``roots`` after the links (a, b) have joined some of them or further nodes."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(ends)
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(
        "node", F.coalesce("to", "root").alias("root"))
    return written(moved.unionByName(merged).distinct(), "roots")


def link_nodes(pairs: DataFrame, known: DataFrame, blocks: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the components; ``pairs`` are the candidates of the first round, ``known`` is (node, sig)."""
    tried = written(_best(pairs), "tried")
    roots = components(confirm(tried, texts, size, percent))
    rooted = known.join(roots, "node", "left").select("node", "sig", F.coalesce("root", "node").alias("root"))
    across, _ = candidate_pairs(rooted, True, percent)
    roots = linked_further(roots, confirm(across.join(tried, ["a", "b"], "left_anti"), texts, size, percent))
    roots = linked_further(roots, confirm(hub_pairs(known, roots, texts, size, percent), texts, size, percent))
    if blocks.isEmpty():
        return roots
    return linked_further(roots, confirm(rest_pairs(blocks, texts, roots, size, percent), texts, size, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", marks: bool = False) -> DataFrame:
    """id, n_shingles, component_id (smallest id of the component) and kept of every row.

    ``marks`` adds the hash of the row's text and the node that stands for its component.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    signed = written(src.mapInArrow(_signed(size), "id long, mark long, n_shingles long, node binary, sig binary"),
                     "signed")
    nodes = signed.where(F.col("node").isNotNull()).select("node", "sig").dropDuplicates(["node"])
    pairs, wanted = candidate_pairs(nodes.withColumn("root", F.col("node")), False, percent)
    blocks = crowded_blocks(nodes, percent)
    wanted = wanted.unionByName(blocks.select("node")).distinct()
    # One document of each wanted node gives the text.
    owners = (signed.where(F.col("id").isNotNull()).groupBy("node").agg(F.min(F.struct("id", "mark")).alias("o"))
              .join(wanted, "node", "left_semi").select("node", "o.id", "o.mark"))
    texts = written(src.join(owners, ["id", "mark"]).select("node", "text").dropDuplicates(["node"]), "node-texts")
    known = signed.join(owners, ["id", "mark"], "left_semi").select("node", "sig").dropDuplicates(["node"])
    roots = link_nodes(pairs, known, blocks, texts, size, percent)
    # The smallest id of each node first: any number of exact copies is one row in the steps that follow.
    smallest = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("smallest"))
    linked = smallest.join(roots, "node")
    lowest = linked.groupBy("root").agg(F.min("smallest").alias("lowest"))
    named = smallest.join(linked.join(lowest, "root").select("node", "root", "lowest"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("lowest", "smallest").alias("smallest"))
    component = F.coalesce("smallest", "id")
    more = ["mark", "root"] if marks else []
    return (signed.join(named, "node", "left")
            .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                    F.col("id").eqNullSafe(component).alias("kept"), *more))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, the one with the smallest id.

    A row is known by its id and text. Of rows that repeat an id within a
    component the smallest text hash stays, of equal rows the smallest of the
    other columns; one id with unrelated texts keeps a row of each. Rows
    with a null id stay if no row of their component has one, and rows
    without words are a component for each id and text.
    """
    kept = near_duplicates(docs, size, percent, id_col, text_col, marks=True).where("kept").select(
        F.col(id_col).alias("_id"), F.col("mark").alias("_mark"), F.col("root").alias("_root")).distinct()
    mark = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (mark == F.col("_mark"))
    alone = F.col("_root").isNull()
    order = Window.partitionBy("_root", F.when(alone, F.col("_id")), F.when(alone, F.col("_mark"))).orderBy(
        "_id", "_mark", *[c for c in docs.columns if c not in (id_col, text_col)])
    return (docs.join(kept, same).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
            .select(*docs.columns))
