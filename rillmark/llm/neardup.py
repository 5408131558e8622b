"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Each text gives its distinct word shingles as 64-bit hashes, a 128-bit digest of
   that set and a MinHash signature.  Texts with equal sets are one node.
2. The forest holds the signature in several orders (each starts at other values);
   nodes sorted by an order that have a common prefix of DEPTH values are a region of
   it.  So many orders make a pair at the threshold meet in a region of one of them
   but with the probability MISS.  (Nodes of a region need only an equal hash of the
   prefix, so light regions are found without a sort.)
3. A region too heavy for one task is sorted by its order, over as many tasks as it
   takes, and cut into runs of neighbours where the common prefixes of neighbours are
   shortest: as deep in each place as its nodes are dense.
4. Each region or run, with its nodes' full sets, is confirmed exactly in one task,
   which returns stars of the links it found: never more rows than nodes.
5. The pairs that a cut kept apart are made up for in heavy regions of several
   components.  Where the nodes outside the main one fit a block, they meet every
   block of the region, in linear work.  Otherwise the region's nodes go through a
   second, deeper forest: DEEP values, and as many orders more as that takes; its
   regions of one component are left out, and those that are heavy even there meet
   block by block.
6. Components of all links; a document's component is the least id in it.

Counts, minima and joins on hot keys are pre-aggregated or salted, the steps are
written to shared storage, and nothing per document comes to the driver.

Defined cases: a document without words has no shingles and is linked with
nothing; with fewer words than a shingle its whole sequence is one shingle; equal
texts are one node however often they occur; null ids are in components, but name
them only if there is no other id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .components import connected

#: Words of a shingle, values of a signature at least, and of the prefixes of the first and of the second forest.
SHINGLE, VALUES, DEPTH, DEEP = 5, 64, 3, 6
#: How likely a pair at the threshold may meet in no region of the first forest, and of the second.
MISS, MISS_DEEP = 1e-5, 1e-4
#: Values after the prefix by which a heavy region's nodes are sorted.
SORTED = 16
#: Most shingles (a node counts LEAST_WEIGHT at least) of a region that one task confirms.
MAX_WEIGHT, LEAST_WEIGHT = 400_000, 300
SALTS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: dict[bytes, int], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of k words (of all words, if fewer)."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(k, n)
    x = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i : n - k + 1 + i]) * _MIX
        x ^= x >> np.uint64(29)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(len(sets), size) MinHash values of nonempty sets: least upper halves of random linear functions."""
    draw = np.random.default_rng(7)
    a = draw.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, size, np.uint64)
    out = np.empty((len(sets), size), np.uint32)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) < 50_000):
            held += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i:j]])[:-1]])
        for f in range(size):
            out[i:j, f] = np.minimum.reduceat(((x * a[f] + b[f]) >> np.uint64(32)).astype(np.uint32), starts)
        i = j
    return out


def _signed(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(t, hashes, k) for t in batch.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full, size).astype(">u4"))
                node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signature = [next(signed).tobytes() if len(s) else None for s in sets]
                arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(signature, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "node", "signature"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingles(t, hashes, k) for t in whole.slice(at, 500).column(0).to_pylist()]
                arrays = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "shingles"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union, exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    shared = df[inverse] > 1
    place = np.cumsum(df > 1) - 1  # shingles of one set alone are in no intersection
    column, owner = place[inverse[shared]].astype(np.int32), owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    width = int((df > 1).sum())
    step = min(width, max(256, 2_000_000 // n))
    for low in range(0, width, step or 1):
        i, j = np.searchsorted(column, [low, low + step])
        block = np.zeros((n, step), np.float32)
        block[owner[i:j], column[i:j] - low] = 1
        both += block @ block.T
    both = np.rint(both).astype(np.int32)
    np.fill_diagonal(both, sizes)
    # 100 * both >= percent * (a + b - both)
    least = (percent * sizes).astype(np.int32)
    both *= 100 + percent
    both -= least[:, None]
    return both >= least[None, :]


def _stars(percent: int):
    """Of a region's nodes and sets: an edge from each linked node to the least of its component here."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        data = table.column("shingles").to_pylist()
        found: list[tuple[bytes, bytes]] = []
        if len(nodes) > 1:
            matrix = linked([np.frombuffer(data[i], np.uint64) for i in order], percent)
            todo = np.ones(len(nodes), bool)
            for i in range(len(nodes)):
                if not todo[i]:
                    continue
                reached = np.zeros(len(nodes), bool)
                front = np.array([i])
                while len(front):
                    reached[front] = True
                    front = np.flatnonzero(matrix[front].any(axis=0) & ~reached)
                todo &= ~reached
                found += [(nodes[order[j]], nodes[order[i]]) for j in np.flatnonzero(reached) if j != i]
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return run


def orders_needed(similarity: float, depth: int, size: int, miss: float) -> int:
    """How many draws of `depth` among `size` values a pair needs to agree in one of them wholly, but with the probability `miss`."""
    held = [(comb(size, m) * similarity**m * (1 - similarity) ** (size - m), comb(m, depth) / comb(size, depth)) for m in range(size + 1)]
    orders = 1
    while sum(p * (1 - q) ** orders for p, q in held) > miss and orders < 10_000:
        orders += 1 + orders // 20
    return orders


def _rotated(tree: Column, start: int, values: int) -> Column:
    """The values from `start` of a tree's order: the signature rotated to the tree's place."""
    twice = F.concat("signature", "signature")
    return twice.substr(tree * (4 * DEPTH) + 4 * start + 1, F.lit(4 * values))


def _drawn(orders: int, size: int) -> Column:
    """Hash of the DEEP values that an order of the second forest starts with, by the column `tree`."""
    draw = np.random.default_rng(11)
    places = F.array(*[F.lit(int(v)) for _ in range(orders) for v in draw.permutation(size)[:DEEP]])
    value = lambda k: F.col("signature").substr(F.element_at(places, F.col("tree") * DEEP + k + 1) * 4 + 1, F.lit(4))
    return F.xxhash64(F.lit("deep"), "tree", F.concat(*[value(k) for k in range(DEEP)]))


def _common(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def cut_runs(weights: list[int], common: list[int], most: int) -> list[int]:
    """Where to cut a sorted row of nodes into runs of at most `most` (or one node): before each run's first node.

    common[i] is the prefix that node i shares with the one before it; a run ends
    before the node that shares least, in the latter half of what fits.
    """
    cuts, start, n = [], 0, len(weights)
    while start < n:
        cuts.append(start)
        held, end = 0, start
        while end < n and (end == start or held + weights[end] <= most):
            held += weights[end]
            end += 1
        if end < n:
            half = max(start + 1, (start + end + 1) // 2)
            end = min(range(end, half - 1, -1), key=lambda i: (common[i] // 4, -i))
        start = end
    return cuts


def _runs(most: int):
    """(key, node) of runs, from rows (key, order, node, weight) that are sorted by key and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def out(whole: bool) -> Iterator[pa.RecordBatch]:
            """The runs held; if more rows may follow, all but the last two, which stay."""
            nonlocal number, held
            # a run ends with its region at the latest: there is nothing in common
            common = [0] + [4 + _common(a[1], b[1]) if a[0] == b[0] else -1 for a, b in zip(held, held[1:], strict=False)]
            ends = [i for i, c in enumerate(common) if c < 0] + [len(held)]
            cuts, start = [], 0
            for end in ends:
                cuts += [start + c for c in cut_runs([r[3] for r in held[start:end]], common[start:end], most)]
                start = end
            stay = len(held) if whole or len(cuts) < 3 else cuts[-2]
            if not whole and stay == len(held):
                return
            cuts = [*[c for c in cuts if c < stay], stay]
            keys, nodes = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = xxhash.xxh3_64_intdigest(b"%d:%d:%d" % (held[a][0], part, number)) - (1 << 63)
                number += 1
                keys += [name] * (b - a)
                nodes += [r[2] for r in held[a:b]]
            held = held[stay:]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.binary())], names=["key", "node"])

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            if sum(r[3] for r in held) > 4 * most:
                yield from out(False)
        if held:
            yield from out(True)

    return run


def _with_heavy(rows: DataFrame, max_weight: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, ...) of regions of two nodes or more: those light enough, and the heavy ones."""
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).filter(F.col("n") > 1)
    met = materialize(rows.join(size, "key"))
    return met.filter(F.col("all") <= max_weight).drop("n", "all"), met.filter(F.col("all") > max_weight).drop("n")


def _confirm(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges of the regions (key, node): alike regions are confirmed once."""
    listed = members.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    listed = listed.dropDuplicates(["nodes"]).filter(F.size("nodes") > 1)
    each = listed.select("key", F.explode("nodes").alias("node"))
    return each.join(sets, "node").select("key", "node", "shingles").groupBy("key").applyInArrow(_stars(percent), "a binary, b binary")


def _several(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node, weight) of regions of several components, with their label."""
    own = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    many = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    return materialize(own.join(many, "key"))


def _left_apart(own: DataFrame, max_weight: int) -> DataFrame:
    """Regions (key, node, ob) for the pairs that cutting heavy regions (key, node, weight, label) kept apart; ob is how many blocks a heavy region has outside its main component.

    A region's main component is that with most nodes.  Its blocks each meet every
    block of the other nodes, and those blocks meet each other.
    """
    per = own.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "label", "w")).alias("m"), F.sum("w").alias("all"))
    half = max(1, max_weight // 2)
    blocks = lambda w: F.ceil(w / F.lit(half)).cast("int")
    main = main.select("key", F.col("m.label").alias("main"), blocks(F.col("m.w")).alias("mb"), blocks(F.col("all") - F.col("m.w")).alias("ob")).filter("ob > 0")
    met = own.join(main, "key").withColumn("other", F.col("label") != F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("ob")).otherwise(F.col("mb"))).cast("int")
    met = met.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # main block i with other block j: ("m", i, j); other blocks j <= k: ("o", j, k)
    crossed = met.withColumn("over", F.explode(F.when(F.col("other"), upto("mb")).otherwise(upto("ob"))))
    crossed = crossed.select(
        F.xxhash64("key", F.lit("m"), F.when(F.col("other"), F.col("over")).otherwise(F.col("block")), F.when(F.col("other"), F.col("block")).otherwise(F.col("over"))).alias("key"), "node", "ob"
    )
    among = met.filter("other").withColumn("over", F.explode(upto("ob")))
    among = among.select(F.xxhash64("key", F.lit("o"), F.least("block", "over"), F.greatest("block", "over")).alias("key"), "node", "ob")
    return crossed.unionByName(among)


def _joined(labels: DataFrame, apart: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, max_weight: int, similarity: float, size: int) -> DataFrame:
    """Labels with the links between components of the heavy regions `apart` (key, node, weight, label) as well."""
    again = lambda found: connected(found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    blocks = materialize(_left_apart(apart, max_weight))
    few = blocks.filter("ob = 1").select("key", "node")
    crowded = blocks.filter("ob > 1").select("node").distinct()
    if crowded.isEmpty():
        return again(_confirm(few, sets, percent))
    orders = orders_needed(similarity, DEEP, size, MISS_DEEP)
    pool = nodes.join(crowded, "node").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    light, heavy = _with_heavy(pool.select(_drawn(orders, size).alias("key"), "node", "weight"), max_weight)
    deep = _several(light, labels).select("key", "node").unionByName(_left_apart(_several(heavy.drop("all"), labels), max_weight).select("key", "node"))
    return again(_confirm(few.unionByName(deep), sets, percent))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    shingle: int = SHINGLE,
    trees: int | None = None,
    max_weight: int = MAX_WEIGHT,
) -> DataFrame:
    """Documents linked by a similarity of percent / 100 or more.

    Per row: doc_id, n_shingles, component_id (the least id reachable by links), kept (it is its own component_id).
    """
    plain = pick(docs, id_col, text_col)
    plain = plain.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = dict(plain.dtypes)["doc_id"]
    # a pair of similarity s shares a prefix of one order with probability s ** DEPTH
    similarity = min(0.99, percent / 100)
    trees = trees or max(4, ceil(log(MISS) / log(1 - similarity**DEPTH)))
    size = max(VALUES, trees * DEPTH)
    base = plain.mapInArrow(_signed(shingle, size), f"doc_id {id_type}, n_shingles bigint, node binary, signature binary")
    base = materialize(base)
    nodes = (
        base.filter("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.count("*").alias("copies"))
    )
    # different sets reach the threshold only if the larger, of b shingles, has 100 * (b - 1) >= percent * b, the smaller one less
    nodes = nodes.filter((F.col("n_shingles") + 1) * (100 - percent) >= 100)
    nodes = materialize(nodes.select("node", "doc_id", F.greatest("n_shingles", F.lit(LEAST_WEIGHT)).alias("weight"), "signature"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = nodes.withColumn("tree", every(trees))
    # tree and node find the signature again where a region turns out heavy
    light, heavy = _with_heavy(rows.select(F.xxhash64("tree", _rotated(F.col("tree"), 0, DEPTH)).alias("key"), "node", "weight", "tree"), max_weight)
    members, any_heavy = light.select("key", "node"), not heavy.isEmpty()
    if any_heavy:
        placed = heavy.join(nodes.select("node", "signature"), "node").select("key", _rotated(F.col("tree"), DEPTH, SORTED).alias("order"), "node", "weight")
        # rows alike in all but the node are told apart, so that ranges can part them
        runs = placed.repartitionByRange("key", "order", "node").sortWithinPartitions("key", "order", "node")
        members = members.unionByName(materialize(runs.mapInArrow(_runs(max(1, max_weight // 2)), "key bigint, node binary")))
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    rows_of = plain.join(wanted.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    # written, so that the shuffled texts can go before the sets are dealt
    sets = materialize(rows_of.mapInArrow(_sets(shingle), "node binary, shingles binary").dropDuplicates(["node"]))
    labels = connected(_confirm(members, sets, percent))
    if any_heavy:
        labels = _joined(labels, _several(heavy.select("key", "node", "weight"), labels), nodes, sets, percent, max_weight, similarity, size)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    named = base.select("doc_id", "n_shingles", "node").withColumn("salt", salt)
    named = named.join(labels.withColumn("salt", spread), ["node", "salt"], "left").withColumn("group", F.coalesce("label", "node"))
    named = materialize(named.select("doc_id", "n_shingles", "group", "salt"))
    groups = named.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    out = named.join(groups.select("group", "least").withColumn("salt", spread), ["group", "salt"], "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for all documents, links at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""
