"""Near-duplicate documents by a chosen-path similarity join on minwise tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import Hasher, digest, mix, parts, utf8, word_spans
from stemma.llm.components import components
from stemma.plans.durable import written

U64 = np.uint64
SLICE = 4 << 20        # bytes of text handled at once inside a task
SMALL = 1_000_000      # so many ids are sent to all executors (16 MB); more are joined by a shuffle
BLOCK = 256            # documents of a block whose pairs are confirmed together


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its runs of `words` words.

    Words are what white space leaves, A-Z lower-cased. A row with fewer words
    has one run, the whole; a row without words has none.
    """
    starts, ends, cut = word_spans(buf, off)
    h = Hasher(buf, lower=True).of(starts, ends)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for j in range(words):
        grams[:n - j] += mix(h[j:] + U64(j + 1)) * U64(2 * j + 3)
    grams = mix(grams + U64(words))
    for i in range(len(off) - 1):
        a, b = cut[i], cut[i + 1]
        if b - a >= words:
            yield np.unique(grams[a:b - words + 1])
        elif b > a:
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            one = mix(h[a:b] + place) * (place * U64(2) + U64(1))
            yield mix(one.sum(keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, np.uint64)


class Forest:
    """Which minwise tokens a document follows in each of `trees` recursion trees.

    Every document has `width` minwise tokens. At a node of a tree each token
    position is chosen with probability 1 / (similarity * width), by a hash of
    the node and the position, so all documents of a node choose alike; a
    document goes on to one child per chosen position, named by its token there.
    Two documents of the wanted similarity share one child per node on average.
    """

    def __init__(self, similarity: float, trees: int, depth: int, width: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.trees, self.depth = width, trees, depth
        self.odd = rng.integers(0, 1 << 31, width, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.mask = rng.integers(0, 1 << 32, width, dtype=np.uint32)
        self.chance = U64(int(2.0 ** 64 / (similarity * width)))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> U64(32)).astype(np.uint32)
        x = (x[None, :] ^ self.mask[:, None]) * self.odd[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        return x.min(axis=1)

    def paths(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and node names at full depth of an (n, width) token matrix."""
        n = len(tokens)
        places = np.arange(self.width, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
        row = np.tile(np.arange(n), self.trees)
        node = np.repeat(mix(np.arange(1, self.trees + 1, dtype=np.uint64)), n)
        last = np.full(len(row), -1)
        for _ in range(self.depth):
            rows, nodes, lasts = [], [], []
            for lo in range(0, len(row), 1 << 15):
                at = slice(lo, lo + (1 << 15))
                r, c = np.nonzero(mix(node[at][:, None] + places[None, :]) < self.chance)
                keep = c != last[at][r]
                r, c = r[keep], c[keep]
                doc = row[at][r]
                rows.append(doc)
                lasts.append(c)
                nodes.append(mix(mix(node[at][r] + places[c]) + tokens[doc, c]))
            row, node, last = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, nodes, lasts))
        return row, node.astype(np.uint64)


def _sketches(words: int, forest: Forest):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for i, j in parts(off, SLICE):
                sizes, digests, tokens = [], [], np.zeros((j - i, forest.width), np.uint32)
                for k, s in enumerate(shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], words)):
                    sizes.append(len(s))
                    digests.append(digest(s))
                    if len(s):
                        tokens[k] = forest.tokens(s)
                row, node = forest.paths(tokens)
                live = np.array(sizes)[row] > 0
                row, node = row[live], node[live]
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(j - i + 1)).astype(np.int32)
                small = tokens.astype(np.uint16)
                yield pa.record_batch([
                    batch.column("id").slice(i, j - i), pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()), pa.array([t.tobytes() for t in small], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(node[order].view(np.int64)))], schema=schema)
    return run


def _sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for i, j in parts(off, SLICE):
                sets = list(shingle_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i], words))
                cut = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.record_batch([batch.column("id").slice(i, j - i),
                                       pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], schema=schema)
    return run


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def _whole_groups(batches):
    """Tables that end where a (path, block) ends, of rows sorted by both."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        path, block = table.column("path").to_numpy(), table.column("block").to_numpy()
        new = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _firsts(table) -> np.ndarray:
    path, block = table.column("path").to_numpy(), table.column("block").to_numpy()
    return np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (block[1:] != block[:-1])])


def _stars(width: int, least: float):
    """Greedy stars: in each block the smallest unassigned id against the other unassigned ones."""
    def run(batches):
        for table in _whole_groups(batches):
            ids = table.column("id").to_numpy()
            sketch = _matrix(table.column("sketch"), width)
            group = np.zeros(len(ids), np.int64)
            group[_firsts(table)[1:]] = 1
            group = np.cumsum(group)
            left = np.arange(len(ids))
            while len(left):
                first = np.r_[True, group[left][1:] != group[left][:-1]]
                hub = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
                like = ~first & ((sketch[left] == sketch[hub]).mean(axis=1) >= least)
                yield pa.record_batch([pa.array(ids[hub[like]]), pa.array(ids[left[like]])], schema=_PAIR)
                left = left[~(first | like)]
    return run


def _joined(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The pairs that join two different sets when taken in turn; `root` gives the sets at first."""
    parent = list(range(n)) if root is None else root.tolist()

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    used = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            used.append((x, y))
    return used


def _pairs(ids, used):
    return pa.record_batch([pa.array(ids[[x for x, _ in used]] if used else ids[:0]),
                            pa.array(ids[[y for _, y in used]] if used else ids[:0])], schema=_PAIR)


def _across(width: int, least: float):
    """Likely pairs of a block between a minor member and a member of another component.

    Only as many as span the block's likely pairs are given, at most one less than its members.
    """
    def run(batches):
        for table in _whole_groups(batches):
            ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
            sketch = _matrix(table.column("sketch"), width)
            minor = table.column("minor").to_numpy()
            cut = np.r_[_firsts(table), len(ids)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                a, b = [], []
                for i in np.flatnonzero(minor[lo:hi]):
                    hit = np.flatnonzero((comp[lo:hi] != comp[lo + i])
                                         & (~minor[lo:hi] | (ids[lo:hi] > ids[lo + i])))
                    hit = hit[(sketch[lo + hit] == sketch[lo + i]).mean(axis=1) >= least]
                    a.append(np.full(len(hit), i))
                    b.append(hit)
                if a:
                    yield _pairs(ids[lo:hi], _joined(hi - lo, np.concatenate(a), np.concatenate(b)))
    return run


def _intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of presence matrices."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), columns):
        i, j = np.searchsorted(column, (lo, lo + columns))
        has = np.zeros((n, columns), np.float32)
        has[row[i:j], column[i:j] - lo] = 1
        both += has @ has.T
    return both.astype(np.int64)


def _linked(percent: int):
    """Links of a block that join two components, confirmed on full sets."""
    def run(batches):
        for table in _whole_groups(batches):
            cut = np.r_[_firsts(table), table.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:]):
                part = table.slice(lo, hi - lo)
                ids, comp = part.column("id").to_numpy(), part.column("component").to_numpy()
                if len(ids) < 2 or (comp == comp[0]).all():
                    continue
                sets = [np.array(x.values.to_numpy()) for x in part.column("grams")]
                both, size = _intersections(sets), np.array([len(x) for x in sets])
                link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
                a, b = np.nonzero(np.triu(link & (comp[:, None] != comp[None, :]), 1))
                _, first, kind = np.unique(comp, return_index=True, return_inverse=True)
                yield _pairs(ids, _joined(len(ids), a, b, first[kind]))
    return run


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, trees: int = 24,
                    depth: int = 2, node_size: int = 512) -> DataFrame:
    """Classes of documents whose word-run sets are alike: (doc_id, n_shingles, component_id, kept).

    `docs` has doc_id and text; other columns are ignored. The set of a text is its
    distinct runs of `words` white-space words, A-Z lower-cased; two documents are
    linked where the intersection holds at least `similarity` of the union, to the
    per cent. component_id is the smallest doc_id reachable over links, kept tells
    whether it is the document's own.

    Null and blank texts have an empty set and no link. A text with fewer words has
    one run. Rows that share a doc_id are one vertex: each row is returned, and is
    linked as any of them is. Rows without doc_id are returned unlinked, with a null
    component, and kept. An empty table gives an empty result.

    Method: texts with equal sets are one class, stood for by its smallest id. Each
    class follows chosen minwise tokens down `trees` independent trees (see Forest).
    Documents of a node are compared in two rounds. First greedy stars: in nodes cut
    into blocks of about `node_size`, each still unassigned document with the
    smallest id against the rest, and the blocks' documents against the node's
    smallest id. Links found are confirmed on full sets and joined to components.
    Then pairs of a node that the sketches call likely and that still lie in different
    components tie their documents to a cluster. In each cluster all pairs between
    components are confirmed on full sets, block by block, where the pairs inside the
    largest component are left out, as no link in it can change anything; only links that
    join components leave a task. So a group of thousands of copies costs one
    star, not all its pairs. With 24 trees of depth 2 a pair at exactly 0.8 meets
    somewhere with a probability above 0.9999. Sketches drop a pair only where fewer than 55 %
    of 64 tokens agree, five deviations below 0.8.
    """
    forest = Forest(similarity, trees, depth)
    least = similarity - 5 * math.sqrt(similarity * (1 - similarity) / forest.width)
    percent = round(similarity * 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    seen = written(docs.mapInArrow(
        _sketches(words, forest),
        "id long, n_shingles long, digest binary, sketch binary, paths array<long>"), "near-sketch")
    classes = seen.filter("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    members = written(seen.filter("n_shingles > 0 and id is not null")
                      .select("id", "digest").distinct().join(classes, "digest").select("id", "rep").distinct(),
                      "near-members")
    stand = seen.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"]).dropDuplicates(["digest"])
    stand = written(stand.select("id", "sketch", "paths"), "near-classes")
    steps = stand.select("id", F.explode("paths").alias("path")).distinct()
    nodes = steps.groupBy("path").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    nodes = written(steps.join(nodes, "path"), "near-nodes")
    sketch = stand.select("id", "sketch")
    blocks = F.ceil(F.col("size") / node_size)
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    stars = (dealt.select("path", "block", "id").join(sketch, "id").repartition("path", "block")
             .sortWithinPartitions("path", "block", "id")
             .mapInArrow(_stars(forest.width, least), "a long, b long"))
    spokes = nodes.filter(blocks > 1).filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    first = written(stars.unionByName(spokes).distinct(), "near-pairs")

    def confirmed(pairs, grams):
        one = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
        two = one.join(grams.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return two.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")

    def sets_of(ids):
        ids = written(ids.distinct(), "near-ids")
        if ids.count() <= SMALL:
            ids = F.broadcast(ids)
        return written(docs.join(ids, "id", "left_semi")
                       .mapInArrow(_sets(words), "id long, grams array<long>").distinct(), "near-sets")

    def ends(pairs):
        return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))

    links = written(confirmed(first, sets_of(ends(first))), "near-links")
    # rows of one doc_id may stand for several classes
    tied = members.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(tied)
    part = components(links, "near-components")

    def with_minor(rows, key):
        """Rows of keys with several components, and whether theirs is another than the largest."""
        own = rows.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        count = own.groupBy(key, "component").agg(F.count("*").alias("n"))
        main = (count.groupBy(key).agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                       F.sum("n").alias("members"), F.max("n").alias("majors"),
                                       F.count("*").alias("kinds")).filter("kinds > 1"))
        return own.join(main, key).withColumn("minor", F.expr("component != main"))

    own = with_minor(nodes.select("path", "size", "id"), "path")
    own = own.withColumn("block", F.explode(F.when(
        F.col("minor"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id"), blocks)))))
    likely = (own.select("path", "block", "id", "component", "minor").join(sketch, "id")
              .repartition("path", "block").sortWithinPartitions("path", "block", "id")
              .mapInArrow(_across(forest.width, least), "a long, b long").distinct())
    likely = written(likely, "near-likely")
    if not likely.isEmpty():
        cluster = components(likely, "near-clusters").withColumnRenamed("component", "path")
        own = with_minor(cluster, "path")
        majors = F.ceil(F.col("majors") / BLOCK)
        minors = F.ceil((F.col("members") - F.col("majors")) / BLOCK)
        at = F.when(F.col("minor"), F.pmod(F.xxhash64("id"), minors)).otherwise(
            minors + F.pmod(F.xxhash64("id"), majors)).alias("at")
        own = own.select("path", "id", "component", "minor", at, majors.alias("majors"), minors.alias("minors"))
        # a minor block meets every block, a major block only the minor ones
        other = F.expr("sequence(0L, if(minor, minors + majors, minors) - 1)")
        own = own.withColumn("other", F.explode(other)).withColumn(
            "block", F.least("at", "other") * (F.col("minors") + F.col("majors")) + F.greatest("at", "other"))
        sets = sets_of(cluster.select("id"))
        more = (own.select("path", "block", "id", "component").join(sets, "id")
                .repartition("path", "block").sortWithinPartitions("path", "block", "id")
                .mapInArrow(_linked(percent), "a long, b long"))
        more = written(more, "near-links")
        if not more.isEmpty():
            part = components(links.unionByName(more), "near-components")
    return (seen.select(F.col("id").alias("doc_id"), "n_shingles")
            .join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True))))
