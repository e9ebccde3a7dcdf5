r"""SimHash near-duplicates through sharded BK-trees.

A fingerprint has bit b set where more than half of the text's word shingles (repeats included) have it set in their
hash. Texts link when their fingerprints differ in at most ``radius`` bits; classes are the components of these links.

Only different fingerprints are compared. They are dealt into the shards of a few tables: a table's key is some of the
fingerprint's bits, as many as leave about ``SHARD`` fingerprints in a shard at any corpus size, so the work grows with
the corpus and not with its square. Each shard is a BK-tree: children are keyed by the integer distance to their
parent, and a search follows only the edges within the radius. All fingerprints of a shard ask its tree at once for the
smallest label near them, again until no label changes; one direct link goes out for each label that came down, never
all pairs. Shards of more than ``TREE_SIZE`` are cut into parts and every pair of parts is a piece of work of its own.

* ``near_duplicates``: 3-word shingles, 64 bits, radius 3. Four tables, whose bits come from four disjoint blocks of
  16: three differing bits leave one block equal, so every link meets in a shard and the classes are exact.
* ``one_row_of_each``: near copies down to a similarity of 0.8 of their 5-word shingles. They differ in about 0.15 of
  their bits, which 64 bits tell badly from 0.25: the fingerprint has ``WIDE`` words of 64 bits (the shingle's hash,
  mixed with different constants), and the radius is ``WIDE_RADIUS``. Keys are random bits, and there are as many
  tables as a link at 0.8 needs to meet in one of them with probability ``MEET``.

Trees together grow with the corpus, so shards are brought to their queries by key and are not broadcast.

Components come from alternating large-star and small-star steps over those links, each written to the shared folder.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; repeated rows and exact copies share a class; rows with a null doc_id get the class of
their fingerprint, whose id is the smallest non-null one (null if there is none); an empty table gives no rows. Only
doc_id and text are read. ``one_row_of_each`` decides by row: equal or null ids take no other row along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, release
from .common import keyed, spread, text_slices, without_rows

SHINGLE, RADIUS, SEED = 3, 3, 42
#: The near-copy form: shingle width, 64-bit words of a fingerprint, radius, and the least chance that a link meets.
WIDE_SHINGLE, WIDE, WIDE_RADIUS, MEET = 5, 8, 94, 0.99
#: Share of the bits in which fingerprints of texts of similarity 0.8 differ: the angle of cosine 2 s / (1 + s), over pi.
DIFFERING = math.acos(1.6 / 1.8) / math.pi
#: Fingerprints a shard has on average, most of them in one tree, and most in a leaf.
SHARD, TREE_SIZE, LEAF = 512, 16384, 32
#: Fingerprints with more than this part of the rows count as heavy.
HEAVY = 1000
_MIXERS = np.array([k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(64)], np.uint64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): independent versions of 64-bit hashes, the first as it is; else xor with a constant and a finalizer."""
    x = hashes[:, None] ^ _MIXERS[None, :words]
    rest = x[:, 1:]
    rest = (rest ^ (rest >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    rest = (rest ^ (rest >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x[:, 1:] = rest ^ (rest >> np.uint64(31))
    return x


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Majority of each bit, as 8 bytes a word, most significant first; counted 255 shingles at a time."""
    counts = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 255):
        bits = np.unpackbits(mixed(hashes[k : k + 255], words).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits((counts * 2 > len(hashes)).reshape(words, 64)[:, ::-1]).tobytes()


def fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = 1) -> DataFrame:
    """(rid, doc_id, fp) for each row; ``rid`` numbers the rows unless ``docs`` has one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = pa.array([fingerprint(shingle_hashes(t, width), words) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), fps], ["rid", "doc_id", "fp"])

    rid = docs["rid"] if "rid" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return spread(rows).mapInArrow(emit, "rid long, doc_id long, fp binary")


def _matrix(fps) -> np.ndarray:
    """(n, words) of a column of equally long binary values."""
    values = fps.to_pylist()
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1) if values else np.empty((0, 1), np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words are in the last axis."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def _within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """(len(a), len(b)): whether at most ``radius`` bits differ. What differs in more of the first half needs no second."""
    half = (a.shape[1] + 1) // 2
    out = _apart(a[:, None, :half], b[None, :, :half]) <= radius
    if half < a.shape[1]:
        i, j = np.nonzero(out)
        out[i, j] = _apart(a[i], b[j]) <= radius
    return out


class BKTree:
    """A BK-tree over different fingerprints, built in bulk: (pivot index, children by distance) or an array of indexes.

    ``visited`` counts the comparisons of all searches.
    """

    def __init__(self, values: np.ndarray, rows: np.ndarray | None = None):
        self.values, self.visited = values, 0
        self.root = self._build(np.arange(len(values)) if rows is None else rows)

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        pivot, rest = rows[0], rows[1:]
        far = _apart(self.values[rest], self.values[pivot])
        order = np.argsort(far, kind="stable")
        distances, starts = np.unique(far[order], return_index=True)
        return pivot, {int(d): self._build(part) for d, part in zip(distances, np.split(rest[order], starts[1:]))}

    def nearest_label(self, asked: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For each asked index the one of smallest label within ``radius``, itself included, and how many are there."""
        best, degree = asked.copy(), np.zeros(len(asked), np.int64)

        def offer(who: np.ndarray, found: np.ndarray) -> None:
            """``found`` are indexes near the asked positions ``who``."""
            better = label[found] < label[best[who]]
            best[who[better]] = found[better]

        stack = [(self.root, np.arange(len(asked)))]
        while stack:
            node, who = stack.pop()
            if isinstance(node, tuple):
                pivot, children = node
                self.visited += len(who)
                far = _apart(self.values[asked[who]], self.values[pivot])
                close = who[far <= radius]
                degree[close] += 1
                offer(close, np.full(len(close), pivot))
                stack += [(child, who[near]) for d, child in children.items() if (near := np.abs(far - d) <= radius).any()]
            elif len(node):
                self.visited += len(who) * len(node)
                by_label = node[np.argsort(label[node], kind="stable")]
                for k in range(0, len(who), 4096):
                    some = who[k : k + 4096]
                    close = _within(self.values[asked[some]], self.values[by_label], radius)
                    degree[some] += close.sum(axis=1)
                    first = close.argmax(axis=1)
                    found = close[np.arange(len(some)), first]
                    offer(some[found], by_label[first[found]])
        return best, degree


def spanning_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): direct links that hold the components of all links within ``radius`` together, at most one for each
    index and pass. The smallest label near an index replaces the one of its whole component so far, until none falls."""
    label, asked, links = np.arange(len(values)), np.arange(len(values)), []
    while len(asked):
        best, degree = BKTree(values, asked).nearest_label(asked, label, radius)
        falls = label[best] < label[asked]
        if falls.any():
            links.append((asked[falls], best[falls]))
            np.minimum.at(label, label[asked[falls]], label[best[falls]])
            while (label[label] != label).any():
                label = label[label]
        asked = asked[degree > 1] if falls.any() else asked[:0]
    return tuple(np.concatenate(x) for x in zip(*links)) if links else (asked, asked)


def exact_tables(n: int) -> list[np.ndarray]:
    """Bit numbers of four keys, one of which is equal where at most three of 64 bits differ."""
    width = min(16, _key_bits(n))
    return [np.arange(16 * k, 16 * k + width) for k in range(4)]


def random_tables(n: int, words: int = WIDE, differing: float = DIFFERING, meet: float = MEET) -> list[np.ndarray]:
    """Bit numbers of as many random keys as let a link with a share ``differing`` meet with probability ``meet``."""
    width = _key_bits(n)
    tables = math.ceil(math.log(1 - meet) / math.log1p(-((1 - differing) ** width)))
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(64 * words) for _ in range(tables * width // (64 * words) + 1)])
    return [order[k * width : (k + 1) * width] for k in range(tables)]


def _key_bits(n: int) -> int:
    return max(4, math.ceil(math.log2(max(n, 1) / SHARD)))


def _shards(distinct: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(k, node, fp): every fingerprint under its key in each table; the table is in the key's upper bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                bits = np.unpackbits(_matrix(batch.column("fp")).view(np.uint8), axis=1, bitorder="little")
                for t, chosen in enumerate(tables):
                    key = bits[:, chosen] @ (np.int64(1) << np.arange(len(chosen), dtype=np.int64)) + (t << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column("node"), batch.column("fp")], ["k", "node", "fp"])

    return distinct.mapInArrow(emit, "k long, node long, fp binary")


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each shard in a partition sorted by shard and part."""

    def links(key_rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(key_rows)
        nodes = table.column("node").to_numpy()
        a, b = spanning_links(_matrix(table.column("fp")), radius)
        u, v = np.maximum(nodes[a], nodes[b]), np.minimum(nodes[a], nodes[b])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "p", "q")], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for s, e in zip(starts, np.r_[starts[1:], len(keys)]):
            key = tuple(keys[s])
            if key != current and held:
                yield links(held)
                held = []
            current = key
            held.append(batch.slice(s, e - s))
    if held:
        yield links(held)


def near_links(distinct: DataFrame, tables: list[np.ndarray], radius: int) -> DataFrame:
    """(u, v), u > v: direct links between nodes of ``distinct`` (node, fp) whose components are those of all links
    that meet in a shard. Written down, repeats gone."""
    shards = materialise(_shards(distinct, tables), "shards")
    large = shards.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE_SIZE).select(F.col("k").alias("lk"), F.ceil(F.col("n") / TREE_SIZE).cast("int").alias("parts"))
    cut = shards.join(large, F.col("k") == F.col("lk"), "left").select("k", "node", "fp", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cut = cut.select("k", "node", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.select("k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "fp")
    dealt = cut.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q")
    out = materialise(dealt.mapInArrow(lambda batches: _shard_links(batches, radius), "u long, v long").distinct(), "links")
    release(shards)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with edges. Large-star, small-star.

    ``edges`` is a written table, which goes when it is no longer needed. The smallest neighbour is a partial aggregate
    and joined back, so that a hub's edges are never in one group.
    """
    while True:
        both = edges.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        after = materialise(small.where("u > v").distinct(), "cc")
        release(edges)
        edges = after
        n, different = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        # Done when all edges form stars: each node has one edge, and no centre has any.
        if n == different and edges.join(edges.select(F.col("u").alias("inner")), F.col("v") == F.col("inner"), "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, tables=exact_tables, radius: int = RADIUS) -> DataFrame:
    """rid, doc_id, fp and ``first``, the (unnamed, doc_id, rid) of the class's first row, from (rid, doc_id, fp).

    ``tables`` makes the keys for a number of fingerprints. Those that hold over 1 / HEAVY of all rows are fewer than
    HEAVY, so they are broadcast; only the others are joined by shuffling, and no key is hot there.
    """
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    distinct = materialise(prints.groupBy("fp").agg(F.min("rid").alias("node"), rank.alias("first"), F.count(F.lit(1)).alias("n_rows")), "distinct")
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    linked = components(near_links(distinct.select("node", "fp"), tables(n), radius)).withColumnRenamed("node", "own")
    rooted = materialise(distinct.join(linked, F.col("node") == F.col("own"), "left").select(F.col("fp").alias("nfp"), "first", "n_rows", F.coalesce("root", "node").alias("root")), "rooted")
    release(distinct)
    heads = rooted.groupBy(F.col("root").alias("head")).agg(F.min("first").alias("first"))
    named = materialise(rooted.drop("first").join(heads, F.col("root") == F.col("head")).select("nfp", "n_rows", "first"), "named")
    release(rooted)
    heavy = F.broadcast(named.where(F.col("n_rows") > max(1, total // HEAVY)))
    same = F.col("fp") == F.col("nfp")
    every = prints.join(heavy, same).unionByName(prints.join(heavy, same, "left_anti").join(named, same))
    return every.select("rid", "doc_id", "fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (8 bytes, most significant first), component_id (smallest doc_id of the class): one row per document."""
    found = classes(materialise(fingerprints(docs), "prints"))
    return found.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def one_row_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id, nulls last.

    Classes are of rows, so neither a null nor a repeated doc_id keeps or drops any other row. Among rows of equal id
    the first by row number stays.
    """
    rows = keyed(docs)
    texts = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    prints = materialise(fingerprints(texts, WIDE_SHINGLE, WIDE), "prints")
    found = classes(prints, random_tables, WIDE_RADIUS)
    return without_rows(rows, found.where(F.col("rid") != F.col("first.rid")).select("rid")).select("row.*")
