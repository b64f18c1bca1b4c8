"""SimHash near-duplicates: majority fingerprints of word shingles, linked through a Gray-ordered hierarchical index.

`one_of_each` takes the index and bands of least hashes for candidates and confirms them by exact shingle similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, id_text, release, slices, stored, stored_few

BITS = 64
HOT_BUCKET, SPLITS = 4096, 4
#: Shingle similarity of near-duplicates, and bands of least hashes: a pair at 0.8 shares none once in 17,000 times.
SIMILAR, BANDS, BAND_ROWS = 0.8, 32, 6
#: Rounds of comparing bucket members with a leader, and members that a task compares with each other twice over.
LEADERS, BLOCK = 2, 256
#: Rows of profiles (about 300 bytes) and of shingle sets (some kilobytes) that a file of a scratch table holds.
FILE_PROFILES, FILE_SETS = 1 << 15, 1 << 11
_FACTOR, _SHIFT = np.random.default_rng(10).integers(0, 1 << 32, (2, BANDS * BAND_ROWS), dtype=np.uint32)
_FACTOR |= np.uint32(1)
_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined word shingles with repeats; a shorter text is one shingle, one without words has none."""
    w = text.lower().split()  # on bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return [b" ".join(t) for t in zip(*(w[i:] for i in range(words)), strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of hashes, the bits that are set in over half of them."""
    n = len(sizes)
    base = np.repeat(np.arange(n, dtype=np.int64) * 256, sizes)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        byte = (hashes >> np.uint64(8 * k)).astype(np.uint8)
        counts = np.bincount(base + byte, minlength=n * 256).reshape(n, 256) @ _BIT_OF
        part = ((2 * counts > sizes[:, None]) << np.arange(8)).sum(axis=1).astype(np.uint64)
        out |= part << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, fp` (64 bits as a signed long). A text without words, or null, has fingerprint zero."""

    def run(batches):
        for b in slices(batches):
            own = [[xxhash.xxh64_intdigest(s, seed) for s in shingles(t, words)] for t in b.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            hashes = np.fromiter((h for hs in own for h in hs), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(majority(hashes, sizes).view(np.int64))], ["doc_id", "fp"])
            del own, hashes
        release()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray sequence (a prefix's rank is a prefix of the rank)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


class Forest:
    """Smallest index reachable, by batches of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


class GrayIndex:
    """Fingerprints of many buckets, sorted by bucket and Gray rank.

    Level k has a node for each shared pattern of the leading 8(k+1) bits in a bucket. Two nodes whose
    patterns differ in more than `bits` bits are dropped with everything below them; what their patterns
    differ by is carried down, so only the next 8 bits are compared at each level.
    """

    LEVELS, CHUNK = 8, 1 << 18

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), bucket))
        self.order, self.fp = order, fp[order]
        bucket = bucket[order]
        fresh = np.append(True, bucket[1:] != bucket[:-1]) if len(fp) else np.zeros(0, bool)
        self.root = np.flatnonzero(fresh)
        starts = []
        for k in range(self.LEVELS):
            lead = self.fp >> np.uint64(8 * (self.LEVELS - 1 - k))
            starts.append(np.flatnonzero(fresh | np.append(True, lead[1:] != lead[:-1])) if len(fp) else np.zeros(0, np.int64))
        #: of each level: first row of every node; of the level above: first child of every node
        self.starts = starts
        self.child = [np.append(np.searchsorted(starts[0], self.root), len(starts[0]))]
        self.child += [np.append(np.searchsorted(starts[k], starts[k - 1]), len(starts[k])) for k in range(1, self.LEVELS)]
        self.byte = [(self.fp[starts[k]] >> np.uint64(8 * (self.LEVELS - 1 - k))).astype(np.uint8) for k in range(self.LEVELS)]

    def pairs(self, bits: int):
        """Batches of linked rows (i, j), i < j, by their place in the input."""
        todo = [(0, part, part, np.zeros(len(part), np.int64)) for part in np.array_split(np.arange(len(self.root)), max(1, len(self.root) // 4096))]
        while todo:
            level, a, b, gone = todo.pop()
            first, size = self.child[level], np.diff(self.child[level])
            total = size[a] * size[b]
            if len(a) > 1 and total.sum() > self.CHUNK:
                half = len(a) // 2
                todo += [(level, a[:half], b[:half], gone[:half]), (level, a[half:], b[half:], gone[half:])]
                continue
            at = np.repeat(np.arange(len(a)), total)
            k = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
            wide = size[b[at]]
            x, y = first[a[at]] + k // wide, first[b[at]] + k % wide
            diff = gone[at] + np.bitwise_count(self.byte[level][x] ^ self.byte[level][y])
            keep = (diff <= bits) & (x <= y)
            x, y, diff = x[keep], y[keep], diff[keep]
            if level + 1 < self.LEVELS:
                if len(x):
                    todo.append((level + 1, x, y, diff))
            else:
                x, y = self.order[self.starts[level][x]], self.order[self.starts[level][y]]
                apart = x != y
                if apart.any():
                    yield np.minimum(x, y)[apart], np.maximum(x, y)[apart]


def _fields(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    cuts = np.linspace(lo, hi, parts + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def bucket_keys(fps: DataFrame, bits: int, hot: int = HOT_BUCKET) -> DataFrame:
    """Rows `key, fp`: any two fingerprints within `bits` bits share a key.

    The 64 bits are cut into bits + 1 fields, one of which two such fingerprints share. A bucket of more than
    `hot` fingerprints is split again by the fields of its other bits, SPLITS - 1 times at most. What is crowded
    even then agrees in most bits; its task holds 8 bytes a fingerprint and a few times that for the index.
    """
    everything = [(0, BITS)]

    def explode(df: DataFrame, free: list[tuple[int, int]], keys: list) -> list[tuple[DataFrame, list[tuple[int, int]]]]:
        # Free bits are cut into fields of adjacent free bits.
        flat = [i for lo, hi in free for i in range(lo, hi)]
        out = []
        for lo, hi in _fields(0, len(flat), bits + 1):
            mask = sum(1 << i for i in flat[lo:hi])
            mask -= (mask >> 63) << 64
            key = F.xxhash64(*keys, F.lit(f"{lo}-{hi}"), F.col("fp").bitwiseAND(F.lit(mask)))
            rest = [(i, i + 1) for i in flat[:lo] + flat[hi:]]
            out.append((df.select(key.alias("key"), "fp"), rest))
        return out

    done: list[DataFrame] = []
    level, n = explode(fps, everything, []), fps.count()
    for depth in range(SPLITS + 1):
        if depth == SPLITS:
            done += [df for df, _ in level]
            break
        counts = None
        for i, (df, _) in enumerate(level):
            part = df.groupBy("key").count().select(F.lit(i).alias("i"), "key", "count")
            counts = part if counts is None else counts.unionAll(part)
        busy = stored_few(counts.filter(F.col("count") > 1), "buckets", n * len(level))
        crowded = {r["i"] for r in busy.filter(F.col("count") > hot).select("i").distinct().collect()}
        deeper = []
        for i, (df, rest) in enumerate(level):
            own = busy.filter(F.col("i") == i)
            done.append(df.join(own.filter(F.col("count") <= hot).select("key"), "key", "left_semi"))
            if i in crowded:
                deeper += explode(df.join(own.filter(F.col("count") > hot).select("key"), "key", "left_semi"), rest, ["key"])
        level = deeper
        if not level:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionAll(df)
    return out


def near_links(fps: DataFrame, bits: int = 2, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges `u, v` (u > v) that join all distinct fingerprints `fp` at most `bits` apart, a forest per task."""

    def run(batches):
        got = [(b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)) for b in batches if b.num_rows]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        names, node = np.unique(fp, return_inverse=True)
        forest = Forest(len(names))
        for a, b in GrayIndex(key, fp).pairs(bits):
            forest.link(node[a], node[b])
        moved = np.flatnonzero(forest.label != np.arange(len(names)))
        u, v = names[moved].view(np.int64), names[forest.label[moved]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return bucket_keys(fps, bits, hot).repartition("key").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Rows `node, root` of every node of the edges `u, v` (`most` at most, if known): the smallest node it can reach.

    Alternating large and small stars; each round is written to the shared folder, and the driver only
    compares a count and a checksum. A node with very many links is aggregated before it is shuffled.
    """
    edges, seen = stored(edges, "edges", "snappy") if most is None else stored_few(edges, "edges", most), None
    most = edges.count()
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionAll(down.select("u", F.col("m").alias("v")))
        # A round makes two edges of one at most.
        edges = stored_few(small.distinct(), "edges", 2 * most)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, most = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, fp, component_id`: the smallest doc_id among the documents reachable over links of at most `bits` bits.

    One row for each row of `docs`, repeated rows included; copies meet in one fingerprint before anything is
    compared. A null id takes part and gets its component's smallest id (null if it has none). A null or
    wordless text has fingerprint zero and is linked like any other; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words, seed, id_col, text_col), "fingerprints", "snappy")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", "snappy")
    roots = components(near_links(least.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.select("fp", "root").join(component, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def _set_of(text: bytes, words: int, seed: int) -> tuple[list[int], np.ndarray]:
    """Hashes of a text's shingles, and the distinct ones in order."""
    own = [xxhash.xxh64_intdigest(s, seed) for s in shingles(text, words)]
    return own, np.unique(np.array(own, np.uint64))


def profiles(docs: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """Rows `doc_id, hash, node, fp, n, bands` of every row of `docs`: text hash, hash of the shingle set, fingerprint, shingles in the set, band hashes."""
    schema = "doc_id long, hash long, node long, fp long, n int, bands array<long>"

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            both = [_set_of(t, words, seed) for t in texts]
            sizes = np.fromiter((len(x) for x, _ in both), np.int64, len(both))
            fps = majority(np.fromiter((h for x, _ in both for h in x), np.uint64, int(sizes.sum())), sizes)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for _, s in both], np.uint64)
            bands = [band_keys(s).tolist() if len(s) else [] for _, s in both]
            cols = [b.column("doc_id"), b.column("hash"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array([len(s) for _, s in both], pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "hash", "node", "fp", "n", "bands"])
        release()

    return hashed(docs).mapInArrow(run, schema)


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def band_keys(shingle_set: np.ndarray) -> np.ndarray:
    """A hash of each band's least values of the set."""
    low = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(low, (x[a : a + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=low)
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of rows `key, node, n` those whose bucket holds nodes of several components (`comp`, by `labels`)."""
    rows = members.join(labels.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    torn = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    return rows.join(torn, "key", "left_semi").select("key", "node", "n", "comp")


def leader_pairs(members: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs `a, b` of every member of an open bucket with its bucket's leader, a row for each member at most in each bucket.

    The leader is the node of least hash, the same in all buckets that hold it, so a family meets few leaders.
    """
    order = F.xxhash64("node", F.lit(turn))
    leader = members.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("other"))).alias("x")).select("key", "x.b", "x.m", "x.other")
    pairs = members.join(leader, "key").filter((F.col("comp") != F.col("other")) & (F.least("n", "m") >= least * F.greatest("n", "m")))
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def torn_pairs(members: DataFrame, sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Edges `u, v` among all pairs of members of a bucket that lie in different components.

    A bucket's members are dealt to blocks of about `block`, any two of which meet in one task with their sets, so a
    task holds two blocks whatever the bucket's size; of buckets with the same members one is looked at.
    """
    seen = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    seen = seen.dropDuplicates(["m", "x", "y"]).select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.join(seen, "key").withColumn("own", own).withColumn("other", other).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "comp")

    def compare(batches):
        def links(node, comp, sets):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            _, token = np.unique(np.concatenate(sets), return_inverse=True)
            owner, often = np.repeat(np.arange(len(sets)), sizes), np.bincount(token) > 1
            token, owner = token[often[token]], owner[often[token]]
            token = np.unique(token, return_inverse=True)[1]
            both = np.zeros((len(sets), len(sets)), np.float32)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
                a, b = np.searchsorted(token, [lo, lo + 4096])
                part = np.zeros((len(sets), 4096), np.float32)
                part[owner[a:b], token[a:b] - lo] = 1
                both += part @ part.T
            i, j = np.nonzero(np.triu(both >= least * (sizes[:, None] + sizes[None] - both), 1))
            apart = comp[i] != comp[j]
            forest = Forest(len(sets))
            forest.link(i[apart], j[apart])
            moved = np.flatnonzero(forest.label != np.arange(len(sets)))
            return node[moved], node[forest.label[moved]]

        def groups():
            rest: list = []
            for b in batches:
                task = b.column("task").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if rest and task[lo] != rest[0].column("task")[0].as_py():
                        yield rest
                        rest = []
                    rest.append(b.slice(lo, hi - lo))
            if rest:
                yield rest

        for group in groups():
            t = pa.Table.from_batches(group)
            if t.num_rows > 1:
                u, v = links(t.column("node").to_numpy(), t.column("comp").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        release()

    return rows.join(sets, "node").select("task", "node", "comp", "set").repartition("task").sortWithinPartitions("task").mapInArrow(compare, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """Rows `node, set` (distinct shingle hashes in order) of the `nodes`, made again from one text of each."""

    def sets(batches):
        seen = set()
        for b in slices(batches):
            own = [_set_of(t, words, seed)[1].tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            named = np.array([xxhash.xxh64_intdigest(s, seed) for s in own], np.uint64).view(np.int64).tolist()
            fresh = [i for i, x in enumerate(named) if not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array([named[i] for i in fresh], pa.int64()), pa.array([own[i] for i in fresh], pa.binary())], ["node", "set"])
        release()

    texts = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("hash").alias("hash")).select("hash").distinct()
    return hashed(docs).join(texts, "hash", "left_semi").select("text").mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs `a, b` of nodes whose shingle sets have a Jaccard similarity of at least `least`, as edges `u, v`."""

    def confirm(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["u", "v"])
        release()

    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirm, "u long, v long")


def merge(labels: DataFrame, links: DataFrame, nodes: int, most: int | None = None) -> DataFrame:
    """`labels` (`node, root`) after more edges `u, v` (`most` at most, if known) between `nodes` nodes: only roots of different components are linked anew."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("x"), F.coalesce("v_root", "v").alias("y"))
    moved = components(ends.filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), most)
    moved = stored_few(moved, "moved", nodes)
    known = labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored_few(known.unionAll(moved.join(labels.select("node"), "node", "left_anti")), "labels", nodes)


def similar_groups(docs: DataFrame, words: int = 5, bits: int = 6, seed: int = 42, least: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Rows `doc_id, hash, root` of every row of `docs` (columns `doc_id, text`): groups reachable over shingle similarities of at least `least`.

    Candidates share a band of least shingle hashes or lie within `bits` bits of one another; each is
    confirmed on the whole shingle sets. Equal sets (texts without words too) are one node from the start.
    What the index finds is linked first. Then every member of a band's bucket is compared with the bucket's leader,
    as long as it lies in another component, in LEADERS rounds; that joins a family in rows as many as it has members.
    Of buckets still torn all pairs in different components are compared, block by block: none is left out.
    """
    rows = stored(profiles(docs, words, seed), "profiles", "snappy")
    sets = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = stored_few(sets.filter("n > 0"), "shingle_sets", rows.count(), FILE_PROFILES)
    n = sets.count()
    first = sets.groupBy("fp").agg(F.min("node").alias("first"))
    same = sets.join(first, "fp").filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    close = near_links(first.select("fp"), bits).join(of("u"), "u").join(of("v"), "v").select("u_node", "v_node")
    pairs = stored(same.unionAll(close), "pairs", "snappy")
    spread = sets.select(F.explode("bands").alias("key"), "node", "n")
    many = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    members = stored_few(spread.join(many, "key", "left_semi"), "buckets", BANDS * n)
    need = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(members.select("node")).distinct()
    sets = stored_few(shingle_sets(docs, rows, need, words, seed), "sets", n, FILE_SETS)
    labels = stored_few(components(similar(pairs, sets, least)), "labels", n)
    for turn in range(LEADERS):
        members = stored_few(open_buckets(members.select("key", "node", "n"), labels), "buckets", members.count())
        # Each row of a bucket meets its leader at most.
        labels = merge(labels, similar(leader_pairs(members, least, turn), sets, least), n, members.count())
    members = stored_few(open_buckets(members.select("key", "node", "n"), labels), "buckets", members.count())
    labels = merge(labels, torn_pairs(members, sets, least, block), n)
    return rows.select("doc_id", "hash", "node").join(labels, "node", "left").select("doc_id", "hash", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, words: int = 5, bits: int = 6, least: float = SIMILAR) -> DataFrame:
    """The rows of `docs` (columns `doc_id, text` and any others) without near-duplicates: of each group one row stays.

    Groups are those of `similar_groups`. The row with the smallest id stands for its group, of rows with that
    id the one with the smallest hash of its text; a row without an id only if nothing in its group has one.
    Unrelated texts under one id stand for their own groups and all stay; of rows equal in id and text one
    stays. Null and empty texts are one group, texts of any length are compared whole, other columns of any
    name pass through, an empty table gives no rows.
    """
    docs_in, docs = docs.columns, apart(docs, ("doc_id", "text"))
    rows = similar_groups(docs.select("doc_id", "text"), words, bits, least=least)
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.hash").alias("_hash"))
    own = docs.withColumn("_text", F.xxhash64("text"))
    kept = own.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text"]).drop("_text").toDF(*docs_in)
