"""Prefix trie of conversations: every distinct sequence of first turns is a node, subtree totals by tree contraction.

Nodes come from running sums: each turn is scattered to 128 bits together with its place, and the sum over the first
turns names the prefix, so no conversation is gathered anywhere. Subtree totals alternate two kinds of join rounds:
rake takes all leaves off and adds them to their parents, compress takes nodes out of unary chains and hands what
they hold to the edge above their only child. The nodes taken out come back in reverse order with their totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import before, value_buckets
from .common import stored

#: Sums of this many 32-bit numbers stay below 2^63, so a conversation may have 2^31 turns.
PARTS = 4
#: Ids that share all but these low bits are written into one text; a node with several texts is hashed text by text.
RANGE_BITS = 12


def slim(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows `conv_id, turn, content, len` without texts: a hash of role and text, the text's code points. Rows without a conversation are left out."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    content = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), content.alias("content"), F.length(t).cast("long").alias("len"))
    return rows.filter("conv_id IS NOT NULL")


def numbered(rows: DataFrame) -> DataFrame:
    """`pos` (from 1) of every row in its conversation: by turn, null first, rows of one turn by `content`."""
    known, at = F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long"))
    coarse = F.when(known, value_buckets(at.cast("double"))[0]).otherwise(F.lit(-(1 << 40)))
    fine = F.struct(known.alias("k"), at.alias("t"), F.substring("content", 1, 2).alias("c"))
    out = before(rows.withColumn("one", F.lit(1).cast("long")), ["conv_id"], coarse, fine, [F.asc_nulls_first("turn"), F.col("content")], sums=["one"])
    return out.withColumn("pos", F.col("one_before") + 1).drop("one", "one_before")


def rebuild(rows: DataFrame, block: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rows `conv_id, depth, content, len` of the rebuilt conversations, and `conv_id, n_turns` of all of them.

    With h = crc32(conv_id) % `shared`, a conversation takes the first h turns of the one at the start of its
    block of ids, then its own turns after its first h. Only those first turns (fewer than `shared`) are
    joined to the ids of a block (at most 2 `block` - 1).
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("long")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("base", base).withColumn("h", h)
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stored(convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "conversations", "snappy")
    heads = rows.filter(F.col("pos") < shared).select(F.col("conv_id").alias("base"), "pos", "content", "len")
    heads = heads.join(convs.filter("taken > 0").select("base").distinct(), "base", "left_semi")
    first = convs.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "content", "len")
    # h follows from the id; only what is taken from the block's first has to be joined.
    own = rows.withColumn("h", h).filter("pos > h").join(convs.select("conv_id", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "content", "len")
    turns = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return first.unionAll(own), turns


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows `conv_id, depth, a, b, pa, pb, len`: 128 bits that name the prefix ending at each turn, and those of the prefix before it."""
    scatter = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.col("content")))
    parts = [f"s{i}" for i in range(PARTS)]
    rows = turns.select("conv_id", "depth", "len", scatter.alias("md5")).select(
        "conv_id", "depth", "len", *[F.conv(F.substring("md5", 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(parts)]
    )
    summed = before(rows, ["conv_id"], F.shiftright("depth", 18), F.shiftright("depth", 9), [F.col("depth")], sums=parts)

    def half(cols: list[Column]) -> Column:
        low = [c.bitwiseAND(F.lit(0xFFFFFFFF)) for c in cols]
        return F.shiftleft(low[0], 32).bitwiseOR(low[1])

    upto, now = [F.col(f"{s}_before") for s in parts], [F.col(f"{s}_before") + F.col(s) for s in parts]
    return summed.select("conv_id", "depth", half(now[:2]).alias("a"), half(now[2:]).alias("b"), half(upto[:2]).alias("pa"), half(upto[2:]).alias("pb"), "len")


def name(conv: str, depth: str) -> Column:
    """A node as its smallest member and its depth."""
    return F.struct(F.col(conv).alias("c"), F.col(depth).alias("d"))


def trie(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows `conv_id, depth, parent_conv_id, n_convs, own` of all nodes, the root included, and `conv_id, depth, end` of all ends."""
    rows = stored(prefixes(turns), "prefixes", "snappy")
    keys = ["depth", "a", "b"]
    nodes = rows.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("len"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = stored(nodes, "nodes", "snappy")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    above = above.unionAll(top.select(F.lit(1).cast("long").alias("depth"), "pa", "pb", "parent_conv_id"))
    own = ((F.col("n_convs") - 1) * F.col("len")).alias("own")
    below = nodes.join(above, ["depth", "pa", "pb"]).select("conv_id", "depth", "parent_conv_id", "n_convs", own)
    whole = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("own"))
    last = rows.join(sizes.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"]).select("depth", "a", "b", F.col("conv_id").alias("end"))
    ends = last.join(nodes.select(*keys, "conv_id"), keys).select("conv_id", "depth", "end")
    bare = sizes.filter("n_turns = 0").select(F.col("conv_id").alias("end")).withColumn("conv_id", root.select("conv_id").scalar())
    return stored(below.unionAll(whole), "trie", "snappy"), ends.unionAll(bare.select("conv_id", F.lit(0).cast("long").alias("depth"), "end"))


def contract(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Rows `node, <value>...` of every node of a forest (`node`, `parent`, `depth`, values): sums over its subtree.

    Rake and compress alternate until nothing is left; every round is written. A node of a unary chain is
    taken out if its depth has fewer trailing zero bits than those of its unary parent and child (ties: by hash), so
    no two adjacent nodes go at once and an untouched chain halves in each round. Long chains and bushy trees
    alike take a number of rounds that grows with the logarithm of their size.
    """
    edge = [f"up_{v}" for v in values]
    kids = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("live"))
    live = nodes.join(kids.withColumnRenamed("parent", "node"), "node", "left").select(
        "node", "parent", "depth", F.coalesce("live", F.lit(0)).alias("live"), *values, *[F.lit(0).cast("long").alias(e) for e in edge]
    )
    live, done, spliced, r = stored(live, "tree", "snappy"), [], [], 0
    while not live.isEmpty():
        # Rake: a leaf's sums are whole; with its edge's they go to the parent, added up before they move.
        leaf = F.col("live") == 0
        done.append(live.filter(leaf).select("node", *values))
        got = live.filter("parent IS NOT NULL").groupBy("parent").agg(
            *[F.sum(F.when(leaf, F.col(v) + F.col(e))).alias(f"got_{v}") for v, e in zip(values, edge, strict=True)],
            F.count(F.when(leaf, 1)).alias("raked"),
            F.min(F.when(~leaf, F.col("node"))).alias("only"),
        )
        raked = live.filter(~leaf).join(got.withColumnRenamed("parent", "node"), "node").select(
            "node", "parent", "depth", (F.col("live") - F.col("raked")).alias("live"), "only", *[(F.col(v) + F.coalesce(f"got_{v}", F.lit(0))).alias(v) for v in values], *edge
        )
        raked = stored(raked, "raked", "snappy")
        # Compress: of two adjacent unary nodes the one of higher order stays.
        zeros = F.length(F.regexp_extract(F.bin("depth"), "0*$", 0))
        unary = raked.filter("live = 1 AND parent IS NOT NULL").withColumn("order", F.struct(zeros, F.xxhash64("node", F.lit(r)), "node"))
        pair = unary.select("node", "parent", "order").join(unary.select(F.col("node").alias("parent"), F.col("order").alias("above")), "parent")
        stay = pair.select(F.when(F.col("order") < F.col("above"), F.col("parent")).otherwise(F.col("node")).alias("node")).distinct()
        out = unary.join(stay, "node", "left_anti").select("node", F.col("parent").alias("to"), "only", *[(F.col(v) + F.col(e)).alias(f"put_{v}") for v, e in zip(values, edge, strict=True)], *values)
        out = stored(out, "out", "snappy")
        moved = raked.join(out.select("node", F.lit(True).alias("gone")), "node", "left").filter("gone IS NULL")
        moved = moved.join(out.select(F.col("only").alias("node"), "to", *[f"put_{v}" for v in values]), "node", "left")
        # What a node adds to its only child's total: its own sums and those of the edge between as it was.
        spliced.append(out.join(raked.select(F.col("node").alias("only"), *edge), "only").select("node", "only", *[(F.col(v) + F.col(e)).alias(v) for v, e in zip(values, edge, strict=True)]))
        live = moved.select(
            "node", F.coalesce("to", "parent").alias("parent"), "depth", "live", *values, *[(F.col(e) + F.coalesce(f"put_{v}", F.lit(0))).alias(e) for v, e in zip(values, edge, strict=True)]
        )
        live, r = stored(live, "tree", "snappy"), r + 1
    # Expand: a node taken out in a round finds its child among what went later, which is no more than the tree was then.
    total = None
    for k in reversed(range(r)):
        if total is not None:
            back = spliced[k].join(total.select(F.col("node").alias("only"), *[F.col(v).alias(f"t_{v}") for v in values]), "only").select("node", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])
            total = total.unionAll(back).unionAll(done[k])
        else:
            total = done[k]
        total = stored(total, "totals", "snappy")
    return total if total is not None else nodes.select("node", *values)


def ends_digest(ends: DataFrame) -> DataFrame:
    """Rows `conv_id, depth, ends_sha256`: of each node SHA-256 of its ends' ids in ascending order, joined by commas.

    Ids are first joined into texts of at most 2^RANGE_BITS ids; a node with several such texts is hashed text after
    text in order, which needs the memory of one of them whatever the number of its ends.
    """
    texts = ends.groupBy("conv_id", "depth", F.shiftright("end", RANGE_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("end")), lambda x: x.cast("string")), ",").alias("ids"))
    texts = stored(texts, "ends", "snappy")
    parts = texts.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("parts"), F.max("ids").alias("ids"))
    one = parts.filter("parts = 1").select("conv_id", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    many = texts.join(parts.filter("parts > 1").select("conv_id", "depth"), ["conv_id", "depth"]).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, state = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if key[:2] != at:
                    if at is not None:
                        yield out()
                    at, state = key[:2], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(key[2].encode())
        if at is not None:
            yield out()

    return one.unionAll(many.select("conv_id", "depth", "ids").mapInArrow(run, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`, one per node.

    A conversation's turns are ordered by turn (null first; several of one turn by a hash of role and text); a null
    role or text is empty, a row without a conversation is left out, repeated rows are turns of their own.
    Rebuilt conversations without turns are members and ends of the root alone. Texts of any length
    are reduced to a hash and a length at once; other columns are not read; an empty table gives no rows. Prefixes are told
    apart by 128 bits.
    """
    rows = stored(numbered(slim(conversations, conv, turn, role, text)), "turns", "snappy")
    turns, sizes = rebuild(rows)
    sizes = stored(sizes, "sizes", "snappy")
    nodes, ends = trie(turns, sizes)
    kids = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie", "snappy")
    above = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d")))
    totals = contract(nodes.select(name("conv_id", "depth").alias("node"), above.alias("parent"), "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    totals = totals.select(F.col("node.c").alias("conv_id"), F.col("node.d").alias("depth"), "n_leaves", "saved_tokens")
    out = nodes.join(totals, ["conv_id", "depth"]).join(ends_digest(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
