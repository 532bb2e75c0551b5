"""Prefix trie of conversations with count-min screening.

Every distinct sequence of first turns is a node. A prefix is known by its depth and 128 bits: the
exclusive-or of its turns' position-salted hashes. A count-min sketch over all prefixes tells which can only stand
in one conversation: their nodes are written where the prefix lies. Only the others, which
may be shared, are shuffled and counted exactly; a wrong guess of the sketch costs a shuffled row and nothing else.

Turns are ordered by their number, null first, equal numbers by the hash of role and text; null roles and texts are
empty. Rows without conv_id belong to no conversation and are left out, repeated rows are
turns of their own, other columns are ignored, whatever their names. A text goes no further than the task that hashes it,
however long it is. A conversation may hold any share of the turns. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import lookup
from scanloom.llm.runs import scan
from scanloom.session import kept

#: Counters of a prefix, and the most bits of one counter row: three rows of 2^27 bits are 48 MB in every worker.
ROWS, MOST_BITS = 3, 27
#: Bits of one bitmap row of Spark's bitmap functions.
BITMAP = 32_768
#: Ids of conversations in one piece of a node's list.
CHUNK = 4_096
KEY = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, at, t1, t2, chars``: place of each turn in its conversation, hashes of role and text, code points of the text."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), r, t).alias("t1"), F.xxhash64(F.lit(2), r, t).alias("t2"), F.length(t).cast("long").alias("chars"))
    return scan(rows, "conv_id", ["turn", "t1", "t2"], name="trie-turns").drop("turn")


def opening_turns(conv_id: Column) -> Column:
    """How many turns of its hundred's first conversation open the rebuilt one."""
    return F.crc32(conv_id.cast("string")) % 6


def share_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c: the first h turns of conversation c - c mod 100, then c's own turns after its first h.

    Returns turns ``conv_id, depth, len, t1, t2, chars`` (depth from 1, len: turns of the rebuilt conversation) and
    all conversations ``conv_id, len``. An opening has at most 5 turns and serves at most 100 conversations.
    """
    h = opening_turns(F.col("conv_id"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(100))).alias("base"))
    opened = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv_id", "base", "h", "n", opened.alias("opened"), (opened + own).alias("len"))
    convs = kept(convs, "trie-conversations")
    starts = turns.where("at < 5").withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "opened", "len"), "base").where("at < opened")
    first = starts.select("conv_id", (F.col("at") + 1).alias("depth"), "len", "t1", "t2", "chars")
    rest = lookup(turns.where(F.col("at") >= h), convs.where("n > h").select("conv_id", "n", "h", "opened", "len"), ["conv_id"], _total(turns))
    rest = rest.select("conv_id", (F.col("at") + 1 - F.col("h") + F.col("opened")).alias("depth"), "len", "t1", "t2", "chars")
    return first.unionByName(rest), convs.select("conv_id", "len")


def _total(rows: DataFrame) -> int:
    return rows.count()


def _slots(p1: Column, p2: Column, bits: int) -> list[Column]:
    """A prefix's counter in each row, numbered through."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(j), p1, p2), 64 - bits) + F.lit(j << bits) for j in range(ROWS)]


def sketch(prefixes: DataFrame, total: int, most_bits: int = MOST_BITS) -> tuple[bytes, int]:
    """The counters above one as a bitmap, and the bits of a row: four counters a prefix as long as most_bits allow."""
    bits = min(max(10, (4 * total).bit_length()), most_bits)
    counted = prefixes.select(F.explode(F.array(*_slots(F.col("p1"), F.col("p2"), bits))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    place = F.col("slot") + 1
    maps = counted.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    crowded = bytearray(ROWS * max(1 << bits, BITMAP) // 8 + BITMAP // 8)
    for row in maps.toLocalIterator():  # at most ROWS * 2^most_bits bits
        at = (row.b - 1) * BITMAP // 8
        crowded[at : at + len(row.m)] = row.m
    return bytes(crowded), bits


def screened(prefixes: DataFrame, total: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Add ``lone`` (the sketch proves that no other conversation has this prefix) and ``parent_lone``."""
    crowded, bits = sketch(prefixes, total, most_bits)
    held = prefixes.sparkSession.sparkContext.broadcast(crowded)
    own, up = _slots(F.col("p1"), F.col("p2"), bits), _slots(F.col("q1"), F.col("q2"), bits)
    rows = prefixes.select(*prefixes.columns, *(c.alias(f"own_{j}") for j, c in enumerate(own)), *(c.alias(f"up_{j}") for j, c in enumerate(up)))
    names = prefixes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.frombuffer(held.value, np.uint8)

        def lone(b: pa.RecordBatch, kind: str) -> pa.Array:
            shared = np.ones(b.num_rows, bool)
            for j in range(ROWS):
                s = b.column(f"{kind}_{j}").to_numpy()
                shared &= (full[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            return pa.array(~shared)

        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lone(b, "own"), pa.array(lone(b, "up").to_numpy(zero_copy_only=False) & (b.column("depth").to_numpy() > 1))], names=[*names, "lone", "parent_lone"])

    shape = ", ".join(f"{c} {t}" for c, t in prefixes.dtypes)
    return rows.mapInArrow(run, f"{shape}, lone boolean, parent_lone boolean")


def _lists(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256``: SHA-256 of each node's ids, ascending, comma-joined.

    Ids are sorted by ranges of (node, id), so a node may lie in many tasks; each writes pieces of CHUNK
    ids, and the digest runs over the pieces, one at a time. A digest can't be parted further.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        names = [*KEY, "first", "ids"]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, ids[0])), pa.array([",".join(map(str, ids))])], names=names)

        for b in batches:
            for *key, i in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (key != node or len(ids) == CHUNK):
                    yield flush()
                    ids = []
                node = key
                ids.append(i)
        if ids:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, run = None, None
        out = lambda: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([run.hexdigest()])], names=[*KEY, "ends_sha256"])
        for b in batches:
            for *key, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key != node:
                    if node:
                        yield out()
                    node, run = key, hashlib.sha256(text.encode())
                else:
                    run.update(b"," + text.encode())
        if node:
            yield out()

    by = [*KEY, "conv_id"]
    some = ends.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(pieces, "depth long, p1 long, p2 long, first long, ids string")
    return some.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def _parents(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """rows (``q1, q2`` and a depth) with ``parent_conv_id``; nodes hold ``n``, the children they have."""
    found = nodes.where("n > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n")
    return lookup(rows, found, ["depth", "q1", "q2"], total)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``depth, p1, p2, leaves, saved`` summed over each node's subtree, in as many rounds as the depth has bits.

    After round k a node holds the sums of its descendants less than 2^k below it, and ``u1, u2`` is its
    ancestor 2^k above.
    """
    step = 1
    while nodes.where("u1 is not null").head(1):
        up = nodes.where("u1 is not null")
        sums = up.groupBy((F.col("depth") - step).alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        zero = F.lit(0).cast("long")
        added = nodes.join(sums, KEY, "left").select(*KEY, "u1", "u2", (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), "n")
        added = kept(added, "trie-sums")
        higher = added.where("n is not null and u1 is not null").select((F.col("depth") + step).alias("depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"), "n")
        go = added.where("u1 is not null").drop("n")
        on = ["depth", "u1", "u2"]
        jump = lookup(go, higher, on, max(1, go.count())).select(*KEY, F.col("w1").alias("u1"), F.col("w2").alias("u2"))
        nodes = kept(added.select(*KEY, "leaves", "saved").join(jump, KEY, "left"), "trie-jumps")
        step *= 2
    return nodes.select(*KEY, "leaves", "saved")


def trie(turns: DataFrame, convs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Nodes of turns ``conv_id, depth, len, t1, t2, chars`` and conversations ``conv_id, len`` (those without turns, too).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. saved_tokens: over the subtree, members but one times code points of the node's last text.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    salted = turns.select("conv_id", "depth", "len", "chars", F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64(F.lit(7), "depth", "t2", "t1").alias("x2"))
    run = scan(salted, "conv_id", ["depth"], ["x1", "x2"], "trie-prefixes")
    before = lambda k: F.col(f"x{k}_run").bitwiseXOR(F.col(f"x{k}"))
    prefixes = run.select("conv_id", "depth", "len", "chars", F.col("x1_run").alias("p1"), F.col("x2_run").alias("p2"), before(1).alias("q1"), before(2).alias("q2"))
    all_rows = kept(screened(prefixes, _total(prefixes), most_bits), "trie-screened")

    lone, shared = all_rows.where("lone"), all_rows.where("not lone").drop("lone", "parent_lone")
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "len", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"))
    shared = shared.unionByName(roots)
    exact = shared.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("chars").alias("chars"))
    exact = kept(exact, "trie-exact")
    # Children of exact nodes: exact ones, and lone prefixes whose parent may be shared; each of these stands for one leaf.
    kids = exact.where("depth > 0").select("depth", "q1", "q2", zero.alias("leaf")).unionByName(lone.where("not parent_lone").select("depth", "q1", "q2", one.alias("leaf")))
    kids = kids.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n"), F.sum("leaf").alias("lone_leaves"))
    nodes = exact.join(kids, KEY, "left").withColumn("n", F.coalesce("n", zero))
    nodes = kept(nodes.withColumn("leaves", F.when(F.col("n") == 0, one).otherwise(F.col("lone_leaves"))).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("lone_leaves", "chars"), "trie-nodes")

    total = max(1, _total(nodes))
    linked = kept(_parents(nodes.where("depth > 0").select(*KEY, "q1", "q2"), nodes, total).select(*KEY, "q1", "q2", "parent_conv_id"), "trie-links")
    started = nodes.select(*KEY, "leaves", "saved").join(linked.select(*KEY, F.col("q1").alias("u1"), F.col("q2").alias("u2")), KEY, "left")
    sums = _subtrees(kept(started, "trie-start"))
    lists = _lists(shared.where("depth = len"))
    whole = nodes.select(*KEY, "conv_id", "n_convs", "n").join(linked.select(*KEY, "parent_conv_id"), KEY, "left").join(sums, KEY).join(lists, KEY, "left")
    # A parent that isn't exact is lone: the same conversation's.
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    counted = whole.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    here = lone.where("parent_lone").withColumn("parent_conv_id", F.col("conv_id"))
    first = lone.where("not parent_lone")
    first = _parents(first, nodes, max(1, _total(first)))
    last = F.col("depth") == F.col("len")
    alone = here.unionByName(first.select(*here.columns)).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return counted.unionByName(alone)


def shared_trie(conversations: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The trie of the rebuilt conversations, see :func:`share_openings`."""
    turns, convs = share_openings(ordered_turns(conversations))
    return trie(turns, convs, most_bits)
