"""The prefix trie of conversations, from sorted turn sequences and their common prefixes.

A turn is a digest of its role and text. Conversations are sorted by their
sequences of digests, so that the members of a trie node stand together; the
length of the prefix that each shares with the one before it (LCP) tells where
nodes begin. The sorted rows are read in blocks. In a block a sparse table holds
the least LCP of every run of 2**k rows, and each prefix finds the left and the
right end of its members by binary search in it, one independent of the other
and without a stack. Counts are differences of running sums over the interval,
the smallest member is another sparse table's minimum. Nodes that reach over the
edges of blocks are added up by their key; they are prefixes of the rows at the
edges, so few.

Nothing depends on a conversation or a node being small: turns are numbered by
sorted ranges, a conversation is cut into layers of ``layer`` turns that are
sorted each under the digest of all that goes before, and equal conversations are
dealt by their ids. Only SHA-256 over the ids of equal conversations is
sequential by its nature: blocks join their ids into pieces, and the pieces of a
list are hashed as a stream, with bounded memory.

Defined results: null roles and texts are empty; turns that are equal in ``turn``
are ordered by their digests, repeated rows are turns each; rows with a null
conv_id take no part; a conversation without a turn is a member of the root
alone; an empty table has no node; texts of any length are read whole; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import look_up, map_arrow, narrow, record
from fieldloom.runtime import BROADCAST_CELLS, discard, materialise, sized

#: Conversations share the beginning of the first in their family of so many; that beginning's length is below HEADS.
FAMILY, HEADS = 20, 4
#: Turns of a layer.
LAYER = 64
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = pa.schema([
    ("i1", pa.int64()), ("i2", pa.int64()), ("conv", pa.int64()), ("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("parent", pa.int64()),
    ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("sha", pa.string()), ("first", pa.int64()), ("piece", pa.string()),
])


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, tuple]) -> DataFrame:
    """``rows`` with the sums of what goes before each row in its key, by ``order``: name -> (F.sum or F.bit_xor, column).

    Rows are written in sorted ranges, each summed by itself. A key that reaches
    over ranges is the first or the last of a range, so what is carried from range
    to range is a few rows for each range, however many rows a key holds.
    """
    held = materialise(rows.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = held.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    ends = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias(key), "_part").groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1").select(key)
    parts = held.join(sized(materialise(ends, "ends")), key).groupBy(key, "_part").agg(*[f(c).alias(f"_{k}") for k, (f, c) in sums.items()])
    carried = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.select(key, "_part", *[F.coalesce(f(f"_{k}").over(carried), F.lit(0)).cast("long").alias(f"_{k}") for k, (f, _) in sums.items()]), "carried")
    inner = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = held.select("*", *[F.coalesce(f(c).over(inner), F.lit(0)).cast("long").alias(k) for k, (f, c) in sums.items()]).join(sized(parts), [key, "_part"], "left")
    plus = lambda k, f: F.col(k).bitwiseXOR(F.coalesce(f"_{k}", F.lit(0).cast("long"))) if f is F.bit_xor else F.col(k) + F.coalesce(f"_{k}", F.lit(0))
    return both.select(*rows.columns, *[plus(k, f).cast("long").alias(k) for k, (f, _) in sums.items()])


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""))


def rebuilt(convs: DataFrame) -> DataFrame:
    """conv, pos (from 0; -1 for the conversation itself), t (digest of the turn), w (its words), len (turns in all) of every rebuilt conversation."""
    rows = narrow(convs, "conv_id", "turn", "role", "text").where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = rows.select("conv", "turn", F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("t"), words_in(F.col("text")).alias("w"))
    own = materialise(running(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("t").asc()], {"k": (F.sum, F.lit(1))}).drop("turn"), "turns")
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS))
    sizes = materialise(own.groupBy("conv").agg((F.max("k") + 1).alias("size")).select("conv", "size", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(FAMILY))).alias("base")), "sizes")
    m = F.least("h", F.coalesce("had", F.lit(0).cast("long")))
    known = sizes.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("had")).hint("merge"), "base", "left")
    known = materialise(known.select("conv", "base", "h", m.alias("m"), (m + F.greatest(F.lit(0).cast("long"), F.col("size") - F.col("h"))).alias("len")), "known")
    heads = own.where((F.col("k") < HEADS) & (F.pmod("conv", F.lit(FAMILY)) == 0)).select(F.col("conv").alias("base"), F.col("k").alias("pos"), "t", "w")
    begin = known.join(heads.hint("merge"), "base").where(F.col("pos") < F.col("h")).select("conv", "pos", "t", "w", "len")
    rest = look_up(own, known.select("conv", "h", "m", "len"), ["conv"], BROADCAST_CELLS).where(F.col("k") >= F.col("h")).select("conv", (F.col("m") + F.col("k") - F.col("h")).alias("pos"), "t", "w", "len")
    self = known.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("t"), F.lit(None).cast("int").alias("w"), "len")
    return begin.unionByName(rest).unionByName(self)


def key_of(layer: Column, turns: Column) -> list[Column]:
    """Two numbers of 60 bits from the digest of a layer's turns; ``Keys`` gives the same for prefixes."""
    digest = F.sha2(F.concat(layer.cast("string"), F.lit(":"), F.array_join(F.transform(turns, lambda t: F.hex(t)), "")), 256)
    return [F.conv(F.substring(digest, a, 15), 16, 10).cast("long") for a in (1, 16)]


def sorted_rows(convs: DataFrame, layer: int) -> DataFrame:
    """The layers of all conversations in their order (_part, _at), with lcp and nlcp (shared with the row before and
    behind), and, for each, whether it ends a leaf (leaf) and the words that the row before has as well (dup); written."""
    turns = rebuilt(convs).withColumn("layer", (F.greatest("pos", F.lit(0).cast("long")) / layer).cast("long"))
    rows = turns.groupBy("conv", "layer").agg(F.max("len").alias("len"), F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "t", "w")))).alias("turns"))
    rows = rows.select("conv", "layer", (F.col("len") > (F.col("layer") + 1) * layer).alias("cont"), F.transform("turns", lambda x: x["t"]).alias("ts"), F.transform("turns", lambda x: x["w"]).alias("ws"))
    rows = materialise(rows, "layers")
    long = (F.col("layer") > 0) | F.col("cont")
    e1, e2 = key_of(F.col("layer"), F.col("ts"))
    above = running(rows.where(long).select("conv", "layer", e1.alias("e1"), e2.alias("e2")), "conv", [F.col("layer").asc()], {"x1": (F.bit_xor, F.col("e1")), "x2": (F.bit_xor, F.col("e2"))}).select("conv", "layer", "x1", "x2")
    zero = F.lit(0).cast("long")
    rows = rows.join(sized(materialise(above, "above")), ["conv", "layer"], "left").withColumns({"x1": F.coalesce("x1", zero), "x2": F.coalesce("x2", zero)})
    order = ["layer", "x1", "x2", "ts", "cont", "conv"]
    held = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    # What stands at the edges of each range: one row for each range.
    spot = F.struct("layer", "x1", "x2", "ts")
    edges = held.groupBy("_part").agg(F.min_by(spot, F.struct(*order)).alias("low"), F.max_by(spot, F.struct(*order)).alias("high"))
    ranges = Window.orderBy("_part")
    edges = materialise(edges.select("_part", F.lag("high").over(ranges).alias("before"), F.lead("low").over(ranges).alias("behind")), "edges")
    here = Window.partitionBy("_part").orderBy(*order)
    near = held.select("*", F.row_number().over(here).alias("_at"), F.lag(spot).over(here).alias("prev"), F.lead(spot).over(here).alias("next")).join(sized(edges), "_part")

    def shared(other: Column) -> Column:
        same = (other["layer"] == F.col("layer")) & (other["x1"] == F.col("x1")) & (other["x2"] == F.col("x2"))
        differ = F.array_position(F.zip_with("ts", other["ts"], lambda a, b: ~a.eqNullSafe(b)), F.lit(True))
        return F.coalesce(F.when(same, F.when(differ == 0, F.size("ts")).otherwise(differ - 1)), F.lit(0)).cast("int")

    rows = near.withColumns({"lcp": shared(F.coalesce("prev", "before")), "nlcp": shared(F.coalesce("next", "behind"))}).drop("prev", "next", "before", "behind")
    leaf = (~F.col("cont") & (F.col("nlcp") < F.size("ts"))).cast("long")
    dup = F.aggregate(F.slice("ws", F.lit(1), F.col("lcp")), zero, lambda a, w: a + w)
    return materialise(rows.withColumns({"leaf": leaf, "dup": dup}), "prefixes")


class SparseTable:
    """Least of every run of 2**k values: minima in constant time, and the reach of a bound by binary search."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows, k = [values], 1
        while 2 * k <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minima of [a, b), none of them empty."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=self.rows[0].dtype)
        for j, row in enumerate(self.rows):
            on = k == j
            out[on] = np.minimum(row[a[on]], row[b[on] - (1 << j)])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose value is under the bound, or the end."""
        at = at.copy()
        for j in range(len(self.rows) - 1, -1, -1):
            row = self.rows[j]
            ok = at < len(row)
            ok[ok] = row[at[ok]] >= bound[ok]
            at[ok] += 1 << j
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` whose value is under the bound; the first value is under every bound."""
        at = at.copy()
        for j in range(len(self.rows) - 1, -1, -1):
            start = at - (1 << j) + 1
            ok = start >= 0
            ok[ok] = self.rows[j][start[ok]] >= bound[ok]
            at[ok] -= 1 << j
        return at


def nodes_of(layers: np.ndarray, x: list[np.ndarray], size: np.ndarray, turns: list[bytes], words: np.ndarray, cont: np.ndarray, conv: np.ndarray, lcp: np.ndarray, last: int, leaf: np.ndarray, dup: np.ndarray, tails: np.ndarray, layer: int) -> pa.RecordBatch:
    """The nodes of one block of sorted rows; those that may reach beyond it have a key (i1, i2) and count what is in it.

    ``turns`` and ``words`` are flat over all rows, ``last`` is the prefix that the
    last row shares with the one behind the block, ``tails`` are the words that
    later layers of a row share with others.
    """
    n = len(size)
    start = np.cumsum(size) - size
    before = np.concatenate([[0], np.cumsum(words)])
    upto = lambda i, d: before[start[i] + d] - before[start[i]]
    low = lcp.copy()
    low[0] = 0
    count = size - low  # prefixes that begin at a row
    offset = np.cumsum(count) - count
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - offset[row] + low[row] + 1
    number = lambda i, d: offset[i] + d - low[i] - 1

    table = np.where(np.arange(n) == 0, -1, lcp)
    reach = SparseTable(table)
    end = reach.right(row + 1, depth)
    fresh = depth > lcp[row]
    open_ = ~fresh | ((end == n) & (last >= depth)) | ((depth == layer) & cont[end - 1])
    inner = depth > 1
    left = reach.left(row[inner], depth[inner] - 1)
    above = np.full(len(row), -1)
    above[inner] = number(left, depth[inner] - 1)
    kids = np.bincount(above[inner & fresh], minlength=len(row))
    total = lambda v: np.concatenate([[0], np.cumsum(v)])
    leaves, dups, later = total(leaf), total(dup), total(tails)
    least = SparseTable(conv).least(row, end)
    sums = leaves[end] - leaves[row]
    saved = dups[end] - dups[row] - np.where(fresh, dup[row], 0) - (end - row - fresh) * upto(row, depth - 1) + later[end] - later[row]

    # Rows that end a conversation, by the row where their equals begin in this block.
    begins = np.where((lcp < size) | (np.arange(n) == 0) | (size == 0), np.arange(n), 0)
    group = np.append(True, (np.diff(layers) != 0) | (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0))
    begins[(size == 0) & ~group] = 0
    begins = np.maximum.accumulate(begins)
    ids = {}
    stops = np.flatnonzero(~cont)
    for i in np.unique(begins[stops]):
        mine = stops[np.searchsorted(begins[stops], i) : np.searchsorted(begins[stops], i, side="right")]
        ids[number(i, size[i]) if size[i] else -1 - i] = conv[mine]
    text = lambda c: ",".join(map(str, c.tolist()))

    keys: dict[int, tuple[int, int]] = {}

    def key(c: int) -> tuple[int, int]:
        if c not in keys:
            i, d = row[c], depth[c]
            data = b"".join(turns[start[i] : start[i] + d]).hex().upper()
            digest = hashlib.sha256(f"{layers[i]}:{data}".encode()).hexdigest()
            keys[c] = int(digest[:15], 16) ^ int(x[0][i]), int(digest[15:30], 16) ^ int(x[1][i])
        return keys[c]

    out = []
    for c in range(len(row)):
        i, a = row[c], above[c]
        mine, up = ids.get(c), (None, None, None)
        if a < 0:
            up = (int(x[0][i]), int(x[1][i]), None)
        elif open_[a]:
            up = (*key(a), None)
        else:
            up = (None, None, least[a])
        names = (*key(c), ) if open_[c] else (None, None)
        ends = (None, None if mine is None else mine[0], None if mine is None else text(mine)) if open_[c] else (EMPTY if mine is None else hashlib.sha256(text(mine).encode()).hexdigest(), None, None)
        out.append((*names, least[c], layers[i] * layer + depth[c], *up, end[c] - i, kids[c], sums[c], saved[c], *ends))
    # The node above each group: the root, or the last one of the layer before, which only lacks its children.
    for i, j in zip(np.flatnonzero(group), [*np.flatnonzero(group)[1:], n], strict=True):
        born = int((fresh & (depth == 1) & (row >= i) & (row < j)).sum())
        whole = (conv[i:j].min(), j - i, leaves[j] - leaves[i], dups[j] - dups[i] + later[j] - later[i]) if layers[i] == 0 else (None, 0, 0, 0)
        mine = ids.get(-1 - i)
        out.append((int(x[0][i]), int(x[1][i]), whole[0], layers[i] * layer, None, None, None, whole[1], born, whole[2], whole[3], None, None if mine is None else mine[0], None if mine is None else text(mine)))
    return record(NODE, *zip(*out, strict=True))


def node_kernel(layer: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                block = batch.slice(a, b - a)
                number = lambda name: block.column(block.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                listed = lambda name: block.column(block.schema.get_field_index(name))  # noqa: B023, E731
                size = np.array([len(t) for t in listed("ts")], dtype=np.int64)
                words = listed("ws").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield nodes_of(number("layer"), [number("x1"), number("x2")], size, listed("ts").flatten().to_pylist(), words, number("cont"), number("conv"), number("lcp").astype(np.int64), int(number("nlcp")[-1]), number("leaf"), number("dup"), number("tails"), layer)

    return kernel


def hashed(pieces: DataFrame) -> DataFrame:
    """i1, i2, sha of the pieces of each key, joined by commas in the order of ``first``; streamed."""
    schema = pa.schema([("i1", pa.int64()), ("i2", pa.int64()), ("sha", pa.string())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for a, b, piece in zip(*(batch.column(j).to_pylist() for j in (0, 1, 3)), strict=True):
                if (a, b) == now:
                    state.update(b"," + piece.encode())
                    continue
                if now:
                    yield record(schema, [now[0]], [now[1]], [state.hexdigest()])
                now, state = (a, b), hashlib.sha256(piece.encode())
        if now:
            yield record(schema, [now[0]], [now[1]], [state.hexdigest()])

    rows = pieces.select("i1", "i2", "first", "piece").repartition("i1", "i2").sortWithinPartitions("i1", "i2", "first")
    return map_arrow(rows, kernel, "i1 long, i2 long, sha string")


def trie(convs: DataFrame, layer: int = LAYER, cells: int = BROADCAST_CELLS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    rows = sorted_rows(convs, layer)
    zero = F.lit(0).cast("long")
    down = running(rows.where((F.col("layer") > 0) | F.col("cont")).select("conv", "layer", "leaf", "dup"), "conv", [F.col("layer").desc()], {"more": (F.sum, F.col("leaf")), "tails": (F.sum, F.col("dup"))})
    down = materialise(down.select("conv", "layer", "more", "tails"), "tails")
    rows = rows.join(sized(down), ["conv", "layer"], "left").select("_part", "_at", "layer", "x1", "x2", "ts", "ws", "cont", "conv", "lcp", "nlcp", (F.col("leaf") + F.coalesce("more", zero)).alias("leaf"), "dup", F.coalesce("tails", zero).alias("tails"))
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in NODE)
    parts = materialise(map_arrow(rows.repartition("_part").sortWithinPartitions("_part", "_at"), node_kernel(layer), kinds), "nodes")
    over = parts.where("i1 is not null")
    add = lambda c: F.sum(c).alias(c)
    merged = over.groupBy("i1", "i2").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("parent").alias("parent"), *map(add, ("n", "kids", "leaves", "saved")))
    lists = materialise(hashed(over.where("piece is not null")), "lists")
    merged = materialise(merged.join(lists.hint("merge"), ["i1", "i2"], "left").withColumn("sha", F.coalesce("sha", F.lit(EMPTY))), "merged")
    every = parts.where("i1 is null").select(*merged.columns).unionByName(merged)
    known = materialise(merged.select(F.col("i1").alias("p1"), F.col("i2").alias("p2"), F.col("conv").alias("up")), "parents")
    asked = materialise(every.where("p1 is not null"), "asked")
    done = look_up(asked, known, ["p1", "p2"], cells).withColumn("parent", F.coalesce("parent", "up")).select(*merged.columns)
    every = every.where("p1 is null").unionByName(done)
    # A root without a turn anywhere is a leaf itself.
    leaves = F.when(F.col("depth") == 0, F.greatest("leaves", F.lit(1))).otherwise(F.col("leaves")).cast("long")
    return every.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), leaves.alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
