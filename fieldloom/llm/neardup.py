"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A text's set holds the hashes of its shingles (k words, A-Z lowered). One
permutation sends each shingle to a place on a ring of 2**20; coordinate j of
the signature is the least value that a second permutation has at the places
shifted by j. With the second permutation laid out twice, a shingle's values
for all coordinates are one contiguous window. Equal sets collapse into a class
first; signatures of classes are cut into bands of rows, classes that agree on
a band meet in a bucket, and links are confirmed on the full sets.

No bucket is expanded into all pairs. Its members are compared with a pivot,
and components are computed; in large buckets that still hold several
components, two further pivots are tried. Members that are not in the main
component of their bucket are then compared, in blocks, with all members of
other components there, so no link between classes of a bucket is left out.
Two classes of similarity 0.8 share no bucket with probability 3e-6.

Defined results: a null or blank text has an empty set and is linked with
nothing; a document with null id is linked with nothing and kept; rows that
repeat an id are compared by their own texts each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import look_up, map_arrow, narrow, record, slices
from fieldloom.operators.graph import merged
from fieldloom.runtime import BROADCAST_CELLS, discard, materialise, sized

RING_BITS, BANDS, ROWS, SEED = 20, 32, 5, 20_220_101
SHINGLE, SIMILARITY = 5, 80
#: Members of a bucket that are worth another pivot; members in a block.
LARGE, BLOCK, PIVOTS = 64, 64, 3
#: Blocks in a group. One class in so many is looked at to find frequent keys; members that make a key frequent; such keys at most; tasks that each is dealt over.
GROUP, SAMPLED, HOT_MEMBERS, HOT_KEYS, SALTS = 16, 64, 512, 1024, 32

_WINDOWS: dict[int, np.ndarray] = {}


def windows() -> np.ndarray:
    """Row p: the second permutation's values at p, p + 1, ... for all coordinates (a view)."""
    k = BANDS * ROWS
    if k not in _WINDOWS:
        ring = np.random.default_rng(SEED).permutation(1 << RING_BITS).astype(np.int32)
        _WINDOWS[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:k]]), k)
    return _WINDOWS[k]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence, if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    places = (scramble(s ^ np.uint64(SEED)) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    ring, least = windows(), None
    for a in range(0, len(places), 2048):
        part = ring[places[a : a + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of the signature; the band's number is part of it."""
    out = np.arange(BANDS, dtype=np.uint64)
    for row in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def digest(items: bytes) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(items), dtype=np.int64)
    return int(d[0]), int(d[1])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, n (set size), d1 and d2 (digest of the set) and bands of every document."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, digests, found = [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                digests.append(digest(s.tobytes()))
                found.append(bands(signature(s)) if len(s) else None)
            yield record(schema, part.column(0), n, *zip(*digests, strict=True), found)

    return map_arrow(docs, kernel, "id long, n long, d1 long, d2 long, bands array<long>")


def sets(docs: DataFrame, wanted: DataFrame, k: int, cells: int) -> DataFrame:
    """node, items (the sorted set as bytes) of the classes in ``wanted`` (id, d1, d2, node), taken from a row with that id and digest."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            nodes, d1, d2, texts = (part.column(i).to_pylist() for i in range(4))
            data = [shingles(t, k).tobytes() for t in texts]
            ok = [i for i, x in enumerate(data) if digest(x) == (d1[i], d2[i])]
            if ok:
                yield record(schema, [nodes[i] for i in ok], [data[i] for i in ok])

    found = docs.join(sized(wanted, cells), "id").select("node", "d1", "d2", "text")
    return map_arrow(found, kernel, "node long, items binary").dropDuplicates(["node"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|, of sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, items: DataFrame, percent: int, cells: int) -> DataFrame:
    """Links (a, b) between the components ``ca`` and ``cb`` of the written pairs (a, b, ca, cb) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = [i for i in range(len(a)) if linked(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), percent)]
            yield record(schema, [a[i] for i in ok], [b[i] for i in ok])

    known = sized(pairs, cells)
    left = items.select(F.col("node").alias("a"), F.col("items").alias("x")).join(known, "a")
    right = items.select(F.col("node").alias("b"), F.col("items").alias("y")).join(known.select("b"), "b", "left_semi")
    full = left.join(right.hint("merge"), "b").select("ca", "cb", "x", "y")
    return map_arrow(full, kernel, "a long, b long").distinct()


def similar(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """``linked`` of x with each of the other sets, none of them empty, at once."""
    n = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    y = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
    return 100 * both >= percent * (len(x) + n - both)


def verify_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from the members (comp, items) of each row's two sides."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    load = lambda side: [(m["comp"], np.frombuffer(m["items"], np.uint64)) for m in side.as_py()]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                right, found = load(batch.column(1)[i]), set()
                comps = np.array([c for c, _ in right], dtype=np.int64)
                n = np.array([len(y) for _, y in right], dtype=np.int64)
                for c, x in load(batch.column(0)[i]):
                    near = np.flatnonzero((comps != c) & (100 * np.minimum(n, len(x)) >= percent * np.maximum(n, len(x))))
                    if len(near):
                        ok = near[similar(x, [right[j][1] for j in near], percent)]
                        found.update((c, int(d)) for d in comps[ok])
                if found:
                    yield record(schema, *zip(*sorted(found), strict=True))

    return map_arrow(blocks, kernel, "a long, b long")


def classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and one row (rep, node, n, d1, d2, bands) for each set that several or one row has.

    A class's node is its smallest id, or a hash of its digest where several classes have that id.
    """
    base = materialise(signatures(docs, k), "signatures")
    reps = base.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialise(reps, "classes")
    shared = materialise(reps.groupBy("rep").agg(F.count("*").alias("m")).where("m > 1").select("rep"), "shared")
    if shared.isEmpty():
        return base, reps.withColumn("node", F.col("rep"))
    flagged = reps.join(sized(shared.withColumn("again", F.lit(True))), "rep", "left")
    return base, materialise(flagged.withColumn("node", F.when(F.col("again"), F.xxhash64("rep", "d1", "d2")).otherwise(F.col("rep"))).drop("again"), "classes")


def labels_of(members: DataFrame, comp: DataFrame, cells: int) -> DataFrame:
    """``members`` with the component of each node; one without links is its own."""
    return members.join(sized(comp, cells), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def bucketed(reps: DataFrame) -> DataFrame:
    """node, n, key, pivot (smallest node), pn and size: the members of every bucket of two classes or more; written.

    Keys that look frequent in a sample, HOT_KEYS of them at most, are dealt over
    SALTS tasks each; all others are dealt by key. One shuffle serves the count
    and the join, as long as no condition on the salt reaches below it: so the salt
    is never null, and the conditions are on its maximum. The sample decides about the way only: every bucket
    is complete.
    """
    keyed = reps.select("node", "n", F.explode("bands").alias("key"))
    seen = keyed.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") * SAMPLED > HOT_MEMBERS)
    hot = materialise(seen.orderBy(F.desc("m"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot")), "hot")
    salt = F.coalesce(F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), F.lit(-1)).alias("salt")
    dealt = keyed.join(hot.hint("broadcast"), "key", "left").select("node", "n", "key", salt).repartition("key", "salt")
    part = dealt.groupBy("key", "salt").agg(F.min("node").alias("pivot"), F.min_by("n", "node").alias("pn"), F.count("*").alias("size"), F.max("salt").alias("of"))
    whole = part.where("of >= 0").groupBy("key").agg(F.min("pivot").alias("pivot"), F.min_by("pn", "pivot").alias("pn"), F.sum("size").alias("size"))
    whole = whole.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "pivot", "pn", "size")
    known = part.where("of < 0").drop("of").unionByName(whole).where("size > 1")
    return materialise(dealt.join(known.hint("merge"), ["key", "salt"]).drop("salt"), "members")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, cells: int = BROADCAST_CELLS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of every document."""
    docs = narrow(docs, id_col, text_col).toDF("id", "text")
    base, reps = classes(docs, shingle)
    members = bucketed(reps)
    wanted = reps.join(sized(members.select("node").distinct(), cells), "node", "left_semi").select(F.col("rep").alias("id"), "d1", "d2", "node")
    items = materialise(sets(docs, materialise(wanted, "candidates"), shingle, cells), "sets")
    near = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")

    pairs = members.where((F.col("node") != F.col("pivot")) & near).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = materialise(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "pairs")
    comp = merged(None, materialise(verify(pairs, items, percent, cells), "links"), cells)
    crowds = not members.where(F.col("size") > large).isEmpty()
    for turn in range(1, PIVOTS if crowds else 1):
        now = materialise(labels_of(members.where(F.col("size") > large).drop("pivot", "pn"), comp, cells), "labelled")
        # A bucket's next pivot is one of its main component: first by a hash that changes from turn to turn.
        count = now.groupBy("key", "comp").agg(F.count("*").alias("m"), F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("p"))
        mixed = count.groupBy("key").agg(F.count("*").alias("comps"), F.max_by(F.struct("comp", "p"), F.struct("m", "comp")).alias("main")).where("comps > 1").select("key", F.col("main.comp").alias("main"), F.col("main.p.node").alias("b"), F.col("main.p.n").alias("pn"))
        pairs = look_up(now, materialise(mixed, "mixed"), ["key"], cells).where((F.col("comp") != F.col("main")) & near).select(F.col("node").alias("a"), "b", F.col("comp").alias("ca"), F.col("main").alias("cb")).distinct()
        pairs = materialise(pairs, "pairs")
        discard(now)
        if pairs.isEmpty():
            break
        comp = merged(comp, materialise(verify(pairs, items, percent, cells), "links"), cells)

    now = materialise(labels_of(members.where("size > 2"), comp, cells), "labelled")
    comp = merged(comp, materialise(rest(now, items, percent, cells), "links"), cells)
    discard(now, members, items)
    return result(base, reps, comp, id_col, cells)


def rest(now: DataFrame, items: DataFrame, percent: int, cells: int) -> DataFrame:
    """Links that a pivot has not shown: members outside the main component of their bucket against all others there.

    Members stand in blocks of about BLOCK, blocks of the right side in groups
    of GROUP. A task's unit is one left block against one group, so neither
    work nor memory of a unit grows with the bucket.
    """
    count = now.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = count.groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("all"), F.max_by(F.struct("comp", "m"), F.struct("m", "comp")).alias("main")).where("comps > 1")
    mixed = materialise(mixed.select("key", F.col("main.comp").alias("main"), "all", (F.col("all") - F.col("main.m")).alias("out")), "mixed")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(n)).cast("int")
    rows = look_up(now, mixed, ["key"], cells).where("main is not null").join(items.hint("merge"), "node")
    rows = materialise(rows.select("key", "comp", "main", "all", "out", block(1, "all").alias("right"), block(2, "out").alias("left"), F.struct("comp", "items").alias("member")), "rest")
    right = rows.groupBy("key", "right").agg(F.collect_list("member").alias("theirs"), F.first("out").alias("out"))
    right = right.select("key", (F.col("right") / GROUP).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), blocks("out") - 1)).alias("left"), "theirs")
    left = rows.where("comp != main").groupBy("key", "left").agg(F.collect_list("member").alias("mine"), F.first("all").alias("all"))
    left = left.select("key", "left", F.explode(F.sequence(F.lit(0), ((blocks("all") - 1) / GROUP).cast("int"))).alias("group"), "mine")
    return verify_blocks(left.join(right.hint("merge"), ["key", "left", "group"]).select("mine", "theirs"), percent).distinct()


def result(base: DataFrame, reps: DataFrame, comp: DataFrame, id_col: str, cells: int) -> DataFrame:
    """Every row of ``base`` with the component of its class."""
    named = materialise(labels_of(reps.select("d1", "d2", "rep", "node"), comp, cells), "named")
    if not named.where("node != rep").isEmpty():  # a component's name is an id, not a hash
        named = materialise(look_up(named, materialise(named.groupBy("comp").agg(F.min("rep").alias("least")), "names"), ["comp"], cells).withColumn("comp", F.col("least")), "named")
    found = look_up(base.select("id", "n", "d1", "d2"), named.select("d1", "d2", F.col("comp").alias("component")), ["d1", "d2"], cells)
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, cells: int = BROADCAST_CELLS, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component, with its own columns; an id stays if one of its rows is kept.

    Rows with a null id or a null or blank text stay; repeated rows of a kept id
    all stay; columns of any name stay as they are; an empty table stays empty.
    """
    ids = near_duplicates(docs, cells=cells, id_col=id_col, **options).groupBy(F.col(id_col).alias("_id")).agg(F.max("kept").alias("kept"))
    gone = materialise(ids.where("not kept").select("_id"), "gone")
    return docs.join(sized(gone, cells), docs[id_col] == gone["_id"], "left_anti")
