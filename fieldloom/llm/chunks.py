"""Repeated passages by content-defined chunking.

A gear rolling hash over the bytes of a text proposes a boundary wherever some
of its bits are zero. Those bits depend on the last WINDOW bytes only, so the
same passage is cut in the same places wherever it stands: insertions elsewhere
move nothing. Of proposals closer than SHORTEST bytes the first counts; in
chunks of over LONG bytes fewer bits must be zero; what is still longer than
LONGEST is cut every LONGEST bytes. So, up to a character, no chunk but a
text's last one is shorter than SHORTEST, and none is longer than LONGEST + SHORTEST.

Chunks are compared by a 128-bit digest. Consecutive chunks that also stand
elsewhere form a run; runs of at least ``least`` bytes are repeated passages.
The first place of every chunk (smallest id, then offset) is the one that stays.

Defined results: null and empty texts have no chunks; documents with null id
take no part; rows that repeat an id and a text are copies of each other, of
which one place stays; rows that repeat an id with another text are documents
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import HOT_SHARE, map_arrow, narrow, slices
from fieldloom.runtime import materialise

#: Bytes that a boundary depends on, bits that must be zero, bits in long chunks, and the lengths named above.
WINDOW, BITS, FEW_BITS, SEED = 16, 4, 2, 9
SHORTEST, LONG, LONGEST = 8, 64, 256
#: Bytes of a run of repeated chunks that make a passage; a passage of 50 words
#: has some 300, of which the chunks at its ends may be lost; chunks are fine
#: enough that two long ones seldom leave less than this.
LEAST = 128
#: Places that make a digest hot at least.
LEAST_HOT = 512
#: The gear table: a random number for each byte.
GEAR = np.random.default_rng(SEED).integers(0, 1 << WINDOW, 256, dtype=np.uint32)


def boundaries(data: bytes) -> np.ndarray:
    """Offsets at which chunks end, the end of the data included; never inside a character."""
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    if not n:
        return np.zeros(0, dtype=np.int64)
    gear, h = GEAR[b], np.zeros(n, dtype=np.uint32)
    for back in range(min(WINDOW, n)):  # h = (h << 1) + gear, all positions at once
        h[back:] += gear[: n - back] << np.uint32(back)
    zero = lambda bits: np.flatnonzero((h & np.uint32(((1 << bits) - 1) << (WINDOW - bits))) == 0) + 1
    cut = np.append(apart(zero(BITS)), n)
    wide = np.flatnonzero(np.diff(cut, prepend=0) > LONG)
    if len(wide):
        more = apart(zero(FEW_BITS))
        last = np.concatenate([[0], cut])[wide]
        for start, end in zip(last.tolist(), cut[wide].tolist(), strict=True):
            x = more[np.searchsorted(more, start + SHORTEST) : np.searchsorted(more, end - SHORTEST, "right")]
            ends = np.concatenate([[start], x, [end]])
            forced = [np.arange(p + LONGEST, q - SHORTEST + 1, LONGEST) for p, q in zip(ends, ends[1:], strict=False) if q - p > LONGEST]
            cut = np.concatenate([cut, x, *forced])
    if data.isascii():
        return np.unique(cut)
    begins = np.flatnonzero(np.append((b & 0xC0) != 0x80, True))  # to the next place where a character begins
    return np.unique(begins[np.searchsorted(begins, cut)])


def apart(cut: np.ndarray) -> np.ndarray:
    """The proposals without another one in the SHORTEST bytes before them; this too depends on nearby bytes only."""
    return cut[np.diff(cut, prepend=-SHORTEST) >= SHORTEST]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, start and end (bytes), d1 and d2 (digest) of every chunk."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            digests: list[bytes] = []
            for i, text_hash, text in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                data = text.encode()
                end = boundaries(data)
                start = np.concatenate([[0], end[:-1]])
                for c, v in zip(columns, (np.full(len(end), i), np.full(len(end), text_hash), start, end), strict=True):
                    c.append(v)
                digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            whole = [np.concatenate(c) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip(whole, (np.int64, np.int64, np.int32, np.int32), strict=True)] + [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], schema=schema)

    base = narrow(docs, id_col, text_col).toDF("id", "text").where("id is not null and text != ''").select("id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(base, kernel, "id long, text_hash long, start int, end int, d1 long, d2 long")


def repeated(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: doc_id, start and end (bytes of the UTF-8 text), n_chunks,
    n_first (its chunks that stand here first), first_doc (smallest document that has one of them)
    and cut (start and end of its chunks that stand elsewhere before)."""
    return passages(docs, least, id_col, text_col).drop("text_hash")


def passages(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``repeated``, with the hash of the text beside its id.

    Digests are counted before places move, as sums of each task's counts. A
    digest with more than a fixed share of the places is hot; there are fewer
    than HOT_SHARE of them by definition. Its places are dealt over as many
    salts as it needs, so no digest fills a task.
    """
    every = chunks(docs, id_col, text_col)
    counted = materialise(every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("id").alias("first_doc")).where("n > 1"), "counted")
    per = max(LEAST_HOT, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    salts = F.ceil(F.col("n") / per).cast("int")
    hot = materialise(counted.where(F.col("n") > per).select("d1", "d2", salts.alias("salts")), "hot")
    salted = every.join(hot.hint("broadcast"), ["d1", "d2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "text_hash"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    known = counted.select("d1", "d2", "first_doc", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    again = salted.join(known.hint("merge"), ["d1", "d2", "salt"]).select("id", "text_hash", "start", "end", "d1", "first_doc")
    again = again.repartition("id", "text_hash").dropDuplicates(["id", "text_hash", "start"])
    # A chunk stays where it stands first in the first document that has it; half of its digest tells it from the others of one text.
    nth = F.row_number().over(Window.partitionBy("id", "text_hash", "d1").orderBy("start"))
    again = again.withColumn("here", (F.col("id") == F.col("first_doc")) & (nth == 1))
    order = Window.partitionBy("id", "text_hash").orderBy("start")
    gap = F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("start")
    marked = again.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(order))
    cut = F.sort_array(F.collect_list(F.when(~F.col("here"), F.struct("start", "end")))).alias("cut")
    runs = marked.groupBy("id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.count_if("here").alias("n_first"), F.min("first_doc").alias("first_doc"), cut)
    return runs.where(F.col("end") - F.col("start") >= least).select(F.col("id").alias(id_col), "text_hash", "start", "end", "n_chunks", "n_first", "first_doc", "cut")


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the chunks of repeated passages that stand elsewhere before.

    Columns of any other name stay as they are, and so do null and empty texts
    and rows with a null id; repeated rows are each cut; an empty table stays empty.
    """
    spans = passages(docs, least, id_col, text_col).where(F.size("cut") > 0).groupBy(F.col(id_col).alias("id"), "text_hash").agg(F.sort_array(F.flatten(F.collect_list("cut"))).alias("spans"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"))
    data = F.col("row").getField(text_col).cast("binary")
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(data, acc["at"] + 1, s["start"] - acc["at"])).alias("out"), s["end"].alias("at"))
    state = F.aggregate("spans", F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(data, acc["at"] + 1, F.octet_length(data))).cast("string"))
    both = rows.join(spans.hint("merge"), ["id", "text_hash"], "left").select("row", "spans", F.when(F.col("spans").isNotNull(), state).otherwise(F.col("row").getField(text_col)).alias("left"))
    return both.select(*[(F.col("left") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
