"""Quality rules: repetition counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: of the trusted target
(labelled documents of good quality that are not toxic) and of the raw corpus
(every document). A document's score is the sum of log(target / raw) over its
n-grams divided by their number. Every document with a score under one fixed
threshold is rejected. The threshold separates the labelled classes best
(largest sum of the shares kept of the good and rejected of the poor; the
middle of the widest gap among ties), so equal inputs give equal verdicts.

Every labelled document counts for the target and the threshold, unless the
caller sets a bound ``fit_docs`` (then those first by a hash of their id); the raw
counts and the verdicts cover all documents.

Defined results: a null text has no words; documents with fewer than 10 words
fail; labels that are null or repeated count by their worst; without labelled
documents of both classes only the base rule rejects; an empty table gives an
empty result; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hot_keys, map_arrow, narrow, record, slices
from fieldloom.runtime import BROADCAST_CELLS, materialise

#: Bytes in an n-gram, buckets it is hashed to, labelled documents that are read (None: all).
N, BUCKETS, FIT_DOCS = 3, 1 << 14, None
#: What keeping a good document counts against rejecting a poor one.
CARE = 10
WINDOW = 5
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, grade int"


def buckets_of(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < N:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(len(b) - N + 1, dtype=np.uint32)
    for i in range(N):
        h = h * np.uint32(257) + b[i : len(b) - N + 1 + i]
    return ((h * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more in the list, the first included.

    Words become integers and windows pairs of integers, compressed step by
    step so that equal numbers mean equal windows exactly.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    at: dict[bytes, int] = {}
    ids = np.array([at.setdefault(w, len(at)) for w in words], dtype=np.int64)
    if len(at) == n:
        return 0
    k = len(at)
    key, span = ids[: n - WINDOW + 1], k
    for i in range(1, WINDOW):
        if span > (1 << 62) // k:
            u, key = np.unique(key, return_inverse=True)
            span = len(u)
        key, span = key * k + ids[i : n - WINDOW + 1 + i], span * k
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    hit = np.zeros(len(key), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - (len(data) - sum(map(len, words))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def graded(labels: DataFrame, fit_docs: int | None = FIT_DOCS) -> DataFrame:
    """doc_id, grade: 1 trusted, 0 poor, 2 neither; of all labelled documents, or of ``fit_docs`` at most."""
    worst = narrow(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    grade = F.when(F.col("q") == 0, 0).when(F.col("t") == 0, 1).otherwise(2).alias("grade")
    if fit_docs is not None:
        worst = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    return worst.select("doc_id", grade)


def with_grades(docs: DataFrame, known: DataFrame, cells: int = BROADCAST_CELLS) -> DataFrame:
    """doc_id, text and grade of the rows of ``docs`` whose id the written ``known`` (doc_id, grade) has.

    Many grades are joined by shuffling the rows, except those of ids that so many
    rows share that they would fill a task.
    """
    rows = narrow(docs, "doc_id", "text")
    if known.count() * len(known.columns) <= cells:
        return rows.join(known.hint("broadcast"), "doc_id").select("doc_id", "text", "grade")
    hot = hot_keys(narrow(docs, "doc_id").where("doc_id is not null"), ["doc_id"]).hint("broadcast")
    rare = rows.join(hot, "doc_id", "left_anti").join(known.join(hot, "doc_id", "left_anti").hint("shuffle_hash"), "doc_id")
    return rare.unionByName(rows.join(known.join(hot, "doc_id", "left_semi").hint("broadcast"), "doc_id")).select("doc_id", "text", "grade")


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of ``docs`` (doc_id, text)."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for part in slices(batches):
            for text in part.column(1).to_pylist():
                total += np.bincount(buckets_of((text or "").encode()), minlength=BUCKETS)
        full = np.flatnonzero(total)
        yield record(schema, full, total[full])

    out = np.zeros(BUCKETS)
    for r in map_arrow(docs, kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, from all ``docs`` and the trusted of ``known`` (doc_id, text, grade); zero where the target has nothing to say."""
    target = bucket_counts(known.where("grade = 1").select("doc_id", "text"))
    if not target.any():
        return np.zeros(BUCKETS)
    raw = bucket_counts(narrow(docs, "doc_id", "text"))
    share = lambda n: (n + 0.5) / (n + 0.5).sum()
    return np.log(share(target) / share(raw))


def llr_of(data: bytes, ratio: np.ndarray) -> float:
    h = buckets_of(data)
    return float(ratio[h].sum() / len(h)) if len(h) else 0.0


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The base counts, length-normalised log ratio and grade (null: unlabelled) of every row of ``docs`` (doc_id, text, grade)."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("llr", pa.float64()), ("grade", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            base = [base_counts(t) for t in texts]
            yield record(schema, part.column(0), *zip(*base, strict=True), [llr_of(t.encode(), sent.value) for t in texts], part.column(2))

    return map_arrow(docs, kernel, SCHEMA)


def fitted(docs: DataFrame, labels: DataFrame, fit_docs: int | None) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold, which only labelled documents decide."""
    grades = materialise(graded(labels, fit_docs).where("grade < 2"), "grades")
    known = materialise(with_grades(docs, grades), "known")
    ratio = log_ratio(docs, known)
    return ratio, threshold(scores(known, ratio))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def threshold(scored: DataFrame) -> float:
    """The score that parts good from poor best; minus infinity where a class is missing."""
    bins = scored.where(~base_failed()).groupBy(F.round("llr", 3).alias("x")).agg(F.sum("grade").alias("good"), F.count("*").alias("all")).orderBy("x").collect()
    good, poor = sum(r["good"] for r in bins), sum(r["all"] - r["good"] for r in bins)
    if not good or not poor:
        return float("-inf")
    best, gap, cut, kept, gone = -1.0, 0.0, float("-inf"), good, 0
    for low, high in zip(bins, bins[1:], strict=False):
        kept, gone = kept - low["good"], gone + low["all"] - low["good"]
        value, wide = round(CARE * kept / good + gone / poor, 9), high["x"] - low["x"]
        if (value, wide) > (best, gap):
            best, gap, cut = value, wide, (low["x"] + high["x"]) / 2
    return cut


def judge(docs: DataFrame, labels: DataFrame, fit_docs: int | None = FIT_DOCS) -> DataFrame:
    """One row per document: the counts, llr, base_failed and kept."""
    ratio, cut = fitted(docs, labels, fit_docs)
    scored = scores(narrow(docs, "doc_id", "text").withColumn("grade", F.lit(None).cast("int")), ratio)
    failed = base_failed()
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= cut)).alias("kept"), "llr", F.lit(cut).alias("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_docs: int | None = FIT_DOCS) -> DataFrame:
    """The rows that ``judge`` keeps, with their own columns, whatever these are called.

    Each row is judged by its own text as it passes, so nothing is shuffled; a
    null text is rejected, a null or repeated id doesn't matter, and an empty
    table stays empty.
    """
    ratio, cut = fitted(docs, labels, fit_docs)
    sent, at = docs.sparkSession.sparkContext.broadcast(ratio), docs.columns.index("text")

    def kept(text: str | None) -> bool:
        words, _, _, _, repeats = base_counts(text or "")
        return words >= 10 and 100 * repeats <= 20 * words and llr_of((text or "").encode(), sent.value) >= cut

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            yield part.filter(pa.array([kept(t) for t in part.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, kernel, docs.schema)
