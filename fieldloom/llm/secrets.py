"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text (the blob).
A ledger keeps, for each blob, the rule versions that have scanned it and the
spans they found. A scan reads only blobs with rule versions that the ledger
lacks, and joins the findings back to every path (document) holding the blob.

Defined results: a null text counts as empty; an empty text has no span; a null
id is kept as it is; repeated rows each get the findings; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from fieldloom.llm.common import look_up, map_arrow, narrow, slices
from fieldloom.runtime import BROADCAST_CELLS, materialise, new_path

#: kind -> (pattern, group whose length counts, least length). The first three
#: are fixed by contract; all are free of look-around, so that other engines
#: with linear-time regular expressions read them alike.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "login": (r"[a-z]+://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@", 0, 1),
}
BASE_KINDS = ("assign", "access", "hex")
#: A text without the word of a rule cannot match it; "" stands for no such word.
HINTS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ", "github": "gh", "slack": "xox", "google": "AIza", "login": "://"}

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
LEDGER = f"blob binary, rule_versions array<string>, spans {SPANS}"


def rule_versions(rules: dict[str, tuple[str, int, int]]) -> dict[str, str]:
    """kind -> version; a changed pattern or limit is another version."""
    return {k: f"{k}@{hashlib.sha256(repr(r).encode()).hexdigest()[:12]}" for k, r in rules.items()}


def find_spans(text: str, rules: dict[str, tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each rule, failing ones dropped; by start, then by rule."""
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(rules.items()):
        if HINTS.get(kind, "") not in text:
            continue
        if pattern == r"[0-9a-f]+":  # a run that is too short holds no other match
            pattern = r"[0-9a-f]{%d,}" % least
        for m in re.finditer(pattern, text, re.ASCII):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def scan_kernel(rules: dict[str, tuple[str, int, int]]):
    versions = rule_versions(rules)
    schema = pa.schema([("blob", pa.binary()), ("rule_versions", pa.list_(pa.string())), ("spans", _SPAN_TYPE)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            blobs, texts, pending = (part.column(i).to_pylist() for i in range(3))
            spans = []
            for text, names in zip(texts, pending, strict=True):
                wanted = set(names)
                use = {k: r for k, r in rules.items() if versions[k] in wanted}
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text, use)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(pending, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)], schema=schema)

    return kernel


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(docs: DataFrame, ledger: str | None = None, rules: dict[str, tuple[str, int, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", cells: int = BROADCAST_CELLS) -> DataFrame:
    """One row per document: id, blob and the spans of every rule in its text (NULL for none).

    ``ledger`` is the path of the Parquet ledger, which this call extends; with
    None a new one is begun in the shared folder. Copies of a blob meet before
    the shuffle, so each crosses the network once for each task that reads it
    at most. Findings reach the documents by ``look_up``.
    """
    rules = rules or RULES
    base = narrow(docs, id_col, text_col).toDF("id", "text")
    versions = materialise(base.select("id", blob_of(F.col("text")).alias("blob")), "versions")
    ledger = extend(base, ledger, rules)
    found = materialise(findings(docs.sparkSession.read.schema(LEDGER).parquet(ledger), rules), "findings")
    return look_up(versions, found, ["blob"], cells).select(F.col("id").alias(id_col), "blob", "spans")


def extend(docs: DataFrame, ledger: str | None, rules: dict[str, tuple[str, int, int]]) -> str:
    """Scan every blob of ``docs`` (text) with the rule versions that the ledger lacks for it; the ledger's path."""
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    wanted = F.array(*[F.lit(v) for v in rule_versions(rules).values()])
    rows = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("seen"))
    if _exists(spark, ledger):
        rows = rows.union(spark.read.schema(LEDGER).parquet(ledger).select("blob", F.lit(None).cast("string"), "rule_versions"))
    blobs = rows.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"), F.flatten(F.collect_list("seen")).alias("seen"))
    todo = blobs.select("blob", "text", F.array_except(wanted, "seen").alias("pending")).where(F.col("text").isNotNull() & (F.size("pending") > 0))
    map_arrow(todo, scan_kernel(rules), LEDGER).write.mode("append").option("compression", "zstd").parquet(ledger)
    return ledger


def findings(ledger: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame:
    """blob -> spans of the present rule versions, each pair of blob and version counted once; blobs without any are left out."""
    now = {v: k for k, v in rule_versions(rules).items()}
    rank = F.create_map(*[x for i, k in enumerate(rules) for x in (F.lit(k), F.lit(i))])
    kinds = F.transform(F.filter("rule_versions", lambda v: v.isin(list(now))), lambda v: F.split_part(v, F.lit("@"), F.lit(1)))
    rows = ledger.withColumn("kinds", kinds).select("blob", F.filter("spans", lambda s: F.array_contains(F.col("kinds"), s["kind"])).alias("spans"))
    merged = rows.where(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return merged.select("blob", F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query from the spans of ``scan``."""
    spans = F.coalesce(F.col("spans"), F.array().cast(SPANS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(docs: DataFrame, mask: str = "<secret>", cells: int = BROADCAST_CELLS, **options) -> DataFrame:
    """The documents with every found span replaced by ``mask``; n_chars follows the text.

    Overlapping spans are merged first. Rows without a span stay as they are, a
    null text among them; columns of any other name stay as they are; repeated
    rows are each redacted; an empty table stays empty. Texts are moved only
    where the findings are too many to be broadcast.
    """
    ledger = extend(narrow(docs, "text"), options.pop("ledger", None), rules := options.pop("rules", None) or RULES)
    found = findings(docs.sparkSession.read.schema(LEDGER).parquet(ledger), rules)
    found = materialise(found.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")), "found")
    # A blob is 4 numbers, a span one.
    few = (found.agg(F.sum(F.size("spans") + 4)).first()[0] or 0) <= cells
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), blob_of(docs["text"]).alias("blob"))
    if few:
        both = rows.join(found.hint("broadcast"), "blob", "left").select("row", "spans")
    else:
        both = look_up(rows, found, ["blob"], 0).select("row", "spans")
    columns, schema = docs.columns, docs.schema
    shape = pa.schema([(f"c{i}", f.type) for i, f in enumerate(to_arrow_schema(schema))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, spans = batch.column(0), batch.column(1)
            held = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            values = [row.field(i) for i in range(len(columns))]
            at = columns.index("text")
            texts = {int(i): masked(values[at][int(i)].as_py(), [(s["start"], s["end"]) for s in spans[int(i)].as_py()], mask) for i in held}
            if texts:
                put = {"text": texts, "n_chars": {i: len(t) for i, t in texts.items()}}
                for name, new in put.items():
                    if name in columns:
                        old = values[columns.index(name)]
                        change = np.zeros(len(old), dtype=bool)
                        change[held] = True
                        values[columns.index(name)] = pc.replace_with_mask(old, pa.array(change), pa.array([new[int(i)] for i in held], type=old.type))
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, shape, strict=True)], schema=shape)

    out = map_arrow(both, kernel, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)]))
    return out.toDF(*columns)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with the spans, sorted, replaced; overlapping ones are one. Each character is looked at once."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
