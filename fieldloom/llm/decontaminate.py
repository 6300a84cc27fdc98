"""Benchmark decontamination with hashed windows of normalised words.

A window is ten consecutive words of a benchmark item (all of them, where it has
fewer). The windows' hashes are the hash set. Every document's words are hashed
once, windows of hashed words are formed at each place in the row, and a bitmap
of the hash set keeps nearly all places from becoming rows. What the bitmap lets
through is joined with the hash set and verified word by word. Everything is
DataFrame functions, without a Python worker.

Texts meet the hash set by their digest, so copies of a text are judged alike.
The hash set is broadcast where a count shows at most ``cells`` values; else it
is joined by hash of the window, frequent windows by broadcast (``look_up``).

Defined results: a null or blank text has no words and no hit; a null or blank
item has no window; items or documents that repeat (an id, a text, a row) are
each counted, an item id once; a null item id takes no part; an empty table of
either kind gives no hits; texts of any length are read whole, as one row; extra
columns are ignored or, where documents are returned, kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import look_up, lower_ascii, narrow
from fieldloom.runtime import BROADCAST_CELLS, discard, materialise

WINDOW = 10
#: A word is a run of these (ASCII letters and digits, and all beyond ASCII); A-Z are lowered first.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of the bitmap for each window, and bits at most (2 MB).
BITS_EACH, MOST_BITS = 512, 1 << 24


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def hashed_at(hashes: Column, i: Column, m: int) -> Column:
    """The hash of the m hashed words from place i (from 0)."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(m)])


def windows(bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """item, m (words in the window), h (its hash), words: every window of every item, each once."""
    rows = narrow(bench, "item_id", "text").toDF("item", "text").where("item is not null")
    rows = rows.select("item", words_of(F.col("text")).alias("ws")).where(F.size("ws") > 0).withColumn("m", F.least(F.size("ws"), F.lit(n)))
    each = rows.select("item", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1), lambda i: F.slice("ws", i, F.col("m")))).alias("words")).distinct()
    hashes = each.withColumn("hs", F.transform("words", lambda w: F.xxhash64(w)))
    h = F.coalesce(*[F.when(F.col("m") == m, hashed_at(F.col("hs"), F.lit(0), m)) for m in range(1, n + 1)])
    return materialise(hashes.select("item", "m", h.alias("h"), "words"), "windows")


def bitmap(known: DataFrame, bits: int) -> Column:
    """A constant array of longs with the bit of every window's hash set; at most MOST_BITS bits, whatever ``known`` holds."""
    rows = known.select(F.pmod("h", F.lit(bits)).alias("b")).distinct().groupBy(F.floor(F.col("b") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("v"))
    cells = [0] * (bits // 64)
    for r in rows.collect():
        cells[r["at"]] = r["v"]
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<long>")


def places(docs: DataFrame, known: DataFrame, n: int = WINDOW) -> DataFrame:
    """id, digest, n_words and found (at, m, h, words: the places whose window the bitmap lets through) of every document; written."""
    rows = docs.select("id", digest_of(F.col("text")).alias("digest"), words_of(F.col("text")).alias("ws"))
    lengths = [r["m"] for r in known.select("m").distinct().orderBy("m").collect()]  # n values at most
    count = F.size("ws").cast("long").alias("n_words")
    if not lengths:
        return materialise(rows.select("id", "digest", count, F.expr("cast(array() as array<struct<at:int,m:int,h:long,words:array<string>>>)").alias("found")), "places")
    size = 1 << 12
    while size < BITS_EACH * known.count() and size < MOST_BITS:
        size *= 2
    held = bitmap(known, size)
    rows = rows.select("id", "digest", "ws", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))

    def seen(m: int) -> Column:
        at = F.when(F.size("hs") >= m, F.sequence(F.lit(0), F.size("hs") - m)).otherwise(F.expr("cast(array() as array<int>)"))
        every = F.transform(at, lambda i: F.struct(i.alias("at"), hashed_at(F.col("hs"), i, m).alias("h")))
        bit = lambda p: F.call_function("shiftright", F.get(held, F.floor(F.pmod(p["h"], F.lit(size)) / 64).cast("int")), F.pmod(p["h"], F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return F.transform(F.filter(every, lambda p: bit(p) == 1), lambda p: F.struct(p["at"].alias("at"), F.lit(m).alias("m"), p["h"].alias("h"), F.slice("ws", p["at"] + 1, F.lit(m)).alias("words")))

    found = F.concat(*[seen(m) for m in lengths]) if len(lengths) > 1 else seen(lengths[0])
    return materialise(rows.select("id", "digest", count, found.alias("found")), "places")


def hits(docs: DataFrame, bench: DataFrame, n: int = WINDOW, cells: int = BROADCAST_CELLS) -> tuple[DataFrame, DataFrame]:
    """``places`` of docs (id, text), and for every digest with a hit: spans (array of at, stop) and items (array, as strings, sorted)."""
    known = windows(bench, n)
    base = places(docs, known, n)
    asked = materialise(base.where(F.size("found") > 0).dropDuplicates(["digest"]).select("digest", F.inline("found")).withColumnRenamed("words", "said"), "asked")
    # One row for each window, with the items that hold it: their number is bounded by the benchmark's.
    sets = materialise(known.groupBy("m", "h", "words").agg(F.collect_set(F.col("item").cast("string")).alias("items")).groupBy("m", "h").agg(F.collect_list(F.struct("words", "items")).alias("same")), "sets")
    met = look_up(asked, sets, ["m", "h"], cells).where("same is not null")
    true = met.select("digest", "at", "m", F.filter("same", lambda s: s["words"] == F.col("said")).alias("same")).where(F.size("same") > 0)
    true = materialise(true.select("digest", "at", "m", F.col("same")[0]["items"].alias("items")), "hits")
    spans = true.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("m")).alias("stop")))).alias("spans"))
    items = true.select("digest", F.explode("items").alias("item")).distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = materialise(spans.join(items.hint("merge"), "digest"), "found")
    discard(asked, sets, true, known)
    return base.drop("found"), found


def fitting(found: DataFrame, cells: int) -> int:
    """``cells`` if ``found`` holds so many values at most, those in its lists included; else -1."""
    return cells if (found.agg(F.sum(5 + 2 * F.size("spans") + F.size("items"))).first()[0] or 0) <= cells else -1


def covered(spans: Column) -> Column:
    """Words in the union of the sorted spans."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["at"]))).cast("long").alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def judge(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", cells: int = BROADCAST_CELLS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    base, found = hits(narrow(docs, id_col, text_col).toDF("id", "text"), bench, n, cells)
    rows = look_up(base, found, ["digest"], fitting(found, cells))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return rows.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, bench: DataFrame, what: str = "documents", n: int = WINDOW, cells: int = BROADCAST_CELLS) -> DataFrame:
    """``docs`` without the contaminated documents, or (``what`` = "spans") without the words that are hit.

    A removed word goes with the separators behind it; n_chars, where there is
    such a column, follows. A null text stays null.
    """
    if what not in ("documents", "spans"):
        raise ValueError("what is removed are documents or spans")
    found = hits(narrow(docs, "doc_id", "text").toDF("id", "text"), bench, n, cells)[1]
    rows = materialise(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest_of(docs["text"]).alias("digest")), "rows")
    both = look_up(rows, found.select("digest", "spans"), ["digest"], fitting(found, cells))
    if what == "documents":
        return both.where("spans is null").select("row.*")
    text = F.col("row.text")
    plain = both.select("row", "spans", F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0)).alias("ws"), F.split(text, ANY_WORD).alias("seps"))
    # Spans, sorted, become one list of the words that stay: those between the end of all spans so far and the next span.
    step = lambda acc, s: F.struct(F.when(s["at"] > acc["end"], F.concat(acc["keep"], F.array(F.struct(acc["end"].alias("a"), s["at"].alias("b"))))).otherwise(acc["keep"]).alias("keep"), F.greatest(acc["end"], s["stop"]).alias("end"))
    start = F.struct(F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("keep"), F.lit(0).alias("end"))
    runs = F.aggregate("spans", start, step, lambda acc: F.concat(acc["keep"], F.array(F.struct(acc["end"].alias("a"), F.size("ws").alias("b")))))
    cut = plain.withColumn("runs", runs)
    pieces = lambda r: F.array_join(F.transform(F.arrays_zip(F.slice("ws", r["a"] + 1, r["b"] - r["a"]).alias("w"), F.slice("seps", r["a"] + 2, r["b"] - r["a"]).alias("s")), lambda z: F.concat(z["w"], z["s"])), "")
    clean = F.concat(F.col("seps")[0], F.array_join(F.transform("runs", pieces), ""))
    done = cut.select("row", "spans", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long")) if "n_chars" in docs.columns else None}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
