"""Language identification by word-first backoff.

A model keeps, for each language, the log frequency of its commonest words and
of the character n-grams of its words. A known word scores by its own
frequencies; an unseen one falls back to the longest n-gram length at which any
of its n-grams is known, down to single characters, and scores by their mean.
A text's language has the highest sum with the log share of the language added.

The fit reads at most ``fit_docs`` labelled documents, those whose ids have the
smallest hashes; every document is scored on its whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the first language in sorted order; an empty training set makes
every text ``und``; a document with null id or null lang is never learned from;
repeated rows each get a result, and an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import map_arrow, narrow, record, slices
from fieldloom.runtime import materialise

#: Bounds of the model: documents it is fitted on, words and n-grams it keeps.
FIT_DOCS, WORDS, GRAMS, LONGEST = 10_000, 30_000, 20_000, 4
#: Unseen words whose backoff a worker remembers beyond the texts at hand.
MEMO = 100_000
SCHEMA = "doc_id long, lang_pred string, score double"
#: Runs of letters and marks are words, in the fit as in a prediction; everything else separates them.
NOT_LETTERS = r"[^\p{L}\p{M}]+"


class Numbers(dict):
    """The number of each word; one that has none takes the next."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


@dataclass
class Model:
    """Row i of ``word_logs`` holds the logs of words[i] for each language, likewise for n-grams."""

    langs: list[str]
    prior: np.ndarray
    words: list[str] = field(default_factory=list)
    word_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: list[str] = field(default_factory=list)
    gram_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __post_init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        row_of, number = {g: i for i, g in enumerate(self.grams)}, {"": 0}
        for n in range(1, max(map(len, self.grams), default=0) + 1):
            key_of = {p: number[p[:-1]] << 32 | ord(p[-1]) for p in {g[:n] for g in self.grams if len(g) >= n}}
            ordered = sorted(key_of, key=key_of.__getitem__)
            number = {p: i for i, p in enumerate(ordered, 1)}
            self.levels.append((np.array([key_of[p] for p in ordered]), np.array([row_of.get(p, -1) for p in ordered])))
        self.forget()

    def forget(self) -> None:
        """Only the model's own words are numbered, and ``logs`` has their rows."""
        self.numbers = Numbers(zip(self.words, range(len(self.words)), strict=True))
        self.logs = self.word_logs.reshape(len(self.words), len(self.langs))

    def backoff(self, words: list[str]) -> np.ndarray:
        """Each unseen word's row: the mean over its known n-grams of the greatest length that has any; 0 if none has.

        ``levels`` is a trie of the n-grams. All places of all words go down it together, one length at a time.
        """
        out = np.zeros((len(words), len(self.langs)))
        codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        owner = np.repeat(np.arange(len(words)), size)
        at, end = np.arange(len(codes)), np.repeat(np.cumsum(size), size)
        state, found = np.zeros(len(codes), dtype=np.int64), []
        for n, (keys, rows) in enumerate(self.levels, 1):
            inside = at + n <= end[at]
            at, key = at[inside], state[inside] << 32 | codes[at[inside] + n - 1]
            to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[to] == key
            at, to = at[ok], to[ok]
            state, row = to + 1, rows[to]
            found.append((owner[at[row >= 0]], row[row >= 0]))
        waiting = np.ones(len(words), dtype=bool)
        for who, row in reversed(found):
            times = np.bincount(who, minlength=len(words))
            now = waiting & (times > 0)
            for j in range(len(self.langs)):
                out[now, j] = np.bincount(who, weights=self.gram_logs[row, j], minlength=len(words))[now] / times[now]
            waiting &= ~now
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its score."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.numbers) > len(self.words) + MEMO:
            self.forget()
        words = [words_of(t or "") for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sizes.sum())
        if len(self.numbers) > len(self.logs):
            self.logs = np.concatenate([self.logs, self.backoff(list(islice(self.numbers, len(self.logs), None)))])
        doc = np.repeat(np.arange(len(texts)), sizes)
        total = np.stack([p + np.bincount(doc, weights=self.logs[numbers, j], minlength=len(texts)) for j, p in enumerate(self.prior)], axis=1)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0).tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@cache
def letters() -> np.ndarray:
    """For each code point, whether its category is a letter or a mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def words_of(text: str) -> list[str]:
    """Runs of letters and marks, in lower case; none if no letter is among them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    found = np.where(letters()[codes], codes, 32).astype(np.uint32).tobytes().decode("utf-32-le").split(" ")
    found = list(filter(None, found))
    return found if any(c.isalpha() for w in found for c in w) else []


def log_shares(rows: list, langs: list[str], key: str) -> tuple[list[str], np.ndarray]:
    """The keys, and the log of the add-half share of each in each language."""
    at, table = {x: i for i, x in enumerate(langs)}, {}
    for r in rows:
        for lang, n in r["by"].items():
            table.setdefault(r[key], np.zeros(len(langs)))[at[lang]] += n
    m = np.array(list(table.values())).reshape(-1, len(langs)) + 0.5
    return list(table), np.log(m / m.sum(axis=0))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """The bounded model. What reaches the driver is the model alone: WORDS words and GRAMS n-grams of each length."""
    base = narrow(train, id_col, text_col, lang_col).toDF("id", "text", "lang").where("id is not null and lang is not null and text is not null")
    ids = materialise(base.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(fit_docs), "fit")
    # The sample has a fixed number of ids at most, hence the broadcast; of a repeated id one row counts.
    base = base.join(ids.hint("broadcast"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row"))
    base = materialise(base.select("row.lang", "row.text"), "fit")
    prior = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(prior)
    if not langs:
        return Model([], np.zeros(0))
    word = F.explode(F.split(F.lower("text"), NOT_LETTERS)).alias("word")
    counts = base.select("lang", word).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    top = lambda df, key, k: df.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where("n >= 3").orderBy(F.desc("n"), key).limit(k).collect()
    words = log_shares(top(counts, "word", WORDS), langs, "word")
    grams, gram_logs = [], []
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def cut(n: int) -> Column:
        # The function for ``transform`` takes one argument: a second one, even with a default, would be the index.
        every = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, every).otherwise(F.array().cast("array<string>"))

    per = counts.select("lang", "n", F.explode(F.concat(*[cut(n) for n in range(1, LONGEST + 1)])).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    for n in range(1, LONGEST + 1):
        keys, logs = log_shares(top(per.where(F.length("gram") == n), "gram", GRAMS), langs, "gram")
        grams += keys
        gram_logs.append(logs)
    per.unpersist()
    counts.unpersist()
    n = np.array([prior[x] for x in langs], dtype=float)
    return Model(langs, np.log(n / n.sum()), *words, grams, np.concatenate(gram_logs))


#: The model that a worker holds, by the id of its broadcast.
_HELD: dict[str, Model] = {}


def held(key: str, sent: Broadcast) -> Model:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Model(*sent.value)
    return _HELD[key]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the text alone decides."""
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.words, model.word_logs, model.grams, model.gram_logs))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, sent)
        for part in slices(batches):
            yield record(schema, part.column(0), *model.predict(part.column(1).to_pylist()))

    return map_arrow(narrow(docs, id_col, text_col).toDF("doc_id", "text"), kernel, SCHEMA)
