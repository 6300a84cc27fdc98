"""Collocations by level-wise counting of candidate phrases with broadcast double-array tries.

Texts are cut into pieces and words once; words become codes, and a document is
a row of codes in which 0 stands for the end of a piece or a word too rare to be
part of a candidate. Level by level, a place's state is the frequent phrase that
begins there. A candidate of the next level is a state and the word behind it,
where the phrase without its first word is frequent as well (Apriori). The
candidates that occur, and whose occurrences in all tasks can add up to ``least``,
are dealt into tries of at most ``shard`` transitions. A trie is a double array: the ``base`` of a state and of the upper bits of
the word's code, plus the lower bits, is the place of the next state, whose ``check`` names where it comes from.
Tries are broadcast in groups of at most ``group`` transitions. A worker keeps what it
has got in files that it maps into its memory, so that it has all groups at hand and
the codes are read once for all of them. Numpy
advances all places of a row at once, the accepting states are counted as they
gather, and the counts of the tasks are summed trie by trie. Frequent candidates give the
states of the next level.

So memory is bounded by ``shard``, ``group``, ``seen`` and the longest text at any size of
the corpus; what grows is the number of groups, which take local disk (of each worker). Every
level counts all texts, and drops only what cannot reach
``least``. Words are told apart by a 64-bit hash; where two share one, the hash is
seeded anew.

Defined results: a null text is empty; a null lang is ``und``; a text without a
word adds nothing; repeated rows count as often as they stand there; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import look_up, map_arrow, narrow, record, slices
from fieldloom.runtime import BROADCAST_CELLS, discard, materialise, sized
from fieldloom.sources.frames import ranked

LONGEST, LEAST, SHADOW, TOP = 3, 10, 50, 2000
#: Transitions of a trie, transitions of a broadcast; words and candidates that a task gathers before it passes them on; bytes of text that are cut at once.
SHARD, GROUP, WORDS, SEEN, TEXT = 1 << 18, 1 << 20, 1 << 17, 1 << 20, 1 << 20
#: Bits of a word's code that are a trie's symbol (the others go with the state, so that an array of few symbols stays dense); bases tried for a state.
SYMBOL, TRIED = 8, 8
#: Stands between pieces; no byte of UTF-8.
BREAK = b"\xff"
_CLEAN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, and BREAK (no byte of UTF-8) at the ends of pieces."""
    return (text or "").encode().lower().translate(_CLEAN).replace(BREAK, b" \xff ").split()


class Vocabulary(dict):
    """word -> number, given in the order of appearance (BREAK is 0), with the words' hashes and counts."""

    def __init__(self, lang: str, seed: int) -> None:
        super().__init__({BREAK: 0})
        self.salt, self.seed = lang.encode() + BREAK, seed
        self.hashes, self.counts = array("q", [0]), np.zeros(1024, dtype=np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append((xxhash.xxh3_64_intdigest(self.salt + word, self.seed) >> 1) or 1)
        return number

    def numbered(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as places (int32) in the second array, which holds the words' hashes (BREAK's is 0), each text after a BREAK; the words are counted."""
        flat = list(chain.from_iterable(x for t in texts for x in ((BREAK,), t)))
        numbers = np.fromiter(map(self.__getitem__, flat), dtype=np.int64, count=len(flat))
        got = np.bincount(numbers, minlength=len(self))
        if len(self) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(self), dtype=np.int64)])
        self.counts[: len(got)] += got
        here = np.flatnonzero(got)
        place = np.zeros(len(got), dtype=np.int32)
        place[here] = np.arange(len(here))
        return place[numbers], np.frombuffer(self.hashes, dtype=np.int64)[here]


def cut(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of two kinds: lang, seq (words as places in table; int32) and table (their hashes, 0 for the end of a piece; int64), or lang, words, hashes and counts of a part of the corpus."""
    schema = pa.schema([("lang", pa.string()), ("seq", pa.binary()), ("table", pa.binary()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, held in known.items():
                words = [w.decode() for w in islice(held, 1, None)]
                hashes, counts = np.array(held.hashes[1:]), held.counts[1 : len(held)]
                for a in range(0, len(words), 1 << 16):
                    b = a + (1 << 16)
                    yield record(schema, [lang], [None], [None], [words[a:b]], [hashes[a:b]], [counts[a:b]])
            known.clear()

        for part in slices(batches, 1, TEXT):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                if lang not in known:
                    known[lang] = Vocabulary(lang, seed)
                mine = [tokens(t) for k, t in zip(langs, texts, strict=True) if k == lang]
                seq, held = known[lang].numbered(mine)
                yield record(schema, [lang], [seq.tobytes()], [held.tobytes()], [None], [None], [None])
            if sum(map(len, known.values())) > WORDS:
                yield from counted()
        yield from counted()

    return map_arrow(docs, kernel, "lang string, seq binary, table binary, words array<string>, hashes array<long>, counts array<long>")


def chunks_of(table: DataFrame, order: str, size: int) -> Iterator[pa.Table]:
    """The rows of a written table with a column ``order`` (0, 1, ...), ``size`` of them at a time."""
    top = table.agg(F.max(order)).first()[0]
    for a in range(0, 0 if top is None else top + 1, size):
        yield table.where(F.col(order).between(a, a + size - 1)).toArrow()


class Mapped(list):
    """(low, first, arrays by name), in the order of low; where they are unpickled, the arrays lie in a mapped file (``mapped``)."""

    def __reduce__(self) -> tuple:
        return mapped, (list(self),)


def mapped(parts: list[tuple[int, int, dict[str, np.ndarray]]]) -> Mapped:
    """The parts, with their arrays in a file without a name, which goes with them; only the pages in use take memory, and none of the process's own."""
    with tempfile.TemporaryFile() as f:
        for a in (a for _, _, arrays in parts for a in arrays.values()):
            f.write(a)
            f.write(bytes(-a.nbytes % 8))
        f.flush()
        held, at, out = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), 0, Mapped()
    for low, first, arrays in parts:
        views = {}
        for name, a in arrays.items():
            views[name] = np.frombuffer(held, a.dtype, len(a), at)
            at += a.nbytes + -a.nbytes % 8
        out.append((low, first, views))
    return out


def opened(shared: list[Broadcast]) -> list[tuple[int, int, dict[str, np.ndarray]]]:
    return [part for s in shared for part in s.value]


def coded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """codes (int32): the rows (seq, table) with the codes of the frequent ``words`` (hash, code: from 1, in the order of hashes), 0 for others; written. Words are broadcast GROUP at a time."""
    schema = pa.schema([("codes", pa.binary())])
    shared = []
    for part in chunks_of(words.select((F.col("code") - 1).alias("at"), "hash", "code"), "at", GROUP):
        hashes = np.sort(part.column("hash").to_numpy())
        shared.append(blocks.sparkSession.sparkContext.broadcast(Mapped([(int(hashes[0]), part.column("code").to_numpy().min(), {"hashes": hashes})])))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [(first, arrays["hashes"]) for _, first, arrays in opened(shared)]
        for batch in batches:
            for i in range(batch.num_rows):
                seq, table = (np.frombuffer(batch.column(j)[i].as_py(), kind) for j, kind in enumerate((np.int32, np.int64)))
                known = np.zeros(len(table), dtype=np.int32)
                for first, hashes in frequent:
                    at = np.minimum(np.searchsorted(hashes, table), len(hashes) - 1)
                    found = np.flatnonzero(hashes[at] == table)
                    known[found] = first + at[found]
                yield record(schema, [known[seq].tobytes()])

    out = materialise(map_arrow(blocks.select("seq", "table"), kernel, "codes binary"), "codes", wide=True)
    for s in shared:
        s.destroy()
    return out


def extensions(state: np.ndarray, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """At each place: the state of level - 1 there, and the word that makes a candidate of it (0 for none)."""
    n = max(0, len(codes) - level + 1)
    p, q = state[:n], codes[level - 1 :]
    return p, np.where((p > 0) & (state[1 : n + 1] > 0), q, 0) if level > 2 else np.where(p > 0, q, 0)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their n."""
    order = np.argsort(keys, kind="stable")  # quick on sorted runs
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else n.astype(np.int64)


def gathered(pieces: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct numbers of the pieces, sorted, and how often each stands there; time and again, before more than SEEN (of one piece at least) come together."""
    held, size = [], 0

    def passed() -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        return summed(keys, n)

    for piece in pieces:
        got = np.unique(piece, return_counts=True)
        if held and size + len(got[0]) > SEEN:
            yield passed()
            size = 0
        held.append(got)
        size += len(got[0])
    if held:
        yield passed()


def observed(rows: DataFrame, level: int) -> DataFrame:
    """key (state << 32 | word) and n (times that a task has seen it) of every candidate that occurs; written."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in gathered(candidates(batches, level)):
            for a in range(0, len(keys), 1 << 16):
                yield record(schema, keys[a : a + (1 << 16)], n[a : a + (1 << 16)])

    return materialise(map_arrow(rows, kernel, "key long, n long"), "observed")


def candidates(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[np.ndarray]:
    """The keys (state << 32 | word) of each row (state, codes), place by place."""
    for batch in batches:
        for i in range(batch.num_rows):
            state, codes = (np.frombuffer(batch.column(j)[i].as_py(), np.int32) for j in (0, 1))
            p, q = extensions(state, codes, level)
            on = q > 0
            yield p[on].astype(np.int64) << 32 | q[on]


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """The double array of sorted keys: parents (a key without its last SYMBOL bits), base of each parent, and check (parent's number from 1) and rank (of the key among all) of each place.

    Parents with many symbols are placed first, where a few tried bases allow, else
    behind all others; those with one symbol then take the places left.
    """
    w = keys & (1 << SYMBOL) - 1
    parents, first, size = np.unique(keys >> SYMBOL, return_index=True, return_counts=True)
    base = np.zeros(len(parents), dtype=np.int32)
    used, end = np.zeros(2 * len(keys) + (2 << SYMBOL), dtype=bool), 0
    many = np.flatnonzero(size > 1)
    many = many[np.argsort(-size[many], kind="stable")]
    tried = np.random.default_rng(len(keys)).random((len(many), TRIED))
    for i, share in zip(many.tolist(), tried, strict=True):
        if len(used) < end + (2 << SYMBOL):
            used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
        mine = w[first[i] : first[i] + size[i]]
        bases = (share * (end + 1)).astype(np.int64)
        free = np.flatnonzero(~used[bases[:, None] + mine].any(axis=1))
        b = int(bases[free[0]] if len(free) else end - mine[0])
        base[i] = b
        used[mine + b] = True
        end = max(end, int(mine[-1]) + b + 1)
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(len(used), len(used) + len(single))])
    base[single] = free[: len(single)] - w[first[single]]
    owner = np.repeat(np.arange(len(parents)), size)
    at = base[owner] + w
    check = np.zeros(int(at.max()) + 1, dtype=np.int32)
    check[at] = owner + 1
    rank = np.zeros(len(check), dtype=np.int32)
    rank[at] = np.arange(len(keys))
    return {"parents": parents, "base": base, "check": check, "rank": rank}


def keys_at(trie: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The keys of places that a transition leads to."""
    owner = trie["check"][at] - 1
    return trie["parents"][owner] << SYMBOL | (at - trie["base"][owner])


def advance(tries: list[tuple[int, int, dict[str, np.ndarray]]], keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each trie that has some of the keys: its number in the list, the places of these keys, and where their transitions lead.

    Tries follow each other in the order of keys, so a key has one trie that may know it.
    """
    of = np.searchsorted(np.array([low for low, _, _ in tries]), keys, "right")
    order = np.argsort(of.astype(np.int16) if len(tries) < 1 << 15 else of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(1, len(tries) + 2))
    for k, (_, _, trie) in enumerate(tries):
        sel = order[cuts[k] : cuts[k + 1]]
        if not len(sel):
            continue
        parent = keys[sel] >> SYMBOL
        i = np.minimum(np.searchsorted(trie["parents"], parent), len(trie["parents"]) - 1)
        to = trie["base"][i] + (keys[sel] & (1 << SYMBOL) - 1)
        ok = (trie["parents"][i] == parent) & (to >= 0) & (to < len(trie["check"]))
        sel, i, to = sel[ok], i[ok], to[ok]
        ok = trie["check"][to] == i + 1
        if ok.any():
            yield k, sel[ok], to[ok]


#: The arrays of a trie, and the types of their numbers.
ARRAYS = {"parents": np.int64, "base": np.int32, "check": np.int32, "rank": np.int32}


def built(keys: DataFrame, least: int) -> DataFrame:
    """Tries of SHARD transitions at most, from the written ``keys`` (key, n: in parts that add up; rn, its place where it has one): first (the rn of its first key), size and the arrays; written.

    Keys are sorted by ranges, and a task cuts its range into tries as it reads it. Keys whose parts don't add up to ``least`` are no candidates.
    """
    schema = pa.schema([("low", pa.int64()), ("first", pa.int64()), ("size", pa.int64()), *[(a, pa.binary()) for a in ARRAYS]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        held, places = none, none
        last = (none, none, none)  # the largest key so far, which may go on

        def trie(n: int) -> pa.RecordBatch:
            got = build(held[:n])
            return record(schema, [held[0]], [places[0]], [n], *[[got[a].tobytes()] for a in ARRAYS])

        def take(key: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
            nonlocal held, places
            held, places = np.concatenate([held, key[n >= least]]), np.concatenate([places, place[n >= least]])

        for batch in batches:
            key, place, n = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(last))
            first = np.unique(key, return_index=True)[1]
            key, n, place = *summed(key, n), place[first]
            take(key[:-1], place[:-1], n[:-1])
            last = (key[-1:], place[-1:], n[-1:])
            while len(held) > SHARD:
                yield trie(SHARD)
                held, places = held[SHARD:], places[SHARD:]
        take(*last)
        if len(held):
            yield trie(len(held))

    place = F.col("rn").cast("long") if "rn" in keys.columns else F.lit(0).cast("long")
    rows = keys.select("key", place.alias("rn"), "n").repartitionByRange("key").sortWithinPartitions("key")
    return materialise(map_arrow(rows, kernel, "low long, first long, size long, " + ", ".join(f"{a} binary" for a in ARRAYS)), "tries")


def tries(keys: DataFrame, least: int) -> list[Broadcast]:
    """Broadcasts of lists (first key, its rn, trie) in the order of keys, each of GROUP transitions or one trie, from the written ``keys``; the caller destroys them."""
    held = built(keys, least)
    groups, size = [[]], 0
    for r in held.select("low", "size").orderBy("low").collect():  # two numbers for each trie
        if groups[-1] and size + r["size"] > GROUP:
            groups.append([])
            size = 0
        groups[-1].append(r["low"])
        size += r["size"]
    shared = []
    for lows in filter(None, groups):
        rows = held.where(F.col("low").between(lows[0], lows[-1])).orderBy("low").toArrow()
        array = lambda a, i: np.frombuffer(rows.column(a)[i].as_buffer(), ARRAYS[a])  # noqa: B023, E731
        shared.append(keys.sparkSession.sparkContext.broadcast(Mapped((rows.column("low")[i].as_py(), rows.column("first")[i].as_py(), {a: array(a, i) for a in ARRAYS}) for i in range(rows.num_rows))))
    discard(held)
    return shared


def counted(rows: DataFrame, keys: DataFrame, level: int, least: int) -> DataFrame | None:
    """key, f of the candidates ``keys`` in the rows (state, codes), None where there is no candidate; written."""
    schema = pa.schema([("shard", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    sums = pa.schema([("key", pa.int64()), ("f", pa.int64())])
    shared = tries(keys, least)
    if not shared:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = opened(shared)
        starts = np.cumsum([0, *[len(t["check"]) for _, _, t in held]])  # the places of all tries in a row
        accepted = (np.concatenate([starts[k] + to for k, _, to in advance(held, asked)] or [starts[:0]]) for asked in candidates(batches, level))
        for at, n in gathered(accepted):
            cuts = np.searchsorted(at, starts)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[k], cuts[k + 1])
                yield record(schema, [k], [(at[mine] - starts[k]).astype(np.int32).tobytes()], [n[mine].tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, total = opened(shared), None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return record(sums, keys_at(held[now][2], at), total[at])

        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                if shard != now:
                    if now is not None:
                        yield done()
                    now, total = shard, np.zeros(len(held[shard][2]["check"]), dtype=np.int64)
                total[np.frombuffer(batch.column(1)[i].as_py(), np.int32)] += np.frombuffer(batch.column(2)[i].as_py(), np.int64)
        if now is not None:
            yield done()

    parts = map_arrow(rows, count, "shard int, at binary, n binary").repartition("shard").sortWithinPartitions("shard")
    out = materialise(map_arrow(parts, add, "key long, f long"), "counts")
    for s in shared:
        s.destroy()
    return out


def marked(rows: DataFrame, keys: DataFrame, level: int) -> DataFrame:
    """The rows (state, codes) with the states of ``level``: the numbers (rn + 1) of the frequent ``keys``; written."""
    schema = pa.schema([("state", pa.binary()), ("codes", pa.binary())])
    shared = tries(keys.withColumn("n", F.col("f")), 0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = opened(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                old, codes = (batch.column(j)[i].as_py() for j in (0, 1))
                p, q = extensions(np.frombuffer(old, np.int32), np.frombuffer(codes, np.int32), level)
                state = np.zeros(len(codes) // 4, dtype=np.int32)
                on = np.flatnonzero(q)
                # Keys are numbered in their order: a place's number is its rank among its trie's, after those before.
                for k, sel, to in advance(held, p[on].astype(np.int64) << 32 | q[on]):
                    _, first, trie = held[k]
                    state[on[sel]] = first + trie["rank"][to] + 1
                yield record(schema, [state.tobytes()], [codes])

    out = materialise(map_arrow(rows, kernel, "state binary, codes binary"), "states", wide=True)
    for s in shared:
        s.destroy()
    return out


def frequent(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """words (code, lang, word, f, n: all words of the lang) and parts (codes, f): the frequent words, and all
    frequent phrases of up to ``longest`` words as arrays of codes; both written."""
    docs = narrow(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    seed = 0
    while True:
        blocks = materialise(cut(docs, seed), "blocks", wide=True)
        every = blocks.where("words is not null").select("lang", F.inline(F.arrays_zip("words", "hashes", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.first("hashes").alias("hash"), F.sum("counts").alias("f"))
        every = materialise(every, "words")
        if every.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
            break
        discard(blocks, every)
        seed += 1
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    often = ranked(every.where(F.col("f") >= least).select("lang", "word", "hash", "f"), ["hash"])
    # One row per lang, of which there are few; a count decides.
    words = materialise(often.select((F.col("rn") + 1).cast("int").alias("code"), "lang", "word", "hash", "f").join(sized(total), "lang"), "vocabulary")
    if words.isEmpty():
        return words, words.select(F.array("code").alias("codes"), "f")
    codes = coded(blocks.where("seq is not null").select("seq", "table"), words)
    discard(blocks, every)
    rows, written = codes.select(F.col("codes").alias("state"), "codes"), codes
    levels = [words.select(F.col("code").alias("id"), F.array("code").alias("codes"), "f")]
    for level in range(2, longest + 1):
        keys = observed(rows, level)
        got = counted(rows, keys, level, least)
        if got is None:
            break
        found = materialise(ranked(got.where(F.col("f") >= least), ["key"]).select("key", "rn", "f"), "frequent")
        above = levels[-1].select(F.col("id").alias("p"), F.col("codes").alias("head"))
        long = look_up(found.select((F.col("rn") + 1).alias("id"), F.shiftright("key", 32).cast("int").alias("p"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("q"), "f"), above, ["p"], BROADCAST_CELLS)
        levels.append(materialise(long.select("id", F.concat("head", F.array("q")).alias("codes"), "f"), "phrases"))
        discard(keys)
        if level < longest:
            rows = marked(rows, found, level)
            discard(written)
            written = rows
    parts = levels[0].select("codes", "f")
    for level in levels[1:]:
        parts = parts.unionByName(level.select("codes", "f"))
    return words, materialise(parts, "parts")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shadow: int = SHADOW, top: int = TOP, cells: int = BROADCAST_CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best ``top`` phrases of two words or more."""
    words, parts = frequent(docs, longest, least)
    # Every phrase of which a candidate is a part is longer, so that only those with three words or more can hide one.
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.size("codes") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("codes") - k + 1), lambda i: F.slice("codes", i, k))))
    longer = materialise(parts.where(F.size("codes") > 2).select("f", F.explode(within).alias("codes")).groupBy("codes").agg(F.max("f").alias("f_longer")), "longer")
    phrases = materialise(parts.where(F.size("codes") > 1).select("codes", F.col("f").alias("a")), "phrases")
    shown = materialise(look_up(phrases, longer, ["codes"], cells).where(~F.coalesce(100 * F.col("f_longer") >= shadow * F.col("a"), F.lit(False))).drop("f_longer"), "shown")
    cuts = shown.select("codes", "a", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = materialise(cuts.select("codes", "a", "k", F.slice("codes", F.lit(1), F.col("k")).alias("left"), F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("right")), "cuts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = materialise(look_up(cuts, materialise(parts.select(F.col("codes").alias(side), F.col("f").alias(name)), "sides"), [side], cells).drop(side), "cuts")
    # a <= l and a <= r, so the quotient fits a long; the products are decimals of 38 digits.
    value = F.expr("cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div cast(cast(l as decimal(15,0)) * cast(r as decimal(15,0)) as decimal(38,0))")
    best = cuts.withColumn("score", value).groupBy("codes").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("a").alias("a"))
    best = materialise(best.select("codes", "a", "b.l", "b.r", "b.score"), "scored")
    letters = materialise(best.select("codes", F.posexplode("codes").alias("at", "code")), "letters")
    named = look_up(letters, materialise(words.select("code", "lang", "word", "n"), "names"), ["code"], cells).groupBy("codes").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang"), F.first("n").alias("n"))
    full = best.join(named.hint("merge"), "codes")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return full.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
