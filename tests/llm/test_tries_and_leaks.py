"""Conversation tries, phrases and benchmark windows against brute force, with odd input."""

import hashlib
import mmap
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, phrases, prefixtrie
from fieldloom.runtime import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONVS = "conv_id long, turn long, role string, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Conversations -------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out = set()
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = sorted(c for c in of if len(full[c]) == len(node))
        out.add((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(kids), len(leaves), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # a family without its first conversation
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c  d\te", "é", "f " * 9])))
    same = [(1000 + c, t, "user", f"hello {t}") for c in range(60) for t in range(4)]
    long = [(2000, t, "user", f"t{t}") for t in range(40)] + [(2020 + t // 39, t % 39, "user", f"t{t % 39}") for t in range(78)]
    odd = [(None, 1, "user", "x"), (5, None, None, None), (5, None, "user", ""), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (-7, 0, "user", "x"), (-20, 0, "user", "y")]
    rows += same + long + odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("layer", "batch", "cells"), [(64, 10_000, 250_000), (2, 7, -1), (3, 1, 1000)])
def test_trie_by_brute_force(spark, layer, batch, cells):
    rows = conversations(60, layer)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = spark.createDataFrame(rows, CONVS).withColumns({"conv": F.lit(1), "t": F.lit(2), "n": F.lit(3)})
        got = [tuple(r) for r in prefixtrie.trie(table, layer, cells).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = trie_by_hand(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_none_and_of_turnless(spark):
    none = spark.createDataFrame([], CONVS)
    assert prefixtrie.trie(none).count() == 0
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(lone, 0, "user", "x")]  # its only turn would come from a conversation that is not there
    assert {tuple(r) for r in prefixtrie.trie(spark.createDataFrame(rows, CONVS)).collect()} == trie_by_hand(rows) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_sparse_table():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        v = rng.integers(0, 5, n)
        table = prefixtrie.SparseTable(v)
        a = rng.integers(0, n, 50)
        b = np.array([rng.integers(i, n) + 1 for i in a])
        assert table.least(a, b).tolist() == [v[i:j].min() for i, j in zip(a, b, strict=True)]
        bound = rng.integers(1, 5, 50)
        assert table.right(a, bound).tolist() == [next((j for j in range(i, n) if v[j] < k), n) for i, k in zip(a, bound, strict=True)]
        v[0] = -1
        assert prefixtrie.SparseTable(v).left(a, bound).tolist() == [next(j for j in range(i, -1, -1) if v[j] < k) for i, k in zip(a, bound, strict=True)]


# Phrases -------------------------------------------------------------------------------------


def phrases_by_hand(rows, longest, least, shadow, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= shadow * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(rows)[:top], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), a, l, r, n[lang], score))
    return out


@pytest.mark.parametrize(("longest", "shard", "group", "words"), [(3, 1 << 18, 1 << 22, 1 << 19), (3, 5, 20, 3), (4, 7, 7, 10)])
def test_phrases_by_brute_force(spark, monkeypatch, longest, shard, group, words):
    for name, value in (("SHARD", shard), ("GROUP", group), ("WORDS", words)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(longest)
    vocabulary = [*"abcdef", "É", "New", "York", "x" * 50, "\x00", "\x1c", "'s"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " ,"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", "fr"), (" .\n", None), ("rare words only", "es"), ("New York is " * 3000, "it")] + [(texts[0], "en")] * 5
    table = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS).withColumns({"code": F.lit(1), "word": F.lit("w"), "f": F.lit(2)})
    got = [tuple(r) for r in phrases.mine(table, longest, 4, 50, 30).collect()]
    want = phrases_by_hand(rows, longest, 4, 50, 30)
    assert len(got) == len(want) and set(got) == want


def test_phrases_of_none(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, "a b c", "en", "s", 5)], DOCS)).count() == 0


def test_phrases_pass_once_over_the_texts(spark, monkeypatch):
    """However many groups of words and tries are broadcast, a level's tables of the texts are written once, in small row groups."""
    monkeypatch.setattr(phrases, "GROUP", 3)
    written, groups, write, tries = [], [], phrases.materialise, phrases.tries
    monkeypatch.setattr(phrases, "materialise", lambda df, name, **more: written.append((name, more)) or write(df, name, **more))
    monkeypatch.setattr(phrases, "tries", lambda *a: groups.append(tries(*a)) or groups[-1])
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        rows = [(" ".join(rng.choice("abcdefgh") for _ in range(50)), "en") for _ in range(40)]
        table = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS)
        assert {tuple(r) for r in phrases.mine(table).collect()} == phrases_by_hand(rows, 3, 10, 50, 2000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert all(len(g) > 1 for g in groups[:2])  # the tries that count and those that mark level 2
    assert [x for x in written if x[1]] == [(name, {"wide": True}) for name in ("blocks", "codes", "states")]
    assert [x for x, _ in written if x in ("known", "codes", "states", "counts")] == ["codes", "counts", "states", "counts"]


def test_wide_rows_in_small_groups(spark):
    path = materialise(spark.range(100).coalesce(1), "wide", wide=True)._fieldloom_path.removeprefix("file://")
    found = [pq.ParquetFile(p).metadata for p in Path(path).glob("*.parquet")]
    assert sum(m.num_rows for m in found) == 100 and all(m.row_group(i).num_rows <= 16 for m in found for i in range(m.num_row_groups))


def test_broadcast_tries_are_mapped():
    """What a worker unpickles doesn't lie in its own memory."""
    tries = [(k, 0, phrases.build(np.arange(k, k + n))) for k, n in ((0, 1), (7, 3), (300, 301))]
    got = pickle.loads(pickle.dumps(phrases.Mapped(tries)))
    assert [x[:2] for x in got] == [x[:2] for x in tries]
    for (_, _, old), (_, _, new) in zip(tries, got, strict=True):
        assert old.keys() == new.keys() and all(np.array_equal(old[a], new[a]) and old[a].dtype == new[a].dtype for a in old)
        assert all(isinstance(a.base.obj if isinstance(a.base, memoryview) else a.base, mmap.mmap) for a in new.values())


def test_gathered_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "SEEN", 10)
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 30, n) for n in (0, 5, 40, 3, 0, 9, 9)]
    got = list(phrases.gathered(pieces))
    assert len(got) > 1 and all((np.diff(keys) > 0).all() and n.dtype == np.int64 for keys, n in got)
    assert sum((Counter(dict(zip(keys.tolist(), n.tolist(), strict=True))) for keys, n in got), Counter()) == Counter(np.concatenate(pieces).tolist())


def test_double_array():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300, 4000):
        p = np.minimum(rng.zipf(1.5, n), 200)
        keys = np.unique(p.astype(np.int64) << 32 | rng.integers(1, 500, n))
        trie = phrases.build(keys)
        state, word = rng.integers(0, 210, 5000).astype(np.int32), rng.integers(0, 510, 5000).astype(np.int32)
        asked = state.astype(np.int64) << 32 | word
        half = len(keys) // 2
        lists = [[(int(keys[0]), 0, trie)], [(int(k[0]), 0, phrases.build(k)) for k in (keys[:half], keys[half:]) if len(k)]]
        want = np.isin(state.astype(np.int64) << 32 | word, keys)
        for tries in lists:
            got = list(phrases.advance(tries, asked))
            assert np.array_equal(np.sort(np.concatenate([sel for _, sel, _ in got] or [[]])), np.flatnonzero(want))
            assert all(np.array_equal(phrases.keys_at(tries[k][2], to), asked[sel]) for k, sel, to in got)


# Benchmark windows ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_by_hand(docs, bench):
    items = [(i, WORD.findall(lowered(t))) for i, t in bench if i is not None]
    wins = {(i, tuple(ws[a : a + min(10, len(ws))])) for i, ws in items if ws for a in range(len(ws) - min(10, len(ws)) + 1)}
    out = []
    for d, text in docs:
        ws = WORD.findall(lowered(text))
        hit, of = set(), set()
        for i, w in wins:
            for a in range(len(ws) - len(w) + 1):
                if tuple(ws[a : a + len(w)]) == w:
                    hit |= set(range(a, a + len(w)))
                    of.add(str(i))
        out.append((d, len(ws), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaky():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("Ab cd é9 xyz naïve 12".split()) + rng.choice(["", ",", "'s", "\n"]) for _ in range(n))
    bench = [(i, text(14)) for i in range(12)] + [(20, "Short one here"), (21, "solo"), (22, None), (23, " ,. "), (None, text(12)), (3, text(11)), (24, "short ONE here")]
    docs = [(i, text(30) + " " + (rng.choice(bench)[1] or "") + "! " + text(20)) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "a SHORT, one? here short one here solo"), (53, "cd " * 4000 + bench[2][1]), (None, bench[0][1]), (1, docs[1][1]), (1, docs[1][1])]
    return docs, bench


@pytest.mark.parametrize("cells", [250_000, -1])
def test_leaks_by_brute_force(spark, cells):
    docs, bench = leaky()
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).withColumns({"id": F.lit(1), "digest": F.lit("d"), "item": F.lit(2), "m": F.lit(3)})
    items = spark.createDataFrame(bench, "item_id long, text string").withColumns({"m": F.lit(1), "h": F.lit(2)})
    assert sorted((tuple(r) for r in decontaminate.judge(table, items, cells=cells).collect()), key=repr) == leaks_by_hand(docs, bench)


def test_leaks_without_rows(spark):
    docs, bench = leaky()
    table, items = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS), spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.judge(table.limit(0), items).count() == 0
    assert decontaminate.judge(table, items.limit(0)).where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_leaks_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, it: {item.upper()}! After {item.replace(' ', ', ')} end.", "clean text", None, item, f"{item} twice {item}"]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).withColumns({"row": F.lit(7), "digest": F.lit(8)})
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    whole = decontaminate.remove(table, items)
    assert whole.columns == table.columns and {r["doc_id"] for r in whole.collect()} == {1, 2}
    cut = decontaminate.remove(table, items, "spans")
    assert cut.columns == table.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert got == {0: ("Before, it: After end.", 22), 1: ("clean text", 10), 2: (None, 0), 3: ("", 0), 4: ("twice ", 6)}
