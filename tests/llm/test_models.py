"""Fitted models against plain counting."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import langid, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).withColumns({"id": F.lit(1), "word": F.lit("w"), "grade": F.lit(9)})


def test_language_by_plain_counting(spark):
    rng = random.Random(1)
    stems = {"en": ["the", "thing", "of", "house"], "de": ["der", "ding", "von", "haus"], "fr": ["le", "chose", "de", "maison"]}
    text = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    train = [(i, text(lang, 30), lang) for i, lang in enumerate(rng.choice(list(stems)) for _ in range(60))]
    words, grams, prior = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, t, lang in train:
        prior[lang] += 1
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words[w][lang] += 1
            padded = f"^{w}$"
            for n in range(1, langid.LONGEST + 1):
                for i in range(len(padded) - n + 1):
                    grams[padded[i : i + n]][lang] += 1
    langs = sorted(prior)
    keep = lambda counts: {k: c for k, c in counts.items() if sum(c.values()) >= 3}
    words, grams = keep(words), keep(grams)
    sums = lambda keys, counts: {x: sum(counts[k][x] + 0.5 for k in keys) for x in langs}
    word_sum = sums(words, words)
    gram_sum = {n: sums([g for g in grams if len(g) == n], grams) for n in range(1, langid.LONGEST + 1)}

    def score(t, lang):
        total = math.log(prior[lang] / sum(prior.values()))
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            if w in words:
                total += math.log((words[w][lang] + 0.5) / word_sum[lang])
                continue
            padded = f"^{w}$"
            for n in range(min(langid.LONGEST, len(padded)), 0, -1):
                known = [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] in grams]
                if known:
                    total += sum(math.log((grams[g][lang] + 0.5) / gram_sum[n][lang]) for g in known) / len(known)
                    break
        return total

    model = langid.fit(table(spark, train))
    assert set(model.words) == set(words)
    assert set(model.grams) == set(grams)
    for at, counts, sizes in ((dict(zip(model.words, model.word_logs)), words, lambda w: word_sum), (dict(zip(model.grams, model.gram_logs)), grams, lambda g: gram_sum[len(g)])):
        for key, logs in at.items():
            assert logs == pytest.approx([math.log((counts[key][x] + 0.5) / sizes(key)[x]) for x in langs]), key
    asked = [(i, text(rng.choice(langs), rng.choice([1, 2, 5])) + rng.choice(["", " houseding", " xq", " lehaus"]), None) for i in range(80)]
    for r in langid.predict(table(spark, asked + asked), model).collect():
        s = np.array([score(asked[r["doc_id"]][1], x) for x in langs])
        assert r["lang_pred"] == langs[int(np.argmax(s))]
        assert r["score"] == pytest.approx(float(1 / np.exp(s - s.max()).sum()), abs=1e-9)


def test_quality_ratio_and_threshold_by_plain_counting(spark):
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(30))
    rows = [(i, text(["fair", "good", "word"] if i % 3 else ["bad", "word", "ugh"]), "en") for i in range(90)] + [(200, None, "en"), (201, "", "en"), (1, "fair again " * 20, "en")]
    grades = {i: (int(rng.random() < (0.9 if i % 3 else 0.1)), int(rng.random() < 0.1)) for i in range(0, 90, 2)}
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in grades.items()] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t, _ in rows:
        n = np.bincount(quality.buckets_of((t or "").encode()), minlength=quality.BUCKETS)
        raw += n
        target += n * (grades.get(i) == (1, 0))
    want = np.log((target + 0.5) / (target + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())
    ratio, cut = quality.fitted(docs, labels, quality.FIT_DOCS)
    assert np.allclose(ratio, want)

    def llr(t):
        h = quality.buckets_of((t or "").encode())
        return float(want[h].sum() / len(h)) if len(h) else 0.0

    def fails(t):
        n, _, _, _, repeats = quality.base_counts(t or "")
        return n < 10 or 100 * repeats > 20 * n

    seen = sorted((round(llr(t), 3), grades[i]) for i, t, _ in rows if i in grades and not fails(t) and (grades[i][0] == 0 or grades[i][1] == 0))
    good, poor = sum(g[0] == 1 for _, g in seen), sum(g[0] == 0 for _, g in seen)
    value = lambda c: round(quality.CARE * sum(g[0] == 1 for x, g in seen if x > c) / good + sum(g[0] == 0 for x, g in seen if x < c) / poor, 9)
    xs = sorted({x for x, _ in seen})
    cuts = [((a + b) / 2, b - a) for a, b in zip(xs, xs[1:], strict=False)]
    assert value(cut) == max(value(c) for c, _ in cuts)
    for r in quality.judge(docs, labels).collect():
        t = next(t for i, t, _ in rows if i == r["doc_id"] and abs(llr(t) - r["llr"]) < 1e-9)
        assert r["kept"] == (not fails(t) and llr(t) >= cut)


def test_language_does_not_depend_on_what_a_worker_has_seen(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the thing thing of things", "en"), ("das ding dinge und nichts", "de")] * 5)]
    model = langid.fit(table(spark, rows))
    texts = ["the dingo", None, "", "12 !", "́", "nichtig " * 50_000, "x" * 200_000, "\U00010410 日本", "the dingo"]
    together = list(zip(*model.predict(texts), strict=True))
    monkeypatch.setattr(langid, "MEMO", 0)
    alone = [tuple(x[0] for x in model.predict([t])) for t in texts]
    assert [a for a, _ in alone] == [a for a, _ in together] and np.allclose([b for _, b in alone], [b for _, b in together])
    assert together[1:5] == [("und", 0.0)] * 4 and together[0] == together[8]
    assert len(model.numbers) == len(model.words) + 1  # the last text's unseen word alone


def test_quality_reads_every_label(spark, monkeypatch):
    # 20,100 labelled documents, all but 100 of them trusted; a bound of 20,000 labels would miss some of both.
    rows = [(i, "fair words " * 6 if i % 201 else "bad words ugh " * 5, "en") for i in range(20_100)] + [(7, "again fair again " * 5, "en")] * 600 + [(None, "no id " * 6, "en")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 201 > 0), 0) for i in range(20_100)], "doc_id long, quality int, toxic int")
    target = np.zeros(quality.BUCKETS)
    for text, n in ((rows[1][1], 20_000), (rows[20_100][1], 600)):
        target += n * np.bincount(quality.buckets_of(text.encode()), minlength=quality.BUCKETS)
    raw = target.copy()
    for text, n in ((rows[0][1], 100), (rows[-1][1], 1)):
        raw += n * np.bincount(quality.buckets_of(text.encode()), minlength=quality.BUCKETS)
    want = np.log((target + 0.5) / (target + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())
    ratio, _ = quality.fitted(docs, labels, quality.FIT_DOCS)
    assert np.allclose(ratio, want, atol=1e-9)
    grades = quality.materialise(quality.graded(labels), "grades")
    few, many = (sorted(quality.with_grades(docs, grades, cells).collect()) for cells in (250_000, 0))
    assert len(many) == 20_700 and few == many
