"""Operators against brute force, round trips and edge cases on small tables."""

import base64
import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import bpe, chunks, htmltree, langid, licenses, mixing, neardup, quality, secrets, topk
from fieldloom.llm.queries import vocabulary
from fieldloom.operators import graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n\t ", "a", "é" * 3, "word " * 3000, "x" * 5000]


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd(df):
    """Extra columns with clashing names, and every row twice."""
    return df.union(df).withColumns({"id": F.lit(1), "n": F.lit(2), "spans": F.lit("x"), "blob": F.lit(b"")})


def test_secrets_base_and_ledger(spark, tmp_path):
    texts = ["TOKEN = 'abcdefgh1' x", "secret=token:abcdefgh12", "AKIA" + "A" * 12, "f" * 32, None, "", "TOKEN = 'abcdefgh1' x"]
    path = f"file://{tmp_path}/ledger"
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs(spark, texts), path)).collect()}
    assert [got[i]["n_assign"] for i in range(7)] == [1, 0, 0, 0, 0, 0, 1]
    assert got[2]["n_access"] == 1 and got[3]["n_hex"] == 1 and got[5]["spans"] == ""
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:0:18").hexdigest()
    assert spark.read.parquet(path).count() == 5  # null counts as empty
    again = secrets.scan(docs(spark, [*texts, "new"]), path)
    assert again.count() == 8 and spark.read.parquet(path).count() == 6
    changed = secrets.RULES | {"login": ("x", 0, 1)}
    secrets.scan(docs(spark, texts), path, changed).collect()
    assert {tuple(r["rule_versions"]) for r in spark.read.parquet(path).collect() if len(r["rule_versions"]) == 1} == {(secrets.rule_versions(changed)["login"],)}


def test_secrets_redact(spark):
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs(spark, ["é token=abcdefgh1 z", None, "plain"])).collect()}
    assert got == {0: ("é <secret> z", 12), 1: (None, 0), 2: ("plain", 5)}


def test_secrets_redact_long_and_overlapping():
    assert secrets.masked("ab secret cd", [(3, 9), (4, 6), (8, 10)], "*") == "ab *cd"
    text = "token=abcdefgh1 " * 300_000  # 5 MB
    spans = [(a, b) for _, a, b in secrets.find_spans(text, secrets.RULES)]
    assert len(spans) == 300_000 and secrets.masked(text, spans, "*") == "* " * 300_000


def test_langid(spark):
    rng = random.Random(1)
    text = lambda w: " ".join(rng.choice(w) for _ in range(30))
    a, b = ["the", "of", "thing", "and"], ["der", "und", "nicht", "das"]
    rows = [(i, text(a if i % 2 else b), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    got = [r["lang_pred"] for r in langid.predict(docs(spark, ["the things", "nichts undas", "12 !", None]), model).orderBy("doc_id").collect()]
    assert got == ["en", "de", "und", "und"]
    empty = langid.fit(spark.createDataFrame([], DOCS))
    assert langid.predict(docs(spark, ["the"]), empty).first()["lang_pred"] == "und"


def test_bpe_like_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(P.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["don't  stop\n\n  it's <|endoftext|> 12 é漢字🙂  x \x1c y", " lead", "tail ", "a  b", *EDGE]
    got = {r["doc_id"]: r for r in bpe.round_trip(odd(docs(spark, texts)), vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs(spark, texts), vocabulary())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, vocabulary()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_html(spark):
    page = "<html><body><nav>menu</nav><div class='box'>{0}</div><article><h1>T&amp;t</h1><p>one <b>bo</b>ld<br>x<p>two<div class='comments'>no</div></article><footer>f</footer><script>var a='</p>';</script></body></html>"
    rows = [(i, "http://h.example/x", page.format("Same words")) for i in range(8)] + [(8, None, None), (9, "bad", ""), (10, "http://o.example/", "<div class=top>Hi<p>there &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, -1):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltree.extract(pages, broadcast_rows=limit).collect()}
        assert got[0] == ("T&t one bold x two", 18) and got[8] == ("", 0) and got[9] == ("", 0) and got[10][0] == "Hi there &am"


def test_html_style_tree_drops_what_is_the_same_everywhere(spark):
    page = "<body><div class='bar'><span>Same words</span></div><div class='t'><p>{0}</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h.example/x", page.format(f"text {i}")) for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in htmltree.extract(pages).collect()} == {f"text {i}" for i in range(30)}
    tree = {r["path"]: r["importance"] for r in htmltree.style_tree(pages).collect()}
    assert tree[htmltree.path_of("body", "div.t", "p")] == pytest.approx(htmltree.entropy_of([1] * 30))


@pytest.mark.parametrize("rest", ["<aside><article>Teaser</article></aside>", "<div class=comments><article>Me too</article></div>", "<nav><main>Go</main></nav>", "<article> <p>\n</p></article>", "<article><aside>Ad</aside></article>"])
def test_html_story_outside_dropped_or_blank_articles(rest):
    page = f"<body><div class='t'><p>The story</p></div>{rest}<div class='bar'>Same words</div></body>"
    assert htmltree.main_text(page, {htmltree.path_of("body", "div.bar")}) == "The story"
    assert htmltree.main_text(page + "<article>Told here</article>", set()) == "Told here"


def test_html_style_tree_prunes_inside_articles(spark):
    story = "<h1>Title {0}</h1><p>text {0}<br>goes <b>on</b></p><p>click <a>here</a> {0}</p>"
    page = "<body><article>" + story + "<div class='x'><p>Same words</p><a>Mail</a> <a>Print</a></div><ul><li>one</li><li>two</li></ul></article></body>"
    want = [f"Title {i} text {i} goes on click here {i}" for i in range(30)]
    rows = [(i, "http://h.example/x", page.format(i)) for i in range(30)]
    # One article on many pages, and few differing ones: nothing goes.
    rows += [(100 + i, "http://same.example/x", page.format(1)) for i in range(30)] + [(200 + i, "http://few.example/x", page.format(i)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltree.extract(pages).collect()}
    assert [got[i] for i in range(30)] == want
    whole = " Same words Mail Print one two"
    assert {got[100 + i] for i in range(30)} == {want[1] + whole} and [got[200 + i] for i in range(4)] == [w + whole for w in want[:4]]


@pytest.mark.parametrize(("wrappers", "paragraphs"), [(1, 1), (4, 1), (8, 3), (80, 5), (3000, 2)])
def test_html_story_in_wrappers_stays(spark, wrappers, paragraphs):
    story = "".join(f"<p>story {{0}} part {k}</p>" for k in range(paragraphs))
    page = "<body><div class=top><p>Same words</p></div>" + "<div>" * wrappers + story + "</div>" * wrappers + "<ul><li>One</li><li>Two</li></ul></body>"
    pages = spark.createDataFrame([(i, "http://h.example/x", page.replace("{0}", str(i))) for i in range(30)], "page_id long, url string, html string")
    want = {i: " ".join(f"story {i} part {k}" for k in range(paragraphs)) for i in range(30)}
    assert {r["page_id"]: r["text"] for r in htmltree.extract(pages).collect()} == want


def test_html_pages_that_all_say_the_same_stay(spark):
    pages = spark.createDataFrame([(i, "http://h.example/x", "<body><div><p>Same words</p></div></body>") for i in range(9)], "page_id long, url string, html string").withColumns({"host": F.lit("x"), "text": F.lit(1)})
    assert {r["text"] for r in htmltree.extract(odd(pages)).collect()} == {"Same words"}
    assert htmltree.extract(pages.limit(0)).count() == 0


def test_html_composite_by_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(12):
        inner = "".join(f"<div class=c{rng.randrange(3)}><p>{rng.choice(['same', str(rng.random())])}</p><span>x</span></div>" for _ in range(rng.randrange(4)))
        rows.append((i, "http://h.example/x", f"<body><div>{inner}</div><div><i>{rng.randrange(2)}</i></div></body>"))
    seen = {}
    for _, _, html in rows:
        for node, shown, said in htmltree.observations(htmltree.Tree(html)):
            a, b, chain = seen.setdefault(node.path, ([], [], htmltree.above(node)))
            a.append(shown)
            b.append(said)
    counts = lambda v: [v.count(x) for x in set(v)]
    own = {p: (len(a), max(htmltree.entropy_of(counts(a)), htmltree.entropy_of(counts(b))), chain) for p, (a, b, chain) in seen.items()}
    sums = {}
    for m, importance, chain in own.values():
        for k, p in enumerate(chain):
            if p in own:
                x, y = sums.get(p, (0, 0))
                sums[p] = (x + 0.9**k * m * importance, y + 0.9**k * m)
    got = {r["path"]: (r["m"], r["importance"], r["composite"]) for r in htmltree.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == set(own)
    for p, (m, importance, _) in own.items():
        assert got[p] == (m, pytest.approx(importance), pytest.approx(sums[p][0] / sums[p][1]))


def test_html_stray_and_deep_tags_in_linear_time():
    for page in ("<div>" * 20_000 + "</p>" * 20_000 + "end", "<b>" * 20_000 + "<hr>" * 20_000 + "end", "<p>" + "<i>a</i>" * 20_000 + "end"):
        assert htmltree.main_text(page, {1}).endswith("end")


def test_quality_counts_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("ab") if rng.random() < 0.5 else str(rng.randrange(40)) for _ in range(rng.randrange(60))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        want = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        assert quality.repeated_words([w.encode() for w in words]) == len(want)


def test_quality_judge(spark):
    good = [" ".join(f"fair{(i * j) % 97}" for j in range(40)) for i in range(1, 30)]
    poor = [" ".join(f"bad%%%{(i * j) % 89}" for j in range(40)) for i in range(1, 30)]
    table = odd(docs(spark, good + poor + EDGE))
    labels = spark.createDataFrame([(i, int(i < 29), 0) for i in range(58)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(table, labels).collect()}
    assert all(got[i] for i in range(29)) and not any(got[i] for i in range(29, 58 + len(EDGE)))
    assert quality.judge(docs(spark, good), labels.limit(0)).where("kept").count() == 29


def test_licenses(spark):
    texts = ["MIT License, mit  license", "SPDX-License-Identifier: MPL-2.0", "GNU Lesser General Public License", *EDGE]
    got = {r["doc_id"]: r for r in licenses.scan(odd(docs(spark, texts))).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"]) == (2, 0, 2, "mit")
    assert got[1]["labels"] == "mpl" and got[2]["labels"] == "gpl,lgpl" and got[3]["n_words"] == 0 and got[4]["labels"] == ""
    assert len(licenses.rules_here().rules) >= 400 and len(licenses.signature_rules()) >= 150


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["good"] * 20 + (["vile"] * 2 if i % 4 == 0 else [])), "en", "s", 1) for i in range(200)] + [(500, None, "en", "s", 0), (501, " ", "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    table = odd(spark.createDataFrame(rows, DOCS))
    got = mixing.mix(table, labels, {"toxic": "toxic = 1", "clean": "toxic = 0"}, {"clean": 0.9, "toxic": 0.1}).collect()
    assert len(got) == 404 and all(r["rate"] >= 0 for r in got)
    total = {k: sum(r["n_tokens"] * r[f"q_{k}"] * r["rate"] for r in got) for k in ("clean", "toxic")}
    assert total["clean"] / total["toxic"] == pytest.approx(9, rel=1e-3)
    assert mixing.mix(table.limit(0), labels, {"toxic": "toxic = 1", "clean": "toxic = 0"}, {"clean": 0.9, "toxic": 0.1}).count() == 0
    with pytest.raises(mixing.Infeasible):
        mixing.mix(table, labels, {"toxic": "toxic = 1", "clean": "toxic = 0"}, {"clean": 0.9999, "toxic": 0.0001})


@pytest.mark.parametrize("most", [None, 1.0, 2.0])
def test_mixing_rates_by_least_squares(spark, most):
    rng = np.random.default_rng(7)
    q = rng.dirichlet([2, 1, 0.5], 60)
    n = rng.integers(1, 400, 60)
    members = spark.createDataFrame([(int(k), *map(float, p)) for k, p in zip(n, q, strict=True)], "n_tokens long, q_a double, q_b double, q_c double")
    targets = {"a": 0.62, "b": 0.26, "c": 0.12}
    steps, residual = mixing.descend(members, targets, "a", most)
    goal = np.array(list(targets.values())) / 0.62 * (n @ q[:, 0])
    rates = np.ones(60)  # the same problem by many small projected steps
    size = 1 / np.linalg.eigvalsh((q * n[:, None]).T @ (q * n[:, None]))[-1]
    for _ in range(20_000):
        rates = np.clip(rates - size * n * (q @ (rates @ (q * n[:, None]) - goal)), 0, most)
    least = np.linalg.norm(rates @ (q * n[:, None]) - goal) / goal.sum()
    assert residual <= least + 2e-3
    mixture = mixing.Mixture(mixing.Model(["a", "b", "c"], {}, []), steps, most, residual)
    got = np.array([r["r"] for r in members.select(mixture.rate().alias("r")).collect()])
    assert (got >= 0).all() and (most is None or (got <= most).all())
    assert np.linalg.norm(got @ (q * n[:, None]) - goal) / goal.sum() == pytest.approx(residual, abs=1e-9)


def test_mixing_logits():
    rng = np.random.default_rng(8)
    x = np.column_stack([np.ones(4000), rng.normal(size=(4000, 2))])
    b = np.array([[0.5, 1.0, 0.0], [0.0, 0.0, -1.0]])
    p = np.exp(x @ b.T)
    y = (rng.random(4000) > p[:, 0] / p.sum(axis=1)).astype(int)
    got = mixing.regressed(x, y, 2)
    assert np.allclose(got[0] - got[1], b[0] - b[1], atol=0.15)


def test_mixing_draws_rates(spark):
    model = mixing.Model(["a"], {"a": [0.0] * mixing.BUCKETS}, [[0.0, 0.0]])
    table = docs(spark, [f"w{i}" for i in range(4000)])
    for rate, most in ((0.004, 1.0), (0.5, 1.0), (1 - 1e-9, 1.0), (2.25, None)):
        got = mixing.sample(table, mixing.Mixture(model, [[1 - rate]], most, 0.0)).count()
        assert abs(got - rate * 4000) <= 5 * math.sqrt(4000 * (rate % 1) * (1 - rate % 1)) + 1e-3, rate


def near_copies():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    out = [" ".join(w if rng.random() > p else f"n{rng.randrange(999)}" for w in base) for p in (0, 0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(20)]
    return out + out[:10] + [" ".join(f"u{rng.randrange(9999)}" for _ in range(50)) for _ in range(30)] + EDGE


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_by_brute_force(spark, shingle):
    texts = near_copies()
    sets = [set(neardup.shingles(t, shingle).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if all(comp[c] == c for c in comp):
            break
    for large, limit in ((64, 1000), (4, -1)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, texts), shingle, large=large, cells=limit).collect()}
        assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}
    none = spark.createDataFrame([(None, "a b c", "en", "s", 5)], DOCS)
    assert neardup.near_duplicates(none).first()["kept"] and neardup.near_duplicates(none.limit(0)).count() == 0


def test_frequent_keys_are_dealt_without_loss(spark, monkeypatch):
    bands = {i: [7, 100 + i % 3, 1000 + i] for i in range(60)}
    reps = spark.createDataFrame([(i, 10 + i, b) for i, b in bands.items()], "node long, n long, bands array<long>")
    keys = {k: [i for i, b in bands.items() if k in b] for k in (7, 100, 101, 102)}
    want = sorted((i, 10 + i, k, m[0], 10 + m[0], len(m)) for k, m in keys.items() for i in m)
    for sampled, least in ((1, 30), (1, 10**6)):  # key 7 is frequent, then none is
        monkeypatch.setattr(neardup, "SAMPLED", sampled)
        monkeypatch.setattr(neardup, "HOT_MEMBERS", least)
        assert sorted(map(tuple, neardup.bucketed(reps).select("node", "n", "key", "pivot", "pn", "size").collect())) == want


@pytest.mark.parametrize("cells", [1000, -1])
def test_keep_one_with_null_and_repeated_ids(spark, cells):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, same, "x"), (2, same, "y"), (2, same, "z"), (None, same, "n"), (4, None, "e"), (5, "", "f"), (5, same, "g")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id string"), cells=cells)
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted(r["_id"] for r in kept.collect()) == ["e", "f", "g", "n", "x"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91)], "a long, b long")
    assert {r["node"]: r["comp"] for r in graph.components(edges).collect()} == {i: 0 for i in range(51)} | {90: 90, 91: 90}


@pytest.mark.parametrize(("order", "cells"), [("shuffled", graph.BROADCAST_CELLS), ("descending", -1)])
def test_components_of_long_chains_in_any_order(spark, order, cells):
    chain = list(range(1000))
    if order == "shuffled":
        random.Random(6).shuffle(chain)
    else:
        chain = [0, *reversed(chain[1:])]
    edges = spark.createDataFrame([*zip(chain, chain[1:], strict=False), (2001, 2000)], "a long, b long")
    assert {r["node"]: r["comp"] for r in graph.components(edges, cells).collect()} == dict.fromkeys(chain, 0) | {2000: 2000, 2001: 2000}


def test_chunks_find_shifted_passages(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(n))
    passage = text(60)
    texts = [text(80) + " " + passage + " " + text(30), text(7) + "! " + passage + text(50), text(120), *EDGE[:4]]
    got = chunks.repeated(odd(docs(spark, texts)).dropDuplicates(["doc_id"])).collect()
    assert {r["doc_id"] for r in got} == {0, 1}
    for t in texts[:3]:
        cut = chunks.boundaries(t.encode())
        assert cut[-1] == len(t.encode()) and all(t.encode()[a:b].decode() for a, b in zip([0, *cut], cut, strict=False))
    left = {r["doc_id"]: r["text"] for r in chunks.remove_repeats(docs(spark, texts)).collect()}
    assert left[0] == texts[0] and len(left[1]) < len(texts[1]) - 150 and left[2] == texts[2]


def test_chunks_find_passages_of_51_words(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    texts = []
    for _ in range(400):
        passage = text(51)
        texts += [f"{text(40)} {passage} {text(40)}", f"{text(60)} {passage} {text(20)}"]
    found = {r["doc_id"] for r in chunks.repeated(docs(spark, texts)).collect()}
    assert len(found) >= 0.99 * len(texts)


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 8)), 2)
    x[100:200] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [1.0] * 7 + [math.nan]), (402, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = np.floor(64 * x).astype(int)
    want = set()
    for q in range(0, 300, 20):
        order = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(order)}
    got = topk.search(table, pivots=6, annulus=32)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.search(table.limit(0)).count() == 0


@pytest.mark.parametrize(("body", "want"), [("<div class='has-sidebar'><p>Hi</p></div>", "Hi"), ("<main><div class='layout no-sidebar'>Hi</div></main>", "Hi"), ("<article>Let <math><mi>x</mi></math> be</article>", "Let x be"), ("<form><article>Hi</article><input value=a><button>Go</button></form>", "Hi"), ("<div class='sidebar'>No</div><p>Hi</p><form>Mail</form>", "Hi")])
def test_html_wrappers_stay(body, want):
    assert htmltree.main_text(f"<body>{body}</body>", set()) == want


def test_stages_keep_columns_that_clash(spark):
    names = "_id _blob _clean _spans _rate row id text_hash spans blob times rate left".split()
    good = " ".join(f"fair{i}" for i in range(40))
    rows = [(1, f"{good} token=abcdefgh1", "en", "s", 9), (1, f"{good} token=abcdefgh1", "en", "s", 9), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, good, "en", "s", 9)]
    table = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(7) for n in names})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    mixture = mixing.fit_mixture(table, labels, {"toxic": "toxic = 1", "clean": "toxic = 0"}, {"clean": 1.0, "toxic": None}, most=1.0, weak=0.0, slack=None)[0]
    stages = {"quality": lambda d: quality.keep_good(d, labels), "secrets": secrets.redact, "mixture": lambda d: mixing.sample(d, mixture), "chunks": chunks.remove_repeats}
    for name, stage in stages.items():
        out = stage(table)
        assert out.columns == table.columns and stage(table.limit(0)).count() == 0, name
        got = out.collect()
        assert all(r[n] == 7 for r in got for n in names), name
        assert len(got) == (3 if name == "quality" else 5), name
    assert {r["text"] for r in secrets.redact(table).collect()} == {f"{good} <secret>", None, "", good}


def test_license_texts_without_a_name():
    texts = {"mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software", "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted", "gpl": "GPLv3", "apache": "http://www.apache.org/licenses/LICENSE-2.0"}
    for label, text in texts.items():
        assert licenses.scan_text(text, licenses.rules_here())[5] == label
    n, base, first, last = licenses.scan_text("mit license foo " * 20_000, licenses.rules_here())[:4]
    assert (n, base, first, last) == (60_000, 20_000, 0, 59_997)


def test_license_forms_and_what_is_none():
    labels = lambda t: licenses.scan_text(t, licenses.rules_here())[5]
    for text in ("placed in public domain", "dedicated to the public domain", "subject to public domain"):
        assert labels(text) == "public-domain"
    assert labels("under the MIT umbrella") == "" and labels("under the Apache helicopter") == ""
    assert labels("under the MIT license") == "mit" and labels("under the Apache 2.0") == "apache"


def test_no_gate_hides_a_license():
    """Every rule without its gates finds nothing in the corpus that the gated scan leaves out."""
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null order by doc_id").fetchall()]
    here = licenses.rules_here()
    for text in texts:
        shown = set(licenses.scan_text(text, here)[5].split(",")) - {""}
        if not shown:
            for line in text.splitlines():
                plain = line.encode().translate(licenses._TABLE)
                plain = b" ".join(plain.split())
                for rule in here.rules:
                    assert not rule.expression.search(plain), (rule.label, rule.expression.pattern, line)


@pytest.mark.parametrize("name", ["op1_secret_ledger", "op8_circulant_minhash", "op10_pivot_topk", "op11_prefix_trie", "op12_phrase_tries", "op13_ngram_decontamination"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from fieldloom.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    want = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted((tuple(r) for r in want.fetchall()), key=repr)


def test_empty_tables(spark):
    none = docs(spark, []).withColumns({"blob": F.lit(1), "words": F.lit(2)})
    model = langid.fit(docs(spark, ["the thing"]))
    empty = [secrets.scan(none), langid.predict(none, model), bpe.round_trip(none, vocabulary()), licenses.scan(none), chunks.repeated(none), mixing.posteriors(none, mixing.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"), mixing.GRADES), "doc_id")]
    assert [e.count() for e in empty] == [0] * len(empty)


def test_chunk_lengths():
    rng = random.Random(9)
    for text in ("a" * 5000, "-" * 999, "ab" * 3000, "".join(rng.choice("abcdefgh é") for _ in range(9000))):
        ends = chunks.boundaries(text.encode())
        sizes = np.diff(ends, prepend=0)
        assert ends[-1] == len(text.encode()) and sizes.max() <= chunks.LONGEST + chunks.SHORTEST + 3 and (sizes[:-1] >= chunks.SHORTEST - 3).all()
