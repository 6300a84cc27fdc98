"""Mixing documents to target weights of domains, with soft membership.

A classifier over hashed word beginnings and endings is fitted on a bounded
sample of a labelled table and gives every document a posterior q over
the domains: log ratios of the features from one half of the sample, summed over a text, and a
logistic regression on these sums from the other half, so that posteriors are
calibrated on labels that the ratios have not seen. Documents get nonnegative rates r (of at most ``most``, where one is set) that minimise the squared
distance between the expected token totals of the domains, sum(n * q * r), and
the targets, by projected gradient from r = 1. The gradient is scaled by the
inverse of M = sum(n * q * q') over the documents whose rate isn't zero, and the
step is halved where the distance doesn't fall. Each step is one aggregation of
a few sums over all documents. Everything is
DataFrame operations; the driver sees the model and K-by-K sums only.

Defined results: a null or blank text has no tokens, the prior as posterior and
takes no part in the totals (its rate follows from its posterior); labels that
are null or repeated count by the first domain in the order of ``domains``
that any of their rows names; without labelled documents all domains are equally
likely; a target share under the least, or over the largest, posterior of any document is an
error, None stands for that least one; repeated
rows are each mixed; an empty table gives an empty result; texts of any length are
read whole, within their row.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import narrow
from fieldloom.runtime import materialise

#: Buckets of hashed features, labelled documents that are read, and what a bucket
#: must show to be a sign of a domain: evidence in standard errors, and its log ratio to
#: the other domains. The ratios of all others are smoothed by so many documents and
#: count by the factor WEAK, since they add up over long texts. A sum of ratios counts up to MOST_SUM.
BUCKETS, FIT_DOCS, EVIDENCE, EFFECT, SMOOTHING, WEAK, MOST_SUM = 1 << 15, 10_000, 5.0, 3.5, 50.0, 0.1, 8.0
STEPS, CHAIN, TOLERANCE, SLACK = 40, 6, 1e-6, 0.01
#: Share of M that documents off their bounds must have for a step by its inverse, and of its largest eigenvalue for a direction to count.
FREE, FLAT = 0.01, 1e-4

#: domain -> condition on a row of labels; the first that holds counts.
GRADES = {"toxic": "toxic = 1", "poor": "quality = 0", "clean": "quality = 1"}
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}


@dataclass
class Model:
    """Log ratios of the buckets for each domain, and for each domain the logit's constant and its slopes on all sums."""

    domains: list[str]
    weights: dict[str, list[float]]
    logits: list[list[float]]


def words_of(text: Column) -> Column:
    """The words of a text as an array; none of a null text."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def features(word: Column) -> list[Column]:
    """Buckets of the word's beginning and of its end."""
    head, tail = F.substring(word, 1, 4), F.concat(F.lit("^"), F.substring(word, -3, 3))
    return [F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int") for x in (head, tail)]


def buckets_of(words: Column) -> Column:
    """The buckets of all words, in the row: no word becomes a row of its own."""
    return F.flatten(F.transform(words, lambda w: F.array(*features(w))))


def labelled(labels: DataFrame, domains: dict[str, str], fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, domain (its place in ``domains``); ``fit_docs`` rows at most, chosen by a hash of the id."""
    place = F.coalesce(*[F.when(F.expr(rule), i) for i, rule in enumerate(domains.values())])
    rows = labels.select("doc_id", place.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)


def fit(docs: DataFrame, labels: DataFrame, domains: dict[str, str], fit_docs: int = FIT_DOCS, weak: float = WEAK) -> Model:
    """The model from at most ``fit_docs`` labelled documents; with ``weak`` = 0 from signs alone."""
    names, k = list(domains), len(domains)
    sample = materialise(labelled(labels, domains, fit_docs), "labelled")
    # The sample has a fixed number of ids at most, hence the broadcast; a repeated id counts once.
    found = narrow(docs, "doc_id", "text").join(sample.hint("broadcast"), "doc_id").groupBy("doc_id", "domain").agg(F.max("text").alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")
    found = materialise(found.select("domain", half, buckets_of(words_of(F.col("text"))).alias("buckets")), "sample")
    of = [F.count_if(F.col("domain") == i).alias(f"c{i}") for i in range(k)]
    # Documents are counted, not words: a word repeated in one text is one piece of evidence.
    first = found.where("half = 0")
    counts = first.select("domain", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(*of).collect()
    sizes = {r["domain"]: r["n"] for r in first.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    c = np.zeros((k, BUCKETS))
    for r in counts:
        c[:, r["bucket"]] = [r[f"c{i}"] for i in range(k)]
    share = np.array([[sizes.get(i, 0) / max(1, sum(sizes.values()))] for i in range(k)])
    expected = share * c.sum(axis=0)
    others, other_expected = c.sum(axis=0) - c, expected.sum(axis=0) - expected
    ratio = lambda a: np.log((c + a) / (expected + a)) - np.log((others + a) / (other_expected + a))
    strong = ratio(0.5)
    sign = (np.abs(c - expected) >= EVIDENCE * np.sqrt(expected + 1)) & (np.abs(strong) >= EFFECT)
    weight = np.where(sign, strong, weak * ratio(SMOOTHING))
    model = Model(names, {n: np.round(weight[i], 6).tolist() for i, n in enumerate(names)}, [[0.0] * (k + 1)] * k)
    seen = found.where("half = 1").select("domain", *evidence(F.col("buckets"), model)).collect()  # fit_docs rows of k numbers at most
    model.logits = np.round(regressed(np.array([[1.0, *[r[f"s_{n}"] for n in names]] for r in seen]).reshape(-1, k + 1), np.array([r["domain"] for r in seen], dtype=int), k), 6).tolist()
    return model


def regressed(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Slopes of a multinomial logistic regression of y (0 to k - 1) on x, by Newton's method with a ridge; one document of each domain is added, so that none has a share of 0."""
    m = x.shape[1]
    mean = np.zeros((k, m))
    mean[:, 0] = 1.0
    x, y = np.vstack([x, mean]), np.concatenate([y, np.arange(k)])
    target, b = np.eye(k)[y], np.zeros((k, m))
    keep = np.diag([1e-6, *[ridge] * (m - 1)])
    for _ in range(rounds):
        z = x @ b.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (p - target).T @ x + b @ keep
        curve = np.block([[(x * (p[:, [i]] * ((i == j) - p[:, [j]]))).T @ x + (i == j) * keep for j in range(k)] for i in range(k)])
        step = np.linalg.lstsq(curve, slope.ravel(), rcond=None)[0].reshape(k, m)
        b -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return b


def literal(values: list[float]) -> Column:
    """A constant array, folded once when the query is planned."""
    return F.split(F.lit(json.dumps(values, separators=(",", ":"))[1:-1]), ",").cast("array<double>")


def evidence(buckets: Column, model: Model) -> list[Column]:
    """s_<domain>, the summed log ratios of a row's buckets, MOST_SUM at most either way."""
    total = lambda n: F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(literal(model.weights[n]), b)) if any(model.weights[n]) else F.lit(0.0)
    return [F.least(F.greatest(total(n), F.lit(-MOST_SUM)), F.lit(MOST_SUM)).alias(f"s_{n}") for n in model.domains]


def posteriors(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep``, n_tokens and q_<domain> of every row of ``rows``, whose text is in the column ``text``.

    All of it happens within the row: no shuffle, no row more than there are texts.
    """
    names = model.domains
    cut = rows.select(*keep, words_of(F.col("text")).alias("words")).select(*keep, F.size("words").cast("long").alias("n_tokens"), buckets_of(F.col("words")).alias("buckets"))
    summed = cut.select(*keep, "n_tokens", *evidence(F.col("buckets"), model))
    logs = {n: sum((F.col(f"s_{m}") * a for m, a in zip(names, b[1:], strict=True)), F.lit(b[0])) for n, b in zip(names, model.logits, strict=True)}
    top = F.greatest(*logs.values()) if len(logs) > 1 else next(iter(logs.values()))
    raw = summed.select(*keep, "n_tokens", *[F.exp(v - top).alias(f"e_{n}") for n, v in logs.items()])
    whole = sum((F.col(f"e_{n}") for n in names), F.lit(0.0))
    return raw.select(*keep, "n_tokens", *[(F.col(f"e_{n}") / whole).alias(f"q_{n}") for n in names])


@dataclass
class Mixture:
    """A fitted mixture: the rate of a document follows from its posterior by ``steps`` of the descent.

    ``residual`` is the distance of the expected totals to the targets, over the sum of the targets.
    """

    model: Model
    steps: list[list[float]]
    most: float | None
    residual: float

    def rate(self) -> Column:
        rate = F.lit(1.0)
        for y in self.steps:
            rate = stepped(rate, y, self.model.domains, self.most)
        return rate


def stepped(rate: Column, y: list[float], names: list[str], most: float | None) -> Column:
    """One step against the gradient, back onto [0, most]."""
    slope = sum((F.col(f"q_{n}") * float(v) for n, v in zip(names, y, strict=True)), F.lit(0.0))
    rate = F.greatest(F.lit(0.0), rate - slope)
    return rate if most is None else F.least(F.lit(float(most)), rate)


class Infeasible(ValueError):
    """No rates meet the targets."""


def shares(members: DataFrame, targets: dict[str, float | None], strict: bool = True) -> dict[str, float]:
    """The targets as shares that sum to 1. A domain's share of any mixture lies between the least and the largest posterior;
    a target of None is the least one, any other beyond them an error, where ``strict`` says so."""
    names = list(targets)
    r = members.where("n_tokens > 0").agg(*[f(f"q_{k}").alias(f"{w}_{k}") for k in names for w, f in (("low", F.min), ("high", F.max))]).first()
    if r[f"low_{names[0]}"] is None:
        return {k: v or 0.0 for k, v in targets.items()}
    fixed = {k: r[f"low_{k}"] for k, v in targets.items() if v is None}
    rest = sum(v for v in targets.values() if v is not None)
    out = {k: fixed[k] if v is None else v / rest * (1 - sum(fixed.values())) for k, v in targets.items()}
    for k, v in out.items():
        if strict and not fixed and not r[f"low_{k}"] - 1e-9 <= v <= r[f"high_{k}"] + 1e-9:
            raise Infeasible(f"a share of {v:.4f} of {k} cannot be met: posteriors lie between {r[f'low_{k}']:.4f} and {r[f'high_{k}']:.4f}")
    return out


def descend(members: DataFrame, targets: dict[str, float], anchor: str, most: float | None = None, steps: int = STEPS, budget: Column | None = None) -> tuple[list[list[float]], float]:
    """The steps from rate 1 that bring the expected tokens of ``members`` (n_tokens, q_<domain>) to the targets, and the residual.

    The token budget is such that the expected tokens of domain ``anchor`` (of the documents
    where ``budget`` holds) stay what they are: target k is its weight over the anchor's, times the anchor's tokens.
    Rates lie in [0, most]; where that bound keeps the targets from being met, the
    descent ends at the least distance it finds.
    """
    names = list(targets)
    n, q = F.col("n_tokens").cast("double"), [F.col(f"q_{k}") for k in names]
    pairs = [(i, j) for i in range(len(q)) for j in range(i, len(q))]

    def sums(frame: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of the domains at ``rate``, and M over the documents whose rate isn't at a bound."""
        free = F.when((rate > 0) if most is None or frame is members else (rate > 0) & (rate < most), n)
        got = frame.agg(*[F.sum(n * x * rate).alias(f"b{i}") for i, x in enumerate(q)], *[F.sum(free * q[i] * q[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
        m = np.zeros((len(q), len(q)))
        for i, j in pairs:
            m[i, j] = m[j, i] = got[f"m{i}_{j}"] or 0.0
        return np.array([got[f"b{i}"] or 0.0 for i in range(len(q))]), m

    have, m = sums(members, F.lit(1.0))
    state, size, taken = members.withColumn("rate", F.lit(1.0)), 1.0, []
    whole = m
    kept = have[names.index(anchor)] if budget is None else sums(members, F.when(budget, 1.0).otherwise(0.0))[0][names.index(anchor)]
    goal = np.array([targets[k] for k in names]) / targets[anchor] * kept
    gap = have - goal
    off = lambda g: float(np.linalg.norm(g) / max(1.0, np.abs(goal).sum()))
    for _ in range(steps):
        if off(gap) < TOLERANCE or size < 1e-3:
            break
        # Where hardly any document is off its bounds, M says nothing of the rest: then the plain gradient shows the way.
        scale = m if np.trace(m) > FREE * np.trace(whole) else np.eye(len(q)) * np.linalg.eigvalsh(whole)[-1]
        y = (size * (np.linalg.pinv(scale, rcond=FLAT) @ gap)).tolist()
        rate = stepped(F.col("rate"), y, names, most)
        now, m_now = sums(state, rate)
        if off(now - goal) > off(gap) * (1 - 1e-4):
            size /= 2  # no descent: a shorter step from the same place
            continue
        state, gap, m, size = state.withColumn("rate", rate), now - goal, m_now, min(1.0, 2 * size)
        taken.append(y)
        if len(taken) % CHAIN == 0:  # else the expression grows with every step
            state = materialise(state, "rates")
    return taken, off(gap)


def fit_mixture(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, targets: dict[str, float | None] | None = None, anchor: str = "clean", most: float | None = None, fit_docs: int = FIT_DOCS, weak: float = WEAK, slack: float | None = SLACK) -> tuple[Mixture, DataFrame]:
    """The mixture that meets ``targets`` with rates of ``most`` at most, and doc_id, n_tokens, q_<domain> of every document. Targets that cannot be met, or a residual over ``slack``, are an error; with None the nearest mixture counts, and a residual over SLACK is a warning."""
    targets = targets or TARGETS
    docs = narrow(docs, "doc_id", "text")
    model = fit(docs, labels, domains or GRADES, fit_docs, weak)
    members = materialise(posteriors(docs, model, "doc_id"), "posteriors")
    wanted = shares(members, {k: targets[k] for k in model.domains}, slack is not None)
    # The least share is that of the documents with the least posterior alone, so these are the budget.
    least = [F.col(f"q_{k}") <= wanted[k] * (1 + 1e-9) for k, v in targets.items() if v is None]
    steps, residual = descend(members, wanted, anchor, most, budget=reduce(lambda a, b: a & b, least) if least else None)
    if residual > (SLACK if slack is None else slack):
        said = f"the nearest mixture is {residual:.4f} of all tokens away from its targets"
        if slack is not None:
            raise Infeasible(said)
        warnings.warn(said, stacklevel=2)
    return Mixture(model, steps, most, residual), members


def mix(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, targets: dict[str, float | None] | None = None, anchor: str = "clean", most: float | None = None, fit_docs: int = FIT_DOCS, weak: float = WEAK, slack: float | None = SLACK) -> DataFrame:
    """doc_id, n_tokens, q_<domain>, rate and residual (the same in every row) of every document."""
    mixture, members = fit_mixture(docs, labels, domains, targets, anchor, most, fit_docs, weak, slack)
    return members.withColumns({"rate": mixture.rate(), "residual": F.lit(mixture.residual)})


def sample(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more for the rest by a hash of its id.

    Rates are computed in each row from its own text, so texts stay where they
    are and columns of any name stay as they are; rows that repeat an id and a
    text are kept or left together. A null id is drawn as one id, a null or blank text by
    the prior. A rate within 1e-6 of a whole number is that number, so that a rate a hair under 1 loses no
    document. A mixture with ``most`` = 1 repeats nothing. An empty table stays empty.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("text"))
    # Zero times the partition's number keeps the condition on the rate from being computed anew, below all columns that it is made of.
    rated = posteriors(rows, mixture.model, "row", "id").select("row", "id", (mixture.rate() + 0 * F.spark_partition_id()).alias("rate"))
    rated = rated.withColumn("rate", F.when(F.abs(F.col("rate") - F.rint("rate")) < 1e-6, F.rint("rate")).otherwise(F.col("rate")))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    kept = rated.where(times > 0)
    if mixture.most is None or mixture.most > 1:
        kept = kept.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return kept.select("row.*")
