"""Mixing to target weights with soft memberships, by distributed projected gradients."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, hashed_sample, stored

_SPACE = r"[\x20\x09-\x0D]+"

#: Letters of the beginnings of words that are features.
START = 5

#: Features of a domain classifier beside words: name and the bounds of its bins.
BINS = {
    "symbols": ("n_symbols / greatest(n_chars, 1)", (0.005, 0.02, 0.05, 0.1)),
    "upper": ("n_upper / greatest(n_chars, 1)", (0.02, 0.05, 0.2, 0.5)),
    "distinct": ("n_distinct / greatest(n_tokens, 1)", (0.2, 0.4, 0.6)),  # of beginnings of words
    "length": ("log10(greatest(n_tokens, 1))", (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)),
    "word": ("n_chars / greatest(n_tokens, 1)", (3.0, 4.5, 6.0, 9.0)),
}


@dataclass
class Classifier:
    """Multinomial logistic regression over the presence of features: constants and weights of each domain."""

    domains: list[str]
    constant: list[float]
    weights: dict[str, list[float]] = field(default_factory=dict)

    @property
    def starts(self) -> list[str]:
        """The beginnings of words among the features."""
        return sorted({f[2:] for f in self.weights if not f.startswith("#")})

    def posterior(self, df: DataFrame, features: str = "features", name: str = "posterior") -> DataFrame:
        """``df`` with an array of posteriors in the order of ``domains``; they add up to 1.

        Each step is a column of its own that later ones use more than once, so that none is
        computed again for each use.
        """
        k, names = len(self.domains), [*self.weights]
        start = F.array(*(F.lit(x) for x in self.constant))
        if names:
            table = F.split(F.lit(",".join(f"{x!r}" for v in self.weights.values() for x in v)), ",").cast("array<double>")
            of = lambda f: F.slice(table, (F.array_position(F.lit(names), f).cast("int") - 1) * k + 1, F.lit(k))
            start = F.aggregate(F.array_intersect(features, F.lit(names)), start, lambda a, f: F.zip_with(a, of(f), lambda x, y: x + y))
        df = df.withColumn("__e", start)
        df = df.withColumn("__x", F.zip_with("__e", F.array_repeat(F.array_max("__e"), k), lambda x, m: F.exp(x - m)))
        total = F.aggregate("__x", F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(name, F.zip_with("__x", F.array_repeat(total, k), lambda x, s: x / s)).drop("__e", "__x")


def features(docs: DataFrame, text: str = "text", starts: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``features``: the beginnings of its lower-case words
    (``1:...``; ``2:...`` for those found twice or more; only those in ``starts``, if given), and
    one feature for the bin of each ratio. A null text has no words. Columns with these names
    are replaced."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    count = lambda kind: (F.length("__t") - F.length(F.regexp_replace("__t", kind, ""))).cast("bigint")
    df = docs.withColumn("__t", t).withColumn("__w", F.array_remove(F.split("__t", _SPACE, -1), ""))
    df = df.withColumn("__d", F.regexp_extract_all(F.lower("__t"), F.lit(rf"([\p{{L}}\p{{N}}]{{1,{START}}})[\p{{L}}\p{{N}}]*"), F.lit(1)))
    if starts is None:
        df = df.withColumn("__p", F.col("__d"))
    else:
        df = df.withColumn("__p", F.filter("__d", lambda x: x.isin(*starts)) if starts else F.array().cast("array<string>"))
    df = df.withColumns({"n_tokens": F.size("__w").cast("bigint"), "__d": F.size(F.array_distinct("__d")), "__p": F.sort_array("__p")})
    df = df.withColumns({"__s": count(r"[#*$%&|<>]+"), "__u": count(r"\p{Lu}+"), "__c": F.length(F.array_join("__w", ""))})
    names = {"n_symbols": "__s", "n_upper": "__u", "n_chars": "__c", "n_distinct": "__d"}
    bins = []
    for name, (expr, bounds) in BINS.items():
        for a, b in names.items():
            expr = expr.replace(a, b)
        value = F.expr(expr)
        bins.append(F.concat(F.lit(f"#{name}:"), sum(((value >= x).cast("int") for x in bounds), F.lit(0)).cast("string")))
    twice = F.array_distinct(F.array_compact(F.zip_with("__p", F.slice("__p", F.lit(2), F.greatest(F.size("__p"), F.lit(0))), lambda a, b: F.when(a == b, a))))
    mark = lambda p, k: F.transform(p, lambda x: F.concat(F.lit(k), x))
    df = df.withColumn("features", F.concat(mark(F.array_distinct("__p"), "1:"), mark(twice, "2:"), F.array(*bins)))
    return df.drop("__t", "__w", "__d", "__p", "__s", "__u", "__c")


def regression(rows: list[tuple[int, list[int]]], domains: int, n: int, ridge: float = 1.0, rounds: int = 50):
    """Weights (domains, n + 1) of a multinomial logistic regression, the constants last.

    ``rows`` have a domain and the places of the features that are present. Newton's method
    with a ridge on all but the constants; steps are halved until the loss falls.
    """
    import numpy as np

    x, y = np.zeros((len(rows), n + 1)), np.zeros((len(rows), domains))
    x[:, n] = 1
    for i, (d, at) in enumerate(rows):
        y[i, d] = 1
        x[i, at] = 1
    pull = np.full(n + 1, ridge)
    pull[n] = 1e-6
    w = np.zeros((domains, n + 1))

    def loss(w):
        z = x @ w.T
        m = z.max(1, keepdims=True)
        return (m[:, 0] + np.log(np.exp(z - m).sum(1)) - (z * y).sum(1)).sum() + (w * w * pull).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - y).T @ x + w * pull
        curve = np.diag(np.tile(pull, domains))
        for a in range(domains):
            for b in range(domains):
                curve[a * (n + 1) : (a + 1) * (n + 1), b * (n + 1) : (b + 1) * (n + 1)] += (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        step = np.linalg.solve(curve, slope.ravel()).reshape(w.shape)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now <= 1e-9 * abs(now):
            break
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, sample: int = 8_000, most: int = 128, least: int = 20, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Classifier of ``domain`` (an expression over ``labels``) from a bounded labelled sample.

    The bound: about ``sample`` labelled rows, chosen by a hash of the id, and the ``most``
    features that tell the domains apart best (largest log-likelihood ratio; all bins of
    ratios are among them). Rows without a domain teach nothing. Of each row its domain and
    the places of its features come to the driver, never a text. Being a regression, it gives
    posteriors whose means over the sample are the shares of the domains. The sample's features
    stay on the executors' disks while the fit runs; what a lost one held is computed again.

    A domain with fewer than ``least`` rows that is also below a hundredth of the largest is not
    learned, with a warning: one or two rows tell nothing of it, and rates that raise it to a
    target would repeat whatever is a little like them by the thousand and drop all else. Its
    documents get posteriors of the others.
    """
    labels = labels.select(doc_id, domain.cast("string").alias("__y")).filter(F.col("__y").isNotNull() & F.col(doc_id).isNotNull())
    labels = labels.groupBy(doc_id).agg(F.min("__y").alias("__y"))
    labels = hashed_sample(labels, doc_id, labels.count(), sample, seed=3)
    held = rows = features(docs.select(doc_id, text).join(F.broadcast(labels), doc_id), text).select("__y", "features").persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
        rare = {d: k for d, k in sorted(sizes.items()) if k < least and 100 * k < max(sizes.values())}
        if rare:
            warnings.warn(f"domains with too few labelled rows to be learned: {rare} of {sum(sizes.values())}", stacklevel=2)
            rows = rows.filter(~F.col("__y").isin(*rare))
        domains = sorted(sizes.keys() - rare)
        if not domains:
            return Classifier(["all"], [0.0])
        n = sum(sizes[d] for d in domains)
        counts = rows.select("__y", F.explode("features").alias("f")).groupBy("f").agg(*(F.sum((F.col("__y") == d).cast("int")).alias(f"c{i}") for i, d in enumerate(domains)))
        total = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))
        gain = sum((F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") * F.log(F.col(f"c{i}") * n / (F.col("c") * sizes[d]))).otherwise(0.0) for i, d in enumerate(domains)), F.lit(0.0))
        counts = counts.withColumn("c", total).filter("c >= 5").withColumn("gain", gain)
        best = counts.filter((F.col("gain") > 8) | F.col("f").startswith("#")).orderBy(F.desc(F.col("f").startswith("#")), F.desc("gain"), "f").limit(most)
        names = [r.f for r in best.select("f").collect()]
        place, number = {f: i for i, f in enumerate(names)}, {d: i for i, d in enumerate(domains)}
        taught = rows.select("__y", F.array_intersect("features", F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("f")).collect()
    finally:
        held.unpersist()
    w = regression([(number[r[0]], [place[f] for f in r.f]) for r in taught], len(domains), len(names))
    return Classifier(domains, [float(x) for x in w[:, -1]], {f: [float(x) for x in w[:, i]] for i, f in enumerate(names)})


def _rate(slope: list[float], p: list[Column]) -> Column:
    """The projection of 1 - slope * posteriors on the numbers that are not negative."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((c * F.lit(float(x)) for c, x in zip(p, slope)), F.lit(0.0)))


@dataclass
class Mix:
    """Fitted steps; ``rate`` turns posteriors into a document rate, by the sum of the steps.
    ``expected`` are the token totals these rates give, to hold against ``targets``; ``met`` says
    whether all are within the tolerance."""

    steps: list[list[float]]
    targets: list[float]
    expected: list[float]
    met: bool = True

    @property
    def slope(self) -> list[float]:
        return [sum(x) for x in zip(*self.steps)] or [0.0] * len(self.targets)

    def rate(self, posterior: str) -> Column:
        return _rate(self.slope, [F.get(posterior, F.lit(i)) for i in range(len(self.targets))])


def fit_rates(scored: DataFrame, targets: list[float], rounds: int = 100, tolerance: float = 1e-4, ridge: float = 1e-8) -> Mix:
    """Nonnegative rates whose expected domain token totals match ``targets``.

    ``scored`` has ``n_tokens`` and ``posterior``. Of all rates that minimise the sum over
    domains of (sum of rate * tokens * posterior - target)^2 / mass, these are the nearest to 1
    (weighted by tokens). They are found by lazily projected gradients: the gradient steps add
    up to one number for each domain, and the rate of a document is the projection on the
    numbers >= 0 of 1 minus its posteriors times these. A step is the domain errors times the
    inverse of the matrix of token-weighted posterior products of the documents with a rate
    above 0, from the same distributed pass, and is halved until the (convex) objective falls.
    Each round is one distributed sum of about K^2 numbers, rarely two; no state is kept by
    document and nothing is joined.

    ``ridge`` weighs nearness to 1 against the errors and bounds the steps where targets cannot
    be had. Ends when all errors are below a hundredth of ``tolerance`` of the total target, when
    the objective no longer falls, or after ``rounds``. Targets that cannot be reached, as far as
    the tolerance, give the best approach with ``met`` false and a warning of expected against
    target totals. A domain without mass is left out of the steps, and its target, if there is
    any, counts as not met.
    """
    import numpy as np

    k = len(targets)
    base = scored.select(F.col("n_tokens").cast("double").alias("n"), *(F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(k)))
    p, t = [F.col(f"p{i}") for i in range(k)], np.array(targets, float)

    def size_of(rate: Column) -> Column:
        return F.sum(F.col("n") * rate * rate) / 2

    def measure(slope, others=()):
        """Totals, matrix and squared rates at ``slope``; squared rates at ``others``. The rate is a
        column of its own, used by all sums."""
        row = base.withColumns({"r": _rate(slope, p), **{f"r{i}": _rate(x, p) for i, x in enumerate(others)}})
        live = F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
        sums = [F.sum(F.col("r") * F.col("n") * x) for x in p] + [F.sum(live * p[i] * p[j]) for i in range(k) for j in range(i + 1)]
        got = [x or 0.0 for x in row.agg(*sums, size_of(F.col("r")), *(size_of(F.col(f"r{i}")) for i in range(len(others)))).first()]
        matrix, at = np.zeros((k, k)), k
        for i in range(k):
            for j in range(i + 1):
                matrix[i, j] = matrix[j, i] = got[at]
                at += 1
        return np.array(got[:k]), matrix, got[at], got[at + 1 :]

    slope = np.zeros(k)
    got, matrix, half, _ = measure(slope)
    mass, limit = got, tolerance * max(float(t.sum()), 1e-12)
    some = mass > 0
    cost = lambda half, slope: half + t[some] @ slope[some] + ridge * (mass * slope * slope).sum() / 2
    now, steps = cost(half, slope), []
    while some.any() and len(steps) < rounds and np.abs(np.where(some, got - t, 0)).max() > limit / 100:
        error = (got - t - ridge * mass * slope)[some]
        step = np.zeros(k)
        step[some] = np.linalg.solve(matrix[np.ix_(some, some)] + ridge * np.diag(mass[some]), error)
        gain, shares = float(error @ step[some]), [1.0, 0.5, 0.25, 0.125, 0.0625]
        new, halves = measure(slope + step, [slope + s * step for s in shares[1:]]), None
        halves = [new[2], *new[3]]
        ok = [s for s, h in zip(shares, halves) if cost(h, slope + s * step) <= now - 1e-4 * s * gain]
        share = ok[0] if ok else shares[-1] / 4
        if share < 1:
            new = measure(slope + share * step)
        if not cost(new[2], slope + share * step) < now:
            break
        steps.append((share * step).tolist())
        slope = slope + share * step
        got, matrix, half, _ = new
        now = cost(half, slope)
    met = bool((np.abs(got - t) <= limit).all())
    if not met:
        warnings.warn(f"targets not met after {len(steps)} rounds: expected tokens {got.tolist()}, targets {targets}", stacklevel=2)
    return Mix(steps, targets, got.tolist(), met)


def score_domains(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``posterior`` (array in the order of ``model.domains``).

    Columns of ``docs`` with these names are replaced, others kept; names that begin with two
    underscores are the operator's own."""
    df = features(docs, text, model.starts)
    return model.posterior(df).drop("features")


def wanted(weights: dict[str, float], domains: list[str], budget: float) -> list[float]:
    """Token targets of the domains; weights are scaled to 1 over the domains there are."""
    w = [max(0.0, weights.get(d, 0.0)) for d in domains]
    total = sum(w)
    return [budget * x / total if total else budget / len(w) for x in w]


def copies(rate: Column, key: str, seed: int = 11) -> Column:
    """A whole number of copies whose mean is the rate; the fraction is decided by a hash of the key."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def mix_rates(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", lift: dict[str, float] | None = None):
    """(classifier, mix, scored): posteriors of every row and the rates that meet the weights.

    The budget is all tokens of ``docs``; with ``lift`` {domain: x} it is set so that this
    domain's target is x times its expected tokens, to keep its documents whole. ``scored``
    (stored) has ``doc_id, n_tokens, posterior``. Null and empty texts have no tokens, the
    posterior of their features, and a rate like any other. Repeated rows count each. An
    empty table has no steps: all rates are 1.
    """
    model = fit_domains(docs, labels, domain, doc_id=doc_id, text=text)
    scored = stored(few(score_domains(docs.select(doc_id, text), model, text).drop(text)), "posteriors")
    sums = scored.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i))) for i in range(len(model.domains)))).first()
    budget = float(sums[0] or 0)
    for d, x in (lift or {}).items():
        if d in model.domains and weights.get(d):
            share = wanted(weights, model.domains, 1.0)[model.domains.index(d)]
            budget = x * float(sums[1 + model.domains.index(d)] or 0) / share
    return model, fit_rates(scored, wanted(weights, model.domains, budget)), scored
