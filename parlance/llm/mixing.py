"""Mixing to target weights: soft domain membership and rates fitted by projected gradient.

A naive Bayes classifier, learned from a table of labelled documents, gives every
document a posterior over the domains. Then nonnegative rates (expected copies) are fitted so that
the expected tokens of each domain, ``sum(rate * tokens * posterior)``, meet the targets. The
objective is the squared residual, whitened by the domains' Gram matrix; in the metric that weighs
documents by their tokens a gradient step is ``rate - posterior . c`` with one vector ``c`` for all
documents, so an iteration is one aggregate over the stored posteriors and only sums of one value
per domain reach the driver. Rates start at 1, hence stay as close to it as the targets let them.

Everything runs in DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column, kept_columns, row_field, stored

#: Labelled rows of each domain from which the classifier learns, in expectation.
SAMPLE = 2000
#: Words of each domain, those with the most evidence first.
LEXICON = 128
#: Standard errors between a word's rate in a domain and in all that make it a feature.
EVIDENCE = 5.0
#: How many times as often as in another domain the word must occur in one.
CONTRAST = 5.0
STEPS = 40
TOLERANCE = 1e-6
#: What a rate's distance from 1 costs against a residual.
RIDGE = 0.01
TEMPERATURES = (1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 8.0)
#: The production mix: what ``labels`` marks as toxic or of low quality shall be rare.
TARGETS = {"good": 0.90, "low": 0.07, "toxic": 0.03}


def label_domain() -> Column:
    """The domain of a row of ``labels``; null (not learned) if a label is null."""
    known = F.col("toxic").isNotNull() & F.col("quality").isNotNull()
    return F.when(known, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good"))


def tokens(text: Column) -> Column:
    """Words between ASCII whitespace, in lower case; none for null."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(folded, "[ \\t-\\r]+"), lambda w: w != "")


def _let(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often and in whatever lambda it is used."""
    return F.transform(F.array(x), use)[0]


def _bins(text: Column, words: Column, distinct: Column) -> list[Column]:
    """Signals of a text's shape as one feature each; names start with a space, so no word equals them."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    shares = {
        "upper": (n - F.length(F.regexp_replace(text, "\\p{Lu}", ""))) / n,
        "signs": (n - F.length(F.regexp_replace(text, "[!#-&*<-@\\[-^{-~]", ""))) / n,
        "same": 1 - F.size(distinct) / F.greatest(F.size(words), F.lit(1)),
    }
    return [F.concat(F.lit(f" {name} "), F.least(F.floor(share * 10), F.lit(9)).cast("string")) for name, share in shares.items()]


@dataclass
class Classifier:
    """Words that tell of each domain, and what each feature adds to a domain's log posterior.

    Features are bins: of the share of signs and the like, and of the number of a domain's words
    that a text has; so correlated words are one piece of evidence, and having none is one, too.
    """

    domains: list[str] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    words: dict[str, list[str]] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)
    temperature: float = 1.0

    def features(self, text: Column, words: Column, distinct: Column) -> Column:
        out = _bins(text, words, distinct)
        for d, lexicon in self.words.items():
            n = F.size(F.array_intersect(distinct, F.array(*[F.lit(w) for w in lexicon])))
            out.append(F.concat(F.lit(f" {d} words "), F.least(F.floor(F.log2(n + F.lit(1.0))), F.lit(5)).cast("string")))
        return F.array(*out)

    def evidence(self, features: Column) -> Column:
        """Log likelihood ratios, an array with one value for each domain."""
        start = F.array(*[F.lit(0.0) for _ in self.domains])
        table = F.create_map(*[x for f, w in self.weights.items() for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in w]))])
        known = F.array_intersect(features, F.array(*[F.lit(f) for f in self.weights]))
        return F.aggregate(known, start, lambda s, f: F.zip_with(s, table[f], lambda a, b: a + b))

    def posterior(self, evidence: Column, temperature: float | None = None) -> Column:
        t = temperature or self.temperature
        prior = F.array(*[F.lit(p) for p in self.prior])
        scores = F.zip_with(evidence, prior, lambda e, p: e / F.lit(t) + p)

        def shares(e: Column) -> Column:
            return _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total))

        def powers(s: Column) -> Column:
            return _let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))

        return _let(_let(scores, powers), shares)


def _rates(rows: DataFrame, feature: Column, seen: dict[str, int]) -> DataFrame:
    """``feature``, its smoothed frequency in each domain (``r0``, ...) and in all (``mean``)."""
    rates = [((F.count_if(F.col("domain") == d) + 0.5) / (n + 1.0)).alias(f"r{i}") for i, (d, n) in enumerate(seen.items())]
    return rows.select("domain", F.explode(feature).alias("feature")).groupBy("feature").agg(((F.count("*") + 0.5) / (sum(seen.values()) + 1.0)).alias("mean"), *rates)


def _lexicon(learn: DataFrame, seen: dict[str, int], lexicon: int) -> dict[str, list[str]]:
    """Of each domain, the words that occur there CONTRAST times as often as in some other.

    A word belongs to the domain where it is most frequent. Evidence is that frequency's distance
    to the frequency in all, in standard errors.
    """
    k = len(seen)
    rates = F.array(*[F.col(f"r{i}") for i in range(k)])
    gaps = [(F.col(f"r{i}") - F.col("mean")) / F.sqrt(F.col("mean") * (1 - F.col("mean")) / n) for i, n in enumerate(seen.values())]
    own = F.array_position(rates, F.array_max(rates)).cast("int")
    found = _rates(learn, F.col("distinct"), seen).where(F.array_max(rates) >= CONTRAST * F.array_min(rates))
    found = stored(found.select("feature", own.alias("own"), F.array_max(F.array(*gaps)).alias("gap")).where(F.col("gap") >= EVIDENCE))
    out = {}
    for i, d in enumerate(seen):
        words = found.where(F.col("own") == i + 1).orderBy(F.desc("gap"), "feature").limit(lexicon).collect()
        if words:
            out[d] = [r["feature"] for r in words]
    return out


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> Classifier:
    """Learn from ``docs`` (doc_id, text) and ``labelled`` (doc_id, domain).

    At most ``sample`` rows of each domain in expectation, drawn by a hash of the id, are read;
    two thirds give the counts, one third the temperature. Rows without a domain, an id or a
    document teach nothing. An id with several domains counts for the first by name. Without any
    row the classifier knows no domain.
    """
    known = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier()
    unit = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    drawn = known.where(unit < share[F.col("domain")])
    part = F.when(F.pmod(F.xxhash64(F.lit("mixing part"), "doc_id"), F.lit(3)) == 0, F.lit("tune")).otherwise(F.lit("learn"))
    # the ids of the sample are few by its bound, so they are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = rows.select("domain", part.alias("part"), "text", tokens(F.col("text")).alias("words"))
    rows = stored(rows.withColumn("distinct", F.array_distinct("words")))
    learn = rows.where("part = 'learn'")
    counts = {r["domain"]: r["n"] for r in learn.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    seen = {d: counts[d] for d in sorted(counts)}
    if not seen:
        return Classifier()
    everything = sum(sizes[d] for d in seen)
    model = Classifier(list(seen), [math.log(sizes[d] / everything) for d in seen], _lexicon(learn, seen, lexicon))
    for r in _rates(learn, model.features(F.col("text"), F.col("words"), F.col("distinct")), seen).collect():  # some bins
        model.weights[r["feature"]] = [math.log(r[f"r{i}"] / r["mean"]) for i in range(len(seen))]
    at = F.array_position(F.array(*[F.lit(d) for d in seen]), F.col("domain")).cast("int")
    tune = rows.where("part = 'tune'").where(F.col("domain").isin(list(seen))).select(at.alias("at"), F.col("domain"), model.evidence(model.features(F.col("text"), F.col("words"), F.col("distinct"))).alias("e"))
    # the sample has another mix than the labels, so the loss weighs rows by their domain's share
    mix = F.create_map(*[F.lit(x) for d in seen for x in (d, sizes[d] / counts[d])])[F.col("domain")]
    loss = [F.avg(-mix * F.log(F.greatest(F.element_at(model.posterior(F.col("e"), t), F.col("at")), F.lit(1e-9)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    got = tune.agg(*loss).first()
    model.temperature = min((x, TEMPERATURES[i]) for i, x in enumerate(got))[1] if got[0] is not None else 1.0
    return model


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``row`` (the caller's columns), ``n_tokens`` and ``posterior`` (in the order of the domains)."""
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(text_col).alias("_text"), tokens(column(text_col)).alias("_words"))
    packed = packed.withColumn("_distinct", F.array_distinct("_words"))
    features = model.features(F.col("_text"), F.col("_words"), F.col("_distinct"))
    scored = packed.select("row", F.size("_words").cast("long").alias("n_tokens"), model.evidence(features).alias("_evidence"))
    return scored.select("row", "n_tokens", model.posterior(F.col("_evidence")).alias("posterior"))


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan for the domains' small Gram matrix, which the caller has made regular."""
    n = len(m)
    a = [[*row, *(float(i == j) for j in range(n))] for i, row in enumerate(m)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[n:] for row in a]


def _rate(posterior: Column, steps: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    for c in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((posterior[i] * F.lit(x) for i, x in enumerate(c)), F.lit(0.0)))
    return rate


def fit_rates(scored: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The gradient steps: one value per domain for each, to be applied in order by :func:`_rate`.

    ``scored`` has n_tokens and posterior. Targets are scaled to sum to 1; the total stays. A step
    is whitened by the Gram matrix of the documents that the projection lets move, those with a
    positive rate; with it few steps are enough. One aggregate gives a step's shares and matrix.
    Stops when every domain's share is within ``tolerance`` of its target, or when a step no longer
    moves the shares (targets out of reach: the least-squares fit), or after ``steps``.
    """
    k = len(targets)
    n = F.col("n_tokens").cast("double")
    p = [F.col("posterior")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if sum(targets) <= 0:
        return []
    goal, done, before = [t / sum(targets) for t in targets], [], None
    for _ in range(steps):
        rated = scored.select("n_tokens", "posterior", _rate(F.col("posterior"), done).alias("rate"))
        free = F.when(F.col("rate") > 0, n).otherwise(0.0)
        got = rated.agg(F.sum(n), *[F.sum(n * F.col("rate") * x) for x in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        total = got[0] or 0.0
        if not total:
            return []
        gap = [x / total - g for x, g in zip(got[1 : k + 1], goal, strict=True)]
        if max(map(abs, gap)) <= tolerance or before and max(abs(a - b) for a, b in zip(gap, before, strict=True)) <= tolerance / 100:
            break
        gram = [[0.0] * k for _ in range(k)]
        for (i, j), x in zip(pairs, got[k + 1 :], strict=True):
            gram[i][j] = gram[j][i] = x / total
        ridge = 1e-9 * max(max(gram[i][i] for i in range(k)), 1e-300)
        inverse = _inverse([[x + ridge * (i == j) for j, x in enumerate(row)] for i, row in enumerate(gram)])
        done.append([sum(m * g for m, g in zip(row, gap, strict=True)) for row in inverse])
        before = gap
    return done


def _thinned(posterior: Column, c: list[float], most: float) -> Column:
    rate = F.lit(1.0) - sum((posterior[i] * F.lit(x) for i, x in enumerate(c)), F.lit(0.0))
    return F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(most)))


def fit_thinning(scored: DataFrame, targets: list[float], most: float = 1, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[float]:
    """One vector ``c`` for :func:`_thinned`: rates in [0, most] whose domain totals are nearest to the targets.

    ``scored`` has n_tokens and posterior. The total is the largest at which no domain needs more
    tokens than there are at rate 1, so the scarcest domain keeps all and only what is too frequent
    is thinned. The rates minimise the squares of the domains' residuals (as shares of all tokens)
    plus ``ridge`` times the token-weighted squared distance from 1: targets out of reach, as with
    a classifier that is never sure, are approached and not paid for with nearly all documents.
    At the optimum rates are ``1 - posterior . c`` cut to the bounds, where ``c`` is the residual
    over the ridge; steps go along the projected gradient, scaled by the Gram matrix of the
    documents that the bounds let move, and are halved until the objective falls: two aggregates
    each. Without tokens or a positive target, ``c`` is zero and all rates are 1.
    """
    k = len(targets)
    n = F.col("n_tokens").cast("double")
    p = [F.col("posterior")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    start = scored.agg(F.sum(n), *[F.sum(n * x) for x in p]).first()
    total = start[0] or 0.0
    wanted = [(there / total, t / sum(targets)) for there, t in zip(start[1:], targets, strict=True) if t > 0] if total and sum(targets) > 0 else []
    if not wanted:
        return [0.0] * k
    scale = min(there / share for there, share in wanted)
    goal = [scale * t / sum(targets) for t in targets]

    def slope(c: list[float]) -> Column:
        return F.lit(1.0) - sum((x * F.lit(v) for x, v in zip(p, c, strict=True)), F.lit(0.0))

    def moved(c: list[float]) -> Column:
        x = slope(c)
        return F.sum(n / total * F.when(x <= 0, 0.0).when(x <= most, x * x / 2).otherwise(x * most - most * most / 2))

    def objective(c: list[float], sum_: float) -> float:
        return sum_ + sum(g * x for g, x in zip(goal, c, strict=True)) + ridge / 2 * sum(x * x for x in c)

    c = [0.0] * k
    for _ in range(steps):
        x = slope(c)
        rate = F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most)))
        free = F.when((x > 0) & (x <= most), n / total).otherwise(0.0)
        got = scored.agg(moved(c), *[F.sum(n / total * rate * y) for y in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        slack = [y - g - ridge * v for y, g, v in zip(got[1 : k + 1], goal, c, strict=True)]
        if max(map(abs, slack)) <= tolerance:
            break
        gram = [[0.0] * k for _ in range(k)]
        for (i, j), v in zip(pairs, got[k + 1 :], strict=True):
            gram[i][j] = gram[j][i] = v
        inverse = _inverse([[v + ridge * (i == j) for j, v in enumerate(row)] for i, row in enumerate(gram)])
        move = [sum(m * g for m, g in zip(row, slack, strict=True)) for row in inverse]
        tries = [[a + b * 2.0**-t for a, b in zip(c, move, strict=True)] for t in range(-2, 12)]
        sums = scored.agg(*[moved(t) for t in tries]).first()
        values = [objective(t, s) for t, s in zip(tries, sums, strict=True)]
        least = min(range(len(tries)), key=lambda t: values[t])
        if values[least] >= objective(c, got[0]):
            break
        c = tries[least]
    return c


def _copies(rate: Column, key: Column) -> Column:
    """A rate of 2.3 gives 2 copies, and a third with chance 0.3 by a hash of the key."""
    unit = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + 1 - F.greatest(unit, F.lit(1e-12))).cast("int")


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """``doc_id, n_tokens, domain, posterior, rate, copies`` for every row.

    ``posterior`` maps domains to their share in the document, ``domain`` is the largest (ties:
    the first by name). Null and empty texts have no tokens; they get posteriors and rates like
    any other. Null ids are given the copies of a null key. Repeated rows are alike. Domains that
    nobody labelled have no posterior and their targets are spread over the rest; without labels,
    or if no target is positive, every rate is 1. An empty table gives an empty result; further
    columns are ignored.
    """
    model = train(docs, labelled, **options)
    own = docs.select("doc_id", "text")
    if not model.domains:
        none = F.lit(None)
        return own.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), none.cast("string").alias("domain"), none.cast("map<string,double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    scored = stored(with_posteriors(own, model).select("row.doc_id", "n_tokens", "posterior"))
    steps = fit_rates(scored, [targets.get(d, 0.0) for d in model.domains])
    names = F.array(*[F.lit(d) for d in model.domains])
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    rated = scored.select("doc_id", "n_tokens", best.alias("domain"), F.map_from_arrays(names, "posterior").alias("posterior"), _rate(F.col("posterior"), steps).alias("rate"))
    return rated.withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, most: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows in their new mix, with the caller's columns; a row comes ``copies`` times.

    ``most`` bounds the rates and so the copies of a row: with 1 no row is repeated, and only
    documents of domains that are too frequent are thinned (see :func:`fit_thinning`). Null and
    empty texts have no tokens, and rates like any other text; rows that repeat, or whose id is
    null, share their draw. Ties in the posterior don't matter, as it is used whole. Without labels
    all rows stay; an empty table stays empty; columns may have any name. Posteriors are computed once and written with their rows.
    """
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    model = train(plain, labelled, **options)
    if not model.domains:
        return docs
    scored = stored(with_posteriors(docs, model, text_col))
    c = fit_thinning(scored.select("n_tokens", "posterior"), [targets.get(d, 0.0) for d in model.domains], most)
    copies = _copies(_let(F.col("posterior"), lambda p: _thinned(p, c, most)), row_field(id_col))
    kept = scored.select("row", copies.alias("copies")).where("copies > 0")
    if most > 1:
        kept = kept.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return kept_columns(kept, docs)
