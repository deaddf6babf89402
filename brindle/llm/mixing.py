"""Mixing sources to target weights: soft domain membership, nonnegative rates by projected gradient."""

from __future__ import annotations

import json
import math
import warnings
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, save, text_or_empty

TRAIN_ROWS = 6000  # labelled documents the classifier is fitted on, at most
MIN_DOCS = 5  # labelled documents of a language that must have a telltale word
#: A word is telltale in a language if one domain has it RATIO times as often as all others together, with a likelihood
#: ratio statistic of SIGNIFICANCE or more (about one chance in 10,000). All such words count, whatever their number.
SIGNIFICANCE, RATIO = 15.0, 2.5
POOLED = 2.0  # rows of the language's average that a domain's share of a word starts from
STEM_LETTERS = (6, 8)  # words this long or longer count by such beginnings, too
SPACES, NO_LETTERS = r"[ \t\n\x0B\f\r]+", r"[^\p{L}\p{M} \t\n\x0B\f\r]+"
ROUNDS = 40
TOLERANCE = 1e-6  # relative gap that ends the rounds
REPORTED = 1e-2  # relative gap beyond which targets count as missed
CALM = 1e-4  # weight of a rate's distance from 1 against the gap
IDENTIFIED = 0.25  # least share of explained variance of a direction in which rates are moved
DOMAINS = ("clean", "toxic", "low")
#: Wanted expected tokens of each domain, as a share of what it has.
KEEP = (1.0, 0.25, 0.5)
SHAPE = ["f_symbols", "f_upper", "f_distinct", "f_length"]


def domain_of(quality: Column, toxic: Column) -> Column:
    """A labelled row's domain: 1 toxic if its toxic flag is set, else 0 clean or 2 low by quality."""
    return F.when(toxic == 1, 1).when(quality == 1, 0).when(quality == 0, 2)


def with_features(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """lang, distinct words (``plain``: letters, lower case), tokens, and shape features of a table (doc_id, text, lang);
    ``carry`` columns stay."""
    body = F.col("body")
    n = F.greatest(F.length(body), F.lit(1)).cast("double")
    return (
        df.select(*carry, "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("body"))
        .withColumn("tokens", F.regexp_count("body", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long"))
        .withColumn("plain", F.array_distinct(F.split(F.regexp_replace(F.lower("body"), NO_LETTERS, ""), SPACES)))
        .withColumn("k", F.greatest(F.col("tokens"), F.lit(1)).cast("double"))
        .select(
            *carry, "doc_id", "lang", "tokens", "plain",
            ((F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>!]+", ""))) / F.col("k")).alias("f_symbols"),
            ((F.length(body) - F.length(F.regexp_replace(body, r"[A-Z]+", ""))) / n).alias("f_upper"),
            (F.size("plain") / F.col("k")).alias("f_distinct"),
            F.log(n / F.col("k")).alias("f_length"),
        )
    )


def stems(k: int, of: Column) -> Column:
    """The distinct stems of k letters of an array of words that all have as many or more."""
    return F.array_distinct(F.transform(of, lambda w: F.concat(F.substring(w, 1, k), F.lit("-"))))


def with_stems() -> Column:
    """All words and stems of with_features()'s rows, each once."""
    return F.concat("plain", *[stems(k, F.filter("plain", lambda w: F.length(w) >= k)) for k in STEM_LETTERS])


@dataclass
class DomainModel:
    """Naive Bayes: by language log priors and telltale words with the share of documents that have them, by domain; mean
    and variance of shape features by domain. A telltale word counts when it is missing, too. Language "" stands for
    any that is not listed."""

    prior: dict[str, list[float]]
    words: dict[str, dict[str, list[float]]]
    shape: list[list[tuple[float, float]]]

    def posteriors(self, featured: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """doc_id, tokens and p, an array<double> over DOMAINS, of with_features()'s rows.

        Steps are columns of their own: an expression inside a lambda is evaluated for each element. The model is one
        literal, folded once. What a word costs does not depend on how many are telltale: words and beginnings are looked
        up in a set of those of all languages, and only what is found there in its own language's hash buckets.
        """
        base = {g: [p + sum(math.log1p(-share[d]) for share in self.words[g].values()) for d, p in enumerate(prior)] for g, prior in self.prior.items()}
        odds: dict[str, list[dict[str, list[float]]]] = {}
        for g, words in self.words.items():
            odds[g] = [{} for _ in words or [""]]
            for w, shares in sorted(words.items()):
                odds[g][zlib.crc32(w.encode()) % len(odds[g])][w] = [math.log(x / (1 - x)) for x in shares]
        known = sorted(set().union(*self.words.values()))

        def telltale(k: int) -> Column:
            beginnings = [w[:k] for w in known if len(w) == k + 1 and w[k] == "-"]
            return stems(k, F.filter("plain", lambda w: F.substring(w, 1, k).isin(beginnings)))

        def odds_of(w: Column) -> Column:
            buckets = table(odds, "array<map<string,array<double>>>")
            return F.element_at(F.element_at(buckets, (F.crc32(w) % F.size(buckets) + 1).cast("int")), w)

        def table(value: dict, kind: str) -> Column:
            return F.element_at(F.from_json(F.lit(json.dumps(value)), f"map<string,{kind}>"), F.col("group"))

        shape = [F.lit(0.0)] * len(DOMAINS)
        for d, fitted in enumerate(self.shape):
            for name, (mean, var) in zip(SHAPE, fitted, strict=True):
                z = (F.col(name) - F.lit(mean)) * (F.col(name) - F.lit(mean)) / F.lit(2 * var)
                shape[d] = shape[d] - F.least(z, F.lit(12.0)) - F.lit(0.5) * F.log(F.lit(var))
        keep = [*carry, "doc_id", "tokens"]
        group = F.when(F.col("lang").isin(*[g for g in odds if g]), F.col("lang")).otherwise("") if len(odds) > 1 else F.lit("")
        shaped = featured.select(*keep, "plain", group.alias("group"), F.array(*shape).alias("shape"))
        hits = shaped.select(*keep, "group", F.zip_with("shape", table(base, "array<double>"), lambda x, y: x + y).alias("s"), F.concat(F.filter("plain", lambda w: w.isin(known)), *[telltale(k) for k in STEM_LETTERS]).alias("hit"))
        each = hits.select(*keep, "s", F.filter(F.transform("hit", odds_of), lambda o: o.isNotNull()).alias("o"))
        scored = each.select(*keep, F.aggregate("o", F.col("s"), lambda a, o: F.zip_with(a, o, lambda x, y: x + y)).alias("s"))
        raised = scored.select(*keep, "s", F.array_max("s").alias("top")).select(*keep, F.transform("s", lambda x: F.exp(x - F.col("top"))).alias("e"))
        summed = raised.select(*keep, "e", F.aggregate("e", F.lit(0.0), lambda a, y: a + y).alias("z"))
        return summed.select(*keep, F.transform("e", lambda x: x / F.col("z")).alias("p"))


def _likelihood_ratio(a: Column, n: Column, b: Column, m: Column) -> Column:
    """The G statistic of a in n against b in m; 1 degree of freedom."""
    share = (a + b) / (n + m)

    def cell(x: Column, want: Column) -> Column:
        return F.when(x > 0, x * F.log(x / want)).otherwise(0.0)

    return 2 * (cell(a, n * share) + cell(n - a, n * (1 - share)) + cell(b, m * share) + cell(m - b, m * (1 - share)))


def fit_domains(docs: DataFrame, labels: DataFrame) -> DomainModel:
    """Fit on at most TRAIN_ROWS labelled documents, those of the smallest id hashes; docs has doc_id, text, lang.

    Cases: of an id's several labels toxic and low quality win, of its several texts the one of the least hash trains;
    a domain without labelled rows gets the prior of one row and the shape of all rows; null languages are one.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = known.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    hits = docs.select("doc_id", "text", "lang").where("text IS NOT NULL").join(F.broadcast(known), "doc_id")  # TRAIN_ROWS rows of two numbers
    one = hits.groupBy("doc_id", "domain").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), "lang")).alias("row"))
    rows = save(spark, with_features(one.select("doc_id", "domain", "row.text", "row.lang"), ["domain"]).withColumn("words", with_stems()), "labelled")
    k = range(len(DOMAINS))
    moments = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{m}") for c in SHAPE for m, f in (("m", F.avg), ("v", F.var_pop))]]
    stats = {r["domain"]: r for r in rows.groupBy("domain").agg(*moments).collect()}
    every = rows.agg(*moments).first()
    shape = [[(float((stats.get(d) or every)[f"{c}_m"] or 0.0), float((stats.get(d) or every)[f"{c}_v"] or 0.0) + 1e-3) for c in SHAPE] for d in k]
    counts: dict[str, list[int]] = {"": [stats[d]["n"] if d in stats else 0 for d in k]}
    for r in rows.groupBy("lang", "domain").count().collect():
        counts.setdefault(r["lang"], [0 for _ in k])[r["domain"]] += r["count"] if r["lang"] else 0
    spoken = rows.select("domain", F.explode("words").alias("w"), "lang")
    total = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{d}") for d in k]
    seen = spoken.where("lang <> ''").groupBy("lang", "w").agg(*total).unionByName(spoken.groupBy("w").agg(*total).withColumn("lang", F.lit("")))
    sizes = spark.createDataFrame([(g, *map(float, n)) for g, n in counts.items()], "lang string, " + ", ".join(f"m{d} double" for d in k))
    judged = seen.where(F.expr(" + ".join(f"n{d}" for d in k)) >= MIN_DOCS).where("w <> ''").join(F.broadcast(sizes), "lang")
    n_all, m_all = (sum((F.col(f"{c}{d}") for d in k[1:]), F.col(f"{c}0")) for c in "nm")

    def wins(d: int) -> Column:
        n, m = F.col(f"n{d}"), F.col(f"m{d}")
        more = n * (m_all - m + 1) >= RATIO * (n_all - n + 0.1) * (m + 1)
        return (m > 0) & (m_all > m) & more & (_likelihood_ratio(n, m, n_all - n, m_all - m) >= SIGNIFICANCE)

    words: dict[str, dict[str, list[float]]] = {g: {} for g in counts}
    for r in judged.where(wins(0) | wins(1) | wins(2)).collect():
        m = counts[r["lang"]]
        pooled = (sum(r[f"n{d}"] for d in k) + 0.1) / (sum(m) + 1.0)
        words[r["lang"]][r["w"]] = [(r[f"n{d}"] + POOLED * pooled) / (m[d] + POOLED) for d in k]
    prior = {g: [math.log(max(1, x) / sum(max(1, y) for y in n)) for x in n] for g, n in counts.items()}
    forget(spark, rows)
    return DomainModel(prior, words, shape)


def descent_metric(gram: list[list[float]], have: Sequence[float]) -> list[list[float]]:
    """The inverse of the Gram matrix sum(tokens * p * p') in the directions that memberships tell apart.

    Scaled by what the domains have, its eigenvalues lie between 0 (all rows have one membership in this direction, so
    only extreme rates would move it) and 1 (every row is wholly on one side): the share of explained variance.
    Directions below IDENTIFIED are left alone.
    """
    scale = np.array([1 / math.sqrt(h) if h > 0 else 0.0 for h in have])
    value, vector = np.linalg.eigh(np.array(gram) * scale[:, None] * scale)
    inverse = np.where(value >= IDENTIFIED, 1 / np.maximum(value, IDENTIFIED), 0.0)
    return ((vector * inverse) @ vector.T * scale[:, None] * scale).tolist()


@dataclass
class Fit:
    """How far the rounds came: the largest gap between a domain's expected tokens and its target, relative to what it has."""

    rounds: int
    missed: float


def fitted_rates(members: DataFrame, targets: Sequence[float]) -> tuple[Column, Fit]:
    """The rate of each row of a (tokens, p) table: r >= 0, near 1, with sum(tokens*r*p[k]) near targets[k].

    Projected gradient descent on the squared distance g to the targets, in the metric M^-1 of descent_metric() for all
    rows, plus CALM * sum(tokens * (r - 1)^2). In that metric the curvature is at most 1 + CALM, so the step is
    1 / (1 + CALM) and every round comes closer: r becomes max(0, r - step * (p' M^-1 g + CALM * (r - 1))). A domain
    whose memberships explain less than IDENTIFIED of their own variance is left at what it has, and its target is
    missed: no rates but extreme ones would meet it. A round is one aggregate of a
    sum per domain over the table. A row's rate is a fold over the steps so far, so nothing is stored or shuffled
    between rounds. Missed targets are reported.
    """
    k = len(targets)
    steps: list[list[float]] = []
    step = 1 / (1 + CALM)
    p = [F.col("p")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = members.agg(*[F.coalesce(F.sum(F.col("tokens") * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in pairs], *[F.coalesce(F.sum(F.col("tokens") * p[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k)]).first()
    have = [sums[f"t{i}"] for i in range(k)]
    whole = max(1.0, sum(have))
    told = [(sums[f"m{i}_{i}"] / h - h / whole) / (1 - h / whole) if 0 < h < whole else 1.0 for i, h in enumerate(have)]
    aim = [t if x >= IDENTIFIED else h for t, h, x in zip(targets, have, told, strict=True)]
    metric = descent_metric([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], have)

    def rate() -> Column:
        if not steps:
            return F.lit(1.0)
        listed = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")

        def after(r: Column, s: Column) -> Column:
            move = F.col("p")[0] * s[0]
            for i in range(1, k):
                move = move + F.col("p")[i] * s[i]
            return F.greatest(F.lit(0.0), r + move - F.lit(step * CALM) * (r - F.lit(1.0)))

        return F.aggregate(listed, F.lit(1.0), after)

    last = math.inf
    while True:
        live = members.select("tokens", "p", rate().alias("r"))
        sums = live.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("r") * p[i]), F.lit(0.0)).alias(f"a{i}") for i in range(k)]).first()
        gap = [t - sums[f"a{i}"] for i, t in enumerate(aim)]
        missed = max(abs(t - sums[f"a{i}"]) / max(1.0, h) for i, (t, h) in enumerate(zip(targets, have, strict=True)))
        far = max(abs(g) / max(1.0, h) for g, h in zip(gap, have, strict=True))
        if far <= TOLERANCE or abs(last - far) <= 1e-3 * far or len(steps) == ROUNDS:
            break
        last = far
        steps.append([step * sum(m * g for m, g in zip(row, gap, strict=True)) for row in metric])
    if missed > REPORTED:
        warnings.warn(f"mixing targets are missed by {missed:.1%} of a domain's tokens after {len(steps)} rounds", stacklevel=2)
    return rate(), Fit(len(steps), missed)


def _copies() -> Column:
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("copies")), 11).cast("double") * F.lit(2.0**-53)
    return F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long")


def _base(docs: DataFrame) -> list[Column]:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), lang]


def fit_mixing(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: Sequence[float]) -> tuple[DomainModel, DataFrame, Column, Fit]:
    """(classifier, every row's doc_id, tokens and posteriors, rate of such a row, how near the targets came)."""
    base = docs.select(*_base(docs))
    model = fit_domains(base, labels)
    members = save(spark, model.posteriors(with_features(base)), "memberships")
    have = members.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(DOMAINS))]).first()
    return model, members, *fitted_rates(members, [s * have[f"t{i}"] for i, s in enumerate(keep)])


def mixing_table(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: Sequence[float] = KEEP) -> DataFrame:
    """Per row: doc_id, tokens, p_clean, p_toxic, p_low, rate, copies, missed.

    ``copies`` is the rate rounded down or up by the hash of doc_id, so that it is right on average; ``missed`` is the
    same in all rows, the largest gap to a target as a share of the domain's tokens (a warning tells of more than 1 %).
    Cases: a null text has no tokens, posteriors by shape alone, and any rate leaves the totals as
    they are; a null doc_id is rounded by the hash of null; equal rows get equal rates; without
    labels all documents have one posterior; a table without ``lang`` has one language; other columns are ignored;
    empty in, empty out.
    """
    _, members, rate, fit = fit_mixing(spark, docs, labels, keep)
    return members.select("doc_id", "tokens", "p", rate.alias("rate")).select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", _copies().alias("copies"), F.lit(fit.missed).alias("missed"))


def mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: Sequence[float] = KEEP) -> DataFrame:
    """docs with each row as often as its ``copies`` say, all columns as they were. Posteriors are worked out again beside
    the row's other columns, which is cheaper than a shuffle of all texts to join them.

    Cases as in mixing_table(); columns of any name are kept apart from the operator's own; empty in, empty out.
    """
    model, members, rate, _ = fit_mixing(spark, docs, labels, keep)
    carry = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, carry, strict=True)], *_base(docs))
    rated = model.posteriors(with_features(rows, carry), carry).select(*carry, "doc_id", rate.alias("rate")).select(*carry, _copies().alias("copies"))
    forget(spark, members)
    # outer: a test of the array's size would be pushed below with all of its expressions
    out = rated.select(*carry, F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).where("one IS NOT NULL")
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, carry, strict=True)])


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_table(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
