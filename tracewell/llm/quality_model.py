"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic regression on a document's counts gives its own evidence. Grouped sums of that evidence over all documents
give each host's and each path's mean; the spread between and within groups, by the method of moments, says how far a
group's mean is shrunk: a path's towards its host's posterior, a host's towards the global mean. The path's posterior
replaces the global mean as the document's prior, with a weight from 0 to 1 that labels fit: where sites tell nothing
about quality, they decide nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, skewed_left_join
from .quality_rules import count_texts

#: A group's variance weighs as much as so many documents of the variance within all groups.
WITHIN = 10


def signals() -> dict[str, Column]:
    """A document's features from its counts; all 0 without words."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "log_words": F.log1p(n.cast("double")),
        "short": (n < 8).cast("double"),
        "symbols": F.sqrt(share(F.col("n_symbols"), chars)),
        "dup_lines": F.sqrt(share(F.col("n_dup_lines"), F.col("n_lines"))),
        "repeats": F.sqrt(share(F.col("n_repeat_words"), n)),
        "upper": F.sqrt(share(F.col("n_upper"), chars)),
        "sameness": F.when(n < 8, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("n_distinct") / F.pow(n.cast("double"), F.lit(0.8)))),
        "word_length": F.least(F.lit(3.0), F.log1p(share(chars, n))),
    }


@dataclass
class Logistic:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def logit(self) -> Column:
        out = F.lit(self.bias)
        for x, m, s, w in zip(signals().values(), self.mean, self.scale, self.weights, strict=True):
            out = out + F.lit(w) * ((x - F.lit(m)) / F.lit(s))
        return F.least(F.lit(12.0), F.greatest(F.lit(-12.0), out))


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, quality) of about most labels, by a hash of doc_id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    return known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) < F.lit(most / max(n, 1) * (1 << 20)))


def fit_evidence(counted: DataFrame, known: DataFrame, l2: float = 1e-3) -> Logistic:
    """A regression on labelled documents: counted(doc_id, counts), known(doc_id, quality) as labelled() gives it.

    With labels of one kind only, every document gets the same evidence.
    """
    rows = counted.join(known, "doc_id").select("quality", *[c.alias(k) for k, c in signals().items()]).collect()
    d = len(signals())
    x, y = np.array([r[1:] for r in sorted(rows)], float).reshape(-1, d), np.array([r[0] for r in sorted(rows)], float)
    if len(set(y.tolist())) < 2:
        return Logistic([0.0] * d, [1.0] * d, [0.0] * d, 0.0 if not len(y) else (3.0 if y[0] else -3.0))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(d + 1)
    ridge = np.diag([*[l2 * len(y)] * d, 1e-9])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean.tolist(), scale.tolist(), w[:d].tolist(), float(w[d]))


def _shrunk(n: str, mean: str, within: str, prior: Column, between: float) -> Column:
    """Posterior mean of a group: prior + B (mean - prior), B = between / (between + within / n)."""
    b = F.lit(between) / (F.lit(between) + F.col(within) / F.col(n))
    return prior + b * (F.col(mean) - prior)


def _between(groups: DataFrame, n: str, mean: str, within: str, prior: Column) -> float:
    """Variance between groups about their priors, by the method of moments; at least a little."""
    r = groups.agg(F.sum(F.col(n) * (F.col(mean) - prior) ** 2 - F.col(within)).alias("over"), F.sum(n).alias("n")).first()
    return max(1e-4, (r["over"] or 0.0) / max(r["n"] or 1, 1))


def site_posteriors(evidence: DataFrame, host: str, path: str, p: str = "p") -> tuple[DataFrame, float]:
    """(host, path, n, host_mean, path_mean) with posterior means of p, and the global mean. Sums run over all rows."""
    paths = evidence.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("q"))
    paths = materialise(paths, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("over")).first()
    mean = (total["s"] or 0.0) / max(total["n"] or 1, 1)
    pooled = max(1e-6, (total["over"] or 0.0) / max(total["n"] or 1, 1))
    # of few documents the own variance says little: one document has none at all
    var = lambda: (F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")) + F.lit(WITHIN * pooled)) / (F.col("n") + WITHIN)
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    hosts = hosts.select(F.col(host).alias("__host"), F.col("n").alias("hn"), (F.col("s") / F.col("n")).alias("hm"), var().alias("hv"))
    hosts = materialise(hosts, "hosts")
    hosts = hosts.withColumn("host_mean", _shrunk("hn", "hm", "hv", F.lit(mean), _between(hosts, "hn", "hm", "hv", F.lit(mean))))
    paths = paths.select(host, path, "n", (F.col("s") / F.col("n")).alias("pm"), var().alias("pv"))
    paths = materialise(paths.join(hosts.select("__host", "host_mean"), F.col(host) == F.col("__host")).drop("__host"), "sites")
    spread = _between(paths, "n", "pm", "pv", F.col("host_mean"))
    return paths.select(host, path, "n", "host_mean", _shrunk("n", "pm", "pv", F.col("host_mean"), spread).alias("path_mean")), mean


def fit_prior_weight(rows: list[tuple[int, float, float]]) -> float:
    """The weight w from 0 to 1 that fits P(good) = sigmoid(l + w * shift) to rows (quality, l, shift) best.

    It leans on 1, Bayes' rule, as much as one label would; without labels it is 1.
    """
    if not rows:
        return 1.0
    y, l, shift = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
    w = 1.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(l + w * shift, -30, 30)))
        step = (((y - p) * shift).sum() - (w - 1)) / ((p * (1 - p) * shift * shift).sum() + 1)
        w = float(np.clip(w + np.clip(step, -0.5, 0.5), 0.0, 1.0))
        if abs(step) < 1e-9:
            break
    return w


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL; null where there is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host, F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]+)/", 1), F.lit(""))


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, url: str | None = None, most_labels: int = 20_000, prior_weight: float | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, and the host and path columns): doc_id, evidence (the document's own
    probability), host_prior, path_prior (posterior means of its sites), quality (the combined probability), kept.

    kept: quality >= threshold, and the text has a word. url: a column whose host and first path segment stand for
    the host and path columns. A null host or path is a site like any other. prior_weight: the weight of the sites'
    part, fitted on labels where none is given. A null or empty text has no words. Repeated rows count as often as they
    occur, in the sums too. About most_labels labels are used; those whose doc_id isn't in docs have no effect. Other
    columns are ignored; no rows give no rows.
    """
    null = "\0null"
    sites_of = site_of(F.col(url)) if url else (F.col(host).cast("string"), F.col(path).cast("string"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(sites_of[0], F.lit(null)).alias("host"), F.coalesce(sites_of[1], F.lit(null)).alias("path"), "text")
    counted = materialise(count_texts(keyed, ["doc_id", "host", "path"]), "quality-counts")
    known = materialise(labelled(labels, most_labels), "known")
    model = fit_evidence(counted, known)
    own = counted.select("doc_id", "host", "path", "n_words", model.logit().alias("l")).withColumn("p", 1 / (1 + F.exp(-F.col("l"))))
    sites, mean = site_posteriors(own, "host", "path")
    sites = materialise(sites, "priors")
    shift = _logit(F.col("path_mean")) - _logit(F.lit(mean))
    if prior_weight is None:
        sample = own.join(known, "doc_id").select("quality", "l", "host", "path")
        prior_weight = fit_prior_weight([tuple(r) for r in sites.join(sample, ["host", "path"]).select("quality", "l", shift).collect()])
    out = skewed_left_join(own, sites, ["host", "path"], "n", ["doc_id", "n_words"])
    quality = 1 / (1 + F.exp(-(F.col("l") + F.lit(prior_weight) * shift)))
    return out.select("doc_id", F.col("p").alias("evidence"), F.col("host_mean").alias("host_prior"), F.col("path_mean").alias("path_prior"), quality.alias("quality"), ((quality >= threshold) & (F.col("n_words") > 0)).alias("kept"))
