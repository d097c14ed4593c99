"""Quality classifier with hierarchical empirical Bayes.

A logistic model of simple text measures gives each document's own evidence: its log-likelihood ratio, free of how
common good documents were in the training rows. A site's (host's) share of good documents is the mean of its
documents' probabilities, shrunk to the share of all documents; a path's share is shrunk to its host's. How strongly
follows from how much shares differ beyond chance (method of moments), so sparse sites stay near the prior. A
document's posterior joins its evidence with its path's share, from which its own part is taken out first.

The model is fitted on at most ``SAMPLE`` labelled rows by hash of the id; shares and posteriors cover all rows.

Null texts count as empty. Rows without a label train nothing; with no labels or one kind of labels the evidence is 0. A
null host or path is a group of its own. Rows that repeat an id are documents of their own. An empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import own_name, text_or_empty, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Penalty on weights, and the largest evidence that a document can have.
RIDGE, MOST_EVIDENCE = 1e-3, 12.0
MARKS = "#$%&*|!<>{}[]\\^~_=+@"


def measures(text: str = "text") -> dict[str, Column]:
    """Columns of a text that don't grow with its length."""
    body = text_or_empty(text)
    chars = F.greatest(F.length(body), F.lit(1))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    return {
        "marks": (F.length(body) - F.length(F.translate(body, MARKS, ""))) / chars,
        "capitals": F.regexp_count(body, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(body, F.lit(r"[0-9]")) / chars,
        "variety": (F.log(F.size(F.array_distinct(words)) + 1.0) / F.log(n + 1.0)),
        "word_length": F.log(chars / n),
        "length": F.log(n + 1.0),
    }


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float  # log odds of good among the training rows

    def evidence(self, text: str = "text") -> Column:
        """Log-likelihood ratio of good against bad."""
        found = measures(text)
        total = F.lit(self.bias - self.prior)
        for name, mean, scale, weight in zip(self.names, self.means, self.scales, self.weights):
            total = total + (found[name] - mean) * (weight / scale)
        return F.greatest(F.least(total, F.lit(MOST_EVIDENCE)), F.lit(-MOST_EVIDENCE))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _fitted(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([RIDGE * len(x)] * (x.shape[1] - 1) + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Train on documents that have a label of 0 or 1. Ids with both labels, or several texts, count with each."""
    names = tuple(measures(text))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("label_id"), F.col(label).cast("double").alias("good"))
    size = known.count()
    part = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE * 0.9 / max(size, 1)))
    known = written(known.where(part).limit(SAMPLE), "quality-labels")
    texts = docs.select(F.col(key).alias("text_id"), F.col(text).alias("body"))
    rows = texts.join(known, F.col("text_id") == F.col("label_id")).select(*[c.alias(n) for n, c in measures("body").items()], "good").limit(SAMPLE)
    table = rows.toArrow().to_pandas().to_numpy(dtype="float64", na_value=0.0)
    x, y = table[:, :-1], table[:, -1]
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    flat = (0.0,) * len(names)
    if len(set(y)) < 2:
        return Model(names, flat, (1.0,) * len(names), flat, _logit(share), _logit(share))
    means, scales = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = _fitted((x - means) / scales, y)
    return Model(names, tuple(map(float, means)), tuple(map(float, scales)), tuple(map(float, w[:-1])), float(w[-1]), _logit(share))


def _strength(groups: DataFrame, n: str, good: str, above: Column) -> float:
    """Pseudo-count of the prior: how many documents a group needs to weigh as much as what stands above it. From the
    excess of the groups' squared deviations over what chance gives; three sums reach the driver."""
    p = F.least(F.greatest(above, F.lit(1e-4)), F.lit(1 - 1e-4))
    share = F.col(good) / F.col(n)
    a, b, c = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * F.pow(share - p, F.lit(2))), F.sum(p * (1 - p)), F.sum((F.col(n) - 1) * p * (1 - p))
    ).first()
    if not c or a <= b:
        return 1e6
    return float(np.clip(c / (a - b), 1.0, 1e6))


@dataclass(frozen=True)
class Sites:
    """Sums of the good and of all documents by host and by path, and what shrinks them."""

    table: DataFrame  # host, path, host_n, host_good, path_n, path_good
    share: float
    host_strength: float
    path_strength: float

    def columns(self, own: Column, names: dict[str, str]) -> tuple[Column, Column]:
        """Host's and path's posterior share without the document's own probability ``own``."""
        c = lambda n: F.col(names[n])
        host = (c("host_good") - own + self.host_strength * self.share) / (c("host_n") - 1 + self.host_strength)
        path = (c("path_good") - own + self.path_strength * host) / (c("path_n") - 1 + self.path_strength)
        return host, path


def probability(evidence: Column, share: float) -> Column:
    return 1 / (1 + F.exp(-(evidence + F.lit(_logit(share)))))


def sites(scored: DataFrame) -> Sites:
    """Group sums of rows (host, path, evidence). A group's rows are summed where they are read, before any shuffle."""
    share, old = 0.5, None
    sums = lambda s: scored.agg(F.avg(probability(F.col("evidence"), s))).first()[0]
    for _ in range(12):  # the share of good documents that agrees with its own posteriors
        old, share = share, float(np.clip(sums(share) or 0.5, 1e-3, 1 - 1e-3))
        if abs(share - old) < 1e-4:
            break
    p = probability(F.col("evidence"), share)
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum(p).alias("path_good")), "quality-paths")
    hosts = paths.groupBy(F.col("host").alias("site")).agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    both = written(paths.join(hosts, F.col("host").eqNullSafe(F.col("site"))).drop("site"), "quality-sites")
    host_strength = _strength(both.dropDuplicates(["host"]), "host_n", "host_good", F.lit(share))
    above = (F.col("host_good") + host_strength * share) / (F.col("host_n") + host_strength)
    return Sites(both, share, host_strength, _strength(both, "path_n", "path_good", above))


def judged(rows: DataFrame, found: Sites, host: str, path: str, evidence: str, prefix: str = "") -> DataFrame:
    """Add host_share, path_share, posterior and keep (posterior of at least one half) to rows with evidence."""
    names = {c: own_name(rows, f"{prefix}{c}") for c in found.table.columns}
    table = found.table.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.join(table, rows[host].eqNullSafe(table[names["host"]]) & rows[path].eqNullSafe(table[names["path"]]))
    host_share, path_share = found.columns(probability(F.col(evidence), found.share), names)
    safe = F.least(F.greatest(path_share, F.lit(1e-4)), F.lit(1 - 1e-4))
    posterior = 1 / (1 + F.exp(-(F.col(evidence) + F.log(safe / (1 - safe)))))
    return joined.select(
        *[F.col(c) for c in rows.columns], host_share.alias(f"{prefix}host_share"), path_share.alias(f"{prefix}path_share"),
        posterior.alias(f"{prefix}posterior"), (posterior >= 0.5).alias(f"{prefix}keep"),
    )


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged. Texts are measured once and written beside their evidence;
    no text is shuffled."""
    model = fit(docs, labels)
    evidence = own_name(docs, "quality_evidence")
    prefix = own_name(docs, "quality_") + "_"
    scored = written(docs.withColumn(evidence, model.evidence()), "quality-evidence")
    found = sites(scored.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(evidence).alias("evidence")))
    return judged(scored, found, host, path, evidence, prefix).where(F.col(f"{prefix}keep")).select(*docs.columns)
