"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x), with one weight vector for all thresholds theta_0 < theta_1 < ... Features are
a text's words and the first letters of its words, so that endings that training never saw still count; x is
1 + log(occurrences). Features are chosen by their likelihood ratio against the grade being above
0. The result is the expected grade, and one decision: a text is toxic where the probability of a grade above 0 reaches
the model's cut, and its grade is 0 where it isn't.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, materialise

PREFIXES = (4, 5)
_WORD = regex.compile(r"\p{L}+").findall


def words(text: str | None) -> Counter[str]:
    return Counter(_WORD((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}-" for n in PREFIXES if len(word) > n]]


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]
    #: The probability of a grade above 0 from which a text counts as toxic; hardly any clean text of the sample has more.
    cut: float = 0.5
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def found(self, text: str | None) -> Counter[str]:
        """Occurrences of each known feature in a text."""
        out: Counter[str] = Counter()
        known = self.cache
        for w, n in words(text).items():
            if (hits := known.get(w)) is None:
                hits = tuple(f for f in features(w) if f in self.weights)
                if len(known) < 120_000:
                    known[w] = hits
            for f in hits:
                out[f] += n
        return out

    def above(self, x: Counter[str]) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        z = sum(self.weights[f] * (1 + np.log(n)) for f, n in sorted(x.items()))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - z, -500, 500)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 2e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the cumulative-link model, by Adam on the penalised likelihood."""
    n, d = x.shape
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(start), 0.05))
    p = np.concatenate([np.zeros(d), [start[0]], gap])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, theta = p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
        z = x @ w
        up = np.concatenate([theta, [np.inf]])[y] - z
        low = np.concatenate([[-np.inf], theta])[y] - z
        su, sl = 1 / (1 + np.exp(-np.clip(up, -500, 500))), 1 / (1 + np.exp(-np.clip(low, -500, 500)))
        prob = np.maximum(su - sl, 1e-9)
        du, dl = su * (1 - su) / prob, sl * (1 - sl) / prob
        g_theta = np.array([-(du * (y == k)).sum() + (dl * (y == k + 1)).sum() for k in range(grades - 1)]) / n
        g = np.concatenate([x.T @ ((du - dl) / n) + l2 * w, [g_theta.sum()], [g_theta[k + 1 :].sum() * np.exp(p[d + 1 + k]) for k in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 6000, levels: int = 3, most_features: int = 2048) -> OrdinalModel:
    """A model from docs(doc_id, text) and labels(doc_id, toxic): about most_toxic and most_clean labels of either kind,
    chosen by a hash of doc_id before their texts are looked up, so that the sample can be broadcast and no text is
    shuffled but its own.

    toxic may be a grade itself (0 and up to any number of grades). A mere 0/1 is turned into grades: toxic texts are
    cut into as many levels by the number of their telling words; they say no more than that about severity. Null labels and texts are left out. Texts with the same
    smallest word hashes of three kinds (copies and near copies, mostly) count once. The most_features most telling
    features of the sample have weights. Without both kinds, as with an empty table, the model finds nothing toxic.
    """
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    size = dict(labelled.groupBy((F.col("y") > 0).alias("t")).count().collect())
    if len(size) < 2:
        return OrdinalModel({}, [1.0])
    rate = F.when(F.col("y") > 0, F.lit(most_toxic / size[True])).otherwise(F.lit(most_clean / size[False]))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 256):
            kinds = [words(t) for t in batch.column(0).to_pylist()]
            least = [xxhash.xxh3_64_intdigest(repr([min((xxhash.xxh3_64_intdigest(w, seed) for w in k), default=0) for seed in range(3)])) >> 1 for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(least, pa.int64()), pa.array([sorted(k) for k in kinds], pa.list_(pa.string())), pa.array([[k[w] for w in sorted(k)] for k in kinds], pa.list_(pa.int32()))], ["y", "least", "words", "times"])

    rows = arrow_map(sample.select("text", "y"), parts, "y int, least long, words array<string>, times array<int>")
    # one of the texts with equal least hash; the choice doesn't depend on the order of rows
    rows = materialise(rows.groupBy("least", (F.col("y") > 0).alias("t")).agg(F.min(F.struct("y", "words", "times")).alias("s")).select("s.*"), "toxic-sample")
    total = dict(rows.groupBy((F.col("y") > 0).alias("t")).count().collect())
    pos, neg = total.get(True, 0), total.get(False, 0)
    if not pos or not neg:
        return OrdinalModel({}, [1.0])
    grow = F.expr("transform(words, w -> array_compact(array(w, " + ", ".join(f"if(length(w) > {n}, concat(substring(w, 1, {n}), '-'), null)" for n in PREFIXES) + ")))")
    each = rows.select("y", F.explode(F.array_distinct(F.flatten(grow))).alias("f")).groupBy("f").agg(F.count_if(F.col("y") > 0).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    term = lambda o, kind: F.when(F.col(o) > 0, 2 * F.col(o) * F.log(F.col(o) / ((F.col("a") + F.col("b")) * (kind / (pos + neg))))).otherwise(F.lit(0.0))
    each = each.where((F.col("a") >= max(3, pos // 150)) & (F.col("a") * neg > 4 * F.col("b") * pos)).withColumn("g2", term("a", pos) + term("b", neg))
    names = [r["f"] for r in each.where("g2 > 15").orderBy(F.desc("g2"), "f").limit(most_features).collect()]
    if not names:
        return OrdinalModel({}, [1.0])
    model = OrdinalModel(dict.fromkeys(names, 0.0), [0.0])

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: i for i, f in enumerate(names)}
        for batch in chunks(batches, 256):
            out, telling = [], []
            for ws, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tally: Counter[int] = Counter()
                for w, n in zip(ws, times, strict=True):
                    for f in features(w):
                        if f in number:
                            tally[number[f]] += n
                telling.append(sum(any(f in number for f in features(w)) for w in ws))
                out.append([{"f": f, "n": n} for f, n in sorted(tally.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(telling, pa.int32()), pa.array(out, pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int32())])))], ["y", "telling", "x"])

    data = sorted((r["y"], r["telling"], [(e["f"], e["n"]) for e in r["x"]]) for r in arrow_map(rows.select("y", "words", "times"), vectors, "y int, telling int, x array<struct<f int, n int>>").collect())
    y = np.array([r[0] for r in data])
    if y.max() == 1 and levels > 1:
        told = np.array([r[1] for r in data])
        cuts = np.quantile(told[y > 0], np.arange(1, levels) / levels)
        y = np.where(y > 0, 1 + (told[:, None] > cuts[None, :]).sum(1), 0)
        y = np.searchsorted(np.unique(y), y)  # grades without texts fall away
    x = np.zeros((len(data), len(names)), np.float32)
    for i, r in enumerate(data):
        for f, n in r[2]:
            x[i, f] = 1 + np.log(n)
    weights, thresholds = fit_ordinal(x, y, int(y.max()) + 1)
    model.weights = {n: float(w) for n, w in zip(names, weights, strict=True) if abs(w) > 1e-3}
    model.thresholds = [float(t) for t in thresholds]
    clean = 1 / (1 + np.exp(np.clip(thresholds[0] - x[y == 0] @ weights, -500, 500)))
    model.cut = float(np.clip(np.quantile(clean, 0.995), 0.1, 0.5))
    return model


SCHEMA = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"


def score_toxicity(docs: DataFrame, model: OrdinalModel, threshold: float | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text), as SCHEMA has it: the expected grade, the grade, the probability of a grade
    above 0, and whether that reaches threshold (the model's own cut where none is given).

    grade: 0 where the text isn't toxic, else the most probable one above 0. Whole texts count. A null or empty text has
    no features, and so the grades' base rates. Repeated rows are scored alike; other columns are ignored; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        least = m.cut if threshold is None else threshold
        for batch in chunks(batches, 1024):
            p = np.array([m.above(m.found(t.as_py())) for t in batch.column(1)])
            each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            toxic = p[:, 0] >= least
            grade = np.where(toxic, 1 + each[:, 1:].argmax(1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(grade), pa.array(p[:, 0]), pa.array(toxic)], [c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
