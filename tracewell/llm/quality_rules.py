"""Quality rules with thresholds that adapt to language and source.

A pass over whole texts counts what the rules look at. Each rate is smoothed by its text's size (a stray symbol of a
short text is little evidence) and taken as a logarithm, so that rates without any hit have a spread too. Per
(language, source) a mergeable quantile sketch (KLL) of each rate gives its upper fence: the upper quartile and some
times the distance between the quartiles. Sketches are merged upwards, not built anew: a group's own fence and that of
its language (and that one's and that of all documents) are averaged by numbers of documents, so that a small group
leans on its language without any switch. The fences are joined back and decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, arrow_map, chunks, hash_words, materialise, skewed_left_join, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_distinct long"


@dataclass(frozen=True)
class Rule:
    """Keep while log(rate) <= q3 + reach * max(q3 - q1, LEAST_SPREAD), quartiles of log(rate) within the group."""

    name: str
    reach: float


RULES = (Rule("symbol_rate", 3.0), Rule("dup_line_rate", 2.0), Rule("repeat_rate", 3.0), Rule("upper_rate", 4.0), Rule("sameness", 4.0))
#: Between the quartiles of a group of like documents, so that a hair's difference fails nothing.
LEAST_SPREAD = 0.02
FEWEST_WORDS = 20
#: A group's parent weighs as much as so many documents.
PRIOR = 200
KLL_K = 400


def counts(text: bytes | None, cache: WordHash) -> tuple[int, ...]:
    """The counts of COUNTS for a whole text."""
    b = text or b""
    words = b.split()
    n = len(words)
    if not n:
        return (0,) * 8
    joined = b"".join(words)
    raw = np.frombuffer(joined, np.uint8)
    chars = len(raw) - int(((raw & 0xC0) == 0x80).sum())
    tally = np.bincount(raw, minlength=128)
    symbols = int(tally[list(SYMBOLS)].sum())
    lines = [x for x in b.split(b"\n") if x.strip()]
    h = hash_words(words, cache)
    w = window_hashes(h, WINDOW)
    repeated = 0
    if len(w):
        _, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
        hit = (times[inverse] > 1).astype(np.int32)
        step = np.zeros(n + 1, np.int32)
        step[: len(w)] += hit
        step[WINDOW : WINDOW + len(w)] -= hit
        repeated = int((np.cumsum(step[:n]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), int(tally[65:91].sum()), len(np.unique(h))


def count_texts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns of docs (with column text), with the counts of each whole text; a null text has no words."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), COUNTS])
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in chunks(batches, 1024):
            rows = [counts(t.as_py(), cache) for t in batch.column(len(keys))]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *cols], [*keys, *names])

    return arrow_map(docs.select(*keys, F.col("text").cast("binary").alias("__text")), run, schema)


def rates(df: DataFrame) -> DataFrame:
    """df with the logarithms of the rates, each smoothed by its text's size."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return df.withColumns({
        "symbol_rate": F.log((F.col("n_symbols") + 1) / (chars + 200)),
        "dup_line_rate": F.log((F.col("n_dup_lines") + 1) / (F.col("n_lines") + 5)),
        "repeat_rate": F.log((F.col("n_repeat_words") + 1) / (n + 50)),
        "upper_rate": F.log((F.col("n_upper") + 1) / (chars + 200)),
        # of long texts many words repeat: distinct words are held against what a text of that length tends to have
        "sameness": F.log(F.pow(n + 50.0, F.lit(0.85)) / (F.col("n_distinct") + 20)),
    })


def fences(rated: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group: its columns, n (documents), and per rule the fence of log(rate), from sketches merged up the groups."""
    leaf = materialise(rated.groupBy(*groups).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r.name, F.lit(KLL_K)).alias(r.name) for r in RULES]), "sketches")

    def own(df: DataFrame, depth: int) -> DataFrame:
        out = []
        for r in RULES:
            q1, q3 = (F.kll_sketch_get_quantile_double(r.name, F.lit(q)) for q in (0.25, 0.75))
            out.append((q3 + r.reach * F.greatest(q3 - q1, F.lit(LEAST_SPREAD))).alias(r.name))
        return df.select(*groups[:depth], "n", *out)

    def merged(depth: int) -> DataFrame:
        if depth == len(groups):
            return own(leaf, depth)
        return own(leaf.groupBy(*groups[:depth]).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r.name).alias(r.name) for r in RULES]).where("n > 0"), depth)

    whole = merged(0).first()  # numbers, not a join; none of an empty table
    out, above = None, {r.name: F.lit(whole[r.name] if whole else None).cast("double") for r in RULES}
    for depth in range(1, len(groups) + 1):
        level = merged(depth)
        if out is not None:
            on = groups[: depth - 1]
            level = level.join(out.select(*[F.col(g).alias(f"__{g}") for g in on], *[F.col(r.name).alias(f"__{r.name}") for r in RULES]), [F.col(g) == F.col(f"__{g}") for g in on])
            above = {r.name: F.col(f"__{r.name}") for r in RULES}
        weight = F.col("n") / (F.col("n") + PRIOR)
        out = level.select(*groups[:depth], "n", *[(weight * F.col(r.name) + (1 - weight) * above[r.name]).alias(r.name) for r in RULES])
    return out.select(*groups, "n", *[F.col(r.name).alias(f"{r.name}_fence") for r in RULES])


def quality_rules(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of docs(doc_id, text, and the group columns): doc_id, the counts of COUNTS, base_failed, kept,
    and failed_rules, the names of the adaptive rules that the document breaks.

    base_failed: fewer than 20 words, or over 30 % of the words in windows of 8 words that occur twice or more.
    kept: false if base_failed, else whether no rate is beyond its group's fence. Quartiles come from sketches, whose
    ranks are off by up to 1 %, so a document at the very fence may be judged either way. A null text has no words and fails.
    A null language or source is a group like any other. Repeated rows are judged alike; an empty table gives no rows.
    Other columns are ignored.
    """
    null = "\0null"  # joins need a value where a group's column is null
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(g).cast("string"), F.lit(null)).alias(f"g{i}") for i, g in enumerate(groups)], "text")
    names = [f"g{i}" for i in range(len(groups))]
    rated = rates(materialise(count_texts(keyed, ["doc_id", *names]), "counts"))
    limits = materialise(fences(rated, names), "fences")
    out = skewed_left_join(rated, limits, names, "n", ["doc_id", "n_words"])
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(F.col(r.name) > F.col(f"{r.name}_fence"), F.lit(r.name)) for r in RULES]), lambda x: x.isNotNull())
    out = out.withColumn("base_failed", base).withColumn("failed_rules", broken)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return out.select("doc_id", *names, "base_failed", (~base & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
