"""Language identification by interpolated Kneser-Ney character models, one per language.

Letters are lower-cased; a run of anything else is one boundary. The symbols are the boundary, every letter that the
training texts have (of whatever script, without a bound) and one for all other letters. Each model keeps, per order,
the hashes of its n-grams in sorted arrays beside their interpolated probabilities, and the back-off weights of its
contexts likewise. A text goes to the language of lowest cross-entropy per symbol; a scale fitted on texts set aside
turns the entropies into a probability, and texts that no model explains are rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, arrow_map, chunks, drop, materialise, mix

ORDER = 4
BOUNDARY, OTHER = 0, 1
UNKNOWN = "und"
#: Code points of texts that are scored at a time.
SCORED = 4_000_000


@dataclass
class Alphabet:
    """Numbers of the letters of the training texts: 2, 3, ... by code point; all others share OTHER."""

    letters: np.ndarray
    table: np.ndarray = field(default_factory=lambda: np.full(0x110000, -1, np.int32), repr=False)

    def __post_init__(self) -> None:
        self.table[self.letters] = np.arange(2, len(self.letters) + 2)

    def __reduce__(self) -> tuple:
        return Alphabet, (self.letters,)

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    def symbols(self, text: str) -> np.ndarray:
        """Numbers of a text's letters, a boundary for each run of other characters and one at either end."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[cp]
        if (out < 0).any():
            for c in np.unique(cp[out < 0]).tolist():
                self.table[c] = OTHER if chr(c).isalpha() else BOUNDARY
            out = self.table[cp]
        out = np.concatenate([[BOUNDARY], out, [BOUNDARY]]).astype(np.int32)
        return out[np.concatenate([[True], (out[1:] != BOUNDARY) | (out[:-1] != BOUNDARY)])]


def grams(symbols: np.ndarray) -> np.ndarray:
    """A row of ORDER symbols for each symbol but the first, which it ends with; boundaries stand before the text."""
    padded = np.concatenate([np.full(ORDER - 2, BOUNDARY, np.int32), symbols])
    return np.lib.stride_tricks.sliding_window_view(padded, ORDER) if len(padded) >= ORDER else np.empty((0, ORDER), np.int32)


def _hash(rows: np.ndarray, tag: int) -> np.ndarray:
    """64-bit hashes of rows of symbols; tag keeps n-grams and contexts of different lengths apart."""
    out = np.full(len(rows), tag + 1, np.uint64)
    for i in range(rows.shape[1]):
        out = out * MULTIPLIER + (rows[:, i].astype(np.uint64) + np.uint64(1))
    return mix(mix(out))


def _kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, in the order of their hashes, and how often each occurs."""
    _, at, count = np.unique(_hash(rows, rows.shape[1]), return_index=True, return_counts=True)
    return rows[at], count


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class CharModel:
    """Per order 1..ORDER: sorted hashes and probabilities of n-grams, sorted hashes and back-off weights of contexts."""

    symbols: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def fit(rows: np.ndarray, symbols: int) -> CharModel:
        """A model of rows of ORDER symbols, over so many kinds of symbols."""
        levels = [_kinds(rows)]
        for _ in range(ORDER - 1):  # below the highest order, in how many contexts a gram was seen
            levels.append(_kinds(levels[-1][0][:, 1:]))
        out = CharModel(symbols, [], [])
        for order, (seen, count) in enumerate(reversed(levels), 1):
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            less = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            heads, own, kinds = np.unique(_hash(seen[:, :-1], ORDER + order), return_inverse=True, return_counts=True)
            total = np.bincount(own, count)
            weight = less * kinds / total
            p = (count - less) / total[own] + weight[own] * out.probability(seen[:, 1:])
            key = _hash(seen, order)
            by = np.argsort(key)
            out.grams.append((key[by], p[by]))
            out.contexts.append((heads, weight))
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Of each row's last symbol after those before it, by all orders that the model has so far."""
        p = np.full(len(rows), 1 / self.symbols)
        for order, ((keys, values), (heads, weights)) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            part = rows[:, rows.shape[1] - order :]
            at, have = _find(heads, _hash(part[:, :-1], ORDER + order))
            p = np.where(have, p * weights[at], p)
            at, have = _find(keys, _hash(part, order))
            p = np.where(have, values[at], p)
        return p


@dataclass
class LanguageModels:
    alphabet: Alphabet
    languages: list[str]
    models: list[CharModel]
    scale: float = 1.0
    #: A text of a higher entropy than its language's texts have, or a lower probability of its language, is rejected.
    most_entropy: list[float] = field(default_factory=list)
    least_score: float = 0.0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, and the number of letters of each text."""
        out, letters = np.full((len(texts), len(self.models)), np.inf), np.zeros(len(texts), np.int64)
        first = 0
        while first < len(texts):  # so many texts at a time as have SCORED code points, one at least
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or "") <= SCORED):
                size += len(texts[last] or "")
                last += 1
            out[first:last], letters[first:last] = self._entropies(texts[first:last])
            first = last
        return out, letters

    def _entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.alphabet.symbols(t or "") for t in texts]
        letters = np.array([(p != BOUNDARY).sum() for p in parts], np.int64)
        rows = [grams(p) for p, n in zip(parts, letters, strict=True) if n]
        out = np.full((len(texts), len(self.models)), np.inf)
        if not rows or not self.models:
            return out, letters
        size = np.array([len(r) for r in rows], np.int64)
        every = np.concatenate(rows)
        _, at, inverse = np.unique(_hash(every, ORDER), return_index=True, return_inverse=True)
        kinds, full, starts = every[at], np.flatnonzero(letters), np.cumsum(size) - size
        for k, m in enumerate(self.models):
            out[full, k] = -np.add.reduceat(np.log(m.probability(kinds))[inverse], starts) / size
        return out, letters

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        e = np.exp(-self.scale * (entropy - entropy.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def training_sample(docs: DataFrame, text: str, lang: str, key: str, per_language: int, most_bytes: int) -> list[tuple[str, str]]:
    """(text, language) of whole texts, by a hash of key: per language at most about per_language texts and most_bytes bytes;
    a text that no longer fits is passed over. A language whose texts are all longer gives its shortest one."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("langid"), F.col(key)).alias("h"), F.octet_length(F.col(text)).alias("size"))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct("size", "h")).alias("least"))
    rate = F.lit(float(per_language << 20)) / F.col("n")
    # the numbers of about per_language rows a language, and of its shortest
    found = materialise(found, "languages")
    near = known.drop("text").join(found, "lang").where((F.pmod("h", F.lit(1 << 20)) < rate) | ((F.col("size") == F.col("least.size")) & (F.col("h") == F.col("least.h"))))
    listed = defaultdict(list)
    for r in near.select("lang", "h", "size", (F.col("h") == F.col("least.h")).alias("least")).collect():
        listed[r["lang"]].append((r["least"], r["h"], r["size"]))
    drop(found)
    chosen = []
    for name, rows in sorted(listed.items()):
        left, taken = most_bytes, []
        for _, h, size in sorted(rows):  # the shortest comes last
            if size <= left and len(taken) < 2 * per_language:
                taken.append(h)
                left -= size
        chosen += [(name, h) for h in set(taken or [r[1] for r in rows if r[0]])]
    if not chosen:
        return []
    keys = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    rows = known.join(F.broadcast(keys), ["lang", "h"]).select("lang", "h", "text").distinct().collect()
    return [(t, n) for n, _, t in sorted(tuple(r) for r in rows)]


def fit_language_models(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, most_bytes: int = 2 << 20) -> LanguageModels:
    """Models of all languages in docs, each from about per_language whole texts of together at most most_bytes bytes,
    chosen by a hash of key.

    Rows with a null text or language are left out. Three in four texts of the sample train the models, the rest
    calibrate scale and rejection. Of an empty table, no models.
    """
    sample = training_sample(docs, text, lang, key, per_language, most_bytes)
    seen = np.unique(np.frombuffer("".join(t for t, _ in sample).lower().encode("utf-32-le", "surrogatepass"), np.uint32))
    alphabet = Alphabet(np.array([c for c in seen.tolist() if chr(c).isalpha()], np.int64))
    train: dict[str, list[np.ndarray]] = defaultdict(list)
    aside: list[tuple[str, str]] = []
    for i, (t, name) in enumerate(sample):
        symbols = alphabet.symbols(t)
        if i % 4 == 3 and train[name]:
            aside.append((t, name))
        elif len(symbols) > 1:
            train[name].append(grams(symbols))
    names = sorted(n for n in train if train[n])
    out = LanguageModels(alphabet, names, [CharModel.fit(np.concatenate(train[n]), alphabet.size) for n in names])
    entropy, letters = out.entropies([t for t, _ in aside])
    true = np.array([names.index(x) for _, x in aside], np.int64)
    out.most_entropy = [float("inf")] * len(names)
    if (ok := letters > 0).any():
        entropy, true = entropy[ok], true[ok]
        right = np.arange(len(true))
        losses = []
        for scale in 2.0 ** np.arange(-2, 7):
            out.scale = float(scale)
            losses.append((-np.log(np.maximum(out.scores(entropy)[right, true], 1e-9)).mean(), float(scale)))
        out.scale = min(losses)[1]
        own = entropy[right, true]
        out.most_entropy = [float(np.quantile(e, 0.999) + 3 * e.std() + 0.05) if len(e := own[true == k]) else float("inf") for k in range(len(names))]
        out.least_score = float(min(0.9, np.quantile(out.scores(entropy)[right, true], 0.001)))
    return out


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


def predict_language(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """One row per row of docs(doc_id, text, held_out): those, lang_pred, score, entropy, rejected, as SCHEMA has it.

    lang_pred is the language of least entropy (the first by name where equal), or "und" with score 0 and a null
    entropy where the text is null or has no letter, or no language was learned. score is its calibrated probability.
    rejected: no model explains the text, or the choice is uncertain; callers who want it treat such texts as "und".
    Whole texts count, however long. Other columns are ignored; repeated rows give repeated results, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, 1024):
            entropy, letters = m.entropies(batch.column(1).to_pylist())
            known = (letters > 0) & bool(m.models)
            names = np.array([*m.languages, UNKNOWN], dtype=object)
            best = np.where(known, np.argmin(entropy, 1), len(m.languages)) if m.models else np.zeros(len(letters), np.int64)
            score, least = np.zeros(len(letters)), np.full(len(letters), np.nan)
            if known.any():
                score[known], least[known] = m.scores(entropy[known]).max(1), entropy[known].min(1)
            rejected = ~known | (least > np.array([*m.most_entropy, np.inf])[best]) | (score < m.least_score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names[best], pa.string()), pa.array(score), pa.array(least, pa.float64(), mask=~known), pa.array(rejected)], [c.split()[0] for c in SCHEMA.split(", ")]
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.col("held_out")), run, SCHEMA)


def held_out(key: str = "doc_id") -> Column:
    """Whether the CRC-32 of an id's decimal text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))
