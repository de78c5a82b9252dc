"""Secret scans: three patterns, and Shannon entropy in sliding windows over candidate strings, by character class.

A candidate is a run of printable ASCII without spaces. Of each class of characters (CLASSES) its runs of at least a
window's length are looked at: a window slides over the run, the counts of its characters change by the one that enters
and the one that leaves, and the sum of c * log2(c) over the counts tells the entropy. Windows that reach the class's
entropy and mix letters with digits are joined to spans. The allow-list suppresses what is known to be harmless; it has no say in what the patterns find.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks

KINDS = ("assign", "access", "hex", "entropy")
# Words before an assigned secret, in either case.
KEYWORDS = r"password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""(?ai:({KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# runs of such characters, of which too short ones would be dropped
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_ASSIGNED = 12


@dataclass(frozen=True)
class CharacterClass:
    """Runs of these characters (a regular expression's set), the window's length, and the least bits per character."""

    chars: str
    window: int
    least: float


#: Random strings of a window's length reach these entropies mostly, names and words rarely. Hexadecimal digits have 4 bits
#: at most, base64 and printable ones log2 of the window.
CLASSES = (CharacterClass("0-9A-Fa-f", 20, 3.1), CharacterClass("A-Za-z0-9+/_=-", 20, 3.95), CharacterClass("!-~", 16, 3.75))
#: Candidates that match, as a whole or in part, are harmless: addresses, numbers of records, placeholders, paths, names.
ALLOW_PATTERNS = (r"://|^www\.", r"^[\w.+-]+@[\w-]+\.[\w.]+[.,;:)]?$", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"(?i)example|sample|dummy|placeholder|changeme|xxxx|redacted", r"^[.~]?(?:/[\w.-]++){2,}+/?$", r"^[A-Za-z][A-Za-z0-9]*+(?:_[A-Za-z0-9]{1,12}+)++[.,;:()]*$", r"^(?:[A-Z]?[a-z]++[0-9]?)++[.,;:()]*$")
#: A span that stands in one of these strings is harmless: alphabets as they are written in code.
ALLOW_TEXTS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef0123456789abcdef")
#: c * log2(c) in fixed point, so that sums don't drift.
SCALE = 1 << 24


def terms(window: int) -> list[int]:
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def hot_windows(s: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Unions (start, end) of overlapping windows of s whose entropy is at least so many bits a character, each window with
    both letters and digits."""
    f, counts = terms(window), [0] * 128
    most = window * (math.log2(window) - least) * SCALE
    spent = letters = digits = 0
    begin = end = -1
    for i, c in enumerate(s.encode("ascii")):
        spent += f[counts[c] + 1] - f[counts[c]]
        counts[c] += 1
        letters += 65 <= c <= 90 or 97 <= c <= 122
        digits += 48 <= c <= 57
        if i >= window:
            o = ord(s[i - window])
            spent -= f[counts[o]] - f[counts[o] - 1]
            counts[o] -= 1
            letters -= 65 <= o <= 90 or 97 <= o <= 122
            digits -= 48 <= o <= 57
        if i >= window - 1 and spent <= most and letters and digits:
            at = i - window + 1
            if at > end:
                if end > 0:
                    yield begin, end
                begin = at
            end = i + 1
    if end > 0:
        yield begin, end


@dataclass(frozen=True)
class SecretRules:
    classes: tuple[CharacterClass, ...] = CLASSES
    allow_patterns: tuple[str, ...] = ALLOW_PATTERNS
    allow_texts: tuple[str, ...] = ALLOW_TEXTS


class Scanner:
    """The rules with their patterns compiled, for one task."""

    def __init__(self, rules: SecretRules) -> None:
        shortest = min((c.window for c in rules.classes), default=1)
        self.candidates = re.compile(rf"(?<![!-~])[!-~]{{{shortest},}}")
        self.classes = [(re.compile(rf"(?<![{c.chars}])[{c.chars}]{{{c.window},}}"), c) for c in rules.classes]
        self.allow = re.compile("|".join(f"(?:{_inline(p)})" for p in rules.allow_patterns)) if rules.allow_patterns else None
        self.texts = rules.allow_texts

    def entropy_spans(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for m in self.candidates.finditer(text):
            if self.allow and self.allow.search(m[0]):
                continue
            found = [(m.start() + run.start() + a, m.start() + run.start() + b) for runs, c in self.classes for run in runs.finditer(m[0]) for a, b in hot_windows(run[0], c.window, c.least)]
            for a, b in sorted(found):
                if any(text[a:b] in t for t in self.texts):
                    continue
                if out and a < out[-1][1]:  # the same string by another class
                    out[-1] = out[-1][0], max(b, out[-1][1])
                else:
                    out.append((a, b))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) by start, then kind; entropy adds spans only where no pattern has one."""
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base.sort()
        more, at, reached = [], 0, -1
        for a, b in self.entropy_spans(text):
            while at < len(base) and base[at][0] < b:
                reached = max(reached, base[at][2])
                at += 1
            if reached <= a:
                more.append((a, 3, b))
        return sorted(base + more)


def _inline(pattern: str) -> str:
    """A pattern whose leading flags hold for itself alone."""
    m = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{m[1]}:{pattern[m.end() :]})" if m else pattern


SCHEMA = "doc_id long, spans array<struct<start:int,kind:string,end:int>>"


def secret_scan(docs: DataFrame, rules: SecretRules | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and spans, an array of (start, kind, end) by start, then kind (assign,
    access, hex, entropy); starts and ends count code points, an end is the first one after the span.

    Patterns match from left to right without overlaps, each kind on its own; entropy spans never overlap those of
    patterns. A null text counts as empty and has no spans. Whole texts are scanned, however long, row by row and without
    a shuffle; equal texts and repeated rows give equal spans. Other columns are ignored; an empty table gives no rows.
    """
    rules = rules or SecretRules()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in chunks(batches, 1000):
            found = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in scanner.spans(t)] if (t := x.as_py()) else [] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """A text with a mark in place of each span (of overlapping ones, one mark)."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(a: Column, s: Column) -> Column:
        before = F.when(s["start"] >= a["at"], F.concat(text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], before).alias("out"))

    return F.aggregate(spans, state, cut, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
