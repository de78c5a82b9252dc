"""Licence scans: a paragraph classifier, a calibrated unknown class, and templates that confirm. DataFrame functions only.

A paragraph is what blank lines part, or what one long line holds; wrapped lines are joined. Training takes the notices
and names below, put into everyday phrases by rule, the same phrases with names of other licences and made-up ones (the
unknown class), and a bounded sample of the corpus' own paragraphs that aren't notices (the class "none"). Features are
telling words (see telling()), the pairs of neighbouring words that have one and the triples that begin with one; a
paragraph without a telling word has no features at all, so that looking for telling words first loses nothing. Multinomial logistic regression gives each
family's probability; below a bound set on phrases kept aside, the paragraph is "unknown", and so is one that has a word
for a licence but is no notice that the model knows. A family is confirmed when one of its templates stands in the
paragraph: all word pairs of a short one, most of a long one.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices by licence family, as they are commonly written.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "bsd": ["Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "mit": ["Released under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
# What the families are called.
NAMES = {
    "apache-2.0": ["Apache License 2.0", "Apache License", "Apache 2.0", "Apache-2.0", "ASL 2.0"],
    "bsd": ["BSD License", "BSD 3-Clause", "3-Clause BSD License", "BSD-2-Clause", "New BSD License"],
    "cc-by": ["CC BY 4.0", "CC-BY-3.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-3.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons BY-NC"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons BY-SA"],
    "cc0": ["CC0", "CC0 1.0", "Creative Commons Zero", "CC0 Public Domain Dedication"],
    "gpl-2.0": ["GPLv2", "GPL v2", "GPL version 2", "GPL-2.0", "GNU General Public License version 2"],
    "gpl-3.0": ["GPLv3", "GPL v3", "GPL version 3", "GPL-3.0", "GNU General Public License version 3"],
    "lgpl": ["LGPL", "LGPLv3", "LGPL 2.1", "LGPL v3", "GNU Lesser General Public License"],
    "mit": ["MIT License", "MIT licence", "MIT/X11 License", "MIT licensed"],
    "mpl-2.0": ["MPL 2.0", "MPL-2.0", "Mozilla Public License", "Mozilla Public License 2.0"],
}
# Licences of no family above, for the unknown class.
OTHER_NAMES = ["Zlib License", "Artistic License 2.0", "Common Development and Distribution License 1.0", "Boost Software License 1.0", "Microsoft Public License", "Open Software License 3.0", "Server Side Public License", "GNU Free Documentation License 1.3", "SIL Open Font License 1.1", "Academic Free License v3.0", "PostgreSQL License", "Unlicense"]
OTHERS = ["All rights reserved", "Licensed under the terms of the accompanying agreement", "See the LICENSE file for licence terms", "Copyright by the authors", "Used under licence from the publisher", "Released under a custom license", "Licensed under the Example License, version 1.1", "Proprietary and confidential, no copying without permission"]
# Phrases around a licence's name.
PHRASES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "This software is available under the {}", "License: {}", "The code is {} licensed", "This work is licensed under {}", "You may use it under the {}", "Published by the authors under {}", "SPDX-License-Identifier: {}"]
# Words that name a family or a licence; two of them in a paragraph make it a notice.
NAMING = frozenset("apache asl bsd cc cc0 commons copyleft copyright copyrighted creative gnu gpl gplv2 gplv3 lgpl lgplv3 licence licences licenced license licenses licensed licensing mit mozilla mpl noncommercial proprietary reserved sharealike spdx unlicense waived".split())
#: A paragraph with such a word speaks of a licence, whatever the model makes of it.
MENTIONS = r"(?i)\b(?:licen[cs]e[sd]?|licensing|copyright(?:ed)?|copyleft)\b"

# Repeated groups are possessive (*+): the JVM's patterns recurse once per repetition of any other group and run out of stack.
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*+"
NONE, UNKNOWN = "none", "unknown"
#: Buckets of the table of weights; an n-gram is looked for in its own only.
BUCKETS = 4096
#: A line of at most so many characters may go on in the next one.
WRAPPED = 100
#: A template of fewer word pairs must stand in the paragraph as a whole, a longer one to the share CONFIRM.
SHORT = 6
CONFIRM = 0.6


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def telling() -> set[str]:
    """NAMING, and of the notices that have none of those words the long ones (9 letters and more)."""
    unnamed = [w for n in [*sum(NOTICES.values(), []), *OTHERS] if not NAMING.intersection(w := tokens(n))]
    return NAMING | {x for w in unnamed for x in w if len(x) > 8}


TELLING = telling()


def grams(words: list[str]) -> list[str]:
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in TELLING or b in TELLING}
    return sorted(pairs | {w for w in words if w in TELLING} | {f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False) if a in TELLING})


def pairs_of(notice: str) -> list[str]:
    """A template: the pairs of a notice's neighbouring words; of a single word, that word."""
    w = tokens(notice)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) or w


#: What confirms a family.
TEMPLATES = {f: [pairs_of(n) for n in [*NOTICES[f], *NAMES[f]]] for f in NOTICES}


def needed(template: list[str]) -> int:
    return len(template) if len(template) < SHORT else -(-int(100 * CONFIRM) * len(template) // 100)


def speaks(words: list[str]) -> bool:
    """Whether a paragraph is a notice, so that it can't stand for paragraphs without one: by a template or two naming words."""
    have = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} | set(words)
    return len(NAMING.intersection(words)) > 1 or any(len(have.intersection(t)) >= needed(t) for ts in TEMPLATES.values() for t in ts)


@dataclass
class LicenceModel:
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    scale: float
    least: float


def _made_up(rng: random.Random) -> str:
    """A licence's name that nobody uses."""
    word = "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    return rng.choice([f"{word} License", f"{word} Public License {rng.randint(1, 4)}.0", f"{word} {rng.randint(1, 3)}.{rng.randint(0, 2)}", f"{word} Licence", f"{word}-{rng.randint(1, 3)}.0", f"GNU {word} License", f"GNU {word} General Public License v{rng.randint(1, 3)}", f"Creative {word} License"])


def training_texts(background: list[list[str]]) -> list[tuple[list[str], str, bool]]:
    """(words, class, kept aside): notices and names of each family, in phrases and beside words of the corpus."""
    rng, out = random.Random(1), []

    def add(text: str, kind: str, aside: bool) -> None:
        w = tokens(text)
        filler = [x for x in rng.choice(background) if x not in TELLING][:8] if background else []
        for more in (w, filler + w, w + filler, filler[:4] + w + filler[4:]):
            out.append((more, kind, aside))

    for family in sorted(NOTICES):
        for n in NOTICES[family]:
            for cut in (0, 1, 2):  # whole, and less a word at an end
                add(" ".join(tokens(n)[cut == 1 : len(tokens(n)) - (cut == 2)]), family, False)
        for k, (phrase, n) in enumerate((p, n) for p in PHRASES for n in NAMES[family]):
            add(phrase.format(n), family, k % 5 == 4)
    for n in OTHERS:
        add(n, UNKNOWN, False)
    for k, (phrase, n) in enumerate((p, n) for p in PHRASES for n in [*OTHER_NAMES, *[_made_up(rng) for _ in range(30)]]):
        add(phrase.format(n), UNKNOWN, k % 5 == 4)
    return out + [(w, NONE, k % 5 == 4) for k, w in enumerate([*background, *[[]] * 200])]


def fit_licences(paragraphs: list[str], l2: float = 3e-4) -> LicenceModel:
    """A model from the fixed values and some paragraphs of the corpus; the same for the same paragraphs in any order."""
    background = [t for p in sorted(set(paragraphs)) if (t := tokens(p)) and not speaks(t)]
    classes = [NONE, UNKNOWN, *sorted(NOTICES)]
    samples = [(grams(w), classes.index(c), aside) for w, c, aside in training_texts(background)]
    number = {g: i for i, g in enumerate(sorted({g for s, c, aside in samples if c and not aside for g in s}))}

    def sparse(rows: list[tuple[list[str], int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = [[number[g] for g in s if g in number] for s, _, _ in rows]
        return np.concatenate([np.array(a, np.int64) for a in at]), np.repeat(np.arange(len(at)), [len(a) for a in at]), np.array([c for _, c, _ in rows])

    def sums(of: np.ndarray, to: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(to, values[of, k], size) for k in range(values.shape[1])], 1)

    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    at, row, y = sparse([s for s in samples if not s[2]])
    ones = np.eye(len(classes))[y]
    w, b = np.zeros((len(number), len(classes))), np.zeros(len(classes))
    mw, vw, mb, vb = (np.zeros_like(a) for a in (w, w, b, b))
    for t in range(1, 301):  # Adam on the penalised likelihood
        p = (soft(sums(at, row, len(y), w) + b) - ones) / len(y)
        gw, gb = sums(row, at, len(number), p) + l2 / len(y) * w, p.sum(0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - 0.1 * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b = b - 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    at, row, own = sparse([s for s in samples if s[2]])
    z = sums(at, row, len(own), w) + b
    scale = min((float(-np.log(np.maximum(soft(z * s)[np.arange(len(own)), own], 1e-12)).mean()), float(s)) for s in 2.0 ** np.arange(-4, 2))[1]
    p = soft(z * scale)
    # the bound that sorts best: families taken for what they are, others for none of the families
    best = p[:, 2:].max(1)
    right = (own > 1) & (2 + p[:, 2:].argmax(1) == own)
    least = max((float((right & (best >= x)).sum() + ((own == 1) & (best < x)).sum()), x) for x in np.arange(0.3, 0.95, 0.05))[1]
    return LicenceModel(classes, {g: w[i].tolist() for g, i in number.items()}, b.tolist(), scale, float(least))


def _sql(words: list[str]) -> str:
    return "array(" + ",".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"


def _doubles(v: list[float]) -> str:
    return "array(" + ",".join(f"{x:.9e}D" for x in v) + ")"


def paragraphs(text: Column) -> Column:
    """A text's paragraphs. A line break ends one where a blank line follows, or the line is longer than WRAPPED or ends a
    sentence, or the next one begins an SPDX tag; other breaks are within a wrapped paragraph."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    # the look back over the line comes last, where a line break follows: at every place it would cost WRAPPED steps
    wrapped = rf"(?m)(?<![.!?\s])(?=[^\S\n]*\n)(?<=^[^\n]{{1,{WRAPPED}}})[^\S\n]*\n[^\S\n]*(?=\S)(?!(?i:(?:[#/*;-]+\s*)?spdx-))"
    return F.split(F.regexp_replace(plain, wrapped, " "), r"\n(?:[^\S\n]*\n)*+")


def sample_paragraphs(docs: DataFrame, most: int = 2000, longest: int = 2000) -> list[str]:
    """About most paragraphs of the corpus of at most longest characters, by a hash of their text (so that repeated ones
    come once)."""
    lines = docs.where(F.col("text").isNotNull()).select(F.explode(F.split("text", "\n")).alias("p")).where((F.col("p") != "") & (F.length("p") <= longest))
    n = lines.count()
    found = lines.where(F.pmod(F.xxhash64(F.lit("licence"), "p"), F.lit(1 << 30)) < F.lit(most / max(n, 1) * (1 << 30)))
    return [r["p"] for r in found.distinct().orderBy("p").collect()]


def _held(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """df with a column that is computed once per row: a projection would be merged into each of its uses, and inside a
    lambda be computed anew for each element."""
    return df.select("*", F.explode(F.array(F.expr(value) if isinstance(value, str) else value)).alias(name))


def licence_scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per paragraph of docs(doc_id, text) that speaks of a licence: doc_id, paragraph (0, 1, ...), family
    ("unknown" where the model is unsure or knows no such family), probability (of the likeliest class), similarity (the
    share of the best template of the likeliest family that stands in the paragraph), confirmed, and licence: the family
    where confirmed, else "unknown".

    A paragraph speaks of a licence where the model says so or it has one of the words of MENTIONS. Null and empty texts
    have no paragraphs. Repeated rows give repeated results. All paragraphs of whole texts are judged, however long.
    Of equally likely classes the first counts (none, unknown, then by name). Other columns are ignored; an empty table gives no rows.
    """
    model = model or fit_licences(sample_paragraphs(docs))
    gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(TELLING, key=lambda w: (-len(w), w))) + r")(?![a-z0-9])"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(gate))
    rows = rows.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "p")).where(F.col("p").rlike(gate))
    words = F.regexp_extract_all(F.lower("p"), F.lit(f"({TOKEN})"), F.lit(1))
    listed = ",".join(f"'{w}'" for w in sorted(TELLING))
    pairs = "if(size(words) < 2, cast(array() as array<string>), transform(sequence(1, size(words) - 1), i -> concat(words[i - 1], ' ', words[i])))"
    buckets: list[dict[str, list[float]]] = [{} for _ in range(BUCKETS)]
    for g, w in sorted(model.weights.items()):
        buckets[zlib.crc32(g.encode()) % BUCKETS][g] = [float(f"{x:.9e}") for x in w]
    # one string for the analyser, one value from the optimiser on
    weights = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<double>>>")
    zeros = _doubles([0.0] * len(model.classes))
    rows = _held(_held(rows, "words", words), "pairs", pairs)
    near = f"if(size(words) < 2, cast(array() as array<string>), transform(filter(sequence(1, size(words) - 1), i -> words[i - 1] in ({listed}) or words[i] in ({listed})), i -> concat(words[i - 1], ' ', words[i])))"
    three = f"if(size(words) < 3, cast(array() as array<string>), transform(filter(sequence(2, size(words) - 1), i -> words[i - 2] in ({listed})), i -> concat(words[i - 2], ' ', words[i - 1], ' ', words[i])))"
    rows = _held(rows, "grams", f"array_distinct(concat(filter(words, w -> w in ({listed})), {near}, {three}))")
    of = lambda g: F.try_element_at(F.get(weights, F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int")), g)
    rows = _held(rows, "known", F.filter(F.transform("grams", of), lambda w: w.isNotNull()))
    rows = _held(rows, "sums", f"aggregate(known, {zeros}, (a, w) -> zip_with(a, w, (x, y) -> x + y))")
    rows = _held(rows, "z", f"zip_with(sums, {_doubles(model.bias)}, (x, y) -> (x + y) * {model.scale:.9e}D)")
    rows = _held(rows, "e", "transform(z, v -> exp(v - array_max(z)))").withColumn("total", F.expr("aggregate(e, 0D, (a, v) -> a + v)"))
    rows = rows.withColumn("at", F.expr("cast(array_position(e, array_max(e)) as int)")).withColumn("probability", F.expr("array_max(e) / total"))
    rows = _held(rows, "likely", f"element_at({_sql(model.classes)}, at)").where((F.col("likely") != NONE) | F.col("p").rlike(MENTIONS))

    templates = "map(" + ",".join(f"'{f}',array({','.join(f'struct({_sql(t)} as t, {needed(t)} as needed)' for t in ts)})" for f, ts in sorted(TEMPLATES.items())) + ")"
    found = f"transform(element_at({templates}, likely), x -> struct(size(array_intersect(x.t, concat(pairs, words))) as hits, size(x.t) as size, x.needed as needed))"
    rows = _held(rows, "found", f"coalesce({found}, cast(array() as array<struct<hits:int,size:int,needed:int>>))")
    rows = rows.withColumn("similarity", F.expr("coalesce(array_max(transform(found, x -> x.hits / x.size)), 0D)"))
    sure = ~F.col("likely").isin(UNKNOWN, NONE) & (F.col("probability") >= model.least)
    family: Column = F.when(sure, F.col("likely")).otherwise(F.lit(UNKNOWN))
    confirmed = sure & F.expr("exists(found, x -> x.hits >= x.needed)")
    return rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), family.alias("family"), "probability", "similarity", confirmed.alias("confirmed"), F.when(confirmed, F.col("likely")).otherwise(F.lit(UNKNOWN)).alias("licence"))
