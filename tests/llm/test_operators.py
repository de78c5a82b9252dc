"""Each operator on awkward rows and against brute force."""

import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracewell.llm import bpe, common, fingerprints, jaccard, langid, licenses, mixing, quality_model, quality_rules, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use inside
CLASH = ["n", "words", "star", "band", "prefix", "token", "h", "y", "k", "p", "__s", "__t", "grams", "z", "kept", "least", "first"]


def awkward(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(200)]
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "   \n\t", "en", "s"), (4, "One two", "en", "s"), (5, "one TWO", "en", "s"), (6, "x " * 3000, "en", "s"), (7, "a" * 20000, "en", "s"), (None, " ".join(base), "en", "s"), (8, " ".join(base), None, "s"), (8, " ".join(base), None, "s"), (9, " ".join(base[:-2] + ["zz"]), "de", "t")]
    for i in range(10, 40):
        cut = base[:]
        for _ in range(rng.randint(0, 4)):
            cut[rng.randrange(200)] = word()
        rows.append((i, " ".join(cut), rng.choice(["en", "de"]), rng.choice("st")))
    rows += [(i, " ".join(word() for _ in range(rng.randint(1, 60))) + "\n" + " ".join(base[:30]), "en", "s") for i in range(40, 60)]
    return [(*r, 0) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(spark), DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_jaccard(docs, none):
    got = Counter(tuple(r) for r in jaccard.ngram_jaccard_join(docs).collect())
    rows = texts(docs)
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    reach = {i: i for i in ids if i is not None}

    def top(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for (a, x), (b, y) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((top(a), top(b)))
            reach[b] = a
    want = Counter((i, len(s), None if i is None else top(i) if s else i) for i, s in zip(ids, sets, strict=True))
    assert got == want and len(set(reach.values())) < len(reach) - 10
    assert jaccard.ngram_jaccard_join(none).collect() == []


def test_jaccard_repeated_ids(spark):
    """Rows that repeat a doc_id with other texts: no link of theirs is lost."""
    rng = random.Random(9)
    base = [[f"f{f}w{i}" for i in range(60)] for f in range(12)]

    def near(f):
        w = base[f][:]
        w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        return " ".join(w)

    four = [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, near(0)), (3, near(1))]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(spark.createDataFrame(four, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 1}
    rows = [(rng.randrange(40), near(rng.randrange(12)) if rng.random() < 0.8 else f"own words only here {i} and nowhere else") for i in range(70)] + [(41, ""), (41, " ".join(base[2]))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    reach = {i: i for i, _ in rows}
    for _ in rows:
        for ((a, _), x), ((b, _), y) in itertools.combinations(zip(rows, sets, strict=True), 2):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                reach[a] = reach[b] = min(reach[a], reach[b])
    got = Counter(tuple(r) for r in jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, len(s), reach[i] if s else i) for (i, _), s in zip(rows, sets, strict=True))


def test_jaccard_blocks(spark, monkeypatch):
    """A family of similar sets, larger than a block, none of them equal."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "STARS", 1)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[: 40 + i % 37] + [f"own{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.ngram_jaccard_join(df).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = dict.fromkeys(sets)
    for i in sets:
        if label[i] is None:
            todo = [i]
            while todo:
                x = todo.pop()
                label[x] = i
                todo += [y for y in sets if label[y] is None and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and y not in todo]
    assert got == label


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    reach = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                reach[a] = reach[b] = min(reach[a], reach[b])
    assert got == reach


def test_skewed_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)], "i long, k string")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("m"))
    got = {tuple(r) for r in common.skewed_left_join(left, right, ["k"], "n", ["i"]).collect()}
    assert got == {(i, k, 1 if k == "hot" else i if k else None) for i, k in ((r[0], r[1]) for r in left.collect())}


def test_fingerprints(docs, none, spark):
    got = Counter(tuple(r) for r in fingerprints.fingerprints(docs).collect())
    rows = sorted(((i, t or "") for i, t in texts(docs)), key=lambda r: (r[0] if r[0] is not None else -math.inf, r[1]), reverse=True)
    want = Counter()
    one = lambda t: fingerprints.sketch(t, fingerprints.syncmers(fingerprints.code_points(t)))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        f, g, h = one(t), one(e), one(u)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.to_string(f), fingerprints.to_string(g), fingerprints.likeness(f, g), fingerprints.likeness(f, h)] += 1
    assert got == want
    assert fingerprints.fingerprints(none).collect() == []
    assert fingerprints.fingerprints(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()["n_chars"] == 2
    for s in list(want)[:5]:
        assert fingerprints.to_string(fingerprints.from_string(s[3])) == s[3]


def test_closed_syncmers_by_definition():
    text = "".join(random.Random(2).choice("abcd ") for _ in range(400))
    cp = fingerprints.code_points(text)
    _, at = fingerprints.syncmers(cp)
    k, s = fingerprints.K, fingerprints.S
    inner = {}

    def rank(x):  # the hash of an s-mer, from a text of that s-mer's length
        if x not in inner:
            h = fingerprints.code_points(x).astype("uint64")
            v = h[:1].copy()
            for i in range(1, s):
                v = v * fingerprints.MULTIPLIER + h[i]
            inner[x] = int(fingerprints.mix(v)[0])
        return inner[x]

    want = [i for i in range(len(text) - k + 1) if min(h := [rank(text[i + j : i + j + s]) for j in range(k - s + 1)]) in (h[0], h[-1])]
    assert at.tolist() == want


def test_toxicity(spark, none):
    rng = random.Random(3)
    clean = ["ab", "cd", "ef", "gh", "ij", "kl"]
    rows = []
    for i in range(600):
        w = [rng.choice(clean) + rng.choice(clean) + rng.choice(clean) for _ in range(rng.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            w += [rng.choice(["vile" + rng.choice("abcdefgh"), "nasty"]) for _ in range(rng.randint(1, 4))]
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = df.where("doc_id % 3 > 0").select("doc_id", F.col("label").alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.fit_toxicity(df.withColumn("y", F.lit(3)), labels)
    assert model.thresholds == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in rows if i % 3 == 0) >= 196
    for i, text, _ in rows[:200]:  # the definition, word by word
        tally = Counter(f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in [w, *[w[:n] + "-" for n in toxicity.PREFIXES if len(w) > n]])
        z = sum(w * (1 + math.log(tally[f])) for f, w in model.weights.items() if tally[f])
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        each = [a - b for a, b in zip(above, [*above[1:], 0.0], strict=True)]
        toxic = above[0] >= model.cut
        want = (sum(above), 1 + max(range(len(each)), key=lambda k: each[k]) if toxic else 0, above[0], toxic)
        assert np.allclose([float(x) for x in tuple(got[i])[1:]], [float(x) for x in want])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "vilezz vilezz"), (3, "vilezz vilezz")], "doc_id long, text string")
    found = [(r["doc_id"], r["toxic"]) for r in toxicity.score_toxicity(odd, model).orderBy("doc_id").collect()]
    assert found == [(1, False), (2, False), (3, True), (3, True)]
    assert toxicity.fit_toxicity(none, labels.limit(0)).weights == {} and toxicity.score_toxicity(none, model).collect() == []


def test_ordinal_fit_is_the_likeliest(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((500, 6)) < 0.4).astype(float)
    z = x @ np.array([2.0, -1.0, 1.5, 0.0, 0.5, -2.0]) + rng.logistic(size=500)
    y = np.digitize(z, [0.0, 1.0, 2.5])

    def loss(w, theta):
        above = np.concatenate([np.ones((500, 1)), 1 / (1 + np.exp(theta[None, :] - (x @ w)[:, None])), np.zeros((500, 1))], 1)
        return -np.log(above[np.arange(500), y] - above[np.arange(500), y + 1]).mean() + 1e-4 * (w @ w)

    w, theta = toxicity.fit_ordinal(x, y, 4)
    assert list(theta) == sorted(theta)
    least = loss(w, theta)
    for _ in range(300):  # one weight vector for all thresholds: nothing near it is likelier
        assert loss(w + rng.normal(0, 0.05, 6), np.sort(theta + rng.normal(0, 0.05, 3))) > least - 1e-5


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(open(path, "rb").read())
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none, encoding):
    path, _, own = encoding
    got = Counter((r[0], r[1], tuple(r[2]), bytes(r[3])) for r in bpe.bpe_encode(docs, path, public_tokenizers.PATTERN).collect())
    want = Counter((i, len(e := own.encode_ordinary(t or "")), tuple(e), (t or "").encode()) for i, t in texts(docs))
    assert got == want
    assert bpe.bpe_encode(none, path, public_tokenizers.PATTERN).collect() == []
    r = bpe.bpe_encode(docs.where("doc_id = 4"), path, public_tokenizers.PATTERN, ("ids_sha256", "decoded_sha256")).first()
    assert r["decoded_sha256"] == hashlib.sha256(b"One two").hexdigest()
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own.encode_ordinary("One two"))).encode()).hexdigest()


def test_bpe_joins(encoding, monkeypatch):
    _, ranks, own = encoding
    monkeypatch.setattr(bpe, "TEXT_LEAF", 5)
    monkeypatch.setattr(bpe, "PIECE_LEAF", 3)
    monkeypatch.setattr(bpe, "TOKEN_LEAF", 2)
    coder, rng = bpe.Bpe(ranks, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(1500):
        s = "".join(rng.choice(rng.choice(["ab", "  \n\t", "'sretvlmd", "éüñ日本😀", "!?*", "019", " the ering"])) for _ in range(rng.randint(0, 80)))
        assert coder.encode(s) == own.encode_ordinary(s)
        assert coder.decode(coder.encode(s)).decode() == s


def test_warc(spark, tmp_path):
    big = "<p>é" * 60
    rows = [(1, "u1", big), (2, "u\r\n2", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (2, "u2", big), (7, "u", big + "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0)).withColumn("payload", F.lit(1))
    path = "file://" + str(tmp_path / "w")
    got = Counter(tuple(r) for r in warc.warc_round_trip(df, path).collect())
    digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = Counter((i, len((h or "").encode()), digest(h), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows)
    assert got == want
    back = warc.read_archives(spark, path, payloads=True).where("record_type = 'response'").collect()
    assert Counter(bytes(r["payload"]) for r in back) == Counter((h or "").encode() for i, _, h in rows if i != 2)
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_warc_payloads_like_records(spark, tmp_path):
    """Payloads with parts, repeats and all of what stands between records come back whole; so do long ones."""
    rng = random.Random(10)
    bits = [warc.BETWEEN, "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "\r", "\n", "WARC-Type: response\r\n", "x" * 90, "é"]
    pages = [(i, "u", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(1000, "u", "y" * 3_000_000), (1001, "u", warc.BETWEEN * 30_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    path = "file://" + str(tmp_path / "w")
    warc.write_archives(df, path, "2026-01-02T03:04:05Z")
    back = warc.read_archives(spark, path, payloads=True).collect()
    assert Counter((r["page_id"], bytes(r["payload"])) for r in back if r["record_type"] == "response") <= Counter((i, h.encode()) for i, _, h in pages)
    kept = {}
    for i, _, h in pages:
        kept.setdefault(h if len(h.encode()) >= 100 else (i, h), i)
    assert {r["page_id"] for r in back if r["record_type"] == "response"} == set(kept.values()) and len(back) == len(pages)
    pieces = [(1, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (1, b"Content-Length: 9\r\n\r\nabc")]
    with pytest.raises(ValueError):
        list(warc.parse(pieces))


def test_language(spark, docs, none):
    rng = random.Random(6)
    sound = {"aa": ["ba", "bo", "ab", "ola"], "bb": ["kri", "zt", "ek", "ßu"]}
    make = lambda x, n: " ".join("".join(rng.choice(sound[x]) for _ in range(3)) for _ in range(n))
    train = spark.createDataFrame([(i, make(x, 30), x) for i in range(60) for x in sound] + [(99, None, "aa"), (98, "text", None)], "doc_id long, text string, lang string")
    m = langid.fit_language_models(train)
    assert m.languages == ["aa", "bb"]
    for name, model in zip(m.languages, m.models, strict=True):  # probabilities of all symbols after a seen context add up to 1
        context = langid.grams(m.alphabet.symbols(make(name, 3)))[5][1:]
        rows = np.array([[*context, x] for x in range(m.alphabet.size)], np.int32)
        assert abs(model.probability(rows).sum() - 1) < 1e-6
    test = spark.createDataFrame([(i, make(x, 8), i % 2 == 0, x) for i, x in enumerate(["aa", "bb"] * 40)] + [(200, None, True, None), (201, "12 !!", True, None), (202, "", False, None), (203, "𝒜𝒷", True, None)], "doc_id long, text string, held_out boolean, y string")
    got = {r["doc_id"]: r for r in langid.predict_language(test, m).collect()}
    assert all(got[i]["lang_pred"] == x for i, x in enumerate(["aa", "bb"] * 40))
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[203]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.fit_language_models(none)
    assert {r["lang_pred"] for r in langid.predict_language(docs.withColumn("held_out", F.lit(False)), empty).collect()} == {"und"}
    assert langid.predict_language(test.limit(0), m).collect() == []
    assert langid.predict_language(docs.withColumn("held_out", F.lit(False)), m).count() == docs.count()
    import zlib

    assert [r[0] for r in spark.range(50).select(langid.held_out("id")).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def kneser_ney(texts, text, symbols):
    """Cross-entropy per symbol of text by an interpolated Kneser-Ney model of texts, with dictionaries only."""
    n = langid.ORDER

    def ends(t):
        s = "\0" * (n - 1) + "\0".join(w for w in re.split(r"[\W\d_]+", t.lower()) if w) + "\0"
        return [s[i - n + 1 : i + 1] for i in range(n - 1, len(s))]

    counts = Counter(g for t in texts for g in ends(t))
    levels = [counts]
    for _ in range(n - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()

    def p(g, order):
        if not order:
            return 1 / symbols
        c = levels[order - 1]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        less = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        after = [v for k, v in c.items() if k[:-1] == g[:-1]]
        below = p(g[1:], order - 1)
        return below if not after else (c[g] - less if g in c else 0) / sum(after) + less * len(after) / sum(after) * below

    return -sum(math.log(p(g, n)) for g in ends(text)) / len(ends(text))


def test_kneser_ney_by_brute_force():
    rng = random.Random(11)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(12))
    texts = [make("abcda") for _ in range(6)]
    alphabet = langid.Alphabet(np.array(sorted(map(ord, "abcdx"))))
    model = langid.CharModel.fit(np.concatenate([langid.grams(alphabet.symbols(t)) for t in texts]), alphabet.size)
    m = langid.LanguageModels(alphabet, ["l"], [model])
    tests = [*texts[:2], make("abcdx"), make("x"), "a"]
    assert np.allclose(m.entropies(tests)[0][:, 0], [kneser_ney(texts, t, alphabet.size) for t in tests])


def test_language_scripts(spark, monkeypatch):
    """Languages of many letters, in scripts of their own and in a shared one; texts that are scored in parts."""
    rng = random.Random(12)
    ranges = {"el": range(0x3B1, 0x3C9), "ru": range(0x430, 0x450), "uk": [*range(0x430, 0x449), 0x456, 0x457, 0x454], "zh": range(0x4E00, 0x4E00 + 1500), "ja": [*range(0x3041, 0x3090), *range(0x4E00, 0x4E00 + 300)], "old": range(0x10400, 0x10428)}
    make = lambda x, n: " ".join("".join(chr(rng.choice(list(ranges[x]))) for _ in range(4)) for _ in range(n))
    train = spark.createDataFrame([(100 * k + i, make(x, 60), x) for k, x in enumerate(ranges) for i in range(40)], "doc_id long, text string, lang string")
    m = langid.fit_language_models(train)
    assert m.alphabet.size > 1000 and m.languages == sorted(ranges)
    monkeypatch.setattr(langid, "SCORED", 500)
    texts = [(make(x, 40), x) for x in ranges for _ in range(10)]
    best = m.entropies([t for t, _ in texts])[0].argmin(1)
    assert np.mean([m.languages[b] == x for b, (_, x) in zip(best, texts, strict=True)]) > 0.95
    none_knows = langid.predict_language(spark.createDataFrame([(1, "\u0e01\u0e02 \u0e03\u0e04\u0e05" * 20, True)], "doc_id long, text string, held_out boolean"), m).first()
    assert none_knows["rejected"]
    few = langid.training_sample(train, "text", "lang", "doc_id", 400, 1500)
    assert {n for _, n in few} == set(ranges) and all(sum(len(t.encode()) for t, x in few if x == n) <= 1500 for n in ranges)
    assert {n for _, n in langid.training_sample(train, "text", "lang", "doc_id", 400, 10)} == set(ranges)


def test_mixing(spark, docs, none, monkeypatch):
    rng = random.Random(7)
    rows = [(i, s, rng.randint(1, 50)) for i, s in enumerate(rng.choices(["a", "b", "c", None], [70, 20, 9, 1], k=2000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("text", F.lit("x"))
    total, by = sum(r[2] for r in rows), Counter()
    for _, s, n in rows:
        by[s] += n
    for limit in (None, 1.5):
        plan = mixing.solve_exponent(df.groupBy("source").agg(F.sum("size").alias("tokens")), 0.5, limit, 1.0)
        weight = lambda a: {s: (n / total) ** a / sum((m / total) ** a for m in by.values()) for s, n in by.items()}
        entropy = lambda a: -sum(w * math.log(w) for w in weight(a).values())
        repeats = lambda a: max(weight(a)[s] * total / by[s] for s in by)
        goal = (entropy(1) + entropy(0)) / 2
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if entropy(mid) <= goal and (limit is None or repeats(mid) <= limit) else (mid, high)
        assert abs(plan.exponent - high) < 1e-6
        out = mixing.mix_sources(df, tokens="size", target_entropy=0.5, most_repeats=limit, block_tokens=500).collect()
        taken = Counter()
        for r in out:
            taken[r["source"]] += r["mix_tokens"]
        for s in by:
            budget = weight(high)[s] * total
            assert budget - 60 < taken[s] <= budget + 1
        times = Counter(r["doc_id"] for r in out)
        for s in by:  # copies of a source's documents differ by one at most
            n = [times[i] for i, x, _ in rows if x == s]
            assert max(n) - min(n) <= 1
    few = mixing.mix_sources(df, tokens="size", block_tokens=500).collect()
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert Counter(mixing.mix_sources(df, tokens="size", block_tokens=500).collect()) == Counter(few)
    full = mixing.mix_sources(df, tokens="size", budget_share=None)
    assert full.select("doc_id").distinct().count() == 2000
    taken = mixing.mix_sources(docs, budget_share=None)
    assert taken.columns[: len(docs.columns)] == docs.columns
    for at in ("doc_id", "text"):  # null and repeated ids, null and empty texts: all of them at least as often as they occur
        assert not Counter(r[at] for r in docs.collect()) - Counter(r[at] for r in taken.collect())
    assert mixing.mix_sources(none).collect() == []
    assert not re.search("Python|Arrow|Pandas", full._jdf.queryExecution().executedPlan().toString())


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked)


def test_quality_rules(docs, none, spark):
    got = Counter((r["doc_id"], *tuple(r)[1:6], r["base_failed"]) for r in quality_rules.quality_rules(docs).collect())
    want = Counter((i, *(c := brute_counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in texts(docs))
    assert got == want
    assert quality_rules.quality_rules(none).collect() == []
    good = [(i, " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(60)), "en", f"s{i % 2}") for i in range(600)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(60)), "en", "s0") for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(600)) and not any(out[i] for i in range(1000, 1005))


def test_quality_fences_by_brute_force(spark):
    """Each group's fence against exact quartiles of its documents, with the sketches' error of ranks."""
    rng, names = random.Random(8), [r.name for r in quality_rules.RULES]
    rows = []
    for (g, h), n in {("a", "x"): 3000, ("a", "y"): 150, ("b", "x"): 5, ("b", "z"): 40, ("c", "x"): 1}.items():
        at, wide = rng.uniform(-6, -2), rng.uniform(0, 1.5)
        rows += [(g, h, *[rng.gauss(at - i, wide) for i in range(len(names))]) for _ in range(n)]
    rows += [("d", "w", *[-3.0] * len(names))] * 50  # no spread at all
    got = {(r["g0"], r["g1"]): r for r in quality_rules.fences(spark.createDataFrame(rows, "g0 string, g1 string, " + ", ".join(f"{n} double" for n in names)), ["g0", "g1"]).collect()}
    error = 0.01

    def own(values, reach, sign):
        v = sorted(values)
        q = lambda p: v[min(len(v) - 1, max(0, math.ceil(p * len(v)) - 1))]
        q1, q3 = q(0.25 - sign * error), q(0.75 + sign * error)
        return q3 + reach * max(q3 - q1, quality_rules.LEAST_SPREAD)

    def exact(group, i, reach, sign):
        out = None
        for depth in range(3):
            v = [r[2 + i] for r in rows if r[:depth] == group[:depth]]
            w = len(v) / (len(v) + quality_rules.PRIOR)
            out = own(v, reach, sign) if out is None else w * own(v, reach, sign) + (1 - w) * out
        return out

    assert set(got) == {r[:2] for r in rows}
    for group, r in got.items():
        for i, rule in enumerate(quality_rules.RULES):
            assert exact(group, i, rule.reach, -1) - 1e-9 <= r[f"{rule.name}_fence"] <= exact(group, i, rule.reach, 1) + 1e-9
    assert all(len({round(r[f"{n}_fence"], 3) for r in got.values()}) == len(got) for n in names)


def test_quality_fences_follow_the_group(spark):
    def text(i, loud, same):  # 60 words, so many in capitals; 20 lines, so many alike
        w = [f"w{(i * 31 + j * 7) % 997}" for j in range(60)]
        w = [f"ABCD{x}" if j < loud else x for j, x in enumerate(w)]
        lines = [" ".join(w[k : k + 3]) for k in range(0, 60, 3)]
        return "\n".join(f"again {i}" if k % 2 and k < 2 * same else x for k, x in enumerate(lines))

    rows = [(i, text(i, 3 + i % 2, i % 2), "en", "calm") for i in range(900)] + [(1000 + i, text(i, 6 + i % 20, 2 + i % 7), "en", "wild") for i in range(900)]
    rows += [(2000, text(7, 26, 0), "en", "calm"), (2001, text(7, 26, 0), "en", "wild"), (2002, text(7, 3, 9), "en", "calm"), (2003, text(7, 6, 9), "en", "wild")]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i]["kept"] for i in [*range(900), *range(1000, 1900), 2001, 2003])
    assert "upper_rate" in out[2000]["failed_rules"] and "dup_line_rate" in out[2002]["failed_rules"]


def test_quality_model(spark, docs, none):
    good = [(i, " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(40 + i % 20)), "en", f"s{i % 3}") for i in range(300)]
    bad = [(1000 + i, "SPAM!! " * (20 + i % 9), "en", "s0" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string").withColumn("quality", F.lit(9))
    labels = df.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    out = {r["doc_id"]: r for r in quality_model.quality_classifier(df, labels).collect()}
    assert all(out[i]["kept"] for i in range(300)) and not any(out[i]["kept"] for i in range(1000, 1100))
    assert out[0]["host_prior"] < out[1]["host_prior"]  # s0 has spam, s1 hasn't
    assert quality_model.quality_classifier(none, labels).collect() == []
    assert quality_model.quality_classifier(docs, labels.limit(0)).count() == docs.count()


def test_quality_model_awkward(spark, docs):
    """Rows of every kind are judged when there is a model, too; a text without words is never kept."""
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), *[(i, 1) for i in range(10, 50)], (None, 1), (12, None), (10**9, 0)], "doc_id long, quality int")
    out = quality_model.quality_classifier(docs, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in texts(docs))
    assert not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3)) and sum(r["kept"] for r in out) > 40


def test_quality_sites_decide_where_texts_cannot(spark):
    """Half of the documents read the same on good and bad sites; only their sites tell them apart. Where sites tell
    nothing, their fitted weight is next to nothing."""
    rng = random.Random(13)

    def doc(kind):  # clear ones differ in symbols, doubtful ones don't
        extra = {"good": "", "bad": "###", "doubtful": "#"}
        return " ".join(f"w{rng.randrange(900)}" + (extra[kind] if rng.random() < (0.9 if kind == "bad" else 0.5) else "") for _ in range(50))

    rows, truth = [], {}
    for i in range(2400):
        site = i % 12
        good = rng.random() < (0.95 if site < 6 else 0.05)
        truth[i] = int(good)
        rows.append((i, doc("doubtful" if i // 12 % 2 else "good" if good else "bad"), f"http://Site{site}.example/{'ab'[i // 24 % 2]}/{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    labels = spark.createDataFrame([(i, truth[i]) for i in truth if i % 3], "doc_id long, quality int")
    right = lambda **more: sum(r["kept"] == bool(truth[r["doc_id"]]) for r in quality_model.quality_classifier(df, labels, url="url", **more).collect() if r["doc_id"] % 3 == 0)
    with_sites, without = right(), right(prior_weight=0.0)
    assert with_sites >= without + 60, (with_sites, without)
    rows = [(rng.random() < 0.5, rng.gauss(0, 2), rng.gauss(0, 1)) for _ in range(4000)]
    said = [(int(rng.random() < 1 / (1 + math.exp(-x))), x, s) for _, x, s in rows]
    assert quality_model.fit_prior_weight(said) < 0.1
    said = [(int(rng.random() < 1 / (1 + math.exp(-x - 0.6 * s))), x, s) for _, x, s in rows]
    assert 0.5 < quality_model.fit_prior_weight(said) < 0.7 and quality_model.fit_prior_weight([]) == 1.0


def test_site_posteriors_by_brute_force(spark):
    rng = random.Random(14)
    rows = [(f"h{h}", f"p{p}", min(1.0, max(0.0, rng.gauss(0.2 + 0.05 * h, 0.1)))) for h in range(12) for p in range(4) for _ in range(rng.choice([1, 2, 5, 60]))]
    sites, mean = quality_model.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"), "host", "path")
    got = {(r["host"], r["path"]): (r["n"], r["host_mean"], r["path_mean"]) for r in sites.collect()}

    def grouped(k):
        out = {}
        for r in rows:
            out.setdefault(r[:k], []).append(r[2])
        return out

    whole = sum(r[2] for r in rows) / len(rows)
    centred = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v)
    pooled = sum(map(centred, grouped(2).values())) / len(rows)

    def shrink(groups, prior):
        within = {g: (centred(v) + quality_model.WITHIN * pooled) / (len(v) + quality_model.WITHIN) for g, v in groups.items()}
        between = max(1e-4, sum(len(v) * (sum(v) / len(v) - prior(g)) ** 2 - within[g] for g, v in groups.items()) / len(rows))
        return {g: prior(g) + between / (between + within[g] / len(v)) * (sum(v) / len(v) - prior(g)) for g, v in groups.items()}

    hosts = shrink(grouped(1), lambda g: whole)
    paths = shrink(grouped(2), lambda g: hosts[g[:1]])
    assert abs(mean - whole) < 1e-9 and set(got) == set(paths)
    assert all(np.allclose(got[g], (len(v), hosts[g[:1]], paths[g])) for g, v in grouped(2).items())


def test_shrinkage(spark):
    rows = [("big", "x", 0.9)] * 500 + [("big", "y", 0.2)] * 3 + [("small", "x", 0.1)] * 2 + [("mid", "x", 0.5)] * 100 + [("mid", "z", 0.4 + 0.2 * (i % 2)) for i in range(100)]
    sites, mean = quality_model.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"), "host", "path")
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    assert abs(mean - sum(r[2] for r in rows) / len(rows)) < 1e-9
    assert 0.1 <= got["small", "x"]["host_mean"] < mean and abs(got["big", "x"]["host_mean"] - 0.9) < 0.05
    assert 0.2 <= got["big", "y"]["path_mean"] <= got["big", "y"]["host_mean"]


def scanned(spark, rows, model):
    return licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()


@pytest.fixture(scope="module")
def licence_model():
    return licenses.fit_licences(["some plain words of a corpus", "other words here", "mit der zeit kommen worte", "a commons for all of us"])


def test_licences(spark, docs, none, licence_model):
    rows = [(1, "Licensed under the Foo License"), (2, ""), (3, None), (4, "Released under the MIT License."), (5, "foo\nbar this work is licensed under the GNU General Public License, version 3. ok"), (7, "All rights reserved"), (8, "nothing of the kind"), (4, "Released under the MIT License."), (9, "A licence to thrill\n\nLicensed under CC BY-NC 4.0"), (10, "mit und ohne"), (11, "License " + "mit " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    scan = licenses.licence_scan(df, licence_model)
    got = Counter((r["doc_id"], r["paragraph"], r["licence"]) for r in scan.collect() if r["doc_id"] < 11)
    assert got == Counter([(1, 0, "unknown"), (4, 0, "mit"), (4, 0, "mit"), (5, 0, "gpl-3.0"), (7, 0, "unknown"), (9, 0, "unknown"), (9, 1, "cc-by-nc")])
    for family, notices in licenses.NOTICES.items():
        found = scanned(spark, [(i, "x.\n" + n) for i, n in enumerate(notices)], licence_model)
        assert {(r["paragraph"], r["licence"]) for r in found} == {(1, family)}
    assert licenses.licence_scan(none).collect() == [] and licenses.licence_scan(docs, licence_model).count() == 0
    assert not re.search("Python|Arrow|Pandas", scan._jdf.queryExecution().executedPlan().toString())


def test_licences_of_no_known_family(spark, licence_model):
    """Licences that training doesn't name: each gives a row, and none is taken for a family."""
    texts = ["Eclipse Public License 2.0", "GNU Affero General Public License v3", "ISC License", "Licensed under the EUPL", "This file is under the European Union Public Licence.", "Code: Vim license", "The Q Public License 1.0 applies", "(C) Copyright 1999 by Foo", "Do you have a driver's license?", "Licensed under the OpenSSL licence"]
    got = {r["doc_id"]: r for r in scanned(spark, list(enumerate(texts)), licence_model)}
    assert set(got) == set(range(len(texts))) and {r["licence"] for r in got.values()} == {"unknown"}
    assert [t for i, t in enumerate(texts) if got[i]["family"] != "unknown"] == []


def test_archives_are_cut_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 8 << 20)
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "concat(repeat(cast(id as string), 500000), 'x') AS html").repartition(2)
    assert warc.file_records(pages) < 12 and warc.file_records(pages.selectExpr("page_id", "url", "'short' AS html")) == (8 << 20) // 705
    warc.write_archives(pages, str(tmp_path / "warc"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) >= 4 and max(sizes) < 3 * (8 << 20)
    got = {r["page_id"]: r["payload_bytes"] for r in warc.resolve(warc.read_archives(spark, str(tmp_path / "warc"))).collect()}
    assert got == {i: 500_000 * len(str(i)) + 1 for i in range(40)}


def test_licences_in_long_repetitions(spark, licence_model):
    """Patterns that recurse once per repetition end the JVM long before this."""
    rows = [(1, "MIT License" + "\n" * 100_000 + "x"), (2, "MIT License\n" + " \n" * 100_000 + "MIT License"), (3, "license " + "1." * 100_000 + "1"), (4, "MIT License" + "\r\n" * 100_000), (5, "MIT License" + " " * 100_000 + "\nx")]
    got = Counter((r["doc_id"], r["paragraph"], r["licence"]) for r in scanned(spark, rows, licence_model))
    assert got == {(1, 0, "mit"): 1, (2, 0, "mit"): 1, (2, 1, "mit"): 1, (3, 0, "unknown"): 1, (4, 0, "mit"): 1, (5, 0, "mit"): 1}


def test_licence_recall_on_unseen_wordings(spark, licence_model):
    texts = {
        "mit": ["MIT license", "This project is MIT licensed.", "Code in this folder falls under the MIT license, see below", "(c) 2021 Ann Example, MIT License", "available to anyone under an MIT licence"],
        "apache-2.0": ["Distributed under the Apache 2.0 license", "Apache License, Version 2.0 governs this file", "we chose the Apache License 2.0 for it", "dual use is allowed by the Apache 2.0 licence terms"],
        "bsd": ["(c) ACME, BSD 3-Clause", "It is free under a 3-clause BSD license", "this module is covered by the new BSD license"],
        "gpl-2.0": ["GPL version 2 only", "You can copy it under GPLv2 terms", "GNU General Public License version 2 or any later one"],
        "gpl-3.0": ["the whole is GPLv3", "GNU General Public License version 3 covers the tool", "use GPL v3 or later here"],
        "lgpl": ["under LGPL 2.1", "linking is fine by the GNU Lesser General Public License"],
        "mpl-2.0": ["Mozilla Public License 2.0 applies to all files", "files are MPL 2.0"],
        "cc0": ["Creative Commons Zero v1.0", "Licensed under CC0", "I put it in the public domain by CC0 1.0"],
        "cc-by": ["Photos: CC BY 4.0", "text may be shared by the Creative Commons Attribution 4.0 terms"],
        "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 licence applies", "wiki text is CC BY-SA 4.0"],
        "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0, no selling", "images CC BY-NC 4.0"],
    }
    rows = [(f, t) for f, ts in texts.items() for t in ts]
    got = {r["doc_id"]: r for r in scanned(spark, [(i, t) for i, (_, t) in enumerate(rows)], licence_model)}
    missed = [(f, t, got.get(i)) for i, (f, t) in enumerate(rows) if i not in got or got[i]["family"] != f]
    assert len(missed) <= len(rows) // 10, missed
    assert sum(r["confirmed"] for r in got.values()) >= 0.8 * len(rows)


def test_wrapped_licence_notices(spark, licence_model):
    import textwrap

    long = {
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it without restriction",
        "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
        "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    }
    for width in (40, 72):
        for end in ("\n", "\r\n"):
            rows = [(i, f"Title\n\n{end.join(textwrap.wrap(t, width))}\n\nthe end") for i, t in enumerate(long.values())]
            got = scanned(spark, rows, licence_model)
            assert [(r["doc_id"], r["paragraph"], r["licence"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(i, 1, f) for i, f in enumerate(long)]


def test_licences_by_brute_force(spark, licence_model):
    """All paragraphs, without looking for telling words first, by the model's definition."""
    import regex

    rng = random.Random(15)
    corpus = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    notices = [x for ns in [*licenses.NOTICES.values(), *licenses.NAMES.values()] for x in ns]
    rows = [(i, t and t + rng.choice(["\n", ". ", "\n\n", "\r\n"]) + rng.choice([*notices, "no notice at all", "a license?"])) for i, t in enumerate(corpus)]
    m, want = licence_model, Counter()
    for i, text in rows:
        joined = regex.sub(rf"(?m)(?<=^[^\n]{{1,{licenses.WRAPPED}}})(?<![.!?\s])[^\S\n]*\n[^\S\n]*(?=\S)(?!(?i:(?:[#/*;-]+\s*)?spdx-))", " ", regex.sub(r"\r\n?", "\n", text or ""))
        for at, p in enumerate(regex.split(r"\n(?:[^\S\n]*\n)*", joined)):
            w = licenses.tokens(p)
            z = (np.array(m.bias) + sum((np.array(m.weights[g]) for g in licenses.grams(w) if g in m.weights), np.zeros(len(m.bias)))) * m.scale
            prob = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            likely = m.classes[int(prob.argmax())]
            if likely == "none" and not re.search(licenses.MENTIONS, p):
                continue
            have = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} | set(w)
            sure = likely not in ("none", "unknown") and prob.max() >= m.least
            good = sure and any(len(have & set(t)) >= licenses.needed(t) for t in licenses.TEMPLATES[likely])
            want[i, at, likely if sure else "unknown", round(float(prob.max()), 6), good] += 1
    got = Counter((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 6), r["confirmed"]) for r in scanned(spark, rows, m))
    assert got == want and len(want) > 100


def test_frequent_licence_notices(spark):
    notices = [(i, f"Copyright {1990 + i % 30} Name{i}. Released under the MIT License.") for i in range(300)]
    prose = [(1000 + i, f"w{i} mit x{i * 3} some plain prose number {i} of it") for i in range(600)]
    for rows in (notices + prose, notices[:4] + prose[:8]):
        got = {(r["doc_id"], r["licence"]) for r in licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(i, "mit") for i, _ in rows if i < 1000}
