"""The subpackage's queries opN_<name>, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import table
from .conversations import DELETE, INSERT, REROLE, TRUNCATED, UNREACHED, damage, repair_conversations
from .fim import fill_in_middle, restored
from .fingerprints import fingerprints
from .jaccard import ngram_jaccard_join
from .langid import fit_language_models, held_out, predict_language
from .licenses import licence_scan
from .mixing import mix_sources, solve_exponent, whitespace_tokens
from .quality_model import quality_classifier
from .quality_rules import quality_rules
from .secrets import KEYWORDS, KINDS, LEAST_ASSIGNED, secret_scan, written
from .toxicity import fit_toxicity, score_toxicity
from .warc import warc_round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ("ids_sha256", "decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    models = fit_language_models(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict_language(docs, models)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) AS n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair_conversations(damage(table(spark, sf_dir, "conversations")))
    return repaired.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("turns", "repaired")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_fingerprints that SQL can tell."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12_secrets that SQL can tell."""
    return op12_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_quality_rules that SQL can tell."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights of op7_mix_sources by source, to five digits, of the exponent that it solves for."""
    docs = table(spark, sf_dir, "documents")
    totals = docs.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.sum(whitespace_tokens()).alias("tokens"))
    plan = solve_exponent(totals, 0.5, 4.0, 1.0)
    total = totals.agg(F.sum("tokens")).first()[0] or 1
    q = F.pow(F.col("tokens") / total, F.lit(plan.exponent))
    norm = totals.agg(F.sum(q)).first()[0] or 1.0
    return totals.select("source", "tokens", F.round(q / norm, 5).alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [edited_texts, rule_counts, mixture_weights, secret_counts, op1_ngram_jaccard_join, op2_fingerprints, op3_toxicity, op4_byte_bpe, op5_warc, op6_language, op7_mix_sources, op8_quality, op9_quality_rules, op10_licences, op11_fill_in_middle, op12_secrets, op13_conversation_repair]
    return {f.__name__: f for f in found}


def _repair_sql() -> str:
    """The SQL of op13_conversation_repair: a checksum bit by bit, and a fold by list_reduce."""
    bits = "list_reduce(range(8), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END), xor(h, x))"
    crc = f"xor(list_reduce(list_transform(range(length(k)), lambda i: CAST(ascii(substr(k, i + 1, 1)) AS BIGINT)), lambda h, x: {bits}, 4294967295), 4294967295)"
    edit = lambda way, cost, letter, code: f"{{'c': ({way}).c + {cost}, 'a': ({way}).a || {letter}, 'p': ({way}).p || {code}}}"
    stays = f"(CASE t.fault WHEN 'truncated' THEN {TRUNCATED} WHEN '' THEN 0 ELSE {UNREACHED} END)"
    takes = lambda way, r: edit(way, f"{stays} + (CASE WHEN t.initial = '{r}' THEN 0 ELSE {REROLE} END)", f"(CASE WHEN t.initial = '{r}' THEN 'K' ELSE 'R' END)", f"(CASE WHEN t.initial = '{r}' THEN 'K' ELSE '{r}' END)")
    gone = lambda way: edit(way, DELETE, "'D'", "'D'")
    after_u = f"least(w[3], {edit('least(w[1], w[2], w[4])', INSERT, chr(39) + 'I' + chr(39), chr(39) + 'U' + chr(39))})"
    inserted = f"list_transform([{after_u}], lambda u: [w[1], w[2], u, least(w[4], {edit('u', INSERT, chr(39) + 'I' + chr(39), chr(39) + 'A' + chr(39))})])[1]"
    opens = edit("x[1]", f"{stays} + (CASE WHEN t.initial = 's' THEN 0 ELSE {UNREACHED} END)", "'K'", "'K'")
    step = f"list_transform([{inserted}], lambda x: [{gone('x[1]')}, least({gone('x[2]')}, {opens}), least({gone('x[3]')}, {takes('least(x[1], x[2], x[4])', 'u')}), least({gone('x[4]')}, {takes('x[3]', 'a')})])[1]"
    begin = "[{'c': CAST(0 AS BIGINT), 'a': '', 'p': ''}, " + ", ".join([f"{{'c': CAST({UNREACHED} AS BIGINT), 'a': '', 'p': ''}}"] * 3) + "]"
    insert = lambda code: f"replace(replace({code}, 'U', 'user:' || chr(10)), 'A', 'assistant:' || chr(10))"
    line = """CASE right(codes[i], 1) WHEN 'D' THEN '' WHEN 'K' THEN ts[i].role || ':' || ts[i].text || chr(10) WHEN 'u' THEN 'user:' || ts[i].text || chr(10) ELSE 'assistant:' || ts[i].text || chr(10) END"""
    return rf"""
        WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        c AS (SELECT *, {crc} % 20 AS c FROM k),
        d AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM p),
        f AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, list({{'initial': initial, 'fault': fault, 'role': role, 'text': text}} ORDER BY pos) AS ts FROM f GROUP BY conv_id),
        e AS (SELECT *, list_reduce(ts, lambda w, t: {step}, {begin}) AS w FROM g),
        b AS (SELECT * EXCLUDE w, least(w[1], w[4]) AS best FROM (SELECT * EXCLUDE w, {inserted} AS w FROM e)),
        r AS (SELECT *, regexp_extract_all(best.p, '[UA]*[DKua]') AS codes FROM b),
        t AS (SELECT *, list_reduce(list_transform(range(1, len(ts) + 1), lambda i: {insert("regexp_extract(codes[i], '^[UA]*')")} || {line}), lambda x, y: x || y, '') || {insert("regexp_extract(best.p, '[UA]*$')")} AS out FROM r)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(out, length(out) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
    """


def oracle_sql() -> dict[str, str]:
    either_case = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in KEYWORDS)
    return {
        "op13_conversation_repair": _repair_sql(),
        "op11_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
            h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS UBIGINT) AS h4 FROM d),
            c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
                CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
            p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
            SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
        """,
        "secret_counts": rf"""
            SELECT doc_id, len(list_filter(regexp_extract_all(t, '({either_case})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= {LEAST_ASSIGNED})) AS n_assign,
                len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        """,
        "op1_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            sets AS (
                SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
            sizes AS (SELECT doc_id, len(s) AS n FROM sets),
            items AS (SELECT doc_id, unnest(s) AS x FROM sets),
            common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
            links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
            both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach AS (SELECT doc_id AS node, doc_id AS seen FROM sizes UNION SELECT node, b FROM reach JOIN both_ways ON a = seen)
            SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, m AS component_id FROM sizes JOIN (SELECT node, min(seen) AS m FROM reach GROUP BY node) ON node = doc_id
        """,
        "edited_texts": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u FROM d)
            SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(u, 1, n // 2)) AS edited_sha256 FROM w
        """,
        "rule_counts": r"""
            WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
            m AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(8) r(j) WHERE c > 1 GROUP BY 1),
            l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
            c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id))
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
        """,
        "mixture_weights": r"""
            WITH RECURSIVE t AS (SELECT coalesce(source, 'none') AS source, sum(greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')), 1)) AS tokens FROM documents GROUP BY 1),
            p AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM t) AS p FROM t), goal AS (SELECT 0.5 * -sum(p * ln(p)) + 0.5 * ln(count(*)) AS e FROM p),
            b AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
                UNION ALL SELECT step + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END FROM (SELECT step, low, high,
                    (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) <= (SELECT e FROM goal) + 1e-9 AND max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) <= 4 + 1e-9 FROM p) AS ok FROM b WHERE step < 40)),
            a AS (SELECT high AS a FROM b WHERE step = 40)
            SELECT source, CAST(tokens AS BIGINT) AS tokens, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a), 5) AS weight FROM p, a
        """,
        "op5_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
            f AS (SELECT payload_digest AS g, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN first < page_id THEN first END AS refers_to FROM d LEFT JOIN f ON g = payload_digest
        """,
    }
