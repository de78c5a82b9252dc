"""Queries for similarity, retrieval and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval as rt
from ..operators import vector_index
from ..tables import load, scratch
from .registry import query


@query("""WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS p, list(DISTINCT l_suppkey) AS q, list(DISTINCT l_returnflag) AS r FROM lineitem GROUP BY 1), t AS (SELECT p AS tp, q AS tq, r AS tr FROM s WHERE k = 7),
    j AS (SELECT k, 0.55 * len(list_intersect(p, tp)) / (len(p) + len(tp) - len(list_intersect(p, tp))) + 0.25 * len(list_intersect(q, tq)) / (len(q) + len(tq) - len(list_intersect(q, tq)))
        + 0.2 * len(list_intersect(r, tr)) / (len(r) + len(tr) - len(list_intersect(r, tr))) AS x FROM s, t WHERE k <> 7)
    SELECT k AS l_orderkey, round(CAST(x AS DOUBLE), 4) AS score FROM j ORDER BY 2 DESC, 1 LIMIT 10""")
def routine_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("suppliers"), F.collect_set("l_returnflag").alias("flags"))
    return rt.routine_similarity(sets, "l_orderkey", 7, {"parts": 0.55, "suppliers": 0.25, "flags": 0.20}, 10)


@query("""WITH r AS (SELECT o_custkey AS root, o_orderkey AS unit FROM orders), x AS (SELECT root, l_partkey, l_suppkey, l_returnflag, l_linenumber, unit FROM r JOIN lineitem ON l_orderkey = unit)
    SELECT root, array_to_string(list_sort(list(DISTINCT unit)), ',') AS reached, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS called, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS used, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS hardware, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS ports FROM x GROUP BY root""")
def routine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature sets over all units that a routine reaches, sorted; materialised tables of them serve similarity searches."""
    reached = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("unit"))
    facts = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("called"), F.col("l_suppkey").alias("used"), F.col("l_returnflag").alias("hardware"), F.col("l_linenumber").alias("ports"))
    sets = rt.routine_sets(reached, facts, "root", "unit", ["called", "used", "hardware", "ports"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return sets.select("root", *[text(c) for c in ("reached", "called", "used", "hardware", "ports")])


@query("""WITH t AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), d AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)))) AS d FROM embeddings, t WHERE vec_id <> 3)
    SELECT vec_id, round(d, 4) AS distance FROM d ORDER BY d, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.vector_top(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, 10).select("vec_id", F.round("distance", 4).alias("distance"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_sum(list_transform(range(1, 65), lambda i: (b.e[i] - a.e[i]) * (b.e[i] - a.e[i]))) AS d FROM x a, x b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query, neighbour, round(d, 4) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS INTEGER) AS rank FROM d QUALIFY rank <= 10""")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all rows to each row whose id is divisible by 20, by the index in its exact form."""
    df = load(spark, sf_dir, "embeddings")
    model = vector_index.fit_centres(df)
    found = vector_index.nearest(vector_index.index_vectors(df, model), df.where("vec_id % 20 = 0"), model, 10, len(model.centres), None)
    return found.select("query", "neighbour", F.round("distance", 4).alias("distance"), "rank")


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries by quantised residuals, with as many lists as a sample of about 200 rows needs for a recall of 0.95."""
    df = load(spark, sf_dir, "embeddings")
    model = vector_index.fit_centres(df)
    index = scratch(vector_index.index_vectors(df, model), "index")
    few = df.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 200 / max(df.count(), 1)) * (1 << 30))))
    probes, _ = vector_index.probes_for(index, few, model)
    return vector_index.nearest(index, df.where("vec_id % 20 = 0"), model, 10, probes)


_QUESTION = "the of THING src3 7"


@query(r"""WITH d AS (SELECT doc_id, lower(source) AS n, lower(text) AS t, length(text) AS len, lang, regexp_extract_all(lower(source) || ' ' || lower(text), '[a-z_][a-z0-9_.]*|\d+') AS w FROM documents),
    f AS (SELECT *, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b, len(list_filter(w, lambda x: x = 'thing')) AS c, len(list_filter(w, lambda x: x = 'src3')) AS e, len(list_filter(w, lambda x: x = '7')) AS g FROM d)
    SELECT doc_id, round(CAST(least(a, 5) * CASE WHEN contains(n, 'the') THEN 4 ELSE 1 END + least(b, 5) * CASE WHEN contains(n, 'of') THEN 4 ELSE 1 END + least(c, 5) * CASE WHEN contains(n, 'thing') THEN 4 ELSE 1 END + least(e, 5) * CASE WHEN contains(n, 'src3') THEN 4 ELSE 1 END
        + least(g, 5) * CASE WHEN contains(n, '7') THEN 4 ELSE 1 END + CASE WHEN contains(regexp_replace(t, '\s+', ' ', 'g'), 'the of thing src3 7') THEN 6 ELSE 0 END
        + CASE WHEN lang = 'en' AND (contains(n, 'the') AND a > 0 OR contains(n, 'of') AND b > 0 OR contains(n, 'thing') AND c > 0 OR contains(n, 'src3') AND e > 0 OR contains(n, '7') AND g > 0) THEN 2.5 ELSE 0 END AS DOUBLE), 3) AS score,
        CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (e > 0)::INT + (g > 0)::INT AS INTEGER) AS overlap, CAST(len AS INTEGER) AS len FROM f WHERE a + b + c + e + g > 0 ORDER BY score DESC, overlap DESC, len DESC, doc_id LIMIT 10""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a question's tokens; English ones are of a kind whose name counts more."""
    rows = load(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("lang") == "en", "POU_x").otherwise("task"))
    return rt.lexical_top(rows, "doc_id", "source", "text", _QUESTION, 10, "kind")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL""")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.term_frequency(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, text, unnest(range(0, greatest(0, n - 241) + 1, 2960)) AS start FROM d)
    SELECT doc_id, CAST(start // 2960 AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, substring(text, start + 1, 3200) AS body FROM c WHERE length(substring(text, start + 1, 3200)) >= 80 OR start = 0""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.chunk_windows(load(spark, sf_dir, "documents"), "doc_id", "text", 3200, 240, 80)


@query("""WITH t AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'ns=4;s=' ELSE '' END || 'Supp.x.K' || (c_custkey % 97) AS token FROM customer), y AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'ns=4;s=' ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN 'Supp' ELSE 'Other' || s_suppkey END || '.' || CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE 'y' END || '.k' || (s_suppkey % 50) AS symbol,
        CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN s_suppkey % 7 < 2 THEN 6 ELSE 0 END AS more FROM supplier),
    ta AS (SELECT token, lower(regexp_replace(token, '^ns=4;s=', '')) AS id, unnest([{'a': lower(regexp_replace(token, '^ns=4;s=', '')), 's': 100}] || CASE WHEN starts_with(token, 'ns') THEN [{'a': lower(token), 's': 80}] ELSE [] END || [{'a': lower(split_part(token, '.', 2) || '.' || split_part(token, '.', 3)), 's': 88}, {'a': lower(split_part(token, '.', 3)), 's': 55}]) AS e FROM t),
    ya AS (SELECT symbol, more, lower(regexp_replace(symbol, '^ns=4;s=', '')) AS id, unnest([{'a': lower(regexp_replace(symbol, '^ns=4;s=', '')), 's': 100}] || CASE WHEN starts_with(symbol, 'ns') THEN [{'a': lower(symbol), 's': 80}] ELSE [] END || [{'a': lower(split_part(symbol, '.', 2) || '.' || split_part(symbol, '.', 3)), 's': 88}, {'a': lower(split_part(symbol, '.', 3)), 's': 55}]) AS e FROM y),
    b AS (SELECT token, symbol, max(ta.e.s + ya.e.s + more + CASE WHEN ta.id = ya.id THEN 25 ELSE 0 END + CASE WHEN lower(token) = lower(symbol) THEN 20 ELSE 0 END) AS score FROM ta JOIN ya ON ta.e.a = ya.e.a GROUP BY ALL)
    SELECT token, symbol, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, symbol) AS n FROM b) WHERE n = 1""")
def alias_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols for tokens: points of both aliases, and more for equal ids and texts, variables and truth values."""
    text, k = lambda c: c.cast("string"), F.col("s_suppkey")
    tokens = load(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "ns=4;s=").otherwise(""), F.lit("Supp.x.K"), text(F.col("c_custkey") % 97)).alias("token")).distinct()
    name = F.concat(F.when(k % 2 == 0, "ns=4;s=").otherwise(""), F.when(k % 4 == 0, "Supp").otherwise(F.concat(F.lit("Other"), text(k))), F.lit("."), F.when(k % 3 == 0, "x").otherwise("y"), F.lit(".k"), text(k % 50))
    symbols = load(spark, sf_dir, "supplier").select(name.alias("symbol"), F.when(k % 5 == 0, "vars").otherwise("rows").alias("source"), F.when(k % 7 == 0, "TRUE").when(k % 7 == 1, "false").when(k % 7 == 2, "12").alias("value"))
    return rt.alias_best(tokens, "token", symbols, "symbol", "source", "value").select("token", "symbol", F.col("score").cast("int").alias("score"))


@query("""SELECT p_partkey, greatest(CASE WHEN lower(p_brand) = 'brand' THEN 100 ELSE 0 END, CASE WHEN lower(regexp_extract(p_brand, '^([A-Za-z0-9]+)[_.]', 1)) = 'brand' THEN 60 ELSE 0 END, CASE WHEN starts_with(lower(p_brand), 'brand') THEN 40 ELSE 0 END, CASE WHEN contains(lower(p_brand), 'brand') THEN 20 ELSE 0 END) AS score FROM part""")
def name_scope_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", tx.name_score("p_brand", "Brand").alias("score"))


@query("""WITH w AS (SELECT p_partkey, p_size, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
    SELECT p_partkey, round(len(list_intersect(w, ['part', 'green', 'red', '7'])) / 4.0 + CASE WHEN p_size = 7 THEN 0.25 ELSE 0 END, 6) AS score FROM w ORDER BY 2 DESC, 1 LIMIT 12""")
def skill_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").withColumn("w", F.array_distinct(F.split(F.lower("p_name"), " ")))
    return rt.skill_prefilter(rows, "p_partkey", "w", ["part", "green", "red", "7"], F.col("p_size") == 7, 12)


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS INTEGER) AS n FROM documents")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tx.identifiers("text")).alias("n"))


@query(r"""SELECT page_id, CAST(length(regexp_replace(regexp_replace('(* ' || url || ' *) x // ' || url || chr(10) || html, '(?s)\(\*.*?\*\)', '', 'g'), '//[^\n]*', '', 'g')) AS INTEGER) AS n FROM pages""")
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("(* "), F.col("url"), F.lit(" *) x // "), F.col("url"), F.lit("\n"), F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.length(tx.strip_comments(code)).alias("n"))


@query("""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM benchmark),
    m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents) SELECT doc_id, name FROM m JOIN v USING (name)""")
def code_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-bounded, case-sensitive mentions of known names of any length, by an equi-join of tokens."""
    names = load(spark, sf_dir, "benchmark").select(F.explode(tx.identifiers("text")).alias("name")).distinct()
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(tx.identifiers("text")).alias("name")).join(names, "name").select("doc_id", "name")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM l),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM x WHERE contains(lower(lines[i + 1]), 'thing'))
    SELECT doc_id, CAST(n AS INTEGER) AS hit, CAST(i AS INTEGER) AS line_no, array_to_string(lines[greatest(i - 1, 0) + 1:i + 2], chr(10)) AS snippet FROM h WHERE n <= 3""")
def line_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.line_snippets(load(spark, sf_dir, "documents"), "doc_id", "text", "thing", 1, 3)


@query("""WITH r AS (SELECT l_orderkey AS path, l_partkey AS token, l_returnflag AS value FROM lineitem), e AS (SELECT p_partkey AS token, CASE WHEN p_size % 2 = 0 THEN 'R' ELSE 'N' END AS have, p_size % 3 = 0 AS snap, p_size % 5 = 0 AS soft FROM part),
    s AS (SELECT path, CASE WHEN have = value THEN CASE WHEN snap THEN CASE WHEN soft THEN 3 ELSE 6 END ELSE CASE WHEN soft THEN 1 ELSE 2 END END WHEN have <> value AND snap THEN CASE WHEN soft THEN -4 ELSE -8 END WHEN have <> value THEN -4 ELSE 0 END AS x, have <> value AS c FROM r LEFT JOIN e USING (token)),
    a AS (SELECT path, CAST(sum(x) AS BIGINT) AS score, count(*) FILTER (c) AS conflicts FROM s GROUP BY path) SELECT path, score, conflicts, conflicts = 0 AS possible FROM a""")
def state_path_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("token"), F.col("l_returnflag").alias("value"))
    even = F.col("p_size") % 2 == 0
    evidence = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("token"), F.when(even, "R").otherwise("N").alias("value"), F.when(F.col("p_size") % 3 == 0, "snapshot").otherwise("skill").alias("kind"), (F.col("p_size") % 5 == 0).alias("soft"))
    return rt.path_fit(needs, evidence, "path").select("path", "score", "conflicts", "possible")


_RANK = "CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_tax > 0.04 THEN 35 ELSE -5 END WHEN 1 THEN CASE WHEN l_tax > 0.04 THEN -5 ELSE 35 END WHEN 2 THEN 5 ELSE 0 END"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 120 WHEN l_returnflag = 'A' THEN 70 ELSE 10 END + CASE WHEN l_linestatus = 'O' THEN 40 WHEN l_quantity > 25 THEN 20 ELSE 0 END + {_RANK} AS score FROM lineitem)
    SELECT l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n FROM s) WHERE n = 1""")
def assignment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("l_linenumber") % 4 == 0, "Start").when(F.col("l_linenumber") % 4 == 1, "abort").when(F.col("l_linenumber") % 4 == 2, "CheckState")
    score = rt.assignment_score(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_linestatus") == "O", F.col("l_quantity") > 25, method, F.col("l_tax") > 0.04)
    rows = load(spark, sf_dir, "lineitem").withColumn("score", score)
    return rows.groupBy("l_orderkey").agg(F.min_by(F.struct("l_linenumber", "score"), F.struct((-F.col("score")).alias("s"), "l_linenumber")).alias("r")).select("l_orderkey", "r.*")


@query("""SELECT p_partkey, substr(md5(p_name || '|' || p_brand), 1, 10) AS id, replace(replace(replace(p_name || '^' || p_brand, '^', '__dach__'), '.', '__dot__'), ' ', '__leerz__') AS uri, p_name || '^' || p_brand AS back FROM part""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("^", "p_name", "p_brand")
    rows = load(spark, sf_dir, "part").select("p_partkey", tx.stable_id(F.col("p_name"), F.col("p_brand")).alias("id"), tx.escape_iri(name).alias("uri"))
    return rows.withColumn("back", tx.unescape_iri("uri"))
