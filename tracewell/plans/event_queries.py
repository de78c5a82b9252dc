"""Queries on the event stream's table: timelines, edges, folds, joins, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as w
from ..tables import events, load
from .registry import query

_E = "e AS (SELECT event_id, user_id AS corr, event_type AS type, value, props, epoch_us(ts) AS us FROM events)"


@query(f"""WITH {_E}, d AS (SELECT corr, event_id, type, CAST(coalesce(us // 1000 - lag(us // 1000) OVER (PARTITION BY corr ORDER BY us, event_id), 0) AS BIGINT) AS delta_ms, us FROM e)
    SELECT corr, event_id, type, delta_ms, CAST(sum(delta_ms) OVER (PARTITION BY corr ORDER BY us, event_id) AS BIGINT) AS total_ms FROM d""")
def timeline_delta_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.timeline(events(spark, sf_dir)).select("corr", "event_id", "type", "delta_ms", "total_ms")


@query(f"""WITH {_E}, d AS (SELECT *, value > 100 AS v, lag(value > 100) OVER (PARTITION BY corr ORDER BY us, event_id) AS b FROM e)
    SELECT corr, event_id, us, value FROM d WHERE v AND NOT b""")
def rising_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.rising_edges(events(spark, sf_dir), F.col("value") > 100).select("corr", "event_id", "us", "value")


@query(f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY corr ORDER BY us, event_id) AS n FROM e WHERE type IN ('error', 'purchase'))
    SELECT corr, event_id, type, us FROM r WHERE n = 1""")
def once_only_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.once_only(events(spark, sf_dir), ["error", "purchase"])


@query(f"""WITH {_E}, t AS (SELECT corr, arg_min({{'t': type, 'us': us, 'id': event_id}}, (us, event_id)) AS t FROM e WHERE type = 'error' GROUP BY corr),
    b AS (SELECT e.*, t.t AS t FROM e JOIN t USING (corr) WHERE (us, event_id) < (t.t.us, t.t.id)),
    s AS (SELECT corr, max((us, event_id)) AS s FROM b WHERE type = 'signup' GROUP BY corr),
    k AS (SELECT b.* FROM b JOIN s USING (corr) WHERE (us, event_id) > s.s),
    l AS (SELECT corr, arg_max(value, (us, event_id)) FILTER (type = 'click') AS last_click, arg_max(value, (us, event_id)) FILTER (type = 'view') AS last_view FROM k GROUP BY corr)
    SELECT corr, t.t.t AS trigger, t.t.us AS trigger_us, s.s IS NOT NULL AS active, last_click, last_view FROM t LEFT JOIN s USING (corr) LEFT JOIN l USING (corr)""")
def session_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.session_fold(events(spark, sf_dir), "signup", ["click", "view"], ["error"])


@query(f"""WITH {_E}, a AS (SELECT corr, min(us) FILTER (type = 'signup') AS a_us, min(us) FILTER (type = 'purchase') AS b_us FROM e GROUP BY corr)
    SELECT corr, a_us, b_us, greatest(a_us, b_us) AS ready_us FROM a WHERE a_us IS NOT NULL AND b_us IS NOT NULL""")
def two_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.event_pairs(events(spark, sf_dir), "signup", "purchase")


@query(f"""WITH {_E}, a AS (SELECT corr, max(us) FILTER (type = 'signup') AS a, max(us) FILTER (type = 'purchase') AS b FROM e GROUP BY corr)
    SELECT corr, CAST(CASE WHEN b >= a THEN (b - a) // 1000 ELSE -((a - b) // 1000) END AS BIGINT) AS segment_ms FROM a""")
def segment_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.segment(events(spark, sf_dir), "signup", "purchase")


@query(f"""WITH {_E}, p AS (SELECT corr, min(us) AS p FROM e WHERE type = 'view' GROUP BY corr),
    a AS (SELECT corr, arg_min(type, (us, event_id)) AS x FROM e JOIN p USING (corr) WHERE type IN ('purchase', 'error') AND us > p GROUP BY corr)
    SELECT corr, CASE WHEN x = 'purchase' THEN 'executed' WHEN x IS NOT NULL THEN 'dropped' ELSE 'pending' END AS outcome FROM p LEFT JOIN a USING (corr)""")
def fallback_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.fallback_outcome(events(spark, sf_dir), "view", "purchase", ["error"])


@query(f"""WITH {_E}, n AS (SELECT corr, count(*) FILTER (value > 120) AS winners FROM e GROUP BY corr)
    SELECT corr, winners, CASE WHEN winners = 0 THEN 'unknown' WHEN winners = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict FROM n""")
def winner_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.winners(events(spark, sf_dir).withColumn("won", F.col("value") > 120), "corr", "won")


@query(f"WITH {_E} SELECT type, us // 3600000000 AS hour, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("type", F.expr("us div 3600000000").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY corr ORDER BY us, event_id) < 21600000000 THEN 0 ELSE 1 END AS f FROM e),
    s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY corr ORDER BY us, event_id) AS BIGINT) AS session FROM g)
    SELECT corr, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY corr, session""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.sessions(events(spark, sf_dir), 6 * 3600 * 1_000_000)


@query(f"""WITH {_E} SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing' ELSE 'given' END AS state FROM e""")
def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return events(spark, sf_dir).select("event_id", k.alias("k"), F.when(k.isNull(), "missing").otherwise("given").alias("state"))


@query(f"""WITH {_E} SELECT event_id, '==InventorySnapshot==' || '{{"id":' || event_id || ',"t":"' || type || '"}}' || '==InventorySnapshot==' AS wrapped, '{{"id":' || event_id || ',"t":"' || type || '"}}' AS inner_text FROM e""")
def snapshot_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import unwrap_snapshot, wrap_snapshot

    inner = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("type").alias("t")))
    rows = events(spark, sf_dir).select("event_id", wrap_snapshot(inner).alias("wrapped"))
    return rows.withColumn("inner_text", unwrap_snapshot("wrapped"))


@query(f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY corr ORDER BY CASE type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, event_id) AS n FROM e)
    SELECT corr, event_id, type, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3""")
def priority_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.when(F.col("type") == "error", 3).when(F.col("type") == "purchase", 2).otherwise(1)
    rows = events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("corr").orderBy(rank.desc(), "event_id")))
    return rows.where("n <= 3").select("corr", "event_id", "type", "n")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 3""")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")))
    return rows.where("n <= 3").drop("n")


_COST = "SELECT conv_id, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS prompt_tokens, CAST(sum(length(text)) FILTER (role <> 'user') AS BIGINT) AS completion_tokens FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, prompt_tokens, completion_tokens, CAST(coalesce(prompt_tokens, 0) * 25 + coalesce(completion_tokens, 0) * 100 AS DOUBLE) / 10000000 AS cost_usd FROM ({_COST})")
def cost_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.length("text"))).alias("prompt_tokens"), F.sum(F.when(F.col("role") != "user", F.length("text"))).alias("completion_tokens"))
    # prices of 0.0025 and 0.01 per 1000 tokens, in whole units of 1e-7, so that nothing is rounded
    units = F.coalesce("prompt_tokens", F.lit(0)) * 25 + F.coalesce("completion_tokens", F.lit(0)) * 100
    return rows.withColumn("cost_usd", units.cast("double") / 10_000_000)


_EVAL = "x AS (SELECT d.lang AS config, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"


@query(f"""WITH {_EVAL} SELECT coalesce(config, 'all') AS config, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS correct, count(*) FILTER (quality = 1 AND toxic = 1) AS partially_correct,
    count(*) FILTER (quality = 0) AS incorrect, round(count(*) FILTER (quality = 1) * 1.0 / count(*), 6) AS root_cause_rate FROM x GROUP BY ROLLUP (config)""")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("config")), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    out = rows.rollup("config").agg(F.count("*").alias("n"), F.count_if(good & ~toxic).alias("correct"), F.count_if(good & toxic).alias("partially_correct"), F.count_if(~good).alias("incorrect"), F.round(F.count_if(good) / F.count("*"), 6).alias("root_cause_rate"))
    return out.withColumn("config", F.coalesce("config", F.lit("all")))


@query("""WITH k AS (SELECT lang, source, count(*) AS kg FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL),
    r AS (SELECT lang, source, count(*) AS rag FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL)
    SELECT lang, source, coalesce(CAST(kg AS VARCHAR), 'n.v.') AS kg, coalesce(CAST(rag AS VARCHAR), 'n.v.') AS rag, round(rag * 1.0 / kg, 6) AS ratio FROM k FULL JOIN r USING (lang, source)""")
def pairwise_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    k = rows.where("quality = 1").groupBy("lang", "source").agg(F.count("*").alias("kg"))
    r = rows.where("toxic = 1").groupBy("lang", "source").agg(F.count("*").alias("rag"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n.v."))
    return k.join(r, ["lang", "source"], "full_outer").select("lang", "source", text("kg").alias("kg"), text("rag").alias("rag"), F.round(F.col("rag") / F.col("kg"), 6).alias("ratio"))


@query("""SELECT doc_id, CASE WHEN v IN ('correct', 'incorrect') THEN v ELSE 'judge_error' END AS verdict
    FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 0 THEN 'incorrect' ELSE 'maybe' END AS v FROM labels)""")
def verdict_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import verdict

    raw = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " Correct ").when(F.col("quality") == 0, "INCORRECT").otherwise("maybe")
    return load(spark, sf_dir, "labels").select("doc_id", verdict(raw).alias("verdict"))
