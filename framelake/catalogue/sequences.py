"""Order in time: nearest frames, chains, runs, strides, segments, samples, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence, temporal
from ..streaming import sessions
from .proxies import frames, moments, sql, table


def _kind(spark, d, kind):
    return moments(spark, d).where(F.col("event_type") == kind)


def q_asof_nearest(spark, d):
    points = _kind(spark, d, "purchase").select("video_id", "t", "event_id")
    at = _kind(spark, d, "view").select("video_id", F.col("t").alias("ft"), F.col("event_id").alias("frame_idx"))
    return temporal.nearest(points, at, "t", "ft").select("video_id", "event_id", "nearest_frame_idx")


def _pools(spark, d):
    return [_kind(spark, d, k).select("video_id", "t", "score") for k in ("view", "click", "purchase")]


def q_chain_min(spark, d):
    return temporal.chain_best(_pools(spark, d), "min", time="t").select("video_id", F.col("path")[2].alias("last_t"), F.round("score", 6).alias("score"))


def q_chain_mean(spark, d):
    found = temporal.chain_best(_pools(spark, d), "mean", time="t")
    return found.select("video_id", *[F.col("path")[i].alias(f"t{i + 1}") for i in range(3)], F.round("score", 6).alias("score"))


def q_chain_greedy(spark, d):
    found = temporal.chain_greedy(_pools(spark, d), "min", time="t")
    return found.select("video_id", *[F.col("path")[i].alias(f"t{i + 1}") for i in range(3)], F.round("score", 6).alias("score"))


def q_pair_score(spark, d):
    found = temporal.pair_scores(_kind(spark, d, "click"), _kind(spark, d, "purchase"), 36000)
    return found.select("video_id", F.round("pair_score", 6).alias("pair_score"))


def q_neighbours(spark, d):
    rows = frames(spark, d).select("video_id", "frame_idx", "label")
    return temporal.neighbours(rows.where("label = 3"), rows, 60).select("video_id", "frame_idx")


def q_runs(spark, d):
    found = sequence.run_summary(moments(spark, d), ["video_id", "event_type"], "event_id", "t", "score", 1500)
    return found.select("video_id", "event_type", "start", "end", "n", F.round("score", 6).alias("score"), F.col("t").alias("best_t"))


def q_run_mid(spark, d):
    return sequence.run_middle(moments(spark, d), ["video_id"], "event_id", 120).select("video_id", "event_id", "score")


def q_skip_stride(spark, d):
    return sequence.skip_stride(moments(spark, d), ["video_id"], "event_id").select("video_id", "event_id")


def q_stride_sample(spark, d):
    return sequence.stride_sample(moments(spark, d).select("event_id", "score"), ["event_id"], 300)


def q_shard(spark, d):
    return sequence.shard(moments(spark, d).select("event_id"), ["event_id"], 7).select("event_id", F.col("shard").cast("bigint").alias("shard"))


def q_segments(spark, d):
    rows = moments(spark, d).withColumn("duration", F.lit(1706745600).cast("bigint"))
    return sequence.lead_segments(rows, ["video_id"], "t", "duration").select("video_id", "event_id", F.col("segment_start").cast("double").alias("segment_start"), "segment_end")


def q_around(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("at"), F.lit(1500.0).alias("duration")).distinct()
    return sequence.around_segments(rows, "at", "duration", 30.0).select("l_orderkey", "l_linenumber", "segment_start", "segment_end")


def q_distractors(spark, d):
    rows = frames(spark, d).select("video_id", "frame_idx", "label")
    return sequence.closest_in_video(rows, rows.where("label = 4"), 9).select("video_id", "truth_idx", "frame_idx", F.col("place").cast("bigint").alias("place"))


def q_stratified(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sequence.stratified(rows, "c_mktsegment", 100, sequence.portable_hash(F.col("c_custkey")), ["c_custkey"])


def q_without_ends(spark, d):
    return sequence.without_ends(_kind(spark, d, "view"), ["video_id"], "event_id", 2, 8).select("video_id", "event_id")


def q_sample_per_label(spark, d):
    rows = frames(spark, d).select("label", "frame_idx")
    return sequence.sample_per_key(rows, ["label"], 25, sequence.portable_hash(F.col("frame_idx")), ["frame_idx"])


def q_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 16.0).alias("total"))
    return sequence.fixed_chunks(rows, "total").select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "chunk_start", F.col("chunk_end"))


def q_batches(spark, d):
    return sequence.batches(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey", F.col("batch").cast("bigint").alias("batch"))


def q_carry_answer(spark, d):
    rows = moments(spark, d).withColumn("answer", F.when(F.col("event_type") == "purchase", F.col("score")))
    return sequence.carry(rows, "answer", ["event_id"], ["video_id"]).select("video_id", "event_id", "answer")


def q_shots(spark, d):
    rows = moments(spark, d).withColumn("alike", F.when(F.col("score") > 8, 0.99).otherwise(0.5))
    return temporal.shots(rows, "alike", 0.97, order="event_id").select("video_id", "event_id", F.col("shot").cast("bigint").alias("shot"))


def q_sessions(spark, d):
    found = sessions.sessions(table(spark, d, "events"), gap="6 hours")
    return found.select("user_id", "session_start", "session_end", "n_events", F.round("total", 4).alias("total"))


def q_windows(spark, d):
    return sessions.windows(table(spark, d, "events"), "1 day").select("event_type", "window_start", "n_events", F.round("total", 4).alias("total"))


_RUN = "r AS (SELECT *, sum(CASE WHEN event_id - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY event_id) AS run FROM (SELECT *, lag(event_id) OVER (PARTITION BY {by} ORDER BY event_id) AS p FROM moments))"
_CHAINS = """, v AS (SELECT * FROM moments WHERE event_type = 'view'), c AS (SELECT * FROM moments WHERE event_type = 'click'), p AS (SELECT * FROM moments WHERE event_type = 'purchase'),
        x AS (SELECT v.video_id, v.t AS t1, c.t AS t2, p.t AS t3, least(v.score, c.score, p.score) AS low, v.score + c.score + p.score AS total
            FROM v JOIN c ON v.video_id = c.video_id AND v.t < c.t JOIN p ON c.video_id = p.video_id AND c.t < p.t)"""

ORACLE = {
    "q_asof_nearest": sql("moments", """, p AS (SELECT * FROM moments WHERE event_type = 'purchase'), f AS (SELECT * FROM moments WHERE event_type = 'view')
        SELECT p.video_id, p.event_id, f.event_id AS nearest_frame_idx FROM p LEFT JOIN f ON p.video_id = f.video_id
        QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(f.t - p.t), f.t, f.event_id) = 1"""),
    "q_chain_min": sql("moments", _CHAINS + " SELECT video_id, t3 AS last_t, round(low, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY low DESC, t3) = 1"),
    "q_chain_mean": sql("moments", _CHAINS + " SELECT video_id, t1, t2, t3, round(total / 3, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(total, 9) DESC, t3, t2, t1) = 1"),
    "q_chain_greedy": sql("moments", """, a AS (SELECT video_id, min(t) AS t1 FROM moments WHERE event_type = 'view' GROUP BY ALL),
        b AS (SELECT a.video_id, t1, min(t) AS t2 FROM a JOIN moments m ON a.video_id = m.video_id AND event_type = 'click' AND t > t1 GROUP BY ALL),
        c AS (SELECT b.video_id, t1, t2, min(t) AS t3 FROM b JOIN moments m ON b.video_id = m.video_id AND event_type = 'purchase' AND t > t2 GROUP BY ALL)
        SELECT c.video_id, t1, t2, t3, round(min(m.score), 6) AS score FROM c JOIN moments m ON c.video_id = m.video_id
            AND ((m.event_type = 'view' AND m.t = t1) OR (m.event_type = 'click' AND m.t = t2) OR (m.event_type = 'purchase' AND m.t = t3)) GROUP BY ALL"""),
    "q_pair_score": sql("moments", """ SELECT a.video_id, round(max(a.score + b.score), 6) AS pair_score FROM moments a JOIN moments b
        ON a.video_id = b.video_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.t - a.t BETWEEN 0 AND 36000 GROUP BY a.video_id"""),
    "q_neighbours": sql("frames", " SELECT DISTINCT a.video_id, a.frame_idx FROM frames a JOIN frames b ON a.video_id = b.video_id AND abs(a.frame_idx - b.frame_idx) <= 60 AND b.label = 3"),
    "q_runs": sql("moments", ", " + _RUN.format(gap=1500, by="video_id, event_type") + """ SELECT video_id, event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n, round(avg(score), 6) AS score,
        arg_max(t, struct_pack(s := score, e := -event_id)) AS best_t FROM r GROUP BY video_id, event_type, run"""),
    "q_run_mid": sql("moments", ", " + _RUN.format(gap=120, by="video_id") + """ SELECT video_id, event_id, score FROM r
        QUALIFY row_number() OVER (PARTITION BY video_id, run ORDER BY event_id) = count(*) OVER (PARTITION BY video_id, run) // 2 + 1"""),
    "q_skip_stride": sql("moments", """, n AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS rn FROM moments) SELECT video_id, event_id FROM n WHERE rn > 5 AND (rn - 6) % 15 = 0"""),
    "q_stride_sample": """WITH n AS (SELECT event_id, value AS score, row_number() OVER (ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER () // 300) AS s FROM events) SELECT event_id, score FROM n WHERE i % s = 0 AND i < s * 300""",
    "q_shard": "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 7 AS shard FROM events",
    "q_segments": sql("moments", """ SELECT video_id, event_id, CAST(t AS DOUBLE) AS segment_start, t + greatest(1e-1, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), 1706745600) - t) AS segment_end FROM moments"""),
    "q_around": "SELECT DISTINCT l_orderkey, l_linenumber, greatest(0e0, l_partkey - 3e1) AS segment_start, least(15e2, l_partkey + 3e1) AS segment_end FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)",
    "q_distractors": sql("frames", """ SELECT a.video_id, b.frame_idx AS truth_idx, a.frame_idx, row_number() OVER w AS place FROM frames a JOIN frames b ON a.video_id = b.video_id AND a.frame_idx <> b.frame_idx AND b.label = 4
        WINDOW w AS (PARTITION BY a.video_id, b.frame_idx ORDER BY abs(a.frame_idx - b.frame_idx), a.frame_idx) QUALIFY row_number() OVER w <= 9"""),
    "q_stratified": """WITH n AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919 + 42 * 104729) % 1000003, c_custkey) AS i,
        greatest(1, round_even(1e2 * count(*) OVER (PARTITION BY c_mktsegment) / count(*) OVER (), 0)) AS take FROM customer) SELECT c_custkey, c_mktsegment FROM n WHERE i <= take""",
    "q_without_ends": sql("moments", """, n AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM moments WHERE event_type = 'view')
        SELECT video_id, event_id FROM n WHERE n <= 8 OR (i > 2 AND i <= n - 2)"""),
    "q_sample_per_label": sql("frames", " SELECT label, frame_idx FROM frames QUALIFY row_number() OVER (PARTITION BY label ORDER BY (frame_idx * 7919 + 42 * 104729) % 1000003, frame_idx) <= 25"),
    "q_chunks": """SELECT doc_id, chunk, chunk * 28e0 AS chunk_start, least((chunk + 1) * 28e0, n_chars / 16e0) AS chunk_end
        FROM (SELECT doc_id, n_chars, unnest(range(CAST(ceil(n_chars / 16e0 / 28e0) AS BIGINT))) AS chunk FROM documents WHERE n_chars > 0)""",
    "q_batches": "SELECT p_name, p_partkey, (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) // 8 AS batch FROM part",
    "q_carry_answer": sql("moments", """ SELECT video_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN score END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS answer FROM moments"""),
    "q_shots": sql("moments", " SELECT video_id, event_id, CAST(sum(CASE WHEN score > 8 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY event_id) AS BIGINT) AS shot FROM moments"),
    "q_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "q_windows": "SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
