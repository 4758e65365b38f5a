"""Text functions, dictionaries, JSON answers, names of archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import Box, normalized_gap
from ..operators import dictionary, statistics
from ..sources.readers import archive_name, mapped_path, member_name
from .proxies import lines, objects, speech, sql, table


#: A dictionary of more terms is an error.
MOST_TERMS = 1_000_000


def q_strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("folded"))


def q_ordered_words(spark, d):
    rows = speech(spark, d)
    return rows.where(text.ordered_words(F.col("text_norm"), "the of a")).select("doc_id", F.col("text_norm").rlike(text.ordered_words_pattern("the of a")).alias("by_pattern"))


def q_contains_phrase(spark, d):
    return speech(spark, d).where(text.contains_phrase(F.col("text_norm"), "of the")).select("doc_id")


def q_significant_tokens(spark, d):
    return lines(spark, d).select("doc_id", F.size(text.significant_tokens(F.col("text_norm"))).cast("bigint").alias("n_tokens"))


def q_prompt(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list("p_name").alias("names"))
    return rows.select("p_brand", text.prompt(F.col("names")).alias("prompt"))


def q_json_answer(spark, d):
    answer = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.col("props")), F.lit("\n```"))
    default = F.struct(F.lit(-1).cast("bigint").alias("k"))
    return table(spark, d, "events").select("event_id", text.parse_answer(answer, "k bigint", default)["k"].alias("k"))


def q_answers_match(spark, d):
    rows = table(spark, d, "part")
    truth = F.element_at(F.split("p_name", " "), 2)
    answer = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise("p_brand")
    return rows.select("p_partkey", text.answers_match(answer, truth).alias("matches"))


def q_archive_name(spark, d):
    rows = table(spark, d, "supplier")
    video = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "L26_V").otherwise("L21_V"), F.lpad((F.col("s_suppkey") * 7 % 500).cast("string"), 3, "0"))
    return rows.select("s_suppkey", archive_name(video).alias("shard"), archive_name(video, "Videos").alias("video_shard"), member_name(video, (F.col("s_suppkey") % 12).cast("int")).alias("member"))


def q_mapped_path(spark, d):
    rows = table(spark, d, "nation")
    local = F.concat(F.lit("D:\\data\\"), F.when(F.col("n_regionkey") < 2, "L21_x").otherwise("L22_x"), F.lit("\\L2\\V"), F.col("n_nationkey").cast("string"), F.lit("\\shot1.jpg"))
    return rows.select("n_nationkey", mapped_path(local, {"D:\\data\\L21_x": "one", "D:\\data\\L22_x": "two"}).alias("path"))


def q_gap(spark, d):
    return objects(spark, d).select("detection_id", F.round(normalized_gap(Box.of(), Box.at(0.3, 0.3, 0.4, 0.5)), 6).alias("gap"))


def _dictionaries(spark, d):
    parts = table(spark, d, "part")
    main = parts.where("p_partkey % 3 = 0").select(F.col("p_name").alias("term"), F.col("p_brand").alias("label"))
    more = parts.where("p_partkey % 3 = 1").select(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")).alias("term"), F.col("p_type").alias("label"))
    extra = parts.where("p_partkey % 3 = 2").select(F.col("p_type").alias("term"), F.lower("p_brand").alias("label"))
    return [(1, main), (2, more), (3, extra)]


def q_priority_union(spark, d):
    return dictionary.priority_union(_dictionaries(spark, d)).select("term_norm", "label", F.col("priority").cast("bigint").alias("priority"))


def q_resolve(spark, d):
    parts = table(spark, d, "part")
    entries = parts.select(F.col("p_name").alias("term_norm"), F.col("p_brand").alias("label"), "p_size").where("p_size >= 25").drop("p_size").distinct()
    asked = parts.select(F.explode(F.array(F.col("p_name"), F.split("p_name", " ")[1], F.concat(F.lit("big "), F.col("p_name"), F.lit(" old")))).alias("term")).distinct()
    return dictionary.resolve(asked, entries)


def q_known_terms(spark, d):
    names = [r.p_name for r in table(spark, d, "part").select("p_name").where("p_name is not null").distinct().limit(MOST_TERMS + 1).collect()]
    if len(names) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} names don't fit into a broadcast dictionary")
    entries = {n: n.upper() for n in names} | {"the": "THE", "of the": "OF THE"}
    return dictionary.known_terms(table(spark, d, "documents"), entries, "doc_id", "text")


def q_synonym_valid(spark, d):
    parts = table(spark, d, "part")
    canonical = parts.groupBy(F.col("p_brand").alias("label")).agg(F.min("p_name").alias("name"))
    candidates = parts.select(F.col("p_brand").alias("label"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("synonym")).distinct()
    return dictionary.valid_synonyms(candidates, canonical)


def q_context_concat(spark, d):
    rows = table(spark, d, "conversations")
    return statistics.concatenated(rows, ["conv_id"], ["turn"], "text")


def q_vocab(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return statistics.phrase_frequency(rows, "words", ["conv_id", "turn"], 3)


def q_bm25(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return statistics.bm25(rows, ["license", "licensed", "apache"], "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


_FOLD = "replace(lower(strip_accents({})), 'đ', 'd')"
_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"

ORACLE = {
    "q_strip_accents": f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents",
    "q_ordered_words": sql("speech", r" SELECT doc_id, true AS by_pattern FROM speech WHERE regexp_matches(text_norm, '(^|\s)the\s(.*\s)?of\s(.*\s)?a(\s|$)', 's')"),
    "q_contains_phrase": sql("speech", " SELECT doc_id FROM speech WHERE contains(' ' || text_norm || ' ', ' of the ')"),
    "q_significant_tokens": sql("lines", " SELECT doc_id, len(list_distinct(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 3 OR regexp_matches(w, '^[0-9]+$')))) AS n_tokens FROM lines"),
    "q_prompt": "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_name))), '. ') || '.' AS prompt FROM part GROUP BY p_brand",
    "q_json_answer": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "q_answers_match": """WITH x AS (SELECT p_partkey, lower(string_split(p_name, ' ')[2]) AS t, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(p_name) ELSE lower(p_brand) END AS a FROM part)
        SELECT p_partkey, coalesce(a <> '' AND t <> '' AND (contains(t, a) OR contains(a, t)), false) AS matches FROM x""",
    "q_archive_name": """WITH x AS (SELECT s_suppkey, s_suppkey * 7 % 500 AS n, s_suppkey % 2 = 0 AS big FROM supplier), y AS (SELECT *, CASE WHEN n <= 99 THEN 'a' WHEN n <= 199 THEN 'b' WHEN n <= 299 THEN 'c' WHEN n <= 399 THEN 'd' ELSE 'e' END AS p FROM x)
        SELECT s_suppkey, CASE WHEN big THEN 'Keyframes_L26_' || p || '.zip' ELSE 'Keyframes_L21.zip' END AS shard, CASE WHEN big THEN 'Videos_L26_' || p || '.zip' ELSE 'Videos_L21_a.zip' END AS video_shard,
               'keyframes/' || CASE WHEN big THEN 'L26_V' ELSE 'L21_V' END || lpad(CAST(n AS VARCHAR), 3, '0') || '/' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 3, '0') || '.jpg' AS member FROM y""",
    "q_mapped_path": "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 'one' ELSE 'two' END || '/L2/V' || CAST(n_nationkey AS VARCHAR) || '/shot1.jpg' AS path FROM nation",
    "q_gap": sql("objects", """, g AS (SELECT detection_id, greatest(3e-1 - xmax, xmin - 5e-1, 0e0) AS dx, greatest(3e-1 - ymax, ymin - 4e-1, 0e0) AS dy, least(greatest(0e0, ymax - ymin), greatest(0e0, xmax - xmin)) AS s FROM objects)
        SELECT detection_id, round(sqrt(dx * dx + dy * dy) / least(CASE WHEN s = 0 THEN 1e-6 ELSE s END, 4e-1 - 3e-1), 6) AS gap FROM g"""),
    "q_priority_union": f"""WITH u AS (SELECT p_name AS term, p_brand AS label, 1 AS priority FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT ' ' || upper(p_name) || '  ', p_type, 2 FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT p_type, lower(p_brand), 3 FROM part WHERE p_partkey % 3 = 2), n AS (SELECT {_NORM.format('term')} AS term_norm, label, CAST(priority AS BIGINT) AS priority FROM u)
        SELECT * FROM n WHERE term_norm <> '' QUALIFY row_number() OVER (PARTITION BY term_norm ORDER BY priority, label) = 1""",
    "q_resolve": """WITH d AS (SELECT DISTINCT p_name AS e, p_brand AS label FROM part WHERE p_size >= 25),
        a AS (SELECT DISTINCT unnest([p_name, string_split(p_name, ' ')[2], 'big ' || p_name || ' old']) AS term FROM part),
        x AS (SELECT a.term, d.label FROM a JOIN d ON a.term = d.e),
        v AS (SELECT term, label, count(*) AS n FROM a JOIN d ON (contains(' ' || e || ' ', ' ' || term || ' ') OR contains(' ' || term || ' ', ' ' || e || ' '))
            WHERE length(term) >= 3 AND length(e) >= 4 AND term NOT IN (SELECT term FROM x) GROUP BY ALL)
        SELECT * FROM x UNION ALL SELECT term, label FROM v QUALIFY n = max(n) OVER (PARTITION BY term)""",
    # names share no word with "of the", and no two of them overlap in the invented texts, so only "the" can be taken by a longer term
    "q_known_terms": f"""WITH t AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents), n AS (SELECT DISTINCT p_name AS term FROM part WHERE p_name IS NOT NULL),
        w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM t WHERE t <> '')
        SELECT doc_id, term, upper(term) AS label FROM t JOIN n ON contains(' ' || t || ' ', ' ' || term || ' ') AND length(term) >= 3
        UNION ALL SELECT doc_id, 'of the', 'OF THE' FROM t WHERE contains(' ' || t || ' ', ' of the ')
        UNION ALL SELECT doc_id, 'the', 'THE' FROM w WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND (i = 1 OR w[i - 1] <> 'of'))) > 0""",
    "q_synonym_valid": """WITH c AS (SELECT p_brand AS label, min(p_name) AS name FROM part GROUP BY p_brand), k AS (SELECT DISTINCT p_brand AS label, p_name || ' ' || lower(p_type) AS synonym FROM part),
        o AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.label <> k.label AND contains(lower(k.synonym), c.name))), n AS (SELECT synonym, count(DISTINCT label) AS owners FROM o GROUP BY ALL)
        SELECT o.label, o.synonym FROM o JOIN n USING (synonym) JOIN c ON c.label = o.label WHERE owners <= 1 OR o.synonym = c.name""",
    "q_context_concat": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "q_vocab": f"""WITH w AS (SELECT conv_id, turn, {_NORM.format('w')} AS phrase FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations))
        SELECT phrase, count(DISTINCT conv_id * 1000 + turn) AS n FROM w WHERE phrase <> '' GROUP BY phrase HAVING n >= 3""",
    "q_bm25": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS words FROM documents), f AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(words)) AS mean FROM w),
        t AS (SELECT doc_id, len(words) AS size, t.term, CAST(len(list_filter(words, lambda x: x = t.term)) AS DOUBLE) AS tf FROM w, (SELECT unnest(['license', 'licensed', 'apache']) AS term) t),
        h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM t WHERE tf > 0)
        SELECT doc_id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * size / mean))), 6) AS score FROM h, f GROUP BY doc_id""",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
