"""One query per operator, and the SQL that tells its result where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.llm import chat, classifier, corpus, fingerprints, jaccard, packing, rules, scoring, sentencepiece_bpe, suffix, tokenfile

#: Tools of the chat query.
TOOLS: chat.Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def with_tool_calls(conversations: DataFrame) -> DataFrame:
    """All conversations and, as they have no tool calls, a second one for each with calls and results made of its assistant's turns.

    Of turn t: a message with the calls a<t> and b<t>, which waits for a<t> and for b<t - 2>, and in every fifth turn p<t> and
    q<t>, which wait for each other; a result of a<t>, before the call; one of b<t>, but for every third turn; and a message
    with text behind its JSON. Some arguments break the schema, have large numbers or unsorted keys.
    """
    m = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    a = m.where("role = 'assistant' and conv_id is not null and turn is not null").select((-1 - F.col("conv_id")).alias("conv_id"), F.col("turn").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    quoted = F.substring_index(F.to_json(F.struct("text")), '{"text":', -1)
    quoted = F.substring(quoted, F.lit(1), F.length(quoted) - 1)
    t = F.col("t").cast("string")
    limit = F.when(F.col("t") % 4 == 3, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    call = lambda i, name, arguments, after: F.concat(F.lit('{"name":"' + name + '","id":"' + i), t, F.lit('","arguments":'), arguments, F.lit(',"after":['), after, F.lit("]}"))
    search = call("a", "search", F.concat(F.lit('{"query":'), quoted, F.lit(', "limit":'), limit, F.lit("}")), F.lit(""))
    scale = F.when(F.col("t") % 7 == 3, F.lit(',"a scale":[1e400,{"z":123456789012345678901234567890123456789012345,"y":-0.10}]')).otherwise("")
    sums = call("b", "calculate", F.concat(F.lit('{"expression":"1 + '), t, F.lit('"'), scale, F.lit("}")), F.concat(F.lit('"a'), t, F.lit('","b'), F.col("t") - 2, F.lit('"')))
    ring = [call(x, "calculate", F.lit('{"expression":2}'), F.concat(F.lit(f'"{y}'), t, F.lit('"'))) for x, y in ("pq", "qp")]
    calls = F.concat(search, F.lit(","), sums, F.when(F.col("t") % 5 == 0, F.concat(F.lit(","), ring[0], F.lit(","), ring[1])).otherwise(""))
    said = F.concat(F.lit('{"content":'), quoted, F.lit(',"tool_calls":['), calls, F.lit("]}"))
    result = lambda i: F.concat(F.lit('{"tool_call_id":"' + i), t, F.lit('","content":'), quoted, F.lit("}"))
    rows = F.array(
        F.struct((10 * F.col("t")).alias("turn"), F.lit("assistant").alias("role"), said.alias("text")),
        F.struct((10 * F.col("t") - 1).alias("turn"), F.lit("tool").alias("role"), result("a").alias("text")),
        F.struct((10 * F.col("t") + 1).alias("turn"), F.lit("tool").alias("role"), F.when(F.col("t") % 3 != 0, result("b")).alias("text")),
        F.struct((10 * F.col("t") + 2).alias("turn"), F.lit("assistant").alias("role"), F.concat(said, F.lit(" and more")).alias("text")),
    )
    more = a.select("conv_id", F.explode(rows).alias("r")).where("r.text is not null").select("conv_id", "r.*")
    return m.unionByName(more)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(with_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_documents(spark, sf_dir)).drop("failed")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{corpus.shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokenfile.write(_documents(spark, sf_dir), folder)
    return tokenfile.read(spark, folder, ids=False)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(_documents(spark, sf_dir), full=False)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(_documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can tell."""
    return fingerprints.edited_texts(_documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = classifier.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_suffix_dedup, op4_quality_rules, op5_lm_scoring, op6_token_files, op7_sentencepiece, op8_fingerprints, op9_quality_classifier, op10_packing, edited_texts)}


_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x.a, x.b FROM (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
  ) x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 10 * c >= 8 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, c.class_id, coalesce(k.n_links, 0) AS n_links FROM documents d
JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY 1) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY 1) k ON k.a = d.doc_id
"""

_OP2 = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         CASE WHEN role IN ('assistant', 'tool') AND starts_with(coalesce(text, ''), '{') AND json_valid(text) THEN text::JSON END AS p
  FROM conversations
), a AS (
  SELECT -1 - conv_id AS conv_id, turn::BIGINT AS t, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), calls AS (
  SELECT conv_id, 10 * t AS turn, 1 AS step, 'a' || t AS id, []::VARCHAR[] AS waits, t % 4 <> 3 AS valid,
         '{"arguments":{"limit":' || CASE WHEN t % 4 = 3 THEN '"' || t || '"' ELSE t::VARCHAR END || ',"query":' || to_json(text)::VARCHAR || '},"id":"a' || t || '","name":"search","type":"tool_call"}' AS json FROM a
  UNION ALL
  SELECT conv_id, 10 * t, 2, 'b' || t, ['a' || t, 'b' || (t - 2)], t % 7 <> 3,
         '{"arguments":{' || CASE WHEN t % 7 = 3 THEN '"a scale":[1e400,{"y":-0.10,"z":123456789012345678901234567890123456789012345}],' ELSE '' END
         || '"expression":"1 + ' || t || '"},"id":"b' || t || '","name":"calculate","type":"tool_call"}' FROM a
  UNION ALL
  SELECT conv_id, 10 * t, 3 + k, ['p', 'q'][k + 1] || t, [['q', 'p'][k + 1] || t], FALSE,
         '{"arguments":{"expression":2},"id":"' || ['p', 'q'][k + 1] || t || '","name":"calculate","type":"tool_call"}' FROM a, (SELECT unnest([0, 1]) AS k) WHERE t % 5 = 0
), results AS (
  SELECT conv_id, 10 * t - 1 AS turn, 'a' || t AS id, text FROM a UNION ALL SELECT conv_id, 10 * t + 1, 'b' || t, text FROM a WHERE t % 3 <> 0
), c AS (
  SELECT *, (SELECT min(r.turn) FROM results r WHERE r.conv_id = o.conv_id AND r.id = o.id) AS result_turn
  FROM (SELECT DISTINCT ON (conv_id, id) conv_id, id, turn, waits FROM calls ORDER BY conv_id, id, turn, step) o
), w AS (
  SELECT x.conv_id, x.id, x.turn, x.result_turn, x.o FROM (SELECT conv_id, id, turn, result_turn, unnest(waits) AS o FROM c) x JOIN c y ON y.conv_id = x.conv_id AND y.id = x.o
), path(conv_id, id, turn, result_turn, level) AS (
  SELECT conv_id, id, turn, result_turn, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.conv_id = c.conv_id AND w.id = c.id)
  UNION SELECT w.conv_id, w.id, greatest(w.turn, p.turn, coalesce(p.result_turn, p.turn)), w.result_turn, p.level + 2 FROM path p JOIN w ON w.conv_id = p.conv_id AND w.o = p.id
), placed AS (
  SELECT c.conv_id, c.id, coalesce(max(p.turn), any_value(c.turn)) AS turn, coalesce(max(p.level), -1) AS level, any_value(c.result_turn) IS NOT NULL AS has_result
  FROM c LEFT JOIN path p ON p.conv_id = c.conv_id AND p.id = c.id GROUP BY 1, 2
)
SELECT conv_id, turn, 0::INT AS step, 'message' AS kind, role, NULL::VARCHAR AS call_id, NULL::BOOLEAN AS linked, NULL::BOOLEAN AS valid,
       turn AS order_turn, 0::INT AS level, json_object('content', text, 'role', role)::VARCHAR AS json
FROM m WHERE p IS NULL
UNION ALL
SELECT conv_id, 10 * t, 0, 'message', 'assistant', NULL, NULL, NULL, 10 * t, 0, json_object('content', text, 'role', 'assistant')::VARCHAR FROM a
UNION ALL
SELECT conv_id, 10 * t + 2, 0, 'message', 'assistant', NULL, NULL, NULL, 10 * t + 2, 0, json_object('content', '{"content":' || to_json(text)::VARCHAR || ',"tool_calls":['
       || '{"name":"search","id":"a' || t || '","arguments":{"query":' || to_json(text)::VARCHAR || ', "limit":' || CASE WHEN t % 4 = 3 THEN '"' || t || '"' ELSE t::VARCHAR END || '},"after":[]},'
       || '{"name":"calculate","id":"b' || t || '","arguments":{"expression":"1 + ' || t || '"'
       || CASE WHEN t % 7 = 3 THEN ',"a scale":[1e400,{"z":123456789012345678901234567890123456789012345,"y":-0.10}]' ELSE '' END || '},"after":["a' || t || '","b' || (t - 2) || '"]}'
       || CASE WHEN t % 5 = 0 THEN ',{"name":"calculate","id":"p' || t || '","arguments":{"expression":2},"after":["q' || t || '"]},{"name":"calculate","id":"q' || t || '","arguments":{"expression":2},"after":["p' || t || '"]}' ELSE '' END
       || ']} and more', 'role', 'assistant')::VARCHAR FROM a
UNION ALL
SELECT k.conv_id, k.turn, k.step, 'call', 'assistant', k.id, has_result, valid, greatest(k.turn, p.turn), level, json FROM calls k JOIN placed p USING (conv_id, id)
UNION ALL
SELECT r.conv_id, r.turn, 0, 'result', 'tool', r.id, TRUE, NULL, greatest(r.turn, p.turn), CASE WHEN p.level < 0 THEN -1 ELSE p.level + 1 END,
       json_object('content', r.text, 'role', 'tool', 'tool_call_id', r.id)::VARCHAR FROM results r JOIN placed p USING (conv_id, id)
"""

_OP4 = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), unnest(range(5)) AS u(k) WHERE c > 1 GROUP BY 1
), b AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), s AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS x1,
         word_chars / greatest(n_words, 1) AS x2, n_dup_lines / greatest(n_lines, 1) AS x3 FROM b
), q AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*) AS n,
         quantile_disc(x1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(x2, [0.25, 0.5, 0.75]) AS q2, quantile_disc(x3, [0.25, 0.5, 0.75]) AS q3
  FROM s WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())
), c AS (
  SELECT g.lang, g.source, CASE WHEN g.n >= 30 THEN g.q1 WHEN l.n >= 30 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN g.n >= 30 THEN g.q2 WHEN l.n >= 30 THEN l.q2 ELSE a.q2 END AS q2,
         CASE WHEN g.n >= 30 THEN g.q3 WHEN l.n >= 30 THEN l.q3 ELSE a.q3 END AS q3
  FROM q g JOIN q l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM g.lang JOIN q a ON a.level = 3 WHERE g.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (x1 > q1[2] + 5.0 * greatest(q1[3] - q1[2], 0.1) OR x2 > q2[2] + 5.0 * greatest(q2[3] - q2[2], 0.75)
       OR x2 < q2[2] - 5.0 * greatest(q2[2] - q2[1], 0.75) OR x3 > q3[2] + 5.0 * greatest(q3[3] - q3[2], 0.1)) AS kept
FROM s LEFT JOIN c ON c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source
"""


_EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(following, 1, n // 4)) AS edited_sha256 FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1, "op2_chat_formatting": _OP2, "op4_quality_rules": _OP4, "edited_texts": _EDITED}
