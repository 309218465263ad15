"""Queries of the general operators for training data: records that fail to parse, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.operators import nested_json, parse_errors
from logothek.plans.registry import query
from logothek.session import table

_SPACE = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]*"
PARSED_SQL = rf"""
WITH cut AS (
  SELECT line_id, regexp_replace(regexp_replace(coalesce(raw, ''), '^\x{{FEFF}}', ''), '\r$', '') AS s FROM lingann_gs_medievalgreek
), kept AS (
  SELECT * FROM cut WHERE NOT regexp_full_match(s, '{_SPACE}')
), free AS (
  SELECT *, regexp_full_match(s, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quotes_ok,
    regexp_extract_all(chr(9) || s, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1) AS raw_fields FROM kept
), fields AS (
  SELECT *, list_transform(raw_fields, lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:len(f)-1], '""', '"') ELSE f END) AS f FROM free
), judged AS (
  SELECT *, f[1] AS form, f[2] AS pos, f[3] AS lemma,
    NOT regexp_full_match(f[1], '{_SPACE}') AND NOT regexp_full_match(f[3], '{_SPACE}')
    AND NOT regexp_matches(f[1], '[\x{{FFFD}}\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}]') AND NOT regexp_matches(f[3], '[\x{{FFFD}}\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}]')
    AND length(f[2]) = 9 AND len(list_filter(range(1, 10), lambda i: list_contains(all_codes, i || f[2][i]))) = 9 AS valid
  FROM fields, (SELECT list(slot || code) AS all_codes FROM morph_tags)
)
"""


@query("p3_found", PARSED_SQL + "SELECT line_id, CASE WHEN NOT quotes_ok THEN 'quoting' WHEN len(f) <> 3 THEN 'columns' ELSE 'value' END AS reason FROM judged WHERE NOT coalesce(quotes_ok AND len(f) = 3 AND valid, FALSE)")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors.failures(table(spark, d, "lingann_gs_medievalgreek"), table(spark, d, "morph_tags")).select("line_id", "reason")


@query("p3_rows", PARSED_SQL + "SELECT line_id, form, pos, lemma FROM judged WHERE quotes_ok AND len(f) = 3 AND valid")
def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors.loaded(table(spark, d, "lingann_gs_medievalgreek"), table(spark, d, "morph_tags"))


@query("p3_edits")
def p3_edits(spark: SparkSession, d: str) -> DataFrame:
    """How often each least set of edits, by kind, would mend the records that fail."""
    f = parse_errors.failures(table(spark, d, "lingann_gs_medievalgreek"), table(spark, d, "morph_tags"))
    kinds = F.concat_ws(", ", F.sort_array(F.transform("edits", lambda e: F.split_part(e, F.lit("@"), F.lit(1)))))
    return f.groupBy("reason", kinds.alias("edits")).agg(F.count("*").alias("n_records"))


NODES_SQL = """
WITH RECURSIVE own AS (SELECT entry_id, entry_json::JSON AS j FROM dictionary_dump WHERE json_valid(entry_json)),
v AS (
  SELECT entry_id, j, '' AS path, FALSE AS node, '' AS field, '' AS up, 0::BIGINT AS position FROM own
  UNION ALL
  SELECT entry_id, c.j, c.path, c.node, c.field, c.up, c.position FROM (
    SELECT v.entry_id, unnest(CASE json_type(v.j)
      WHEN 'OBJECT' THEN list_transform(json_keys(v.j), lambda k: {
        'j': json_extract(v.j, '$."' || k || '"'),
        'path': v.path || CASE WHEN v.path = '' THEN '' ELSE '.' END || k || CASE WHEN k IN ('forms', 'senses') AND json_type(json_extract(v.j, '$."' || k || '"')) <> 'ARRAY' THEN '[0]' ELSE '' END,
        'node': k IN ('forms', 'senses') AND json_type(json_extract(v.j, '$."' || k || '"')) <> 'ARRAY',
        'field': k, 'up': CASE WHEN v.node THEN v.path ELSE v.up END, 'position': 0::BIGINT})
      WHEN 'ARRAY' THEN list_transform(range(json_array_length(v.j)::BIGINT), lambda i: {
        'j': json_extract(v.j, '$[' || i || ']'), 'path': v.path || '[' || i || ']', 'node': v.field IN ('forms', 'senses') AND NOT v.node, 'field': CASE WHEN v.field IN ('forms', 'senses') AND NOT v.node THEN v.field ELSE '' END,
        'up': CASE WHEN v.node THEN v.path ELSE v.up END, 'position': i})
      END) AS c
    FROM v WHERE json_type(v.j) IN ('OBJECT', 'ARRAY'))
), nodes AS (SELECT entry_id, path AS node_path, j, up AS parent_path, field, position::INT AS position FROM v WHERE node AND json_type(j) <> 'NULL'),
tags AS (
  SELECT entry_id, node_path, unnest(CASE
    WHEN json_type(j) <> 'OBJECT' OR json_type(json_extract(j, '$.tags')) IS NULL THEN []
    WHEN json_type(json_extract(j, '$.tags')) = 'ARRAY' THEN list_transform(range(json_array_length(json_extract(j, '$.tags'))::BIGINT), lambda i: {'no': i, 'tag': json_extract_string(j, '$.tags[' || i || ']')})
    ELSE [{'no': 0::BIGINT, 'tag': json_extract_string(j, '$.tags')}] END) AS t
  FROM nodes
), kept AS (SELECT entry_id, node_path, t.no::INT AS tag_no, t.tag AS tag FROM tags WHERE t.tag IS NOT NULL)
"""
FIELD_SQL = NODES_SQL + """
SELECT entry_id, node_path, parent_path, position, CASE json_type(j) WHEN 'VARCHAR' THEN json_extract_string(j, '$') WHEN 'OBJECT' THEN
  list_filter(list_transform(list_filter(json_keys(j), lambda k: k IN ('form', 'glosses')), lambda k: CASE json_type(json_extract(j, '$.' || k)) WHEN 'VARCHAR' THEN json_extract_string(j, '$.' || k)
    WHEN 'ARRAY' THEN json_extract_string(list_filter(json_extract(json_extract(j, '$.' || k), '$[*]'), lambda e: json_type(e) = 'VARCHAR')[1], '$') END), lambda t: t IS NOT NULL)[1] END AS text
FROM nodes WHERE field = '{0}'
"""
ENTRIES_SQL = "SELECT entry_id, ok, " + ", ".join(f"CASE WHEN ok AND json_type(json_extract(j, '$.{k}')) = 'VARCHAR' THEN json_extract_string(j, '$.{k}') END AS {k}" for k in ("word", "pos", "lang_code")) + """
FROM (SELECT entry_id, coalesce(json_valid(entry_json), FALSE) AS ok, CASE WHEN json_valid(entry_json) THEN entry_json::JSON END AS j FROM dictionary_dump)
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.nodes(table(spark, d, "dictionary_dump"))


@query("p5_found", NODES_SQL + "SELECT * FROM kept UNION ALL SELECT entry_id, node_path, -1::INT, '' FROM (SELECT DISTINCT entry_id, node_path FROM nodes) ANTI JOIN kept USING (entry_id, node_path)")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.node_tags(_nodes(spark, d))


@query("p5_entries", ENTRIES_SQL)
def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.entry_table(table(spark, d, "dictionary_dump"))


@query("p5_forms", FIELD_SQL.replace("{0}", "forms"))
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.field_table(_nodes(spark, d), "forms")


@query("p5_senses", FIELD_SQL.replace("{0}", "senses"))
def p5_senses(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.field_table(_nodes(spark, d), "senses")
