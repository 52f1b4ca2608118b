"""Queries of the core's data-pipeline operators (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.text import blank_key, cell_fragments
from pairforge.operators import records, skew
from pairforge.sources.tables import table

FIELDS = ["dataset_name", "endpoint", "smiles", "label"]
KEYS = ["dataset_name", "endpoint"]
#: A key is hot from this percentage of all rows on.
HOT_PERCENT = 3
QUANTILES = [0.25, 0.5, 0.75, 0.99]


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "molecules_raw": records.parse_lines(table(spark, d, "molecules_raw"), "line_id", "line"),
        "molecules": records.check_rows(table(spark, d, "molecules"), "mol_id", FIELDS),
    }


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(_sources(spark, d))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(_sources(spark, d), FIELDS)


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(_sources(spark, d)).groupBy("src", "reason").agg(F.count("*").alias("n"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "toxicitycliff").withColumns({k: blank_key(F.col(k)) for k in KEYS})


def _length():
    return F.length(F.trim("toxic_smiles"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(skew.key_histogram_quantiles(_keyed(spark, d), KEYS, _length(), QUANTILES), KEYS, HOT_PERCENT)


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    fragments = F.concat(cell_fragments(F.col("only_toxic_safe_fragments")), cell_fragments(F.col("only_nontoxic_safe_fragments")))
    return skew.key_figures(_keyed(spark, d), KEYS, F.nullif(F.trim("toxic_smiles"), F.lit("")), fragments, _length(), QUANTILES)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_reasons, p4_found, p4_keys)}

_BAD_SQL = r"""
WITH cut AS (
  SELECT line_id, line,
    coalesce(regexp_full_match(line, '(?s)([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*'), false) AS readable,
    regexp_extract_all(line || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1) AS raw_cells
  FROM molecules_raw),
cells AS (
  SELECT line_id, line, readable,
    list_transform(raw_cells, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:length(x)-1], '""', '"') ELSE x END) AS c
  FROM cut),
recs AS (
  SELECT 'molecules_raw' AS src, line_id AS rec_id, readable, coalesce(len(c), 0) AS n, c[1] AS dataset_name, c[2] AS endpoint, c[3] AS smiles, c[4] AS label_text,
    coalesce(trim(c[4]) IN ('0', '1'), false) AS label_ok FROM cells
  UNION ALL
  SELECT 'molecules', mol_id, true, 4, dataset_name, endpoint, smiles, label::varchar, coalesce(label IN (0, 1), false) FROM molecules),
parts AS (
  SELECT *, trim(smiles) AS s, regexp_replace(trim(smiles), '\[[^\]]*\]', '', 'g') AS outside FROM recs),
marks AS (
  SELECT *, list_transform(string_split(regexp_replace(outside, '[^()]', '', 'g'), ''), lambda x: CASE x WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) AS steps,
    regexp_extract_all(outside, '%[0-9][0-9]|[0-9]') AS labs FROM parts),
judged AS (
  SELECT *, coalesce(regexp_full_match(s, '(Cl|Br|[BCNOPSFI]|[bcnops]|\[[A-Za-z0-9@+\-:]+\]|[-=#:/\\.]|[()]|[0-9]|%[0-9][0-9])+')
    AND list_reduce(list_prepend(0, steps), lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END) = 0
    AND len(list_filter(list_distinct(labs), lambda y: len(list_filter(labs, lambda x: x = y)) % 2 = 1)) = 0, false) AS smiles_ok FROM marks),
reasons AS (
  SELECT *, CASE WHEN NOT readable THEN 'quoting' WHEN n <> 4 THEN 'columns' WHEN NOT smiles_ok THEN 'smiles' WHEN NOT label_ok THEN 'label' END AS reason FROM judged)
"""

_KEYED_SQL = """
WITH keyed AS (
  SELECT *, lower(trim(coalesce(dataset_name, ''))) AS k1, lower(trim(coalesce(endpoint, ''))) AS k2 FROM toxicitycliff)
"""

SQL = {
    "p1_found": _BAD_SQL + "SELECT src, rec_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p1_reasons": _BAD_SQL + "SELECT src, reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY ALL",
    "p1_loaded": _BAD_SQL
    + """SELECT src, rec_id, CASE WHEN src = 'molecules' THEN dataset_name ELSE nullif(dataset_name, '') END AS dataset_name,
  CASE WHEN src = 'molecules' THEN endpoint ELSE nullif(endpoint, '') END AS endpoint, s AS smiles, trim(label_text)::integer AS label
FROM reasons WHERE reason IS NULL""",
    "p4_found": _KEYED_SQL + "SELECT k1 AS dataset_name, k2 AS endpoint FROM keyed GROUP BY k1, k2 HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM keyed)",
    "p4_keys": _KEYED_SQL
    + """, frags AS (
  SELECT k1, k2, trim(f) AS f FROM (
    SELECT k1, k2, unnest(string_split(cell, '.')) AS f FROM (
      SELECT k1, k2, only_toxic_safe_fragments AS cell FROM keyed UNION ALL SELECT k1, k2, only_nontoxic_safe_fragments FROM keyed)
    WHERE cell IS NOT NULL AND lower(trim(cell)) NOT IN ('', 'nan')) WHERE trim(f) <> ''),
fn AS (SELECT k1, k2, count(*) AS n, count(DISTINCT f) AS nd FROM frags GROUP BY k1, k2),
kn AS (
  SELECT k1, k2, count(*) AS n_rows, count(DISTINCT nullif(trim(toxic_smiles), '')) AS n_molecules,
    quantile_disc(length(trim(toxic_smiles))::double, 0.25) AS q25, quantile_disc(length(trim(toxic_smiles))::double, 0.5) AS q50,
    quantile_disc(length(trim(toxic_smiles))::double, 0.75) AS q75, quantile_disc(length(trim(toxic_smiles))::double, 0.99) AS q99
  FROM keyed GROUP BY k1, k2)
SELECT k1 AS dataset_name, k2 AS endpoint, n_rows, n_molecules, coalesce(n, 0)::bigint AS n_fragments, coalesce(nd, 0)::bigint AS n_distinct_fragments, q25, q50, q75, q99
FROM kn LEFT JOIN fn USING (k1, k2)""",
}
