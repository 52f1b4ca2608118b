"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_ENTITY = """
WITH named AS (
  SELECT t.cliff_id, t.split, coalesce(p.scaffold, p.canonical, nullif(trim(t.toxic_smiles), '')) AS entity
  FROM toxicitycliff t LEFT JOIN mol_profile p ON p.smiles = trim(t.toxic_smiles))
"""

_COMPONENTS = """
WITH RECURSIVE mols AS (SELECT trim(toxic_smiles) AS m, min(cliff_id) AS id FROM toxicitycliff WHERE trim(toxic_smiles) <> '' GROUP BY 1),
keys AS (
  SELECT id, m AS key FROM mols UNION SELECT id, p.canonical FROM mols JOIN mol_profile p ON p.smiles = m WHERE p.canonical IS NOT NULL
  UNION SELECT id, p.scaffold FROM mols JOIN mol_profile p ON p.smiles = m WHERE p.scaffold IS NOT NULL),
stars AS (SELECT id AS a, min(id) OVER (PARTITION BY key) AS b FROM keys),
edges AS (SELECT a, b FROM stars UNION SELECT b, a FROM stars),
reach AS (SELECT id, id AS seen FROM mols UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.seen),
roots AS (SELECT m, min(seen) AS root FROM reach JOIN mols USING (id) GROUP BY m)
SELECT t.cliff_id, coalesce(r.root, t.cliff_id) AS component FROM toxicitycliff t LEFT JOIN roots r ON r.m = trim(t.toxic_smiles)
"""

# The shares themselves: the tables have single rows enough to meet them.
_TOTALS = """
WITH n AS (SELECT count(*) AS n, round_even(0.1::double * count(*), 0)::bigint AS share FROM toxicitycliff)
SELECT 'test' AS new_split, share AS n_rows FROM n UNION ALL SELECT 'valid', share FROM n UNION ALL SELECT 'train', n - 2 * share FROM n
"""

_FRAGMENTS = """
WITH cells AS (
  SELECT cliff_id, 1 AS side, only_toxic_safe_fragments AS cell FROM toxicitycliff
  UNION ALL SELECT cliff_id, 2, only_nontoxic_safe_fragments FROM toxicitycliff),
lists AS (
  SELECT cliff_id, list_filter(list_transform(string_split(cell, '.'), lambda x: trim(x)), lambda x: x <> '') AS l
  FROM cells WHERE cell IS NOT NULL AND lower(trim(cell)) NOT IN ('', 'nan')),
grams AS (
  SELECT cliff_id, n, array_to_string(l[i:i + n - 1], '.') AS ngram
  FROM lists, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS n), LATERAL (SELECT unnest(range(1, len(l) - n + 2)) AS i)),
counts AS (
  SELECT ngram, n::integer AS n, count(*) AS occurrences, count(DISTINCT cliff_id) AS n_records FROM grams GROUP BY ngram, n),
marked AS (
  SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 100 > 2 * (SELECT count(*) FROM toxicitycliff) THEN 'common' END AS mark FROM counts)
"""

_NEAR = """
WITH r AS (
  SELECT cliff_id, split, lower(trim(coalesce(dataset_name, ''))) AS dataset_name, trim(toxic_smiles) AS a, trim(nontoxic_smiles) AS b
  FROM toxicitycliff WHERE trim(toxic_smiles) <> '' AND trim(nontoxic_smiles) <> '' AND split IN ('train', 'valid', 'test')),
near AS (
  SELECT x.cliff_id AS id_a, y.cliff_id AS id_b, y.split, y.dataset_name, x.a = y.a AND x.b = y.b AS exact
  FROM r x JOIN r y ON x.split = 'train' AND y.split <> 'train' AND abs(length(x.a) - length(y.a)) <= 3 AND abs(length(x.b) - length(y.b)) <= 3
  WHERE CASE WHEN levenshtein(x.a, y.a) <= 3 THEN levenshtein(x.b, y.b) <= 3 ELSE false END)
"""

_TOKENS = r"""
WITH counted AS (
  SELECT source, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{b}\x{85}]+')) AS tokens FROM documents),
per AS (
  SELECT w.source, w.target_share, w.max_repeats, coalesce(sum(tokens), 0) AS tokens
  FROM source_weights w LEFT JOIN counted c ON c.source = w.source GROUP BY ALL)
"""

SQL = {
    "p2_found": _ENTITY + "SELECT cliff_id FROM named WHERE split IS NOT NULL AND entity IN (SELECT entity FROM named WHERE split IS NOT NULL AND entity IS NOT NULL GROUP BY entity HAVING count(DISTINCT split) > 1)",
    "p2_components": _COMPONENTS,
    "p2_totals": _TOTALS,
    "p3_ngrams": _FRAGMENTS + "SELECT ngram, n, occurrences, n_records, mark FROM marked",
    "p3_fragments": _FRAGMENTS + "SELECT ngram AS fragment, occurrences, n_records, mark FROM marked WHERE n = 1",
    "p3_found": _FRAGMENTS + "SELECT ngram AS fragment, mark FROM marked WHERE n = 1 AND mark IS NOT NULL",
    "p5_found": _NEAR + "SELECT least(id_a, id_b) AS cliff_id_a, greatest(id_a, id_b) AS cliff_id_b FROM near",
    "p5_report": _NEAR + "SELECT split, dataset_name, count(*) AS n_pairs, count(DISTINCT id_b) AS n_rows, count(*) FILTER (WHERE exact) AS n_exact FROM near GROUP BY split, dataset_name",
    "p7_limits": _TOKENS + "SELECT source, tokens::bigint AS source_tokens, tokens * max_repeats < target_share * (SELECT sum(tokens) FROM per) AS limited, true AS met FROM per",
    "p7_found": _TOKENS + "SELECT source FROM per WHERE tokens * max_repeats < target_share * (SELECT sum(tokens) FROM per)",
}
