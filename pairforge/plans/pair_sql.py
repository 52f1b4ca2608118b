"""DuckDB SQL for the queries of the pair engine."""

import random

from pairforge.functions.scoring import DESIRABILITY
from pairforge.operators import descriptions as D
from pairforge.operators.qa import BODY, ONE_KEY, PREAMBLE, TASKS, THREE_KEYS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STRIP = r"regexp_replace({}, '^[\s\x{{b}}\x{{85}}\p{{Z}}]+|[\s\x{{b}}\x{{85}}\p{{Z}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _tokens(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '.'), lambda x: {_strip('x')}), lambda x: x <> '')"


def _set(x: str) -> str:
    return f"list_sort(list_distinct({_tokens(x)}))"


def _join(x: str) -> str:
    return f"coalesce(array_to_string({x}, '.'), '')"


_MOLECULES = "WITH m AS (SELECT DISTINCT dataset_name, endpoint, trim(smiles) AS smiles, label FROM molecules WHERE trim(smiles) <> '' AND dataset_name IS NOT NULL AND endpoint IS NOT NULL AND label IN (0, 1))"
_PAIRS = (
    _MOLECULES
    + """
SELECT DISTINCT t.dataset_name, t.endpoint, t.smiles AS toxic_smiles, n.smiles AS nontoxic_smiles
FROM m t JOIN m n ON t.dataset_name = n.dataset_name AND t.endpoint = n.endpoint AND t.label = 1 AND n.label = 0
  AND 10 * abs(length(t.smiles) - length(n.smiles)) <= greatest(length(t.smiles), length(n.smiles))
WHERE 10 * levenshtein(t.smiles, n.smiles) <= greatest(length(t.smiles), length(n.smiles))"""
)


def _word(bit: str) -> str:
    return f"list_sum(list_transform(list_distinct(list_transform(range(1, length(smiles) + 1), lambda i: {bit})), lambda b: 1::bigint << b::integer))::bigint"


_NEXT = "(CASE WHEN i < length(smiles) THEN ascii(smiles[i + 1]) ELSE 0 END)"
_BITS = (
    _MOLECULES
    + f""",
f AS (SELECT *, {_word(f"(ascii(smiles[i]) * 31 + {_NEXT} * 7) % 63")} AS fp, CASE WHEN length(smiles) > 30 THEN {_word("(ascii(smiles[i]) * 5 + i // 8) % 63")} END AS sfp FROM m)
SELECT DISTINCT t.dataset_name, t.endpoint, t.smiles AS toxic_smiles, n.smiles AS nontoxic_smiles{{more}}
FROM f t JOIN f n ON t.dataset_name = n.dataset_name AND t.endpoint = n.endpoint AND t.label = 1 AND n.label = 0
WHERE 10 * bit_count(t.fp & n.fp)::integer >= 9 * bit_count(t.fp | n.fp)::integer OR coalesce(10 * bit_count(t.sfp & n.sfp)::integer >= 9 * bit_count(t.sfp | n.sfp)::integer, false)
  OR CASE WHEN 10 * abs(length(t.smiles) - length(n.smiles)) <= greatest(length(t.smiles), length(n.smiles)) THEN 10 * levenshtein(t.smiles, n.smiles) <= greatest(length(t.smiles), length(n.smiles)) ELSE false END"""
)
_TANIMOTO = ", ".join(f"CASE WHEN bit_count(t.{c} | n.{c}) > 0 THEN bit_count(t.{c} & n.{c})::double / bit_count(t.{c} | n.{c}) END AS {name}_similarity" for c, name in (("fp", "fp"), ("sfp", "scaffold_fp")))
_SCORES = _BITS.replace("{more}", ", 1 - levenshtein(t.smiles, n.smiles)::double / greatest(length(t.smiles), length(n.smiles), 1) AS text_similarity, " + _TANIMOTO)
_BITS = _BITS.replace("{more}", "")

_COMPARED = f"""
WITH s AS (
  SELECT cliff_id, dataset_name, endpoint, toxic_smiles, nontoxic_smiles, toxic_safe, nontoxic_safe, {_set("toxic_safe")} AS t, {_set("nontoxic_safe")} AS n FROM toxicitycliff),
parts AS (SELECT *, list_filter(t, lambda x: list_contains(n, x)) AS c, list_filter(t, lambda x: NOT list_contains(n, x)) AS ot, list_filter(n, lambda x: NOT list_contains(t, x)) AS onn FROM s),
compared AS (
  SELECT cliff_id, dataset_name, endpoint, toxic_smiles, nontoxic_smiles, toxic_safe, nontoxic_safe, {_join("t")} AS toxic_safe_fragments, {_join("n")} AS nontoxic_safe_fragments,
    {_join("c")} AS common_safe_fragments, {_join("ot")} AS only_toxic_safe_fragments, {_join("onn")} AS only_nontoxic_safe_fragments,
    len(c)::integer AS n_common_safe, len(ot)::integer AS n_only_toxic_safe, len(onn)::integer AS n_only_nontoxic_safe, len(ot) > 0 OR len(onn) > 0 AS has_safe_diff, ot || onn AS tokens
  FROM parts),
core AS (SELECT * FROM compared WHERE n_common_safe <> 0 AND NOT (n_only_toxic_safe = 0 AND n_only_nontoxic_safe = 0)),
lens AS (SELECT length(unnest(tokens))::double AS x FROM core)
"""


def _fence(x: str) -> str:
    iqr = f"(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"
    return f"CASE WHEN count({x}) >= 4 AND {iqr} > 0 THEN quantile_cont({x}, 0.75) + 1.5 * {iqr} END"


_LONG = f"""
, f1 AS (SELECT coalesce({_fence("x")}, 27.0) AS f FROM lens),
kept AS (SELECT * FROM core, f1 WHERE coalesce(list_max(list_transform(tokens, lambda x: length(x))), 0) <= f1.f),
f2 AS (SELECT coalesce({_fence("n_only_toxic_safe::double")}, 4) AS a, coalesce({_fence("n_only_nontoxic_safe::double")}, 4) AS b FROM kept)
SELECT cliff_id FROM kept WHERE n_only_toxic_safe <= (SELECT a FROM f2) AND n_only_nontoxic_safe <= (SELECT b FROM f2)"""

_PROPS = {"MW": "mw", "logP": "logp", "TPSA": "tpsa", "HBD": "hbd", "HBA": "hba", "RotB": "rotb"}
_DELTAS = (
    """
WITH p AS (SELECT smiles, scaffold, min(smiles) OVER (PARTITION BY scaffold) AS first FROM mol_profile WHERE scaffold IS NOT NULL),
d AS (SELECT p.first AS toxic_smiles, p.smiles AS nontoxic_smiles, """
    + ", ".join(f"b.props.{f} - a.props.{f} AS delta_{p}" for p, f in _PROPS.items())
    + " FROM p JOIN mol_profile a ON a.smiles = p.first JOIN mol_profile b ON b.smiles = p.smiles WHERE p.smiles <> p.first)"
)


def _two_sided(p: str) -> str:
    lo, hi = f"quantile_cont(abs(delta_{p}), 0.25)", f"quantile_cont(abs(delta_{p}), 0.75)"
    return f"{lo} - 1.5 * ({hi} - {lo}) AS lo_{p}, {hi} + 1.5 * ({hi} - {lo}) AS hi_{p}"


_STEP1 = f"CASE WHEN len({_tokens('only_toxic_safe_fragments')}) = 1 THEN 'single_step' ELSE 'multi_step' END"
_STEP2 = f"CASE WHEN len({_tokens('only_toxic_safe_fragments')}) = 1 AND len({_tokens('only_nontoxic_safe_fragments')}) = 1 THEN 'single_step' ELSE 'multi_step' END"
_CLEAN = "\n".join(["WITH notes AS (SELECT dataset_name, endpoint, min(description) AS description FROM endpoint_notes GROUP BY ALL),", "base AS (SELECT t.cliff_id AS source_index,"]) + ", ".join(
    f"coalesce({_strip(f't.{c}')}, '') AS {c}" for c in ("dataset_name", "endpoint", "toxic_safe", "nontoxic_safe", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments", "toxic_smiles", "nontoxic_smiles")
) + """, coalesce(e.description, w.description, '') AS description
  FROM toxicitycliff t LEFT JOIN notes e ON e.dataset_name = t.dataset_name AND e.endpoint = t.endpoint LEFT JOIN notes w ON w.dataset_name = t.dataset_name AND w.endpoint IS NULL),
rows AS (SELECT * FROM base WHERE dataset_name <> '' OR endpoint <> '')
"""  # fmt: skip


def _task_sql(task: str) -> str:
    step = _STEP1 if task == "task1" else _STEP2
    single, multi = BODY[task]
    body = f"CASE WHEN {step} = 'single_step' THEN {_q(single)} ELSE {_q(multi)} END"
    if task == "task1":
        body = f"'SAFE of the toxic molecule: ' || toxic_safe || chr(10) || {body}"
    if task == "task2":
        body = f"'Fragments that make it toxic: ' || only_toxic_safe_fragments || chr(10) || {body}"
    repr_ = lambda c: f"chr(39) || replace(replace({c}, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39)"
    shown = f"coalesce(chr(10) || 'Toxic molecule: ' || nullif(concat_ws(', ', CASE WHEN toxic_smiles <> '' THEN 'SMILES = ' || {repr_('toxic_smiles')} END, CASE WHEN toxic_safe <> '' THEN 'SAFE = ' || {repr_('toxic_safe')} END), ''), '')"
    tail = f"chr(10) || chr(10) || {_q(THREE_KEYS)}" if task == "task3_cot_safe_gen" else f"' ' || {_q(ONE_KEY)}"
    text = f"CASE WHEN description = '' THEN '' ELSE description || chr(10) END || {_q(PREAMBLE)} || {shown} || chr(10) || {body}"
    gold = {"task1": "only_toxic_safe_fragments", "task2": "only_nontoxic_safe_fragments", "task3_smiles_gen": "nontoxic_smiles"}.get(task, "nontoxic_safe")
    return f"SELECT '{task}' AS task, {step} AS step, source_index AS id, {_strip(text)} || {tail} AS question, {gold} AS answer, dataset_name, endpoint FROM rows"


_GOLD = f"""
WITH r AS (
  SELECT cliff_id, coalesce(split, 'none') AS split, {_strip("coalesce(only_toxic_safe_fragments, '')")} AS gold, {_strip("coalesce(only_nontoxic_safe_fragments, '')")} AS pred FROM toxicitycliff),
l AS (
  SELECT *, list_filter(string_split(replace(gold, ' ', ''), '.'), lambda x: x <> '') AS g, list_filter(string_split(replace(pred, ' ', ''), '.'), lambda x: x <> '') AS p
  FROM r),
k AS (SELECT *, len(list_distinct(g)) AS ng, len(list_distinct(p)) AS np, len(list_intersect(list_distinct(g), list_distinct(p)))::double AS hit FROM l),
scored AS (
  SELECT cliff_id, split, CASE WHEN gold <> '' AND list_sort(g) = list_sort(p) THEN 1.0::double ELSE 0.0::double END AS em,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0::double WHEN ng = 0 OR np = 0 THEN 0.0::double ELSE hit / np END AS precision,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0::double WHEN ng = 0 OR np = 0 THEN 0.0::double ELSE hit / ng END AS recall,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0::double WHEN ng = 0 OR np = 0 THEN 0.0::double ELSE 2 * hit / (ng + np) END AS f1,
    CASE WHEN gold = '' OR pred = '' THEN 0.0::double ELSE
      list_sum(list_transform(list_distinct(string_split(pred, '')), lambda c: least(length(pred) - length(replace(pred, c, '')), length(gold) - length(replace(gold, c, '')))))::double / length(pred) END AS bleu,
    CASE WHEN len(g) = 0 OR len(p) = 0 THEN levenshtein(gold, pred)::double ELSE
      list_sum(list_transform(p, lambda x: list_min(list_transform(g, lambda y: levenshtein(x, y)))))::double / len(p) END AS lev,
    CASE WHEN len(g) = 1 THEN 'single_step' ELSE 'multi_step' END AS step, g
  FROM k)
"""


def _desirability(p: str) -> str:
    a, b, c, d, e, f, most, _ = DESIRABILITY[p]
    x = f"props.{_PROPS[p]}"
    return f"(({a}::double + {b}::double / (1 + exp(-({x} - {c}::double + {d}::double / 2) / {e}::double)) * (1 - 1 / (1 + exp(-({x} - {c}::double - {d}::double / 2) / {f}::double)))) / {most}::double)"


_QED = "exp((" + " + ".join(f"{v[-1]}::double * ln({_desirability(p)})" for p, v in DESIRABILITY.items()) + f") / {sum(v[-1] for v in DESIRABILITY.values())}::double)"

_WORDS = "list_value(" + ", ".join(f"list_sum(list_transform(list_zip(embedding[{a}:{a + 15}], range(0, 16)), lambda x: CASE WHEN x[1] > 0 THEN (1::bigint << x[2]::integer) ELSE 0 END))::bigint" for a in (1, 17, 33, 49)) + ")"

_KEPT = _LONG.replace("SELECT cliff_id FROM kept", ", chosen AS (SELECT * FROM kept") + ")"
_OF_PAIRS = (
    _COMPARED
    + _KEPT
    + ", d AS (SELECT s.*, pa.canonical AS ca, pb.canonical AS cb, "
    + ", ".join(f"pb.props.{f} - pa.props.{f} AS delta_{p}" for p, f in _PROPS.items())
    + " FROM chosen s LEFT JOIN mol_profile pa ON pa.smiles = s.toxic_smiles LEFT JOIN mol_profile pb ON pb.smiles = s.nontoxic_smiles), f AS (SELECT "
    + ", ".join(map(_two_sided, _PROPS))
    + " FROM d) SELECT dataset_name, endpoint, "
    + ", ".join(f"coalesce({c}, {_strip(x)}, '') AS {x}" for c, x in (("ca", "toxic_smiles"), ("cb", "nontoxic_smiles")))
    + ", toxic_safe, nontoxic_safe, only_toxic_safe_fragments, only_nontoxic_safe_fragments, common_safe_fragments FROM d, f WHERE NOT ("
    + " OR ".join(f"coalesce(abs(delta_{p}) < lo_{p} OR abs(delta_{p}) > hi_{p}, false)" for p in _PROPS)
    + ")"
)

_FAMILY = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASKS.items()) + " END"
_TASK3 = rf"""
WITH q AS (SELECT smiles, canonical, {_QED} AS qed FROM mol_profile),
r AS (
  SELECT cliff_id, coalesce({_strip("nontoxic_smiles")}, '') AS gold, coalesce({_strip("CASE cliff_id % 3 WHEN 0 THEN nontoxic_smiles WHEN 1 THEN toxic_smiles ELSE 'no molecule' END")}, '') AS pred,
    replace(toxic_smiles, chr(92), chr(92) || chr(92)) AS input FROM toxicitycliff),
j AS (
  SELECT cliff_id, a.canonical AS g, b.canonical AS p, c.canonical AS i, b.qed AS qp, c.qed AS qi
  FROM r LEFT JOIN q a ON a.smiles = gold LEFT JOIN q b ON b.smiles = pred LEFT JOIN q c ON c.smiles = input)
SELECT cliff_id, CASE WHEN g = p THEN 1.0::double ELSE 0.0::double END AS exact_match,
  CASE WHEN g <> '' AND p <> '' THEN list_sum(list_transform(list_distinct(string_split(p, '')), lambda c: least(length(p) - length(replace(p, c, '')), length(g) - length(replace(g, c, '')))))::double / length(p) ELSE 0.0::double END AS bleu,
  coalesce(levenshtein(g, p), 0)::double AS levenshtein, CASE WHEN p IS NULL THEN 0.0::double ELSE 1.0::double END AS validity,
  coalesce(exp(-abs(qi - qp)), 0.0::double) AS prs_property_score, CASE WHEN i = p THEN 1.0::double ELSE 0.0::double END AS copy_rate
FROM j"""


def _pick(names: list[str], by: int) -> str:
    return f"list_value({', '.join(map(_q, names))})[((cliff_id // {by}) % {len(names)} + 1)::integer]"


def _text_of(scope: str, key: str) -> str:
    names = {"assay": D.ASSAYS, "organ": D.ORGAN_CLASSES, "endpoint": D.ENDPOINTS, "dataset": [*D.DATASETS, *D.ENZYME_SETS]}[scope]
    return f"CASE {key} " + " ".join(f"WHEN {_q(n)} THEN {_q(D.text_of(scope, n))}" for n in names) + " END"


_ORGAN = "coalesce(" + _text_of("organ", "e") + f", {_q(D.ORGAN_CLASS)} || e || '.')"
_LADDER = f"""
WITH k AS (
  SELECT cliff_id, {_pick([*D.DATASETS, *D.ASSAY_SETS, *D.ORGAN_SETS, *D.ENZYME_SETS, "", "unknown"], 64)} AS dataset_name,
    CASE cliff_id % 8 WHEN 1 THEN 'tox21_' || {_pick(D.ASSAYS, 8)} WHEN 2 THEN 'TOX21_other' WHEN 3 THEN {_pick(D.ORGAN_CLASSES, 8)} WHEN 4 THEN lower({_pick(D.ORGAN_CLASSES, 8)})
      WHEN 5 THEN upper({_pick(D.ENDPOINTS, 8)}) WHEN 6 THEN {_pick(D.ASSAYS, 8)} WHEN 7 THEN endpoint END AS endpoint FROM toxicitycliff),
x AS (SELECT *, coalesce(endpoint, '') AS e, dataset_name AS d FROM k)
SELECT cliff_id, dataset_name, endpoint, CASE WHEN e = '' AND d = '' THEN ''
  WHEN starts_with(lower(e), 'tox21_') THEN coalesce({_text_of("assay", "replace(e, 'tox21_', '')")}, {_q(D.GENERIC_ASSAY)})
  WHEN lower(e) IN ({", ".join(_q(o.lower()) for o in D.ORGAN_CLASSES)}) THEN {_ORGAN}
  WHEN {_text_of("endpoint", "lower(e)")} IS NOT NULL THEN {_text_of("endpoint", "lower(e)")}
  WHEN {_text_of("dataset", "lower(d)")} IS NOT NULL THEN {_text_of("dataset", "lower(d)")}
  WHEN lower(d) = 'tox21' THEN coalesce({_text_of("assay", "e")}, {_q(D.GENERIC_ASSAY)})
  WHEN lower(d) IN ({", ".join(map(_q, D.ORGAN_SETS))}) THEN CASE WHEN e = '' THEN {_q(D.GENERIC_ORGAN)} ELSE {_ORGAN} END END AS description
FROM x"""

_PLACES = list(range(400))  # eval_items has so many rows at every scale
random.Random(42).shuffle(_PLACES)

SQL = {
    "cliffs_of_pairs": _OF_PAIRS,
    "task3_scores": _TASK3,
    "description_ladder": _LADDER,
    "infer_run": f"SELECT split, {_FAMILY} AS task, step || '_step' AS step, count(*) AS total, count(*) AS inference_samples FROM eval_items GROUP BY ALL",
    "qa_round_trip": _CLEAN.rstrip() + ", every AS (" + " UNION ALL ".join(map(_task_sql, TASKS)) + f") SELECT 'test' AS split, {_FAMILY} AS task, step, count(*) AS n, sum(id)::bigint AS ids, sum(length(question))::bigint AS characters FROM every GROUP BY ALL",
    "sql_functions": _GOLD + "SELECT cliff_id, f1, bleu, len(g)::integer AS n_gold FROM scored",
    "stream_means": _GOLD + "SELECT 'm' AS model, split, 'task2' AS task, step, count(*) AS total, avg(em) AS \"fragment_EM\", CASE WHEN step = 'multi_step' THEN avg(f1) END AS \"fragment_F1\" FROM scored GROUP BY split, step",
    "seeded_shuffle": f"SELECT item_id AS was, list_position({_PLACES}, row_number() OVER (ORDER BY item_id) - 1)::bigint - 1 AS id FROM eval_items",
    "pair_levenshtein": _PAIRS,
    "pair_by_length": _PAIRS,
    "pair_by_bits": _BITS,
    "pair_scores": _SCORES,
    "csv_round_trip": "SELECT row_number() OVER (ORDER BY cliff_id) - 1 AS source_index, cliff_id::varchar AS cliff_id, "
    + ", ".join(f"nullif({c}, '') AS {c}" for c in ("dataset_name", "endpoint", "toxic_smiles", "toxic_safe", "common_safe_fragments"))
    + " FROM toxicitycliff",
    "fragment_sets": f"SELECT cliff_id, {_join(_set('toxic_safe'))} AS fragments, len(list_filter(string_split(replace(coalesce(toxic_safe, ''), ' ', ''), '.'), lambda x: x <> ''))::integer AS n_listed FROM toxicitycliff",
    "fragment_compare": _COMPARED + "SELECT * EXCLUDE (tokens) FROM compared",
    "core_filter": _COMPARED + "SELECT cliff_id, n_common_safe, n_only_toxic_safe, n_only_nontoxic_safe FROM core",
    "tukey_fences": _COMPARED + f"SELECT count(*) AS n, {_fence('x')} AS fence FROM lens",
    "fragment_filters": _COMPARED + _LONG,
    "fixed_thresholds": _COMPARED + "SELECT cliff_id FROM core WHERE len(list_filter(tokens, lambda x: length(x) >= 28)) = 0 AND n_only_toxic_safe <= 4 AND n_only_nontoxic_safe <= 4",
    "property_deltas": _DELTAS + "SELECT * FROM d",
    "property_outliers": _DELTAS
    + ", f AS (SELECT " + ", ".join(map(_two_sided, _PROPS)) + " FROM d) SELECT toxic_smiles, nontoxic_smiles FROM d, f WHERE NOT ("
    + " OR ".join(f"coalesce(abs(delta_{p}) < lo_{p} OR abs(delta_{p}) > hi_{p}, false)" for p in _PROPS) + ")",
    "group_split": """
WITH r AS (SELECT t.cliff_id, p.scaffold FROM toxicitycliff t LEFT JOIN mol_profile p ON p.smiles = trim(t.toxic_smiles)),
g AS (SELECT scaffold, count(*) AS n, min(cliff_id) AS first FROM r WHERE scaffold IS NOT NULL GROUP BY scaffold),
c AS (SELECT scaffold, sum(n) OVER (ORDER BY n, first ROWS UNBOUNDED PRECEDING) AS upto FROM g)
SELECT cliff_id, CASE WHEN upto <= 0.1 * (SELECT count(*) FROM r) THEN 'test' ELSE 'train' END AS split FROM r LEFT JOIN c USING (scaffold)""",
    "row_numbers": "SELECT cliff_id, row_number() OVER (ORDER BY toxic_smiles NULLS FIRST, nontoxic_smiles NULLS FIRST, cliff_id) - 1 AS row_id FROM toxicitycliff",
    "step_route": _CLEAN + f"SELECT source_index, {_STEP1} AS step_task1, {_STEP2} AS step_task2 FROM rows",
    "description_lookup": """
WITH n AS (SELECT dataset_name, endpoint, min(description) AS description FROM endpoint_notes GROUP BY ALL)
SELECT i.item_id, coalesce(e.description, w.description) AS description
FROM eval_items i LEFT JOIN n e ON e.dataset_name = i.dataset_name AND e.endpoint = i.endpoint LEFT JOIN n w ON w.dataset_name = i.dataset_name AND w.endpoint IS NULL""",
    "qa_records": _CLEAN + " UNION ALL ".join(map(_task_sql, TASKS)),
    "resume_anti": "SELECT item_id AS id FROM eval_items WHERE NOT (split = 'test' AND task <> 'task1')",
    "infer_replay": "SELECT item_id AS id, true AS same FROM eval_items",
    "json_salvage": "SELECT event_id, CASE WHEN event_type <> 'error' THEN (props->>'$.k')::integer END AS k FROM events",
    "regex_context": r"SELECT cliff_id, coalesce(nullif(regexp_extract('Edit this. SMILES = ' || chr(39) || replace(toxic_smiles, chr(92), chr(92) || chr(92)) || chr(39) || ' please', 'SMILES = ''([^'']+)''', 1), ''), '') AS molecule FROM toxicitycliff",
    "fragment_scores": _GOLD + "SELECT cliff_id, em, precision, recall, f1, bleu, lev FROM scored",
    "tanimoto_words": f"""
WITH r AS (SELECT vec_id, label, {_WORDS} AS w FROM embeddings),
f AS (SELECT label, arg_min(w, vec_id) AS f FROM r GROUP BY label),
c AS (SELECT vec_id, list_sum(list_transform(list_zip(w, f), lambda x: bit_count(x[1] & x[2]))) AS z, list_sum(list_transform(w, lambda x: bit_count(x))) + list_sum(list_transform(f, lambda x: bit_count(x))) AS s
  FROM r JOIN f USING (label))
SELECT vec_id, CASE WHEN s - z > 0 THEN z::double / (s - z) ELSE 0.0 END AS similarity, s - z > 0 AND z * 10 >= (s - z) * 9 AS near FROM c""",
    "qed_prs": f"""WITH q AS (SELECT smiles, {_QED} AS qed FROM mol_profile)
SELECT smiles, qed, coalesce(exp(-abs(0.5 - qed)), 0.0) AS exponential, coalesce(CASE WHEN qed IS NOT NULL THEN greatest(0.0::double, 1 - abs(0.5 - qed)) END, 0.0) AS linear, coalesce(1 / (1 + abs(0.5 - qed)), 0.0) AS reciprocal FROM q""",
    "summary": _GOLD
    + "SELECT split, step, count(*) AS total, avg(em) AS \"fragment_EM\", avg(em) * 100 AS \"fragment_EM_Acc\", CASE WHEN step = 'multi_step' THEN avg(f1) END AS \"fragment_F1\", avg(lev) AS \"fragment_Levenshtein\" FROM scored GROUP BY split, step",
    "summary_rollup": _GOLD + "SELECT split, step, count(*) AS total, avg(em) AS em FROM scored GROUP BY ROLLUP (split, step)",
    "distinct_union": "SELECT toxic_smiles AS smiles FROM toxicitycliff WHERE toxic_smiles IS NOT NULL UNION SELECT nontoxic_smiles FROM toxicitycliff WHERE nontoxic_smiles IS NOT NULL",
    "limit_prefix": "SELECT item_id AS id, question FROM eval_items ORDER BY item_id LIMIT 20",
    "safe_lookup": """
WITH d AS (SELECT smiles, min(scaffold) AS direct, min(canonical) AS form FROM mol_profile GROUP BY smiles),
c AS (SELECT canonical AS form, min(scaffold) AS by_form FROM mol_profile WHERE canonical IS NOT NULL GROUP BY canonical)
SELECT t.cliff_id, coalesce(nullif(a.direct, ''), ca.by_form, '') AS toxic_safe, coalesce(nullif(b.direct, ''), cb.by_form, '') AS nontoxic_safe
FROM toxicitycliff t LEFT JOIN d a ON a.smiles = t.toxic_smiles LEFT JOIN c ca ON ca.form = coalesce(a.form, t.toxic_smiles)
LEFT JOIN d b ON b.smiles = t.nontoxic_smiles LEFT JOIN c cb ON cb.form = coalesce(b.form, t.nontoxic_smiles)""",
    "kernel_table": "SELECT m.smiles, p.canonical, p.scaffold FROM (SELECT DISTINCT smiles FROM molecules WHERE smiles IS NOT NULL) m LEFT JOIN mol_profile p USING (smiles)",
}
