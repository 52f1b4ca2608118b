"""Queries of the pair engine: pairing, fragments, fences, splits, records, replies, scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import scoring, similarity
from pairforge.functions import sql as functions_sql
from pairforge.functions.text import fragment_join, fragment_list, fragment_set, py_repr, strip
from pairforge.kernel import kernels
from pairforge.kernel.kernels import GraphKernel, TableKernel, distinct_molecules
from pairforge.operators import descriptions, evaluation, fences, fragments, groupsplit, inference, pairing, qa, stages
from pairforge.plans.pair_sql import SQL
from pairforge.schema import PREDICTIONS, PROPERTIES
from pairforge.sources.files import ordered_ids, read_csv_texts, read_qa, write_csv, write_qa
from pairforge.sources.tables import table
from pairforge.storage import materialize, shared_dir

__all__ = ["QUERIES", "SQL"]


def _molecules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "molecules").select("dataset_name", "endpoint", F.nullif(F.trim("smiles"), F.lit("")).alias("smiles"), "label")


def _cliffs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "toxicitycliff").select("cliff_id", "dataset_name", "endpoint", "toxic_smiles", "nontoxic_smiles", "toxic_safe", "nontoxic_safe")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return fragments.compare_fragments(_cliffs(spark, d))


def pair_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_molecules(_molecules(spark, d))


def pair_by_length(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_molecules(_molecules(spark, d), by_length=True)


def pair_all_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _molecules(spark, d).where("label IN (0, 1)")
    profile = materialize(GraphKernel(columns=("fp", "scaffold_fp")).profile(rows), "profile")
    return pairing.pair_molecules(rows.hint("merge").join(profile.select("smiles", "fp", "scaffold_fp"), "smiles", "left"))


def _with_bits(spark: SparkSession, d: str) -> DataFrame:
    """Molecules with fingerprints that SQL can make, too: pairs of neighbouring characters, and all characters, hashed to 64 bits."""
    rows = _molecules(spark, d).where("label IN (0, 1)")
    code = lambda i: F.ascii(F.col("smiles").substr(i, F.lit(1)))
    word = lambda bits: F.aggregate(F.array_distinct(bits), F.lit(0).cast("bigint"), lambda n, b: n.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    places = F.sequence(F.lit(1), F.length("smiles"))
    fp = word(F.transform(places, lambda i: F.pmod(code(i) * 31 + code(i + 1) * 7, F.lit(63)).cast("int")))
    scaffold = word(F.transform(places, lambda i: F.pmod(code(i) * 5 + F.floor(i / 8), F.lit(63)).cast("int")))
    return rows.withColumns({"fp": F.when(F.length("smiles") > 0, F.array(fp)), "scaffold_fp": F.when(F.length("smiles") > 30, F.array(scaffold))})


def pair_by_bits(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_molecules(materialize(_with_bits(spark, d), "bits"))  # worked out once for both rules and sides


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(_with_bits(spark, d), "bits")
    return pairing.with_scores(pairing.pair_molecules(rows), rows)


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as ordered CSV and read back as texts with their places."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(table(spark, d, "toxicitycliff").select("cliff_id", "dataset_name", "endpoint", "toxic_smiles", "toxic_safe", "common_safe_fragments", F.col("cliff_id").alias("__at")), path, order_by="__at")
    return read_csv_texts(spark, path)


def cliffs(spark: SparkSession, d: str) -> DataFrame:
    """From molecules to pairs with fragments: pair by all rules, compare, filter by fragments and by all properties, export."""
    return stages.toxicity_cliffs(_molecules(spark, d).where("label IN (0, 1)"), lambda *columns: GraphKernel(columns=columns))


def cliffs_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same from delivered pairs and profiles on: compare, filter by fragments and by all properties, export."""
    profile = table(spark, d, "mol_profile")
    compared = materialize(_compared(spark, d), "compared")
    kept = materialize(fences.property_deltas(fences.fragment_filters(compared), profile), "deltas")
    return fragments.for_export(fences.drop_outliers(kept, [f"delta_abs_{p}" for p in PROPERTIES]), profile)


def fragment_sets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("toxic_safe")
    return _cliffs(spark, d).select("cliff_id", fragment_join(fragment_set(c)).alias("fragments"), F.size(fragment_list(c)).alias("n_listed"))


def fragment_compare(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


def core_filter(spark: SparkSession, d: str) -> DataFrame:
    return fences.core_filter(_compared(spark, d)).select("cliff_id", "n_common_safe", "n_only_toxic_safe", "n_only_nontoxic_safe")


def tukey_fences(spark: SparkSession, d: str) -> DataFrame:
    tokens = fences.core_filter(_compared(spark, d)).select(F.explode(fences.only_tokens()).alias("t"))
    return tokens.agg(F.count("*").alias("n"), fences.upper_fence(F.length("t")).alias("fence"))


def fragment_filters(spark: SparkSession, d: str) -> DataFrame:
    return fences.fragment_filters(materialize(_compared(spark, d), "compared")).select("cliff_id")


def fixed_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return fences.fragment_filters(_compared(spark, d), use_iqr=False).select("cliff_id")


def _scaffold_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "mol_profile").select("smiles", "scaffold", "canonical").where("scaffold IS NOT NULL")
    first = p.groupBy("scaffold").agg(F.min("smiles").alias("toxic_smiles"))
    return p.join(first, "scaffold").where("smiles <> toxic_smiles").select("toxic_smiles", F.col("smiles").alias("nontoxic_smiles"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return fences.property_deltas(_scaffold_pairs(spark, d), table(spark, d, "mol_profile"))


def property_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("toxic_smiles", "nontoxic_smiles", *[f"delta_{p}" for p in PROPERTIES])


def property_outliers(spark: SparkSession, d: str) -> DataFrame:
    return fences.drop_outliers(materialize(_deltas(spark, d), "deltas"), [f"delta_abs_{p}" for p in PROPERTIES]).select("toxic_smiles", "nontoxic_smiles")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    scaffolds = table(spark, d, "mol_profile").select(F.col("smiles").alias("m"), "scaffold")
    rows = table(spark, d, "toxicitycliff").select("cliff_id", F.trim("toxic_smiles").alias("m"))
    return rows.join(scaffolds, "m", "left").select("cliff_id", "scaffold")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.smallest_first_split(_grouped(spark, d), "cliff_id", F.col("scaffold")).select("cliff_id", "split")


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ordered_ids(materialize(_cliffs(spark, d).select("toxic_smiles", "nontoxic_smiles", "cliff_id"), "rows"), ["toxic_smiles", "nontoxic_smiles", "cliff_id"]).select("cliff_id", "row_id")


def _qa_input(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "toxicitycliff").withColumn("source_index", F.col("cliff_id"))
    rows = descriptions.note_of(rows.drop("split"), table(spark, d, "endpoint_notes"))
    return rows.drop("loaded_at")


def step_route(spark: SparkSession, d: str) -> DataFrame:
    rows = qa.has_key(qa.normalised(_qa_input(spark, d)))
    return rows.select("source_index", qa.step_of("task1").alias("step_task1"), qa.step_of("task2").alias("step_task2"))


def description_lookup(spark: SparkSession, d: str) -> DataFrame:
    return descriptions.note_of(table(spark, d, "eval_items").select("item_id", "dataset_name", "endpoint"), table(spark, d, "endpoint_notes")).select("item_id", "description")


def qa_records(spark: SparkSession, d: str) -> DataFrame:
    out = qa.build_qa(_qa_input(spark, d), strict=False)
    return out.select("task", "step", "id", "question", F.col("answer.answer").alias("answer"), "dataset_name", "endpoint")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "split", "task", "question")
    before = items.where("split = 'test'").select("id", F.when(F.col("task") == "task1", "ERROR: timeout").otherwise("{}").alias("raw"))
    return inference.unanswered(items, before).select("id")


def infer_replay(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "question")
    return inference.ask(items, inference.EchoProvider()).select("id", (inference.answer_text(F.col("raw")) == F.col("question")).alias("same"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("well: "), "props", F.lit(" done"))).when(F.col("event_type") == "error", F.lit("no json")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", F.try_variant_get(F.try_parse_json(inference.salvage(F.col("raw"))), "$.k", "int").alias("k"))


def task3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Molecule answers scored on delivered profiles: a right answer, a copy of the input, or no molecule, by turns."""
    pred = F.when(F.col("cliff_id") % 3 == 0, F.col("nontoxic_smiles")).when(F.col("cliff_id") % 3 == 1, F.col("toxic_smiles")).otherwise("no molecule")
    rows = table(spark, d, "toxicitycliff").select(
        "cliff_id", F.lit("task3").alias("task"), F.lit("single_step").alias("step"), F.struct(F.col("nontoxic_smiles").alias("answer")).alias("gold"),
        F.to_json(F.struct(pred.alias("answer"))).alias("raw"), F.concat(F.lit("Edit this. SMILES = "), py_repr(F.col("toxic_smiles"))).alias("question"),
    )
    scored = evaluation.with_metrics(rows, TableKernel(table(spark, d, "mol_profile")))
    return scored.select("cliff_id", "exact_match", "bleu", "levenshtein", "validity", "prs_property_score", "copy_rate")


def safe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Molecules written as fragments and read back: the same canonical form each time."""
    kernels.register(spark)
    rows = table(spark, d, "molecules").select("smiles").where("smiles IS NOT NULL").distinct()
    rows = kernels.spread(rows).selectExpr("smiles", "smiles_to_safe(smiles) AS safe", "canonical_smiles(smiles) AS canonical")
    return materialize(rows.where("safe IS NOT NULL"), "safe").selectExpr("smiles", "safe_to_smiles(safe) = canonical AS same")


def description_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Endpoint descriptions by precedence: known and unknown keys of every kind, dealt to the pairs by their ids."""
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), F.pmod(F.col("cliff_id") / by, F.lit(len(names))).cast("int"))
    organ = pick(descriptions.ORGAN_CLASSES, 8)
    endpoint = F.get(F.array(F.lit(None).cast("string"), F.concat(F.lit("tox21_"), pick(descriptions.ASSAYS, 8)), F.lit("TOX21_other"), organ, F.lower(organ), F.upper(pick(descriptions.ENDPOINTS, 8)), pick(descriptions.ASSAYS, 8), F.col("endpoint")), F.pmod("cliff_id", F.lit(8)).cast("int"))
    dataset = pick([*descriptions.DATASETS, *descriptions.ASSAY_SETS, *descriptions.ORGAN_SETS, *descriptions.ENZYME_SETS, "", "unknown"], 64)
    rows = table(spark, d, "toxicitycliff").select("cliff_id", dataset.alias("dataset_name"), endpoint.alias("endpoint"))
    return descriptions.with_description(rows, descriptions.dimension(spark))


def qa_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written to their files and read back, counted per file."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    write_qa(qa.build_qa(_qa_input(spark, d).withColumn("split", F.lit("test")), strict=False), path)
    back = read_qa(spark, path)
    return back.groupBy("split", "task", "step").agg(F.count("*").alias("n"), F.sum("source_index").alias("ids"), F.sum(F.length("question")).cast("bigint").alias("characters"))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions registered for SQL."""
    functions_sql.register(spark)
    _scored(spark, d).createOrReplaceTempView("pairforge_scored")
    return spark.sql("SELECT cliff_id, set_f1(gold, pred) AS f1, bleu1(gold, pred) AS bleu, size(fragment_list(gold)) AS n_gold FROM pairforge_scored")


def infer_run(spark: SparkSession, d: str) -> DataFrame:
    """Ask, score, append and summarise, with a model that answers every question with itself."""
    items = table(spark, d, "eval_items").select(
        "split", "task", F.concat("step", F.lit("_step")).alias("step"), F.col("item_id").alias("id"), "question",
        F.struct(F.col("answer.answer").alias("answer"), F.lit(None).cast("string").alias("gold_only_toxic_safe_fragments"), F.lit(None).cast("string").alias("gold_only_nontoxic_safe_fragments")).alias("answer"),
        "dataset_name", "endpoint", "source_index",
    )
    out = evaluation.run(items.replace(qa.TASKS, subset="task"), inference.EchoProvider(), "echo", f"{shared_dir(spark)}/infer-{uuid.uuid4().hex}")
    return out.select("split", "task", "step", "total", "inference_samples")


def regex_context(spark: SparkSession, d: str) -> DataFrame:
    question = F.concat(F.lit("Edit this. SMILES = "), py_repr(F.col("toxic_smiles")), F.lit(" please"))
    return table(spark, d, "toxicitycliff").select("cliff_id", inference.input_molecule(F.lit(None).cast("string"), question).alias("molecule"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "toxicitycliff").select("cliff_id", F.coalesce("split", F.lit("none")).alias("split"), strip(F.coalesce("only_toxic_safe_fragments", F.lit(""))).alias("gold"), strip(F.coalesce("only_nontoxic_safe_fragments", F.lit(""))).alias("pred"))


def fragment_scores(spark: SparkSession, d: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    prf = scoring.set_prf(g, p)
    return _scored(spark, d).select("cliff_id", scoring.fragment_em(g, p).alias("em"), prf["precision"].alias("precision"), prf["recall"].alias("recall"), prf["f1"].alias("f1"), scoring.bleu1(g, p).alias("bleu"), scoring.fragment_levenshtein(g, p).alias("lev"))


def tanimoto_words(spark: SparkSession, d: str) -> DataFrame:
    sign = lambda at: F.aggregate(F.transform(F.slice("embedding", at, 16), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(0)), F.lit(0).cast("bigint"), lambda n, x: n + x)
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.array(*[sign(at) for at in (1, 17, 33, 49)]).alias("words"))
    first = rows.groupBy("label").agg(F.min_by("words", "vec_id").alias("first"))
    return rows.join(first, "label").select("vec_id", similarity.tanimoto(F.col("words"), F.col("first")).alias("similarity"), similarity.tanimoto_090(F.col("words"), F.col("first")).alias("near"))


def qed_prs(spark: SparkSession, d: str) -> DataFrame:
    names = {"MW": "mw", "logP": "logp", "TPSA": "tpsa", "HBD": "hbd", "HBA": "hba", "RotB": "rotb"}
    q = scoring.qed_six({p: F.col("props").getField(f) for p, f in names.items()})
    rows = table(spark, d, "mol_profile").select("smiles", q.alias("qed"))
    return rows.select("smiles", "qed", *[scoring.prs(F.lit(0.5), F.col("qed"), m)["score"].alias(m) for m in ("exponential", "linear", "reciprocal")])


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumns({"task": F.lit("task2"), "step": F.when(F.size(fragment_list(F.col("gold"))) == 1, "single_step").otherwise("multi_step"), "model": F.lit("m")})
    return rows.withColumns(scoring.task_metrics(F.col("task"), F.col("step"), F.col("gold"), F.col("pred")))


def summary(spark: SparkSession, d: str) -> DataFrame:
    out = inference.summarise(_predictions(spark, d))
    return out.select("split", "step", "total", *[F.col("metrics_mean")[m].alias(m) for m in ("fragment_EM", "fragment_EM_Acc", "fragment_F1", "fragment_Levenshtein")])


def summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).rollup("split", "step").agg(F.count("*").alias("total"), F.avg(scoring.finite(F.col("fragment_EM"))).alias("em"))


def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    rows = _cliffs(spark, d)
    return distinct_molecules((rows, "toxic_smiles"), (rows, "nontoxic_smiles"))


def limit_prefix(spark: SparkSession, d: str) -> DataFrame:
    return inference.first_questions(table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "question"), 20)


def safe_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "toxicitycliff").select("cliff_id", "toxic_smiles", "nontoxic_smiles")
    profile = table(spark, d, "mol_profile").select("smiles", "canonical", F.col("scaffold").alias("safe"))
    return fragments.attach_safe(rows, profile).select("cliff_id", "toxic_safe", "nontoxic_safe")


def kernel_table(spark: SparkSession, d: str) -> DataFrame:
    return TableKernel(table(spark, d, "mol_profile").drop("props")).profile(table(spark, d, "molecules")).select("smiles", "canonical", "scaffold")


def kernel_profile(spark: SparkSession, d: str) -> DataFrame:
    return GraphKernel().profile(table(spark, d, "molecules")).select("smiles", "canonical", "safe", "scaffold", F.size("fp").alias("n_words"))


def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.seeded_permutation(table(spark, d, "eval_items").select(F.col("item_id").alias("was")), "was", 42)


def stream_means(spark: SparkSession, d: str) -> DataFrame:
    from pairforge.streaming.means import prediction_stream, running_means

    path, name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", f"means_{uuid.uuid4().hex}"
    rows = _predictions(spark, d).withColumns({"id": F.col("cliff_id"), "asked_at": F.timestamp_seconds(F.col("cliff_id") % 1000 + 1_700_000_000)})
    rows.select(*[F.col(f.name) for f in PREDICTIONS if f.name in rows.columns]).write.json(path)
    q = running_means(prediction_stream(spark, path), ["fragment_EM", "fragment_F1"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (
        pair_levenshtein, pair_by_length, pair_all_rules, pair_by_bits, pair_scores, cliffs, cliffs_of_pairs, csv_round_trip, fragment_sets, fragment_compare, core_filter, tukey_fences, fragment_filters, fixed_thresholds, property_deltas,
        property_outliers, group_split, row_numbers, step_route, description_lookup, qa_records, resume_anti, infer_replay, infer_run, task3_scores, safe_round_trip, description_ladder, qa_round_trip, sql_functions, json_salvage, regex_context, fragment_scores, tanimoto_words,
        qed_prs, summary, summary_rollup, distinct_union, limit_prefix, safe_lookup, kernel_table, kernel_profile, seeded_shuffle, stream_means,
    )
}
