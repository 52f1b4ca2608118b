"""Descriptions of endpoints and datasets: a small dimension, looked up with precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys under which descriptions are looked up.
ASSAYS = ["NR-AR", "NR-AR-LBD", "NR-AhR", "NR-Aromatase", "NR-ER", "NR-ER-LBD", "NR-PPAR-gamma", "SR-ARE", "SR-ATAD5", "SR-HSE", "SR-MMP", "SR-p53"]
ORGAN_CLASSES = [
    "Blood and lymphatic system disorders", "Cardiac disorders", "Congenital, familial and genetic disorders", "Ear and labyrinth disorders", "Eye disorders",
    "General disorders and administration site conditions", "Hepatobiliary disorders", "Immune system disorders", "Infections and infestations",
    "Injury, poisoning and procedural complications", "Investigations", "Metabolism and nutrition disorders", "Musculoskeletal and connective tissue disorders",
    "Neoplasms benign, malignant and unspecified (incl cysts and polyps)", "Nervous system disorders", "Pregnancy, puerperium and perinatal conditions", "Product issues",
    "Psychiatric disorders", "Renal and urinary disorders", "Reproductive system and breast disorders", "Respiratory, thoracic and mediastinal disorders",
    "Skin and subcutaneous tissue disorders", "Social circumstances", "Surgical and medical procedures", "Vascular disorders",
]
ENDPOINTS = ["herg_unified", "ames", "clintox", "dilist", "cyp1a2_veith", "cyp2c19_veith", "cyp2c9_veith", "cyp2d6_veith", "cyp3a4_veith"]
DATASETS = ["dilist", "dictrank", "diril", "ames", "herg_karim", "herg", "herg_inhib", "herg_unified", "skin_reaction", "carcinogens_lagunin", "clintox"]
ASSAY_SETS, ORGAN_SETS, ENZYME_SETS = ["tox21"], ["sider_train", "sider_test", "sider"], ["metabolism"]

# Our own wording.
_TOPIC = {
    "herg": "blocks the cardiac potassium channel encoded by the hERG gene", "ames": "causes mutations in the bacterial reverse mutation assay", "clintox": "failed in clinical trials because of toxicity",
    "dilist": "was linked to liver injury caused by drugs", "dictrank": "was linked to heart injury caused by drugs", "diril": "was linked to kidney injury caused by drugs",
    "skin_reaction": "sensitises skin", "carcinogens_lagunin": "causes tumours", "metabolism": "inhibits an enzyme that breaks down drugs",
}


def _topic(key: str) -> str:
    stem = "herg" if key.startswith("herg") else key
    if stem.startswith("cyp"):
        return f"inhibits the enzyme {stem.split('_')[0].upper()}"
    return _TOPIC[stem]


def text_of(scope: str, key: str) -> str:
    """The text of a known assay, organ class, endpoint or dataset."""
    said = {"assay": f"is active in the assay {key} of the stress response and nuclear receptor panel", "organ": f"has side effects of the class: {key}"}
    return f"The toxic molecule of each pair {said.get(scope) or _topic(key)}."


def dimension(spark: SparkSession) -> DataFrame:
    """``scope``, ``key``, ``text``: what each key stands for.  Fixed size."""
    keys = {"assay": ASSAYS, "organ": ORGAN_CLASSES, "endpoint": ENDPOINTS, "dataset": [*DATASETS, *ENZYME_SETS]}
    rows = [(scope, k, text_of(scope, k)) for scope, names in keys.items() for k in names] + [("organ_lower", o.lower(), "") for o in ORGAN_CLASSES]
    return spark.createDataFrame(rows, "scope string, key string, text string")


ORGAN_CLASS = "The toxic molecule of each pair has side effects of the class "
GENERIC_ASSAY = "The toxic molecule of each pair is active in an assay of the stress response and nuclear receptor panel."
GENERIC_ORGAN = "The toxic molecule of each pair has side effects recorded after approval."


def with_description(df: DataFrame, dims: DataFrame, out: str = "description") -> DataFrame:
    """``df`` with the description of ``dataset_name`` and ``endpoint``: the first rung that holds.

    Empty keys; an endpoint with the assay prefix (its key is case-sensitive, else a generic text); an organ class (found
    in any case, its text only in its own case, else a sentence with the endpoint); a known endpoint; a known dataset;
    the assay panel and the side-effect register, which resolve any endpoint.  Null if nothing holds.
    """
    ep, ds = F.coalesce("endpoint", F.lit("")), F.coalesce("dataset_name", F.lit(""))
    part = lambda scope, name: F.broadcast(dims.where(F.col("scope") == scope).select(F.col("key").alias(f"__k_{name}"), F.col("text").alias(f"__t_{name}")))

    def look(frame: DataFrame, scope: str, name: str, key: Column) -> DataFrame:
        return frame.join(part(scope, name), key == F.col(f"__k_{name}"), "left")

    bare = F.replace(ep, F.lit("tox21_"), F.lit(""))
    out_df = df
    for scope, name, key in (("assay", "pre", bare), ("assay", "raw", ep), ("organ", "organ", ep), ("organ_lower", "low", F.lower(ep)), ("endpoint", "ep", F.lower(ep)), ("dataset", "ds", F.lower(ds))):
        out_df = look(out_df, scope, name, key)
    organ_text = F.coalesce("__t_organ", F.concat(F.lit(ORGAN_CLASS), ep, F.lit(".")))
    dsl = F.lower(ds)
    text = (
        F.when((ep == "") & (ds == ""), F.lit(""))
        .when(F.startswith(F.lower(ep), F.lit("tox21_")), F.coalesce("__t_pre", F.lit(GENERIC_ASSAY)))
        .when(F.col("__k_low").isNotNull(), organ_text)
        .when(F.col("__t_ep").isNotNull(), F.col("__t_ep"))
        .when(F.col("__t_ds").isNotNull(), F.col("__t_ds"))
        .when(dsl.isin(ASSAY_SETS), F.coalesce("__t_raw", F.lit(GENERIC_ASSAY)))
        .when(dsl.isin(ORGAN_SETS), F.when(ep == "", GENERIC_ORGAN).otherwise(organ_text))
    )
    return out_df.withColumn(out, text).drop(*[f"__{x}_{n}" for n in ("pre", "raw", "organ", "low", "ep", "ds") for x in ("k", "t")])


def note_of(rows: DataFrame, notes: DataFrame, keys: tuple[str, str] = ("dataset_name", "endpoint"), out: str = "description") -> DataFrame:
    """The same precedence over a delivered table of notes: the note of dataset and endpoint, else the one that holds for
    the whole dataset (null endpoint), else null.  Several notes of a key: the least text."""
    d, e = keys
    exact = notes.where("endpoint IS NOT NULL").groupBy(F.col("dataset_name").alias("__d"), F.col("endpoint").alias("__e")).agg(F.min("description").alias("__exact"))
    whole = notes.where("endpoint IS NULL").groupBy(F.col("dataset_name").alias("__w")).agg(F.min("description").alias("__whole"))
    joined = rows.join(exact, (F.col(d) == F.col("__d")) & (F.col(e) == F.col("__e")), "left").join(whole, F.col(d) == F.col("__w"), "left")
    return joined.withColumn(out, F.coalesce("__exact", "__whole")).drop("__d", "__e", "__w", "__exact", "__whole")
