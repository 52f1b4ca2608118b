"""The first stage as a whole: from molecules to filtered pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pairforge.kernel.kernels import MolKernel, distinct_molecules
from pairforge.operators import fences, fragments, pairing
from pairforge.schema import PROPERTIES
from pairforge.storage import materialize, release


def toxicity_cliffs(
    molecules: DataFrame, kernel: Callable[..., MolKernel], compat: bool = False, use_iqr: bool = True, too_long: int = fences.TOO_LONG, max_count: int = fences.MAX_COUNT, drop_outliers: bool = True
) -> DataFrame:
    """The columns of CLIFFS of every pair that passes the filters.

    ``kernel`` makes a kernel for the fields named.  Each field is worked out once per molecule and as late as can be: fingerprints for all,
    fragments for the molecules of pairs, properties for those of the pairs that the fragment filters leave.
    """
    prints = materialize(kernel("fp", "scaffold_fp").profile(molecules), "prints")
    pairs = materialize(pairing.pair_molecules(molecules.join(prints.select("smiles", "fp", "scaffold_fp"), "smiles", "left"), compat), "pairs")
    release(prints)
    profile = materialize(kernel("canonical", "safe").profile(distinct_molecules((pairs, "toxic_smiles"), (pairs, "nontoxic_smiles"))), "profile")
    compared = materialize(fragments.compare_fragments(fragments.attach_safe(pairs, profile)), "compared")
    kept = materialize(fences.fragment_filters(compared, use_iqr, too_long, max_count), "kept")
    release(pairs, compared)
    if drop_outliers:
        props = kernel("props").profile(distinct_molecules((kept, "toxic_smiles"), (kept, "nontoxic_smiles")))
        kept = fences.drop_outliers(materialize(fences.property_deltas(kept, props), "deltas"), [f"delta_abs_{p}" for p in PROPERTIES])
    return fragments.for_export(kept, profile)
