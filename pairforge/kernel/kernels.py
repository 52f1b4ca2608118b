"""Kernels that give a molecule's profile: from a table, from this package's graph, or from a chemistry library."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import combinations
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.kernel import graph as G
from pairforge.kernel.properties import descriptors
from pairforge.kernel.safe import Converter
from pairforge.schema import MOL_PROFILE

FP_BITS, RADIUS = 1024, 2


class MolKernel(Protocol):
    """``profile`` maps a frame with ``smiles`` to one MOL_PROFILE row per distinct, non-null molecule."""

    def profile(self, molecules: DataFrame) -> DataFrame: ...


def distinct_molecules(*columns: tuple[DataFrame, str]) -> DataFrame:
    """The distinct non-null molecules of several columns, so that a kernel sees each once."""
    out = None
    for df, c in columns:
        part = df.select(F.col(c).alias("smiles"))
        out = part if out is None else out.union(part)
    return out.where("smiles IS NOT NULL").distinct()


class TableKernel:
    """Profiles computed beforehand, joined by molecule.  Missing columns are null."""

    def __init__(self, table: DataFrame):
        self.table = table

    def profile(self, molecules: DataFrame) -> DataFrame:
        keys = molecules.select("smiles").where("smiles IS NOT NULL").distinct()
        have = {f.name for f in self.table.schema}
        cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in MOL_PROFILE if f.name != "smiles"]
        return keys.join(self.table.select("smiles", *cols).dropDuplicates(["smiles"]), "smiles", "left")


@lru_cache(1 << 16)
def _code(text: str) -> int:
    """63 bits that stand for a symbol, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1


def _words(values: Iterable[int], bits: int) -> list[int]:
    words = [0] * (bits // 64)
    for x in values:
        words[x % bits // 64] |= 1 << (x % 64)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def fingerprint(g: G.Graph, radius: int = RADIUS, bits: int = FP_BITS) -> list[int]:
    """Hashed circular neighbourhoods of every atom up to ``radius`` bonds, as 64-bit words (signed)."""
    near = [[(_code(s), j) for j, s in x] for x in g.neighbours()]
    # Hashes of tuples of integers are the same in every process.
    ident = [hash((_code(a), len(x))) for a, x in zip(g.atoms, near)]
    seen = set(ident)
    for _ in range(radius):
        ident = [hash((ident[i], *sorted((s, ident[j]) for s, j in x))) for i, x in enumerate(near)]
        seen.update(ident)
    return _words(seen, bits)


def path_fingerprint(g: G.Graph, longest: int = 7, bits: int = 2048) -> list[int]:
    """Hashed paths of 1 to ``longest`` bonds, read from either end."""
    near, code = [[(_code(s or "-"), j) for j, s in x] for x in g.neighbours()], [_code(a) for a in g.atoms]
    seen: set[int] = set()
    for start in range(len(code)):
        todo = [((start,), (code[start],), (code[start],))]
        for _ in range(longest):
            longer = []
            for atoms, there, back in todo:
                for s, j in near[atoms[-1]]:
                    if j not in atoms:
                        longer.append(((*atoms, j), (*there, s, code[j]), (code[j], s, *back)))
            seen.update(hash(min(there, back)) for _, there, back in longer)
            todo = longer
    return _words(seen, bits)


def key_fingerprint(g: G.Graph, bits: int = 192) -> list[int]:
    """Structural keys, made by rule: elements, bonds and pairs of bonds that occur once, twice, or four times; rings by size."""
    near, names = g.neighbours(), [G.element(a) for a in g.atoms]
    flat = G.bridges(g)
    counts = Counter(names)
    counts.update(f"{min(x, y)}{s or '-'}{max(x, y)}" for (a, b), s in g.bonds.items() for x, y in [(names[a], names[b])])
    counts.update("".join(sorted((s or "-") + names[j] for j, s in pair)) + names[i] for i, x in enumerate(near) for pair in combinations(x, 2))
    counts.update("ring" if b not in flat else "chain" for b in g.bonds)
    counts.update(f"charge{a[-2]}" for a in g.atoms if a[0] == "[" and a[-2] in "+-")
    counts["parts"] = len(g.components())
    counts["rings"] = len(g.bonds) - len(g.atoms) + counts["parts"]
    return _words((hash((_code(k), n)) for k, v in counts.items() for n in (1, 2, 4) if v >= n), bits)


class GraphKernel:
    """Profiles from this package's own graph, in batches on the executors.  A text that is no molecule has null fields;
    a molecule without a bond to cut has the empty SAFE text; one without rings has the empty scaffold and no
    scaffold fingerprint.  Values are this kernel's own: compare them only with each other.

    ``columns`` names what is worked out; the other fields are null.  A text is parsed and ranked once for all of them.
    """

    def __init__(self, slicer="brics", columns: Iterable[str] | None = None):
        self.slicer, self.columns = slicer, set(columns or [n for n in MOL_PROFILE.fieldNames() if n not in ("path_fp", "keys_fp")])

    def profile(self, molecules: DataFrame) -> DataFrame:
        wanted, converter = self.columns, Converter(self.slicer)

        def one(text: str) -> dict:
            out = {"smiles": text}
            try:
                g = G.parse(text.strip())
            except G.ParseError:
                return out
            order = G.ranks(g) if wanted & {"canonical", "safe"} else None
            if "canonical" in wanted:
                out["canonical"] = G.canonical(g, order)
            if "safe" in wanted:
                try:
                    out["safe"] = converter.encode_graph(g, order)
                except ValueError:
                    out["safe"] = ""
            if wanted & {"scaffold", "scaffold_fp"}:
                core = G.scaffold(g)
                if "scaffold" in wanted:
                    out["scaffold"] = G.canonical(core) if core.atoms else ""
                if "scaffold_fp" in wanted:
                    out["scaffold_fp"] = fingerprint(core) if core.atoms else None
            for name, make in (("fp", fingerprint), ("path_fp", path_fingerprint), ("keys_fp", key_fingerprint), ("props", descriptors)):
                if name in wanted:
                    out[name] = make(g)
            return out

        return _profiled(molecules, one)


def _profiled(molecules: DataFrame, one) -> DataFrame:
    def run(parts):
        names = MOL_PROFILE.fieldNames()
        for pdf in parts:
            yield pd.DataFrame([{n: None for n in names} | one(x) for x in pdf["smiles"]], columns=names)

    return spread(molecules.select("smiles").where("smiles IS NOT NULL").distinct()).mapInPandas(run, MOL_PROFILE)


def spread(rows: DataFrame) -> DataFrame:
    """Small rows that are slow to work on, over four tasks per core: by their size alone they would be merged into a few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


class RdkitKernel:
    """Profiles from the chemistry library RDKit, if it is installed."""

    def __init__(self):
        import rdkit  # noqa: F401

    def profile(self, molecules: DataFrame) -> DataFrame:
        def one(text: str) -> dict:
            from rdkit import Chem
            from rdkit.Chem import BRICS, Crippen, Descriptors, Lipinski, MACCSkeys, rdFingerprintGenerator, rdMolDescriptors
            from rdkit.Chem.Scaffolds import MurckoScaffold

            mol = Chem.MolFromSmiles(text)
            if mol is None:
                return {"smiles": text}
            gen = rdFingerprintGenerator.GetMorganGenerator(radius=RADIUS, fpSize=FP_BITS)

            def words(bits):
                return _words(bits.GetOnBits(), -(-bits.GetNumBits() // 64) * 64)

            canon = Chem.MolToSmiles(mol)
            core = MurckoScaffold.GetScaffoldForMol(mol)
            cut = [tuple(p) for p, _ in BRICS.FindBRICSBonds(Chem.MolFromSmiles(canon))]
            try:
                safe = Converter(lambda g: [b for b in G.bridges(g) if b in cut or b[::-1] in cut]).encode(canon)
            except ValueError:
                safe = ""
            props = {"MW": Descriptors.ExactMolWt(mol), "logP": Crippen.MolLogP(mol), "TPSA": rdMolDescriptors.CalcTPSA(mol), "HBD": float(Lipinski.NumHDonors(mol)), "HBA": float(Lipinski.NumHAcceptors(mol)), "RotB": float(Lipinski.NumRotatableBonds(mol))}
            return {"smiles": text, "canonical": canon, "safe": safe, "scaffold": Chem.MolToSmiles(core), "fp": words(gen.GetFingerprint(mol)), "scaffold_fp": words(gen.GetFingerprint(core)) if core.GetNumHeavyAtoms() else None, "path_fp": words(Chem.RDKFingerprint(mol)), "keys_fp": words(MACCSkeys.GenMACCSKeys(mol)), "props": props}

        return _profiled(molecules, one)


@F.pandas_udf(T.DoubleType())
def safe_validity(texts: pd.Series) -> pd.Series:
    decode = Converter().decode
    return texts.map(lambda x: float(bool(x and x.strip() and decode(x.strip(), ignore_errors=True)))).astype(float)


def register(spark) -> None:
    """SQL functions ``smiles_to_safe``, ``safe_to_smiles`` and ``canonical_smiles`` (null where a text is broken), and
    ``safe_validity``: 1 if a SAFE text can be decoded to a molecule, else 0."""

    def series(f):
        def safe(x):
            try:
                return None if x is None else f(x)
            except ValueError:
                return None

        @F.pandas_udf(T.StringType())
        def udf(s: pd.Series) -> pd.Series:
            return s.map(safe)

        return udf

    spark.udf.register("smiles_to_safe", series(lambda x: Converter().encode(x)))
    spark.udf.register("safe_to_smiles", series(lambda x: Converter().decode(x, canonical=True)))
    spark.udf.register("safe_validity", safe_validity)
    spark.udf.register("canonical_smiles", series(lambda x: G.canonical(G.parse(x))))


