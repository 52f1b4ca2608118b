"""Line notation to fragments joined by dots, and back: cut bonds become ring labels that two fragments share."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import partial

from pairforge.kernel import graph as G
from pairforge.kernel import properties
from pairforge.kernel.smarts import PatternError, View, pattern


class DecodeError(ValueError):
    """A text that cannot be decoded."""


class EncodeError(ValueError):
    """A molecule that cannot be encoded."""


__all__ = ["Converter", "DecodeError", "EncodeError", "FragmentationError", "PatternError", "SLICERS", "safe_to_smiles", "smiles_to_safe"]


class FragmentationError(ValueError):
    """A molecule in which there is no bond to cut."""


Bonds = Iterable[tuple[int, int]]


def _single(g: G.Graph, bond: tuple[int, int]) -> bool:
    a, b = bond
    return g.bonds[bond] in ("", "-", "/", "\\") and not (g.bonds[bond] == "" and g.atoms[a][0].islower() and g.atoms[b][0].islower() and bond not in G.bridges(g))


def _degree(g: G.Graph) -> list[int]:
    return [len(x) for x in g.neighbours()]


def any_single(g: G.Graph) -> Bonds:
    """Any single bond outside rings."""
    return [b for b in G.bridges(g) if _single(g, b)]


def any_bond(g: G.Graph) -> Bonds:
    """Any bond outside rings."""
    return G.bridges(g)


def rotatable(g: G.Graph) -> Bonds:
    """Single bonds outside rings between inner atoms without a triple bond."""
    degree, near = _degree(g), g.neighbours()
    inner = [degree[i] > 1 and all(s != "#" for _, s in near[i]) for i in range(len(g.atoms))]
    return [b for b in G.bridges(g) if _single(g, b) and inner[b[0]] and inner[b[1]]]


def matched_pairs(g: G.Graph) -> Bonds:
    """Single bonds outside rings at a carbon that has no multiple bond to another element."""
    near = g.neighbours()
    fine = [G.element(a) in ("C", "c") and all(s not in ("=", "#") or G.element(g.atoms[j]) in ("C", "c") and s == "=" for j, s in near[i]) for i, a in enumerate(g.atoms)]
    return [b for b in G.bridges(g) if _single(g, b) and (fine[b[0]] or fine[b[1]])]


SLICERS: dict[str, Callable[[G.Graph], Bonds]] = {"brics": properties.brics, "recap": properties.recap, "hr": any_single, "rotatable": rotatable, "mmpa": matched_pairs, "attach": any_bond}


def with_hydrogens(g: G.Graph) -> G.Graph:
    """The graph with an atom for every hydrogen."""
    atoms, bonds = list(g.atoms), dict(g.bonds)
    for i, n in enumerate(View(g).hydrogens):
        if atoms[i][0] == "[" and G.element(atoms[i]) != "H":
            atoms[i] = re.sub(r"^(\[[0-9]*(?:\*|[A-Z][a-z]?|[a-z]{1,2})@*)H[0-9]*", r"\1", atoms[i])
        for _ in range(n - sum(G.element(g.atoms[j]) == "H" for j, _ in g.neighbours()[i])):
            bonds[i, len(atoms)] = ""
            atoms.append("[H]")
    return G.Graph(atoms, bonds)


def without_hydrogens(g: G.Graph) -> G.Graph:
    """The graph with its plain hydrogen atoms drawn into the atoms that hold them."""
    near = g.neighbours()
    drop = {i for i, a in enumerate(g.atoms) if a == "[H]" and len(near[i]) == 1 and G.element(g.atoms[near[i][0][0]]) != "H"}
    atoms = list(g.atoms)
    for i, a in enumerate(atoms):
        n = sum(j in drop for j, _ in near[i])
        if a[0] == "[" and n:
            m = re.match(r"(\[[0-9]*(?:\*|[A-Z][a-z]?|[a-z]{1,2})@*)(?:H([0-9]*))?(.*)", a)
            n += 0 if m[2] is None else int(m[2] or 1)
            atoms[i] = f"{m[1]}H{n if n > 1 else ''}{m[3]}"
    return G.Graph(atoms, g.bonds).without(drop)


class Converter:
    """Encoder and decoder.

    ``slicer`` is a name of SLICERS, a list of patterns of which the first two atoms are the ends of a bond to cut, or a callable from
    a graph to such bonds.  ``require_hs`` writes hydrogens as atoms of their own; the slicer ``attach`` does.
    """

    def __init__(self, slicer: str | list[str] | Callable[[G.Graph], Bonds] | None = "brics", ignore_stereo: bool = False, label_by_ring: bool = True, require_hs: bool | None = None):
        self.require_hs = require_hs if require_hs is not None else slicer == "attach"
        if isinstance(slicer, str):
            slicer = SLICERS[slicer.lower()] if slicer.lower() in SLICERS else [slicer]
        if isinstance(slicer, (list, tuple)):
            slicer = partial(properties.matched_bonds, patterns=[pattern(x).text for x in slicer])  # PatternError if one cannot be read
        self.slicer, self.ignore_stereo, self.label_by_ring = slicer, ignore_stereo, label_by_ring

    def fragment(self, g: G.Graph, allow_empty: bool = False) -> list[tuple[int, int]]:
        cuts = [b if b in g.bonds else (b[1], b[0]) for b in (self.slicer(g) if self.slicer else ())]
        if not cuts and not allow_empty:
            raise FragmentationError("there is no bond to cut")
        return sorted(set(cuts))

    @staticmethod
    def randomize(g: G.Graph, seed: int | None = None) -> G.Graph:
        """The same graph with its atoms in another order; the same order for the same seed."""
        order = list(range(len(g.atoms)))
        random.Random(seed).shuffle(order)
        new = {old: k for k, old in enumerate(order)}
        return G.Graph([g.atoms[i] for i in order], {(new[a], new[b]): s for (a, b), s in g.bonds.items()})

    def encode(self, text: str, canonical: bool = True, randomize: bool = False, seed: int | None = None, constraints: Iterable[set[int] | str] = (), allow_empty: bool = False) -> str:
        """Fragments by size, largest first, joined by dots; cut bonds lying wholly inside a constraint (a pattern, or a set of atoms by
        their place in the text) stay whole.  EncodeError for a broken text, FragmentationError without a cut."""
        if self.ignore_stereo:
            text = text.replace("@", "").replace("/", "").replace("\\", "")
        try:
            g = G.parse(text)
        except G.ParseError as x:
            raise EncodeError(str(x)) from None
        if self.require_hs:
            g = with_hydrogens(g)
        constraints = [c for x in constraints for c in ([set(m) for m in pattern(x).matches(View(g))] if isinstance(x, str) else [x])]
        if randomize:
            order = list(range(len(g.atoms)))
            random.Random(seed).shuffle(order)
        else:
            order = G.ranks(g) if canonical else list(range(len(g.atoms)))
        return self.encode_graph(g, order, constraints, allow_empty)

    def encode_graph(self, g: G.Graph, order: list[int], constraints: Iterable[set[int]] = (), allow_empty: bool = False) -> str:
        """The fragments of a graph whose atoms are written in this order."""
        constraints = list(constraints)
        cuts = [(a, b) for a, b in self.fragment(g, allow_empty) if not any(a in c and b in c for c in constraints)]
        kinds = {c: g.bonds[c] for c in cuts}
        whole = G.Graph(g.atoms, {b: s for b, s in g.bonds.items() if b not in kinds})
        parts = sorted(whole.components(), key=len, reverse=True)
        place = {i: k for k, p in enumerate(parts) for i in p}
        # Above all labels of rings: no fragment opens more of them than it has ring bonds.
        inside = Counter(place[a] for a, b in whole.bonds)
        first = 1 + max([inside[k] - len(p) + 1 for k, p in enumerate(parts)], default=0)
        extra: dict[int, list[str]] = {}
        for n, (a, b) in enumerate(sorted(cuts, key=lambda c: sorted((order[c[0]], order[c[1]]))), first):
            s = kinds[a, b] if kinds[a, b] not in ("", "-") else ""
            extra.setdefault(a, []).append(s + G.ring_text(n))
            extra.setdefault(b, []).append(s + G.ring_text(n))
        roots = [min((i for i in p if not G.is_dummy(g.atoms[i])), key=lambda i: order[i], default=p[0]) for p in parts]
        return ".".join(G.write(whole, p, order, r, extra) for p, r in zip(parts, roots))

    def ensure_valid(self, text: str) -> str:
        """The text with a partner for each ring label that stands alone: a dummy atom with the label's number, or with its place
        among all labels."""
        counts = Counter(G.ring_numbers(text))
        alone = ((n, n if self.label_by_ring else k) for k, n in enumerate(counts, 1) if counts[n] % 2)
        return text + "".join(f".[*:{name}]{G.ring_text(n)}" for n, name in alone)

    def decode(self, text: str, canonical: bool = False, fix: bool = True, remove_dummies: bool = True, ignore_errors: bool = False, remove_added_hs: bool = True, as_graph: bool = False) -> str | G.Graph | None:
        """The molecule of a fragment text, or its graph; DecodeError, or None with ``ignore_errors``, if it is broken."""
        try:
            g = G.parse(self.ensure_valid(text) if fix else text)
        except G.ParseError as x:
            if ignore_errors:
                return None
            raise DecodeError(str(x)) from None
        if remove_dummies:
            near = g.neighbours()
            g = g.without({i for i, a in enumerate(g.atoms) if G.is_dummy(a) and len(near[i]) <= 1})
        if remove_added_hs:
            g = without_hydrogens(g)
        return g if as_graph else G.canonical(g) if canonical else ".".join(G.write(g, p) for p in g.components())


def smiles_to_safe(text: str, canonical: bool = True, slicer="brics", require_hs: bool | None = None, ignore_stereo: bool = False, **options) -> str:
    return Converter(slicer, ignore_stereo, require_hs=require_hs).encode(text, canonical=canonical, **options)


def safe_to_smiles(text: str, canonical: bool = True, **options) -> str | None:
    return Converter().decode(text, canonical=canonical, **options)
