"""Substructure patterns over this package's graph: enough of SMARTS for slicing rules, property rules and constraints.

Atoms: symbols, ``*``, ``A``, ``a``, ``#n``, ``D``, ``H``, ``h``, ``X``, ``v``, ``R``, ``r``, ``x``, charges, ``$(...)``, with ``!``, ``&``, ``,`` and ``;``.  Bonds:
``- = # : ~ @ / \\`` with the same operators.  Chirality and isotopes are read and match anything.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pairforge.kernel import graph as G

# Atomic numbers and usual valences.
NUMBER = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Mg": 12, "Al": 13, "Si": 14, "P": 15, "S": 16, "Cl": 17, "K": 19, "Ca": 20, "Fe": 26, "Zn": 30, "As": 33, "Se": 34, "Br": 35, "I": 53, "*": 0}
VALENCES = {"B": (3,), "C": (4,), "N": (3,), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
_CHARGE = re.compile(r"(\++|-+)(\d*)(?::\d+)?\]$")
_HYDROGENS = re.compile(r"^\[\d*(?:\*|[A-Z][a-z]?|[a-z]{1,2})@*(?:H(\d*))?")


class PatternError(ValueError):
    """A pattern that cannot be read."""


class View:
    """What patterns ask about a graph, worked out once."""

    def __init__(self, g: G.Graph):
        self.g, self.near, flat = g, g.neighbours(), G.bridges(g)
        self.symbol = [G.element(a).capitalize() for a in g.atoms]
        self.number = [NUMBER.get(s, -1) for s in self.symbol]
        self.aromatic = [G.element(a).islower() for a in g.atoms]
        self.order: dict[tuple[int, int], float] = {}
        self.ring_bond: dict[tuple[int, int], bool] = {}
        for (a, b), s in g.bonds.items():
            ring = (a, b) not in flat
            plain = 1.5 if s == ":" or (s == "" and ring and self.aromatic[a] and self.aromatic[b]) else {"=": 2, "#": 3}.get(s, 1)
            self.order[a, b] = self.order[b, a] = plain
            self.ring_bond[a, b] = self.ring_bond[b, a] = ring
        self.degree = [len(x) for x in self.near]
        self.rings = [sum(self.ring_bond[i, j] for j, _ in x) for i, x in enumerate(self.near)]
        self.charge = [self._charge(a) for a in g.atoms]
        self.hydrogens = [self._hydrogens(i) for i in range(len(g.atoms))]
        self.known: dict[tuple[int, int], bool] = {}
        self._sizes: dict[int, frozenset[int]] = {}  # the view's own, so that it goes with its molecule

    @staticmethod
    def _charge(atom: str) -> int:
        m = _CHARGE.search(atom) if atom[0] == "[" else None
        return 0 if not m else (1 if m[1][0] == "+" else -1) * (int(m[2]) if m[2] else len(m[1]))

    def used(self, i: int) -> int:
        """Valence taken by bonds; an aromatic atom gives one more to its ring."""
        orders = [self.order[i, j] for j, _ in self.near[i]]
        return int(sum(1 if o == 1.5 else o for o in orders)) + (1.5 in orders and self.aromatic[i])

    def _hydrogens(self, i: int) -> int:
        atom = self.g.atoms[i]
        bare = sum(1 for j, _ in self.near[i] if self.symbol[j] == "H")
        if atom[0] == "[":
            m = _HYDROGENS.match(atom)
            return bare + (0 if not m or m[1] is None else int(m[1] or 1))
        used = self.used(i)
        return bare + max(0, next((v for v in VALENCES.get(self.symbol[i], ()) if v >= used), used) - used)

    def ring_sizes(self, i: int) -> frozenset[int]:
        """The size of the smallest ring through each pair of ring bonds of an atom."""
        if i not in self._sizes:
            self._sizes[i] = self._ring_sizes(i)
        return self._sizes[i]

    def _ring_sizes(self, i: int) -> frozenset[int]:
        out, ring_near = set(), lambda a: [j for j, _ in self.near[a] if self.ring_bond[a, j]]
        ends = ring_near(i)
        for k, a in enumerate(ends):
            far, layer, size, seen = set(ends[k + 1 :]), {a}, 2, {i, a}
            while far and layer:
                layer = {j for x in layer for j in ring_near(x)} - seen
                seen |= layer
                size += 1
                if layer & far:
                    out.add(size)
                    far -= layer
        return frozenset(out)


Atom = Callable[[View, int], bool]
Bond = Callable[[View, int, int], bool]


def _atom_primitive(text: str, at: int) -> tuple[Atom, int]:
    c = text[at]
    if text.startswith("$(", at):
        depth, end = 1, at + 2
        while depth:
            if end >= len(text):
                raise PatternError(f"open bracket in {text!r}")
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = Pattern(text[at + 2 : end - 1])

        def recursive(v: View, i: int) -> bool:
            key = (id(inner), i)
            if key not in v.known:
                v.known[key] = inner.any_at(v, i)
            return v.known[key]

        return recursive, end
    m = re.compile(r"#(\d+)").match(text, at)
    if m:
        return (lambda v, i, n=int(m[1]): v.number[i] == n), m.end()
    m = re.compile(r"(\++|-+)(\d*)").match(text, at)
    if m:
        n = (1 if m[1][0] == "+" else -1) * (int(m[2]) if m[2] else len(m[1]))
        return (lambda v, i: v.charge[i] == n), m.end()
    m = re.compile(r"([DHhXvRrx])(\d*)(?![a-z])").match(text, at)
    if m and not (m[1] == "H" and text.strip("[]") == "H"):
        n = int(m[2]) if m[2] else None
        one = 1 if n is None else n
        test = {
            "D": lambda v, i: v.degree[i] == one, "H": lambda v, i: v.hydrogens[i] == one, "h": lambda v, i: v.hydrogens[i] == one if n is not None else v.hydrogens[i] > 0,
            "X": lambda v, i: v.degree[i] + v.hydrogens[i] - sum(v.symbol[j] == "H" for j, _ in v.near[i]) == one, "v": lambda v, i: v.used(i) + v.hydrogens[i] - sum(v.symbol[j] == "H" for j, _ in v.near[i]) == one,
            "R": lambda v, i: v.rings[i] > 0 if n is None else (v.rings[i] == 0 if n == 0 else v.rings[i] > 0 and max(1, v.rings[i] - 1) == n),
            "r": lambda v, i: v.rings[i] > 0 if n is None else (v.rings[i] == 0 if n == 0 else min(v.ring_sizes(i), default=0) == n),
            "x": lambda v, i: v.rings[i] > 0 if n is None else v.rings[i] == n,
        }[m[1]]
        return test, m.end()
    m = re.compile(r"@+|:\d+|\d+").match(text, at)
    if m:
        return (lambda v, i: True), m.end()
    m = re.compile(r"Cl|Br|Si|Se|Na|Mg|Al|Ca|Fe|Zn|As|se|as|[HBCNOFPSIKbcnops]").match(text, at)
    if m:
        number, lower = NUMBER[m[0].capitalize()], m[0].islower()
        return (lambda v, i: v.number[i] == number and v.aromatic[i] == lower), m.end()
    if c in "*Aa":
        return {"*": lambda v, i: True, "A": lambda v, i: not v.aromatic[i], "a": lambda v, i: v.aromatic[i]}[c], at + 1
    raise PatternError(f"unknown atom {text[at:]!r}")


def _bond_primitive(text: str, at: int) -> tuple[Bond, int]:
    order = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, ":": 1.5}
    c = text[at]
    if c in order:
        return (lambda v, a, b, n=order[c]: v.order[a, b] == n), at + 1
    if c in "~@":
        return (lambda v, a, b: True) if c == "~" else (lambda v, a, b: v.ring_bond[a, b]), at + 1
    raise PatternError(f"unknown bond {text[at:]!r}")


def _expression(text: str, primitive) -> Callable[..., bool]:
    """``!`` before ``&`` (or nothing) before ``,`` before ``;``."""
    lows, ors, ands, at = [], [], [], 0
    while at < len(text):
        if text[at] in "&,;":
            if text[at] != "&":
                ors, ands = [*ors, ands], []
            if text[at] == ";":
                lows, ors = [*lows, ors], []
            at += 1
            continue
        negate = False
        while text[at] == "!":
            negate, at = not negate, at + 1
        test, at = primitive(text, at)
        ands.append((lambda *x, t=test: not t(*x)) if negate else test)
    lows.append([*ors, ands])
    if any(not a for o in lows for a in o):
        raise PatternError(f"empty condition in {text!r}")
    if len(lows) == len(lows[0]) == len(lows[0][0]) == 1:
        return lows[0][0][0]
    if all(len(o) == 1 for o in lows):
        tests = [t for o in lows for t in o[0]]
        if len(tests) == 2:
            first, second = tests
            return lambda *x: first(*x) and second(*x)
        return lambda *x: all(t(*x) for t in tests)
    return lambda *x: all(any(all(t(*x) for t in a) for a in o) for o in lows)


def _default_bond(v: View, a: int, b: int) -> bool:
    return v.order[a, b] in (1, 1.5)


class Pattern:
    """A pattern; ``matches`` gives the atoms of each place it is found at, in the order of the pattern."""

    def __init__(self, text: str):
        self.text = text
        self.atoms: list[Atom] = []
        #: Per atom the earlier atoms it is bound to, and how; the first of them is where the search goes on from.
        self.bonds: list[list[tuple[int, Bond]]] = []
        prev, bond, stack, rings, at = None, "", [], {}, 0
        while at < len(text):
            c = text[at]
            if c == "(":
                stack.append(prev)
                at += 1
            elif c == ")":
                prev, at = stack.pop(), at + 1
            elif c in "-=#:~@/\\!&,;":
                bond, at = bond + c, at + 1
            elif c.isdigit() or c == "%":
                n, at = (text[at + 1 : at + 3], at + 3) if c == "%" else (c, at + 1)
                if n in rings:
                    other, its = rings.pop(n)
                    self.bonds[prev].append((other, self._bond(bond or its)))
                else:
                    rings[n] = (prev, bond)
                bond = ""
            else:
                if c == "[":
                    depth, end = 1, at + 1
                    while depth:
                        if end >= len(text):
                            raise PatternError(f"open bracket in {text!r}")
                        depth += {"[": 1, "]": -1}.get(text[end], 0)
                        end += 1
                    inner, at = text[at + 1 : end - 1], end
                    # A lone H is an atom, not a count.
                    test = (lambda v, i: v.number[i] == 1) if inner == "H" else _expression(inner, _atom_primitive)
                else:
                    test, at = _atom_primitive(text, at)
                self.atoms.append(test)
                self.bonds.append([] if prev is None else [(prev, self._bond(bond))])
                prev, bond = len(self.atoms) - 1, ""
        if stack or rings or bond or not self.atoms:
            raise PatternError(f"open branch, ring or bond in {text!r}")

    @staticmethod
    def _bond(text: str) -> Bond:
        return _expression(text, _bond_primitive) if text else _default_bond

    def at(self, v: View, start: int) -> Iterator[tuple[int, ...]]:
        """The places where the first atom of the pattern is ``start``."""
        if not self.atoms[0](v, start):
            return
        todo = [(start,)]
        while todo:
            found = todo.pop()
            k = len(found)
            if k == len(self.atoms):
                yield found
                continue
            (anchor, bond), *closing = self.bonds[k]
            a = found[anchor]
            for j, _ in reversed(v.near[a]):
                if j not in found and bond(v, a, j) and self.atoms[k](v, j) and all((j, found[o]) in v.order and b(v, j, found[o]) for o, b in closing):
                    todo.append((*found, j))

    def matches(self, v: View) -> Iterator[tuple[int, ...]]:
        for i in range(len(v.near)):
            yield from self.at(v, i)

    def any_at(self, v: View, i: int) -> bool:
        if len(self.atoms) == 1:
            return self.atoms[0](v, i)
        return next(self.at(v, i), None) is not None


@lru_cache(4096)
def pattern(text: str) -> Pattern:
    return Pattern(text)
