"""A small molecular graph: reads and writes line notation without a chemistry library.

It knows atoms, bonds, rings and branches, not aromaticity models or stereochemistry: stereo marks are carried as written.
Its canonical form is this kernel's own, from refined neighbourhood ranks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"(?P<atom>\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops*])|(?P<bond>[-=#:/\\])|(?P<ring>%\([0-9]+\)|%[0-9][0-9]|[0-9])|(?P<other>[().])")
_ELEMENT = re.compile(r"\[[0-9]*(?P<el>\*|[A-Z][a-z]?|[bcnops]|se|as)(?P<chi>@*)(?:H(?P<h>[0-9]*))?")


class ParseError(ValueError):
    pass


@dataclass
class Graph:
    atoms: list[str] = field(default_factory=list)
    bonds: dict[tuple[int, int], str] = field(default_factory=dict)
    _near: tuple | None = field(default=None, compare=False, repr=False)

    def neighbours(self) -> list[list[tuple[int, str]]]:
        """Per atom its neighbours and the bonds to them; kept until atoms or bonds are added."""
        size = (len(self.atoms), len(self.bonds))
        if self._near is None or self._near[0] != size:
            out: list[list[tuple[int, str]]] = [[] for _ in self.atoms]
            for (a, b), s in self.bonds.items():
                out[a].append((b, s))
                out[b].append((a, s))
            self._near = size, out
        return self._near[1]

    def without(self, drop: set[int]) -> Graph:
        keep = [i for i in range(len(self.atoms)) if i not in drop]
        new = {old: k for k, old in enumerate(keep)}
        return Graph([self.atoms[i] for i in keep], {(new[a], new[b]): s for (a, b), s in self.bonds.items() if a in new and b in new})

    def components(self) -> list[list[int]]:
        near, seen, out = self.neighbours(), set(), []
        for start in range(len(self.atoms)):
            if start in seen:
                continue
            seen.add(start)
            part = [start]
            for i in part:
                for j, _ in near[i]:
                    if j not in seen:
                        seen.add(j)
                        part.append(j)
            out.append(part)
        return out


def element(atom: str) -> str:
    m = _ELEMENT.match(atom) if atom[0] == "[" else None
    return m["el"] if m else atom


def is_dummy(atom: str) -> bool:
    return element(atom) == "*"


def ring_number(text: str) -> int:
    return int(text.strip("%()"))


def ring_text(n: int) -> str:
    return str(n) if n < 10 else f"%{n}" if n < 100 else f"%({n})"


def ring_numbers(text: str) -> list[int]:
    """Ring labels in order of appearance, those inside bracket atoms left out."""
    return [ring_number(x) for x in re.findall(r"%\([0-9]+\)|%[0-9][0-9]|[0-9]", re.sub(r"\[[^\]]*\]", "", text))]


def parse(text: str) -> Graph:
    """The graph of a text; ParseError if it is empty or not well formed."""
    g, at, prev, bond, stack, open_rings = Graph(), 0, None, "", [], {}
    if not text:
        raise ParseError("empty text")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unknown symbol at {at}")
        at = m.end()
        if m["atom"]:
            if m["atom"][0] == "[" and not _ELEMENT.match(m["atom"]):
                raise ParseError(f"unknown atom {m['atom']}")
            g.atoms.append(m["atom"])
            i = len(g.atoms) - 1
            if prev is not None:
                g.bonds[prev, i] = bond
            elif bond:
                raise ParseError("bond without an atom before it")
            prev, bond = i, ""
        elif m["bond"]:
            if bond:
                raise ParseError("two bonds in a row")
            bond = m["bond"]
        elif m["ring"]:
            if prev is None:
                raise ParseError("ring label without an atom")
            n = ring_number(m["ring"])
            if n in open_rings:
                other, its = open_rings.pop(n)
                if other == prev or (other, prev) in g.bonds or (prev, other) in g.bonds:
                    raise ParseError("ring bond repeats a bond")
                g.bonds[other, prev] = bond or its
            else:
                open_rings[n] = (prev, bond)
            bond = ""
        elif m["other"] == "(":
            if prev is None:
                raise ParseError("branch without an atom")
            stack.append(prev)
        elif m["other"] == ")":
            if not stack or bond:
                raise ParseError("branch not open, or ends with a bond")
            prev = stack.pop()
        else:
            if bond:
                raise ParseError("bond before a dot")
            prev = None
    if stack or open_rings or bond:
        raise ParseError("open branch, ring or bond")
    return g


def bridges(g: Graph) -> set[tuple[int, int]]:
    """Bonds that lie in no ring."""
    near = g.neighbours()
    depth: dict[int, int] = {}
    low: dict[int, int] = {}
    out = set()
    for root in range(len(g.atoms)):
        if root in depth:
            continue
        depth[root] = low[root] = 0
        todo = [(root, -1, iter(near[root]))]
        while todo:
            i, parent, it = todo[-1]
            step = next(it, None)
            if step is None:
                todo.pop()
                if todo:
                    p = todo[-1][0]
                    low[p] = min(low[p], low[i])
                    if low[i] > depth[p]:
                        out.add((p, i) if (p, i) in g.bonds else (i, p))
                continue
            j = step[0]
            if j == parent:
                continue
            if j in depth:
                low[i] = min(low[i], depth[j])
            else:
                depth[j] = low[j] = depth[i] + 1
                todo.append((j, i, iter(near[j])))
    return out


def ranks(g: Graph) -> list[int]:
    """A rank per atom from its symbol and, round by round, its neighbours'; ties are broken one at a time."""
    near = g.neighbours()

    def dense(keys: list) -> list[int]:
        order = {k: i for i, k in enumerate(sorted(set(keys)))}
        return [order[k] for k in keys]

    rank = dense([(a, len(near[i])) for i, a in enumerate(g.atoms)])
    while True:
        while True:
            new = dense([(rank[i], tuple(sorted((s, rank[j]) for j, s in near[i]))) for i in range(len(g.atoms))])
            if len(set(new)) == len(set(rank)):
                break
            rank = new
        if len(set(rank)) == len(rank):
            return rank
        tied = next(r for r in sorted(rank) if rank.count(r) > 1)
        chosen = rank.index(tied)
        rank = dense([(r, 0 if i == chosen else 1) for i, r in enumerate(rank)])


def write(g: Graph, part: list[int] | None = None, order: list[int] | None = None, root: int | None = None, extra: dict[int, list[str]] | None = None, first_ring: int = 1) -> str:
    """One connected part as text, depth first by ``order``; ``extra`` holds labels to put behind atoms."""
    near, order, extra = g.neighbours(), order or range(len(g.atoms)), extra or {}
    part = part if part is not None else list(range(len(g.atoms)))
    root = root if root is not None else min(part, key=lambda i: order[i])
    children: dict[int, list[tuple[int, str]]] = {}
    closures: dict[int, list[tuple[int, int, str]]] = {}
    parent, state, seq = {root: -1}, {}, []
    todo = [(root, iter(sorted(near[root], key=lambda x: order[x[0]])))]
    state[root] = 1
    seq.append(root)
    while todo:
        i, it = todo[-1]
        step = next(it, None)
        if step is None:
            state[i] = 2
            todo.pop()
            continue
        j, s = step
        if j == parent[i]:
            continue
        if j not in state:
            parent[j], state[j] = i, 1
            seq.append(j)
            children.setdefault(i, []).append((j, s))
            todo.append((j, iter(sorted(near[j], key=lambda x: order[x[0]]))))
        elif state[j] == 1:  # a bond back to an open ancestor closes a ring
            closures.setdefault(j, []).append((j, i, s))
            closures.setdefault(i, []).append((j, i, s))
    number, free, top = {}, [], first_ring
    labels: dict[int, list[str]] = {}
    for i in seq:
        ending = [c for c in closures.get(i, []) if c[1] == i]
        opening = [c for c in closures.get(i, []) if c[0] == i]
        labels[i] = []
        for a, b, s in ending:
            labels[i].append(s + ring_text(number[a, b]))
        for a, b, _ in opening:
            n = free.pop(0) if free else top
            top = max(top, n + 1)
            number[a, b] = n
            labels[i].append(ring_text(n))
        free = sorted(free + [number[a, b] for a, b, _ in ending])
    out: list[str] = []
    stack: list = [(root, "")]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        i, s = x
        out.append(s + g.atoms[i] + "".join(labels[i]) + "".join(extra.get(i, [])))
        kids = children.get(i, [])
        for k, kid in reversed(list(enumerate(kids))):
            if k < len(kids) - 1:
                stack += [")", kid, "("]
            else:
                stack.append(kid)
    return "".join(out)


def canonical(g: Graph, order: list[int] | None = None) -> str:
    order = order or ranks(g)
    return ".".join(sorted(write(g, p, order) for p in g.components()))


def scaffold(g: Graph) -> Graph:
    """Rings and what links them: ends are cut until none is left.  Empty for a molecule without rings."""
    keep = set(range(len(g.atoms)))
    near = g.neighbours()
    degree = {i: len(near[i]) for i in keep}
    ends = [i for i in keep if degree[i] <= 1]
    while ends:
        i = ends.pop()
        if i not in keep:
            continue
        keep.discard(i)
        for j, _ in near[i]:
            if j in keep:
                degree[j] -= 1
                if degree[j] <= 1:
                    ends.append(j)
    return g.without(set(range(len(g.atoms))) - keep)
