"""Molecular properties and slicing rules from published tables, over this package's graph."""

from __future__ import annotations

from functools import lru_cache

from pairforge.kernel import graph as G
from pairforge.kernel.smarts import View, pattern

# Masses of the commonest isotopes.
MASS = {
    "H": 1.00782503207, "B": 11.0093054, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Na": 22.9897692809, "Mg": 23.985041700, "Al": 26.98153863, "Si": 27.9769265325, "P": 30.97376163,
    "S": 31.972071, "Cl": 34.96885268, "K": 38.96370668, "Ca": 39.96259098, "Fe": 55.9349375, "Zn": 63.9291422, "As": 74.9215965, "Se": 79.9165213, "Br": 78.9183371, "I": 126.904473,
}

# Polar surface of nitrogen and oxygen by charge, hydrogens and bonds (s, d, t, a; r: in a ring of three) (Ertl et al., 2000).
POLAR = {
    "N": {"sss": 3.24, "sd": 12.36, "t": 23.79, "dds": 11.68, "dt": 13.60, "rsss": 3.01, "Hss": 12.03, "rHss": 21.94, "Hd": 23.85, "HHs": 26.02, "+ssss": 0.0, "+dss": 3.01, "+st": 4.36, "+Hsss": 4.44, "+Hds": 13.97, "+HHss": 16.61, "+HHd": 25.59, "+HHHs": 27.64,
          "aa": 12.89, "aaa": 4.41, "aas": 4.93, "aad": 8.39, "Haa": 15.79, "+aaa": 4.10, "+aas": 3.88, "+Haa": 14.14},
    "O": {"ss": 9.23, "rss": 12.53, "d": 17.07, "Hs": 20.23, "-s": 23.06, "aa": 13.14},
}
POLAR["N"]["ds"] = POLAR["N"].pop("sd")

# Atom types and their contributions to logP, the first that holds (Wildman and Crippen, 1999).
LOGP = {
    "C": [
        ("[CH4]", 0.1441), ("[CH3]C", 0.1441), ("[CH2](C)C", 0.1441), ("[CH](C)(C)C", 0.0), ("[C](C)(C)(C)C", 0.0), ("[CH3][N,O,P,S,F,Cl,Br,I]", -0.2035),
        ("[CH2X4]([N,O,P,S,F,Cl,Br,I])[A;!#1]", -0.2035), ("[CH1X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])[A;!#1]", -0.2051), ("[CH0X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])([A;!#1])[A;!#1]", -0.2051),
        ("[C]=[!C;A;!#1]", -0.2783), ("[CH2]=C", 0.1551), ("[CH1](=C)[A;!#1]", 0.1551), ("[CH0](=C)([A;!#1])[A;!#1]", 0.1551), ("[C](=C)=C", 0.1551), ("[CX2]#[A;!#1]", 0.0017), ("[CH3]c", 0.08452),
        ("[CH3]a", -0.1444), ("[CH2X4]a", -0.0516), ("[CHX4]a", 0.1193), ("[CH0X4]a", -0.0967), ("[cH0]-[A;!C;!N;!O;!S;!F;!Cl;!Br;!I;!#1]", -0.5443), ("[c][#9]", 0.0), ("[c][#17]", 0.245),
        ("[c][#35]", 0.198), ("[c][#53]", 0.0), ("[cH]", 0.1581), ("[c](:a)(:a):a", 0.2955), ("[c](:a)(:a)-a", 0.2713), ("[c](:a)(:a)-C", 0.136), ("[c](:a)(:a)-N", 0.4619), ("[c](:a)(:a)-O", 0.5437),
        ("[c](:a)(:a)-S", 0.1893), ("[c](:a)(:a)=[C,N,O]", -0.8186), ("[C](=C)(a)[A;!#1]", 0.264), ("[C](=C)(c)a", 0.264), ("[CH1](=C)a", 0.264), ("[C]=c", 0.264),
        ("[CX4][A;!C;!N;!O;!P;!S;!F;!Cl;!Br;!I;!#1]", 0.2148), ("[#6]", 0.08129),
    ],
    "N": [
        ("[NH2+0][A;!#1]", -1.019), ("[NH+0]([A;!#1])[A;!#1]", -0.7096), ("[NH2+0]a", -1.027), ("[NH1+0]([!#1])a", -0.5188), ("[NH+0]=[!#1]", 0.08387), ("[N+0](=[!#1])[!#1]", 0.1836),
        ("[N+0]([A;!#1])([A;!#1])[A;!#1]", -0.3187), ("[N+0](a)([!#1])[A;!#1]", -0.4458), ("[N+0](a)(a)a", -0.4458), ("[N+0]#[A;!#1]", 0.01508), ("[NH3,NH2,NH;+,+2,+3]", -1.95), ("[n+0]", -0.3239),
        ("[n;+,+2,+3]", -1.119), ("[NH0;+,+2,+3]([A;!#1])([A;!#1])([A;!#1])[A;!#1]", -0.3396), ("[NH0;+,+2,+3](=[A;!#1])([A;!#1])[!#1]", -0.3396), ("[NH0;+,+2,+3](=[#6])=[#7]", -0.3396),
        ("[N;+,+2,+3]#[A;!#1]", 0.2887), ("[N;-,-2,-3]", 0.2887), ("[N;+,+2,+3](=[N;-,-2,-3])=N", 0.2887), ("[#7]", -0.4806),
    ],
    "O": [
        ("[o]", 0.1552), ("[OH,OH2]", -0.2893), ("[O]([A;!#1])[A;!#1]", -0.0684), ("[O](a)[!#1]", -0.4195), ("[O]=[#7,#8]", 0.0335), ("[OX1;-,-2,-3][#7]", 0.0335), ("[OX1;-,-2,-3][#16]", -0.3339),
        ("[O;+0]=[#16;+0]", -0.3339), ("[O-]C(=O)", -1.326), ("[OX1;-,-2,-3][!#1;!N;!S]", -1.189), ("[O]=c", 0.1788), ("[O]=[CH]C", -0.1526), ("[O]=C(C)([A;!#1])", -0.1526),
        ("[O]=[CH][N,O]", -0.1526), ("[O]=[CH2]", -0.1526), ("[O]=[CX2]=O", -0.1526), ("[O]=[CH]c", 0.1129), ("[O]=C([C,c])[a;!#1]", 0.1129), ("[O]=C(c)[A;!#1]", 0.1129),
        ("[O]=C([!#1;!#6])[!#1;!#6]", 0.4833), ("[#8]", -0.1188),
    ],
    "other": [
        ("[#9,#17,#35,#53;-]", -2.996), ("[#9]", 0.4202), ("[#17]", 0.6895), ("[#35]", 0.8456), ("[#53]", 0.8857), ("[#15]", 0.8612), ("[S;-,-2,-3,-4,+1,+2,+3,+5,+6]", -0.0024),
        ("[S;+0]=[N,O,P,S]", -0.0024), ("[S;A]", 0.6482), ("[s;a]", 0.6237),
    ],
}
#: The same for hydrogens, by the atom that holds them; the first that holds.
HYDROGEN_LOGP = [("[#6,#1]", 0.123), ("O[#6X4,c,#1]", -0.2677), ("OC=[#6,#7,O,S]", 0.298), ("O[O,S]", 0.298), ("O[#7]", 0.2142), ("O[!C;!N;!O;!S]", -0.2677), ("[OH2]", -0.2677), ("[#7]", 0.2142), ("[!C;!N;!O]", -0.2677), ("*", 0.1125)]

DONOR = "[$([N;!H0;v3]),$([N;!H0;+1;v4]),$([O,S;H1;+0]),$([n;H1;+0])]"
ACCEPTOR = "[$([O,S;H1;v2]-[!$(*=[O,N,P,S])]),$([O,S;H0;v2]),$([O,S;-]),$([N;v3;!$(N-*=!@[O,N,P,S])]),$([nH0,o,s;+0])]"
_END = "!$(*#*)&!D1&!$(C(F)(F)F)&!$(C(Cl)(Cl)Cl)&!$(C(Br)(Br)Br)&!$(C([CH3])([CH3])[CH3])"
_NOT_AMIDE = "!$([CD3](=[N,O,S])-!@[#7,O,S!D1])&!$([#7,O,S!D1]-!@[CD3]=[N,O,S])&!$([CD3](=[N+])-!@[#7!D1])&!$([#7!D1]-!@[CD3]=[N+])"
ROTATABLE = f"[{_END}&{_NOT_AMIDE}]-,:;!@[{_END}]"


@lru_cache(1)
def _read_logp() -> tuple[dict[str, list], list]:
    return {k: [(pattern(p), x) for p, x in rows] for k, rows in LOGP.items()}, [(pattern(p), x) for p, x in HYDROGEN_LOGP]


def logp(v: View) -> float:
    types, hydrogen = _read_logp()
    total = 0.0
    for i, symbol in enumerate(v.symbol):
        if symbol == "H":
            continue
        total += next((x for p, x in types.get(symbol, types["other"]) if p.any_at(v, i)), 0.0)
        if v.hydrogens[i]:
            total += v.hydrogens[i] * next(x for p, x in hydrogen if p.any_at(v, i))
    return total


def polar_surface(v: View) -> float:
    total = 0.0
    for i, symbol in enumerate(v.symbol):
        if symbol not in POLAR:
            continue
        heavy = [j for j, _ in v.near[i] if v.symbol[j] != "H"]
        kinds = "".join(sorted({1: "s", 2: "d", 3: "t", 1.5: "a"}[v.order[i, j]] for j in heavy))
        charge = "+" if v.charge[i] > 0 else "-" if v.charge[i] < 0 else ""
        small = "r" if "a" not in kinds and 3 in v.ring_sizes(i) else ""
        key = charge + "H" * v.hydrogens[i] + kinds
        found = POLAR[symbol].get(small + key, POLAR[symbol].get(key))
        if found is None:  # what the table leaves out, by the table's own trend
            base, step = (30.5, 8.2) if symbol == "N" else (28.5, 8.6)
            found = max(0.0, base - step * len(heavy) + 1.5 * v.hydrogens[i])
        total += found
    return total


def descriptors(g: G.Graph, view: View | None = None) -> dict[str, float]:
    """Exact mass, logP, polar surface, donors, acceptors and rotatable bonds."""
    v = view or View(g)
    mass = sum(MASS.get(s, 0.0) for s in v.symbol) + MASS["H"] * sum(h - sum(v.symbol[j] == "H" for j, _ in v.near[i]) for i, h in enumerate(v.hydrogens))
    holders = [i for i, s in enumerate(v.symbol) if s in ("N", "O", "S")]
    count = lambda p: float(sum(pattern(p).any_at(v, i) for i in holders))
    inner = [i for i in range(len(v.near)) if v.degree[i] > 1 and v.rings[i] < v.degree[i]]
    turning = {(min(m), max(m)) for i in inner for m in pattern(ROTATABLE).at(v, i)}
    return {"MW": round(mass, 6), "logP": round(logp(v), 6), "TPSA": round(polar_surface(v), 6), "HBD": count(DONOR), "HBA": count(ACCEPTOR), "RotB": float(len(turning))}


# Surroundings of an end of a bond that may be cut, and which meet which, by single bonds outside rings unless
# noted (Degen et al., 2008).
BRICS_ENDS = {
    1: "[C;D3]([#0,#6,#7,#8])(=O)", 3: "[O;D2]-;!@[#0,#6,#1]", 4: "[C;!D1;!$(C=*)]-;!@[#6]", 5: "[N;!D1;!$(N=*);!$(N-[!#6;!#16;!#0;!#1]);!$([N;R]@[C;R]=O)]", 6: "[C;D3;!R](=O)-;!@[#0,#6,#7,#8]", 7: "[C;D2,D3]-[#6]", 8: "[C;!R;!D1;!$(C!-*)]",
    9: "[n;+0;$(n(:[c,n,o,s]):[c,n,o,s])]", 10: "[N;R;$(N(@C(=O))@[#6,#7,#8,#16])]", 11: "[S;D2](-;!@[#0,#6])", 12: "[S;D4]([#6,#0])(=O)(=O)", 13: "[C;$(C(-;@[C,N,O,S])-;@[N,O,S])]", 14: "[c;$(c(:[c,n,o,s]):[n,o,s])]", 15: "[C;$(C(-;@C)-;@C)]", 16: "[c;$(c(:c):c)]",
}
BRICS_MEET = {
    1: (3, 5, 10), 3: (4, 13, 14, 15, 16), 4: (5, 11), 5: (12, 13, 14, 15, 16), 6: (13, 14, 15, 16), 7: (7,), 8: (9, 10, 13, 14, 15, 16), 9: (13, 14, 15, 16), 10: (13, 14, 15, 16), 11: (13, 14, 15, 16), 13: (14, 15, 16), 14: (14, 15, 16), 15: (16,), 16: (16,),
}

# Bonds to cut by retrosynthetic rules (Lewell et al., 1998), between the two atoms of each pattern.
RECAP_BONDS = [
    "[$([C;!$(C([#7])[#7])](=!@O))]!@[$([#7;+0;!D1])]",
    "[$(C=!@O)]!@[$([O;+0])]",
    "[$([N;!D1;+0;!$(N-C=[#7,#8,#15,#16])](-!@[*]))]-!@[$([*])]",
    "[$(C(=!@O)([#7;+0;D2,D3])!@[#7;+0;D2,D3])]!@[$([#7;+0;D2,D3])]",
    "[$([O;+0](-!@[#6!$(C=O)])-!@[#6!$(C=O)])]-!@[$([#6!$(C=O)])]",
    "C=!@C",
    "[N;+1;D4]!@[#6]",
    "[$([n;+0])]-!@C",
    "[$([O]=[C]-@[N;+0])]-!@[$([C])]",
    "c-!@c",
    "[$([#7;+0;D2,D3])]-!@[$([S](=[O])=[O])]",
]


def matched_bonds(g: G.Graph, patterns: list[str]) -> list[tuple[int, int]]:
    """Bonds between the first two atoms of each match."""
    v = View(g)
    found = {m[:2] for p in map(pattern, patterns) for m in p.matches(v) if len(m) > 1}
    return sorted({b if b in g.bonds else b[::-1] for b in found} & set(g.bonds))


def brics(g: G.Graph) -> list[tuple[int, int]]:
    """Bonds between surroundings that meet."""
    v = View(g)
    ends = [{n for n, p in BRICS_ENDS.items() if pattern(p).any_at(v, i)} if v.rings[i] < v.degree[i] else set() for i in range(len(g.atoms))]
    meet = lambda a, b: {(x, y) for x in ends[a] for y in ends[b] if y in BRICS_MEET.get(x, ()) or x in BRICS_MEET.get(y, ())}
    out = []
    for a, b in g.bonds:
        if not v.ring_bond[a, b]:
            double = [p for p in meet(a, b) if p == (7, 7)]
            if v.order[a, b] == 1 and len(meet(a, b)) > len(double) or v.order[a, b] == 2 and double:
                out.append((a, b))
    return out


def recap(g: G.Graph) -> list[tuple[int, int]]:
    return matched_bonds(g, RECAP_BONDS)
