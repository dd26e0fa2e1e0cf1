"""Molecules from structure texts: a parser, graphs, circular fingerprints and substructure keys.

Texts become atoms, bonds and adjacency lists in one Arrow pass; everything after that is built-in functions over those
arrays, a molecule a row, so nothing is shuffled. The hashes and keys are this library's own: bits can be compared with each
other, not with those of other toolkits. Aromatic atoms are those written so; a ring with alternating double bonds isn't taken
for aromatic, and nothing checks that an aromatic system has a Kekulé form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.bits import WORD_BITS, pack
from tessera.functions.columns import let
from tessera.sources.shared import written

#: Element symbols by atomic number, from 1.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db "
    "Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(ELEMENTS)} | {"*": 0}
#: Valences of the elements that may stand without brackets.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1, 3, 5, 7), "Br": (1, 3, 5, 7), "I": (1, 3, 5, 7)}
AROMATIC = ("b", "c", "n", "o", "p", "s", "se", "as", "te")
#: Bond orders in halves, so that an aromatic bond is 3. UNSAID and ANY are for patterns.
SINGLE, AROMATIC_BOND, DOUBLE, TRIPLE, QUADRUPLE, UNSAID, ANY = 2, 3, 4, 6, 8, -1, 0
BONDS = {"-": SINGLE, "/": SINGLE, "\\": SINGLE, ":": AROMATIC_BOND, "=": DOUBLE, "#": TRIPLE, "$": QUADRUPLE, "~": ANY}
TOKEN = re.compile(
    r"\[(?P<isotope>\d+)?(?P<inner>[A-Z][a-z]?|se|as|te|[bcnops]|\*)(?:@(?:@|[A-Z]{2}\d+)?)?(?P<h>H\d*)?(?P<charge>\++\d*|-+\d*)?(?::\d+)?\]"
    r"|(?P<outer>Br|Cl|[BCNOPSFI]|[bcnops]|\*)|(?P<bond>[-=#$:/\\~])|(?P<ring>\d|%\d\d|%\(\d+\))|(?P<mark>[().])"
)
MOLECULE = (
    "valid boolean, atoms array<struct<number:int,charge:int,hydrogens:int,isotope:int,aromatic:boolean,ring:boolean>>, "
    "bonds array<struct<a:int,b:int,halves:int,ring:boolean>>, around array<array<struct<atom:int,halves:int,bond:int>>>"
)


@dataclass
class Atom:
    symbol: str
    aromatic: bool = False
    isotope: int = 0
    charge: int | None = 0
    #: None: not said, and so what the valence leaves.
    hydrogens: int | None = None


@dataclass
class Graph:
    atoms: list[Atom] = field(default_factory=list)
    bonds: list[tuple[int, int, int]] = field(default_factory=list)

    def around(self) -> list[list[tuple[int, int, int]]]:
        """For each atom its neighbours as (atom, order, bond)."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.atoms]
        for i, (a, b, o) in enumerate(self.bonds):
            out[a].append((b, o, i))
            out[b].append((a, o, i))
        return out


def read(text: str) -> Graph | None:
    """The graph as it is written; None where the grammar is broken. What follows white space is a name."""
    text = (text.split() or [""])[0]
    g, at, last, bond, stack = Graph(), 0, None, None, []
    rings: dict[str, tuple[int, int | None]] = {}
    pairs: set[tuple[int, int]] = set()

    def join(a: int, b: int, order: int | None) -> bool:
        pair = (min(a, b), max(a, b))
        if a == b or pair in pairs:
            return False
        pairs.add(pair)
        g.bonds.append((a, b, UNSAID if order is None else order))
        return True

    opened = False  # a branch that has no atom yet
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        symbol = m["inner"] or m["outer"]
        if symbol:
            aromatic = symbol in AROMATIC
            name = symbol.capitalize() if aromatic else symbol
            if name not in NUMBER:
                return None
            if m["inner"]:
                c = m["charge"] or ""
                size = int(c.strip("+-") or len(c)) if c else 0
                atom = Atom(name, aromatic, int(m["isotope"] or 0), -size if "-" in c else size, int(m["h"][1:] or 1) if m["h"] else 0)
            else:
                atom = Atom(name, aromatic)
            g.atoms.append(atom)
            if last is not None and not join(last, len(g.atoms) - 1, bond):
                return None
            if last is None and bond is not None:
                return None
            last, bond, opened = len(g.atoms) - 1, None, False
        elif m["bond"]:
            if bond is not None or last is None:
                return None
            bond = BONDS[m["bond"]]
        elif m["ring"]:
            if last is None or opened:
                return None
            key = m["ring"].strip("%()").lstrip("0") or "0"
            if key in rings:
                other, said = rings.pop(key)
                if said is not None and bond is not None and said != bond or not join(other, last, bond if said is None else said):
                    return None
            else:
                rings[key] = (last, bond)
            bond = None
        elif m["mark"] == "(":
            if last is None or bond is not None or opened:
                return None
            stack.append(last)
            opened = True
        elif m["mark"] == ")":
            if not stack or bond is not None or opened:
                return None
            last = stack.pop()
        else:  # a dot: what follows isn't bonded
            if last is None or bond is not None or opened:
                return None
            last = None
    if rings or stack or bond is not None or opened or last is None:
        return None
    return g


def ring_bonds(g: Graph) -> list[bool]:
    """Which bonds lie on a cycle: all but the bridges."""
    around, seen, low = g.around(), [-1] * len(g.atoms), [0] * len(g.atoms)
    ring, clock = [True] * len(g.bonds), 0
    for root in range(len(g.atoms)):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        path = [(root, -1, iter(around[root]))]
        while path:
            a, by, rest = path[-1]
            for b, _, i in rest:
                if seen[b] < 0:
                    seen[b] = low[b] = clock
                    clock += 1
                    path.append((b, i, iter(around[b])))
                    break
                if i != by:
                    low[a] = min(low[a], seen[b])
            else:
                path.pop()
                if path:
                    up = path[-1][0]
                    low[up] = min(low[up], low[a])
                    ring[by] = low[a] <= seen[up]
    return ring


def molecule(text: str | None) -> dict:
    """A row of MOLECULE. Not valid, and empty: null or empty text, broken grammar, more bonds than a valence has, aromatic
    atoms outside rings, bonds of no order."""
    none = {"valid": False, "atoms": [], "bonds": [], "around": []}
    g = read(text or "")
    if g is None or not g.atoms or any(o == ANY for _, _, o in g.bonds):
        return none
    ring = ring_bonds(g)
    both = lambda a, b: g.atoms[a].aromatic and g.atoms[b].aromatic
    g.bonds = [(a, b, (AROMATIC_BOND if both(a, b) and r else SINGLE) if o in (UNSAID, AROMATIC_BOND) else o) for (a, b, o), r in zip(g.bonds, ring, strict=True)]
    around, atoms = g.around(), []
    for atom, near in zip(g.atoms, around, strict=True):
        in_ring = any(ring[i] for _, _, i in near)
        if atom.aromatic and not in_ring:
            return none
        # Each aromatic bond counts as one, and the atom's share in the system as one more.
        used = sum(SINGLE if o == AROMATIC_BOND else o for _, o, _ in near) // 2
        fits = VALENCES.get(atom.symbol, ())
        h = atom.hydrogens
        if h is None:
            h = max(0, fits[0] - used - 1) if atom.aromatic and fits else max(0, next((v for v in fits if v >= used), used) - used)
        if fits and not atom.charge and used + (0 if atom.hydrogens is None else h) > fits[-1]:
            return none
        atoms.append((NUMBER[atom.symbol], atom.charge, h, atom.isotope, atom.aromatic, in_ring))
    return {"valid": True, "atoms": atoms, "bonds": [(*b, r) for b, r in zip(g.bonds, ring, strict=True)], "around": around}


def by_text(df: DataFrame, structure: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that add gives to rows of _text: each text is worked on once, however many rows have it and however few files
    the rows came from. What is made is written, so that Spark knows its size for the join."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(structure).alias("_text")).distinct().repartition(parts, "_text")
    return df.join(written(add(texts)), F.col(structure).eqNullSafe(F.col("_text")), "left").drop("_text")


def parsed(df: DataFrame, structure: str, out: str = "molecule") -> DataFrame:
    """Adds the molecule (MOLECULE) of each row's text; one that can't be read is not valid and empty. Equal texts, equal molecules."""
    @F.pandas_udf(MOLECULE)
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([molecule(t) for t in texts], columns=["valid", "atoms", "bonds", "around"])

    return by_text(df, structure, lambda texts: texts.withColumn(out, parse("_text")))


def atom_rows(df: DataFrame, row_id: str, molecule: str = "molecule") -> DataFrame:
    """row_id, atom (from 0) and what is known of it: a row for each atom."""
    return df.select(row_id, F.posexplode(f"{molecule}.atoms").alias("atom", "_a")).select(row_id, "atom", "_a.*")


def bond_rows(df: DataFrame, row_id: str, molecule: str = "molecule") -> DataFrame:
    """row_id, a, b, halves, ring: a row for each bond, once."""
    return df.select(row_id, F.inline(f"{molecule}.bonds"))


#: Atomic numbers from here on are 0 in graphs.
MOST_NUMBER = 100


def graphs(df: DataFrame, molecule: str = "molecule", out: str = "graph") -> DataFrame:
    """Adds graph: atomic numbers, and bonds in both directions as heads and tails. A molecule that isn't valid is one atom 0."""
    atoms = F.transform(f"{molecule}.atoms", lambda a: F.when(a["number"] < MOST_NUMBER, a["number"]).otherwise(0))
    both = F.flatten(F.transform(f"{molecule}.bonds", lambda b: F.array(F.struct(b["a"].alias("h"), b["b"].alias("t")), F.struct(b["b"].alias("h"), b["a"].alias("t")))))
    none = ~F.coalesce(F.col(f"{molecule}.valid"), F.lit(False))
    ends = let(both, lambda e: F.struct(e["h"].alias("heads"), e["t"].alias("tails")))
    return df.withColumn("_ends", ends).withColumn(out, F.struct(F.when(none, F.array(F.lit(0))).otherwise(atoms).alias("atoms"), *(F.when(none, F.array().cast("array<int>")).otherwise(F.col(f"_ends.{x}")).alias(x) for x in ("heads", "tails")))).drop("_ends")


def from_places(places: Column, bits: int) -> Column:
    """Packed words with the bits at these places (from 0)."""
    one = F.lit(1).cast("bigint")
    word = lambda p, w: F.aggregate(F.filter(p, lambda i: F.floor(i / WORD_BITS) == w), F.lit(0).cast("bigint"), lambda x, i: x.bitwiseOR(F.call_function("shiftleft", one, (i % WORD_BITS).cast("int"))))
    return let(F.array_distinct(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(-(-bits // WORD_BITS) - 1)), lambda w: word(p, w)))


def environments(m: Column, radius: int = 2) -> Column:
    """Codes of the surroundings of each atom up to radius bonds; whatever the order of atoms in the text, the same codes.

    An atom's code holds its element, neighbours, hydrogens, charge, isotope and whether it is in a ring; each round hashes an
    atom's code with the sorted orders and codes of its neighbours. Surroundings of the same bonds as smaller or other ones of
    their size are one: the least code stands for them, and the atoms of the others don't grow on.
    """
    atoms, around = m["atoms"], m["around"]
    first = F.transform(atoms, lambda a, i: F.struct(
        F.xxhash64(a["number"], F.size(around[i]), a["hydrogens"], a["charge"], a["isotope"], a["ring"]).alias("code"), F.array().cast("array<int>").alias("bonds"), F.lit(True).alias("grows")))

    def grown(state: Column, r: int) -> Column:
        def at(near: Column, i: Column) -> Column:
            own = state[i]
            code = F.xxhash64(F.lit(r), own["code"], F.array_sort(F.transform(near, lambda n: F.struct(n["halves"].alias("o"), state[n["atom"]]["code"].alias("c")))))
            bonds = F.flatten(F.concat(F.array(own["bonds"], F.transform(near, lambda n: n["bond"])), F.transform(near, lambda n: state[n["atom"]]["bonds"])))
            return F.struct(code.alias("code"), F.array_sort(F.array_distinct(bonds)).alias("bonds"), own["grows"].alias("grows"))

        return F.transform(around, at)

    def known(now: Column, before: list[Column]) -> Column:
        """now, with grows taken from atoms whose bonds an earlier round, or a lesser code, has."""
        same = lambda x: F.exists(now, lambda o: o["grows"] & (o["bonds"] == x["bonds"]) & (o["code"] < x["code"]))
        return F.transform(now, lambda x: F.struct(x["code"].alias("code"), x["bonds"].alias("bonds"), (x["grows"] & ~same(x) & ~_any(before, x)).alias("grows")))

    def _any(before: list[Column], x: Column) -> Column:
        found = F.size(x["bonds"]) == 0
        for b in before:
            found = found | F.exists(b, lambda o: o["grows"] & (o["bonds"] == x["bonds"]))
        return found

    def rounds(states: list[Column]) -> Column:
        if len(states) > radius:
            said = [F.transform(F.filter(s, lambda x: x["grows"]), lambda x: x["code"]) for s in states]
            return F.concat(*said)
        return let(grown(states[-1], len(states)), lambda now: let(known(now, states[1:]), lambda s: rounds([*states, s])))

    return let(first, lambda s: rounds([s]))


def circular(m: Column, bits: int = 2048, radius: int = 2) -> Column:
    """The folded circular fingerprint as packed words; all zero for a molecule that isn't valid."""
    return from_places(F.transform(environments(m, radius), lambda c: F.pmod(c, F.lit(bits)).cast("int")), bits)


@dataclass(frozen=True)
class Key:
    """A pattern that must be found so many times, at different sets of atoms.

    Patterns are structure texts: an element in capitals isn't aromatic, * is any atom, ~ any bond, an unsaid bond is single or
    aromatic; in brackets hydrogens and charge are as said (none said: any).
    """

    name: str
    pattern: str
    least: int = 1


#: The keys in the order of their bits.
KEYS = (
    *(Key(f"element_{s}", f"[{s}]") for s in "B C N O F Si P S Cl Se Br I Li Na Mg K Ca Fe Cu Zn As Pt Hg".split()),
    Key("aromatic_carbon", "c"), Key("aromatic_nitrogen", "n"), Key("aromatic_oxygen", "o"), Key("aromatic_sulfur", "s"),
    Key("hydroxyl", "[OH1]"), Key("two_hydroxyls", "[OH1]", 2), Key("three_hydroxyls", "[OH1]", 3), Key("amine_primary", "C[NH2]"), Key("amine_secondary", "C[NH1]C"), Key("amine_tertiary", "CN(C)C"),
    Key("carbonyl", "C=O"), Key("two_carbonyls", "C=O", 2), Key("aldehyde", "[CH1]=O"), Key("ketone", "CC(=O)C"), Key("carboxyl", "C(=O)[OH1]"), Key("carboxylate", "C(=O)[O-]"), Key("ester", "C(=O)OC"), Key("two_esters", "C(=O)OC", 2),
    Key("amide", "C(=O)N"), Key("carbamate", "OC(=O)N"), Key("urea", "NC(=O)N"), Key("carbonate", "OC(=O)O"), Key("anhydride", "C(=O)OC(=O)"), Key("imide", "C(=O)NC(=O)"),
    Key("ether", "COC"), Key("aryl_ether", "cOC"), Key("phenol", "c[OH1]"), Key("aniline", "cN"), Key("thiol", "[SH1]"), Key("sulfide", "CSC"), Key("disulfide", "SS"), Key("sulfoxide", "CS(=O)C"), Key("sulfone", "S(=O)=O"), Key("sulfonamide", "S(=O)(=O)N"),
    Key("phosphate", "P(=O)(O)O"), Key("phosphonate", "CP(=O)(O)O"), Key("nitrile", "C#N"), Key("alkyne", "C#C"), Key("alkene", "C=C"), Key("diene", "C=CC=C"), Key("imine", "C=N"), Key("azo", "N=N"), Key("hydrazine", "NN"), Key("hydroxylamine", "NO"), Key("peroxide", "OO"),
    Key("nitro", "[N+](=O)[O-]"), Key("nitro_neutral", "N(=O)=O"), Key("acyl_halide_cl", "C(=O)Cl"), Key("alkyl_cl", "CCl"), Key("alkyl_br", "CBr"), Key("aryl_cl", "cCl"), Key("aryl_br", "cBr"), Key("aryl_f", "cF"), Key("trifluoromethyl", "C(F)(F)F"),
    Key("methyl", "[CH3]"), Key("two_methyls", "[CH3]", 2), Key("four_methyls", "[CH3]", 4), Key("methylene_chain", "[CH2][CH2][CH2]"), Key("long_chain", "[CH2][CH2][CH2][CH2][CH2][CH2]"), Key("tert_butyl", "C([CH3])([CH3])[CH3]"), Key("isopropyl", "[CH1]([CH3])[CH3]"), Key("quaternary", "*~C(~*)(~*)~*"),
    Key("ring_3", "*1~*~*1"), Key("ring_4", "*1~*~*~*1"), Key("ring_5", "*1~*~*~*~*1"), Key("ring_6", "*1~*~*~*~*~*1"), Key("ring_7", "*1~*~*~*~*~*~*1"), Key("benzene", "c1ccccc1"), Key("two_benzenes", "c1ccccc1", 2), Key("pyridine", "n1ccccc1"), Key("pyrimidine", "n1cnccc1"), Key("pyrrole", "n1cccc1"), Key("imidazole", "n1cncc1"), Key("furan", "o1cccc1"), Key("thiophene", "s1cccc1"), Key("biaryl", "c-c"),
    Key("cation", "[*+]"), Key("anion", "[*-]"), Key("amino_acid", "NCC(=O)O"), Key("glycol", "OCCO"), Key("acetal", "COCOC"), Key("acyloxymethyl", "C(=O)OCO"), Key("choline_like", "C[N+](C)(C)C"), Key("heteroatom_pair", "N~*~O"),
)


@dataclass(frozen=True)
class Plan:
    """A pattern in the order in which its atoms are placed: each is next to one that has its place already."""

    atoms: list[Atom]
    explicit: list[bool]
    #: For each further atom: the place it is reached from, that bond, and bonds to other places, as (place, order).
    steps: list[tuple[int, int, list[tuple[int, int]]]]

    def possible(self, m: dict) -> bool:
        """A quick look: are there such elements, and rings if it has one?"""
        have = {a[0] for a in m["atoms"]}
        return all(w.symbol == "*" or NUMBER[w.symbol] in have for w in self.atoms) and (not any(more for *_, more in self.steps) or any(a[5] for a in m["atoms"]))


def plan(pattern: str) -> Plan:
    g = read(pattern)
    if g is None or not g.atoms or "." in pattern:
        raise ValueError(f"no pattern of one piece: {pattern!r}")
    bracketed = [t["inner"] is not None for t in TOKEN.finditer(pattern) if t["inner"] or t["outer"]]
    near, order, steps = g.around(), [0], []
    while len(order) < len(g.atoms):
        atom, at, bond = next((b, i, o) for i, a in enumerate(order) for b, o, _ in near[a] if b not in order)
        steps.append((at, bond, [(order.index(b), o) for b, o, _ in near[atom] if b in order and b != order[at]]))
        order.append(atom)
    return Plan([g.atoms[i] for i in order], [bracketed[i] for i in order], steps)


def fits(want: Atom, explicit: bool, atom: tuple) -> bool:
    number, charge, hydrogens, _, aromatic, _ = atom
    if want.symbol != "*" and (number != NUMBER[want.symbol] or aromatic != want.aromatic and (want.aromatic or not explicit)):
        return False  # an element in brackets may be aromatic
    return (not want.hydrogens or want.hydrogens == hydrogens) and (not want.charge or want.charge == charge)


def bonded(said: int, order: int) -> bool:
    return said == ANY or (order in (SINGLE, AROMATIC_BOND) if said == UNSAID else said == order)


def places(m: dict, p: Plan) -> Iterator[list[int]]:
    """Every way to lay the pattern on the molecule: depth first, back where no neighbour fits."""
    atoms, around = m["atoms"], m["around"]

    def onward(met: list[int]) -> Iterator[list[int]]:
        if len(met) == len(p.atoms):
            yield met
            return
        at, bond, more = p.steps[len(met) - 1]
        for b, order, _ in around[met[at]]:
            if b not in met and bonded(bond, order) and fits(p.atoms[len(met)], p.explicit[len(met)], atoms[b]):
                if all(any(c == met[i] and bonded(o, k) for c, k, _ in around[b]) for i, o in more):
                    yield from onward([*met, b])

    for i, a in enumerate(atoms):
        if fits(p.atoms[0], p.explicit[0], a):
            yield from onward([i])


def has(m: dict, p: Plan, least: int = 1) -> bool:
    """Whether the pattern lies at so many different sets of atoms; stops as soon as it does."""
    sets = set()
    for met in places(m, p) if p.possible(m) else ():
        sets.add(frozenset(met))
        if len(sets) >= least:
            return True
    return False


def substructures(df: DataFrame, structure: str, keys: tuple[Key, ...] = KEYS, out: str = "keys") -> DataFrame:
    """Adds an array of 0/1, one for each key; all 0 for a text that can't be read."""
    @F.pandas_udf("array<int>")
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        plans = [(plan(k.pattern), k.least) for k in keys]
        for texts in parts:
            molecules = map(molecule, texts)
            yield pd.Series([[int(has(m, p, n)) for p, n in plans] for m in molecules], dtype=object)

    return by_text(df, structure, lambda texts: texts.withColumn(out, match("_text")))


def add_fingerprints(df: DataFrame, structure: str, bits: int = 2048, radius: int = 2) -> DataFrame:
    """Adds fp_valid, circular and keys (packed words; all zero where the structure can't be read) to every row."""
    def add(texts: DataFrame) -> DataFrame:
        made = substructures(parsed(texts.withColumnRenamed("_text", "_own"), "_own", "_molecule"), "_own", out="_keys").withColumnRenamed("_own", "_text")
        return made.select("_text", circular(F.col("_molecule"), bits, radius).alias("circular"), pack(F.col("_keys")).alias("keys"), F.col("_molecule.valid").alias("fp_valid"))

    return by_text(df, structure, add)
