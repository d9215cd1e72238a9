"""Element properties by atomic number; row 0 is the padding element X.

One line an element: symbol, mass (g/mol), atomic radius, D3 covalent radius (both in
Angstrom, unscaled), D3 van-der-Waals radius (Angstrom), Pauling electronegativity, hardness,
core electrons, effective charge, valence electrons, and the bond model's electronegativity,
radius and coordination-number slope. "-" stands where a table ends.

Lookups are gathers from a literal array inside the projection: no join, no broadcast, and
an atomic number without an entry is an error rather than a lost row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units

_ROWS = """
X 0.0 0.0 0.0 0.0 0.0 0.0 0 0 0 0.0 0.0 0.0
H 1.00797 0.32 0.32 1.09155 2.2 0.47259288 0 1 1 2.30085633 0.55682207 0.17957827
He 4.0026 0.37 0.46 0.86735 3.0 0.92203391 0 2 2 2.78445145 0.80966997 0.25584045
Li 6.941 1.3 1.2 1.7478 0.98 0.17452888 2 3 1 1.52956084 2.49092101 -0.02485871
Be 9.01218 0.99 0.94 1.5491 1.57 0.25700733 2 4 2 1.51714704 1.91705642 0.00374217
B 10.81 0.84 0.77 1.608 2.04 0.33949086 2 5 3 2.205683 1.35974851 0.05646607
C 12.011 0.75 0.75 1.45515 2.55 0.42195412 2 6 4 2.4964082 0.98310699 0.10514203
N 14.0067 0.71 0.71 1.31125 3.04 0.50438193 2 7 5 2.81007174 0.98423007 0.09753494
O 15.9994 0.64 0.63 1.24085 3.44 0.58691863 2 8 6 4.51078438 0.76716063 0.3047038
F 18.998403 0.6 0.64 1.1498 3.98 0.66931351 2 9 7 4.67476223 1.06139799 0.23261783
Ne 20.179 0.62 0.67 1.0687 4.5 0.75191607 2 10 8 3.2938361 1.17736822 0.36752208
Na 22.98977 1.6 1.4 1.8541 0.93 0.17964105 10 11 1 2.84505365 2.85570926 0.00131819
Mg 24.305 1.4 1.25 1.74195 1.31 0.22157276 10 12 2 2.2004795 2.56149012 -0.00368122
Al 26.98154 1.24 1.13 2.0053 1.61 0.26348578 10 13 3 2.31739628 2.31673425 -0.0136451
Si 28.0855 1.14 1.04 1.89585 1.9 0.30539645 10 14 4 2.03636974 2.0318174 0.04265789
P 30.97376 1.09 1.1 1.75085 2.19 0.34734014 10 15 5 1.97558064 1.82568535 0.07583916
S 32.06 1.04 1.02 1.65535 2.58 0.38924725 10 16 6 2.1344657 1.73685958 0.08973207
Cl 35.453 1.0 0.99 1.5523 3.16 0.4311567 10 17 7 2.91638164 1.97498207 -0.00589677
Ar 39.948 1.01 0.96 1.4574 3.5 0.47308269 10 18 8 1.54098156 2.00136196 0.13689929
K 39.0983 2.0 1.76 2.12055 0.82 0.17105469 18 19 1 2.91656301 3.58772537 -0.01861307
Ca 40.08 1.74 1.54 2.05175 1.0 0.20276244 18 20 2 2.26312147 2.68096221 0.11061699
Sc 44.9559 1.59 1.33 1.94515 1.36 0.21007322 18 21 3 2.25621439 2.23355957 0.10201137
Ti 47.9 1.48 1.22 1.8821 1.54 0.21739647 18 22 4 1.32628677 2.33135502 0.05426229
V 50.9415 1.44 1.21 1.86055 1.63 0.22471039 18 23 5 2.27050569 2.15870365 0.06014681
Cr 51.996 1.3 1.1 1.7207 1.66 0.23201501 18 24 6 1.86790977 2.10522128 0.05667719
Mn 54.938 1.29 1.07 1.7731 1.55 0.23933969 18 25 7 2.44759456 2.16376162 0.02992924
Fe 55.847 1.24 1.04 1.72105 1.83 0.24665638 18 26 8 2.49480042 2.10804037 0.03764312
Co 58.9332 1.18 1.0 1.71635 1.88 0.25398255 18 27 9 2.91545568 1.96460045 0.0614079
Ni 58.7 1.17 0.99 1.6731 1.91 0.26128863 18 28 10 3.2589775 2.00476257 0.08563465
Cu 63.546 1.22 1.01 1.6504 1.9 0.26859476 18 29 11 2.68723778 2.22628712 0.03707679
Zn 65.38 1.2 1.09 1.61545 1.65 0.27592565 28 30 2 1.86132251 2.438467 0.03053526
Ga 69.72 1.23 1.12 1.97895 1.81 0.30762999 28 31 3 2.01200832 2.39408483 -0.00843454
Ge 72.59 1.2 1.09 1.93095 2.01 0.3393158 28 32 4 1.97030722 2.24245792 0.01887497
As 74.9216 1.2 1.15 1.83125 2.18 0.37235985 28 33 5 1.95495427 2.05751204 0.06876354
Se 78.96 1.18 1.1 1.7634 2.55 0.40273549 28 34 6 2.6892099 2.15427677 0.01370795
Br 79.904 1.17 1.14 1.6831 2.96 0.43445776 28 35 7 2.84503857 2.2719192 -0.01129196
Kr 83.8 1.16 1.17 1.6048 3.0 0.46611708 28 36 8 2.61591858 2.19722638 0.07226529
Rb 85.4678 2.15 1.89 2.3088 0.82 0.15585079 36 9 1 2.64188286 3.8091035 0.01005367
Sr 87.62 1.9 1.67 2.2382 0.95 0.18649324 36 10 2 2.28442252 3.26020971 0.01541506
Y 88.9059 1.76 1.47 2.1098 1.22 0.1935621 36 11 3 1.33011187 2.99716916 0.05301365
Zr 91.22 1.64 1.39 2.02985 1.33 0.20063311 36 12 4 1.19809388 2.71707818 0.07066571
Nb 92.9064 1.56 1.32 1.9298 1.6 0.20770522 36 13 5 1.8918139 2.34950167 0.07637611
Mo 95.94 1.46 1.24 1.87715 2.16 0.21477254 36 14 6 2.40186898 2.11644818 0.07873977
Tc 98.0 1.38 1.15 1.7845 1.9 0.22184614 36 15 7 1.89282464 2.47180659 0.02997732
Ru 101.07 1.36 1.13 1.73115 2.2 0.22891872 36 16 8 3.09963488 2.321988 0.047454
Rh 102.9055 1.34 1.13 1.69875 2.28 0.23598621 36 17 9 2.50677823 2.32809515 0.04582912
Pd 106.4 1.3 1.08 1.67625 2.2 0.24305612 36 18 10 2.61196704 2.15244869 0.10557321
Ag 107.868 1.36 1.15 1.6654 1.93 0.25013018 36 19 11 2.0994345 2.55958313 0.02167468
Cd 112.41 1.4 1.23 1.731 1.69 0.25719937 46 20 2 2.66930105 2.591413 0.05463616
In 114.82 1.42 1.28 2.13115 1.78 0.2878478 46 21 3 1.78349472 2.62030465 0.05370913
Sn 118.69 1.4 1.26 2.0937 1.96 0.31848673 46 22 4 2.09634533 2.39935278 0.05985441
Sb 121.75 1.4 1.26 2.0075 2.05 0.34912431 46 23 5 2.00028974 2.56912355 0.02793994
Te 126.9045 1.37 1.23 1.94505 2.1 0.37976593 46 24 6 1.99869908 2.54374096 0.02922983
I 127.6 1.36 1.32 1.869 2.66 0.41040808 46 25 7 2.59072029 2.5691483 0.02220438
Xe 131.3 1.36 1.31 1.79445 2.6 0.44105777 46 26 8 2.54497829 2.53680807 0.0334046
Cs 132.9054 2.38 2.09 2.52835 0.79 0.05019332 54 9 1 2.5238789 4.24537037 -0.04110969
Ba 137.33 2.06 1.76 2.5907 0.89 0.0676257 54 10 2 2.30204667 3.66542289 -0.0198724
La 138.9055 1.94 1.62 2.31305 1.1 0.08504445 54 11 3 1.601193 3.19903011 0.07260201
Ce 140.12 1.84 1.47 2.31005 1.12 0.10247736 54 30 3 2.0 2.8 0.077
Pr 140.9077 1.9 1.58 2.2851 1.13 0.11991105 54 31 3 2.0 2.8 0.077
Nd 144.24 1.88 1.57 2.26355 1.14 0.13732772 54 32 3 2.0 2.8 0.077
Pm 145 1.86 1.56 2.2448 1.15 0.15476297 54 33 3 2.0 2.8 0.077
Sm 150.4 1.85 1.55 2.22575 1.17 0.17218265 54 34 3 2.0 2.8 0.077
Eu 151.96 1.83 1.51 2.2117 1.18 0.18961288 54 35 3 2.0 2.8 0.077
Gd 157.25 1.82 1.52 2.06215 1.2 0.2070476 54 36 3 2.0 2.8 0.077
Tb 158.9254 1.81 1.51 2.12135 1.21 0.22446752 54 37 3 2.0 2.8 0.077
Dy 162.5 1.8 1.5 2.07705 1.22 0.24189645 54 38 3 2.0 2.8 0.077
Ho 164.9304 1.79 1.49 2.1397 1.23 0.25932503 54 39 3 2.0 2.8 0.077
Er 167.26 1.77 1.49 2.1225 1.24 0.27676094 54 40 3 2.0 2.8 0.077
Tm 168.9342 1.77 1.48 2.1104 1.25 0.29418231 54 41 3 2.0 2.8 0.077
Yb 173.04 1.78 1.53 2.0993 1.26 0.31159587 54 42 3 2.0 2.8 0.077
Lu 174.967 1.74 1.46 2.0065 1.27 0.32902274 54 43 3 2.0 2.8 0.077
Hf 178.49 1.64 1.37 2.1225 1.3 0.34592298 68 12 4 2.30089349 2.34880037 0.083791
Ta 180.9479 1.58 1.31 2.049 1.5 0.36388048 68 13 5 1.75039077 2.37597108 0.07314553
W 183.85 1.5 1.23 1.99275 2.36 0.38130586 68 14 6 1.5178513 2.49067697 0.05318438
Re 186.207 1.41 1.18 1.94775 1.9 0.39877476 68 15 7 2.62972945 2.14100577 0.06799334
Os 190.2 1.36 1.16 1.8745 2.2 0.41614298 68 16 8 2.75372921 2.33473532 0.04671159
Ir 192.22 1.32 1.11 1.7228 2.2 0.4336451 68 17 9 2.62540906 2.194989 0.06758819
Pt 195.09 1.3 1.12 1.67625 2.28 0.45104014 68 18 10 2.55860939 2.12678348 0.09488437
Au 196.9665 1.3 1.13 1.6282 2.54 0.46848986 68 19 11 3.32492356 2.34895048 0.07556405
Hg 200.59 1.32 1.32 1.67995 2.0 0.4858455 78 20 2 2.65140898 2.33422774 0.13384502
Tl 204.37 1.44 1.3 2.15635 1.62 0.1252673 78 21 3 1.52014458 2.86560827 0.03203572
Pb 207.2 1.45 1.3 2.1382 2.33 0.14268677 78 22 4 2.54984804 2.62488837 0.04235009
Bi 208.9804 1.5 1.36 2.05875 2.02 0.16011615 78 23 5 1.72021963 2.88376127 0.03153769
Po 209 1.42 1.31 2.0027 2.0 0.17755889 78 24 6 2.69303422 2.75174124 -0.00152488
At 210 1.48 1.38 1.9322 2.2 0.19497557 78 25 7 1.81031095 2.83054552 0.02714675
Rn 222 1.46 1.42 1.8608 2.2 0.21240778 78 26 8 2.34224386 2.63264944 0.04800662
Fr - 2.42 2.01 2.5398 0.79 0.07263525 - 9 - - - -
Ra - 2.11 1.81 2.4647 0.9 0.09422158 - 10 - - - -
Ac - 2.01 1.67 2.35215 1.1 0.09920295 - 11 - - - -
Th - 1.9 1.58 2.2126 1.3 0.10418621 - 30 - - - -
Pa - 1.84 1.52 2.2297 1.5 0.14235633 - 31 - - - -
U - 1.83 1.53 2.19785 1.38 0.16394294 - 32 - - - -
Np - 1.8 1.54 2.17695 1.36 0.18551941 - 33 - - - -
Pu - 1.8 1.55 2.21705 1.28 0.22370139 - 34 - - - -
Am - 1.73 1.49 - 1.3 0.2511 - 35 - - - -
Cm - 1.68 1.49 - 1.3 0.2503 - 36 - - - -
Bk - 1.68 1.51 - 1.3 0.2884 - 37 - - - -
Cf - 1.68 1.51 - 1.3 0.31 - 38 - - - -
Es - 1.65 1.48 - 1.3 0.3316 - 39 - - - -
Fm - 1.67 1.5 - 1.3 0.3532 - 40 - - - -
Md - 1.73 1.56 - 1.3 0.3682 - 41 - - - -
No - 1.76 1.58 - 1.3 0.3963 - 42 - - - -
Lr - 1.61 1.45 - 1.3 0.4014 - 43 - - - -
Rf - 1.57 1.41 - 1.5 0.0 - 12 - - - -
Db - 1.49 1.34 - 1.5 0.0 - 13 - - - -
Sg - 1.43 1.29 - 1.5 0.0 - 14 - - - -
Bh - 1.41 1.27 - 1.5 0.0 - 15 - - - -
Hs - 1.34 1.21 - 1.5 0.0 - 16 - - - -
Mt - 1.29 1.16 - 1.5 0.0 - 17 - - - -
Ds - 1.28 1.15 - 1.5 0.0 - 18 - - - -
Rg - 1.21 1.09 - 1.5 0.0 - 19 - - - -
Cn - 1.22 1.22 - 1.5 0.0 - 20 - - - -
Nh - 1.36 1.36 - 1.5 0.0 - 21 - - - -
Fl - 1.43 1.43 - 1.5 0.0 - 22 - - - -
Mc - 1.62 1.46 - 1.5 0.0 - 23 - - - -
Lv - 1.75 1.58 - 1.5 0.0 - 24 - - - -
Ts - 1.65 1.48 - 1.5 0.0 - 25 - - - -
Og - 1.57 1.57 - 1.5 0.0 - 26 - - - -
"""

_NAMES = ("symbol", "mass", "r_atomic", "r_cov", "r_vdw", "en", "hardness", "ecore", "zeff", "zvalence", "bo_en", "bo_r0", "bo_cf")
_WHOLE = {"ecore", "zeff", "zvalence"}
_SCALE = {"r_atomic": units.AA2AU, "r_cov": units.AA2AU * 4.0 / 3.0, "r_vdw": units.AA2AU}
_LINES = [line.split() for line in _ROWS.strip().splitlines()]
MAX_ELEMENT = len(_LINES) - 1
SYMBOLS = [line[0] for line in _LINES]
NUMBERS = {s: z for z, s in enumerate(SYMBOLS)}

#: Bond polynomials by row of the periodic table, linear and quadratic in the electronegativity difference.
_LINEAR = (0.0, 29.84522887, -1.70549806, 6.54013762, 6.39169003, 6.00, 5.6)
_SQUARE = (0.0, -8.87843763, 2.10878369, 0.08009374, -0.85808076, -1.15, -1.3)


def period(z: int) -> int:
    return sum(z > last for last in (0, 2, 10, 18, 36, 54))


def _table() -> dict[str, list]:
    out: dict[str, list] = {}
    for k, name in enumerate(_NAMES[1:], 1):
        scale = _SCALE.get(name)
        out[name] = [None if line[k] == "-" else int(line[k]) if name in _WHOLE else float(line[k]) * scale if scale else float(line[k]) for line in _LINES]
    out["mass_au"] = [None if m is None else m * units.GMOL2AU for m in out["mass"]]
    out["bo_p1"] = [None if v is None else 0.01 * _LINEAR[period(z)] for z, v in enumerate(out["bo_en"])]
    out["bo_p2"] = [None if v is None else 0.01 * _SQUARE[period(z)] for z, v in enumerate(out["bo_en"])]
    return out


TABLE = _table()


def lookup(name: str, z: Column) -> Column:
    """Property `name` of atomic number z; an entry that is not there raises."""
    kind = "int" if name in _WHOLE else "double"
    values = F.array(*[F.lit(v).cast(kind) for v in TABLE[name]])
    return F.coalesce(F.get(values, z), F.raise_error(F.concat(F.lit(f"no {name} for atomic number "), z.cast("string"))).cast(kind))


def number(symbol: Column) -> Column:
    """Atomic number of a symbol in any case; an unknown one raises."""
    pairs = F.create_map(*[F.lit(x) for s, z in NUMBERS.items() for x in (s, z)])
    return F.coalesce(F.element_at(pairs, F.initcap(symbol)), F.raise_error(F.concat(F.lit("unknown element symbol "), symbol)).cast("int"))


def symbol(z: Column) -> Column:
    """Symbol of an atomic number, X for 0; an unknown one raises."""
    return F.coalesce(F.get(F.array(*map(F.lit, SYMBOLS)), z), F.raise_error(F.concat(F.lit("no element with number "), z.cast("string"))).cast("string"))


def frame(spark):
    """The whole table as a DataFrame of MAX_ELEMENT + 1 rows."""
    names = list(TABLE)
    rows = [(z, SYMBOLS[z], *[TABLE[n][z] for n in names]) for z in range(MAX_ELEMENT + 1)]
    return spark.createDataFrame(rows, "z int, symbol string, " + ", ".join(f"{n} {'int' if n in _WHOLE else 'double'}" for n in names))
