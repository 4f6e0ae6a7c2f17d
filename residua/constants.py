"""Fixed values.

Published substitution scores, the residue coordinates, the genetic code and
the alignment limits. Results only agree with other tools when these are equal
to the last digit, so they are written out as plain text. Everything that
follows from them (distances, group means, index tables) is derived below.
"""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------
# fixed values: residue order
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
# fixed values: letters that are not residues
NON_RESIDUES = "BJOUXZ"
# fixed values: letter order of motif probability matrices
MOTIF_LETTERS = "ACDEFGHIKLMNPQRSTVWY"

# fixed values: position of each residue in an 8-dimensional Euclidean space
_COORDINATES_TEXT = """
A -0.876280  3.598596  2.554616 -0.729216  0.698828  1.221507 -2.765205 -3.163091
R -4.111404 -1.936791 -2.682295  0.942498  6.924314 -1.195785 -1.639269  0.615381
N -7.471612 -2.468058  0.932738 -4.488355  0.553080 -3.081577  0.368010  4.223792
D -8.317871 -0.848602  1.752372 -1.407818 -4.874022 -1.493568  5.256411 -2.561758
C  5.421664 11.791877  2.675596 -5.622478  4.322457  3.946839  2.229597 -1.901479
Q -3.771796 -2.525005 -1.567736  2.619391  2.781873  0.952486  3.947072 -0.954304
E -6.585010 -2.752755 -1.649014  1.605597 -1.833933 -0.730211  2.313328 -3.239486
G -3.978253 -1.155062  9.994796 -0.195264 -1.110059 -2.860194 -4.952672 -1.495210
H -2.630176 -8.283034 -4.773107 -6.479084  0.070359  4.318067 -1.847373 -0.086451
I  4.548022  5.189698 -3.999001 -0.186966 -3.275059 -1.882387 -0.627095  0.049364
L  5.341899  4.436639 -3.552811  1.250614  0.266899 -2.609335 -0.694939  0.812004
K -5.742562 -1.207887 -2.587323  2.866228  4.169821 -1.991698 -1.941954 -0.747156
M  4.241223  2.474317 -2.658336  2.946054  2.011534 -3.254331  1.266004 -0.186966
F  9.340442 -3.359172 -0.635377 -2.878570 -3.255191 -2.200202 -1.104637 -0.062654
P -6.150933  3.182318  0.122393  7.788554 -3.094076  6.831600 -1.992627  1.807240
S -2.523437  1.824168  3.256463 -2.386830  0.439791  1.024198  0.486894  1.190316
T -0.823028  3.115233  2.075337 -0.585875 -1.471153  0.518398  1.846290  6.269577
W 13.592409 -8.961858  6.548108  4.623650  2.128797  0.808588  2.631353  0.521535
Y  7.173223 -6.765800 -2.811202 -1.654989 -1.878135  3.104673 -1.272146 -0.635970
V  3.323480  4.651177 -2.996218  1.972858 -3.576126 -1.427066 -1.507041 -0.454682
"""

# fixed values: BLOSUM62, lower triangle, rows and columns in RESIDUES order
_BLOSUM62_TEXT = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""

# fixed values: reduced alphabets, groups in code order. S and T share the last
# group of murphy10 and murphy9; octet also places the non-residue J in group 1
REDUCED_ALPHABETS = {
    "octet": ("AST", "RKEDQ", "NH", "C", "G", "IVLM", "FYW", "P"),
    "gbmr10": ("G", "D", "N", "AEFIKLMQRVW", "Y", "H", "C", "T", "S", "P"),
    "dayhoff6": ("AGPST", "C", "DENQ", "FWY", "HKR", "ILMV"),
    "murphy5": ("LVIMC", "ASGTP", "FYW", "EDNQ", "KRH"),
    "murphy10": ("A", "KR", "EDNQ", "C", "G", "H", "ILVM", "FYW", "P", "ST"),
    "murphy9": ("A", "KREDNQ", "C", "G", "H", "ILVM", "FYW", "P", "ST"),
    "hsdm4": ("LIVFMYW", "C", "DNTSKEQRAGP", "H"),
    "aabet20": tuple(RESIDUES),
}

# fixed values: representative residue of each group
REPRESENTATIVES = {
    "gbmr10": "GDNAYHCTSP",
    "dayhoff6": "ACDFHI",
    "murphy5": "LAFEK",
    "murphy10": "AKECGHIFPS",
    "murphy9": "AKCGHIFPS",
    "hsdm4": "LCDH",
    "aabet20": RESIDUES,
}

# fixed values: standard genetic code, codons counted in base order TCAG
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# fixed values: Karlin-Altschul parameters for BLOSUM62
#            lambda  K       H      alpha/lambda  beta   gap decay
UNGAPPED_KA = (0.318, 0.134, 0.401, 2.492397, -3.2, 0.5)
GAPPED_KA = (0.267, 0.0410, 0.140, 7.116105, -30.0, 0.1)
SUM_SCORE_GAP = 50
SUM_SCORE_DECAY = 0.1

# fixed values: alignment limits
GAP_OPEN = 11
GAP_EXTEND = 1
MIN_RUNNING_SCORE = -20
SEED_LENGTH = 10
SEED_MIN_SCORE = 11
SEED_MIN_IDENTITIES = 4
UNGAPPED_DROP_BITS = 7.0
GAPPED_DROP_BITS = 15.0
GAPPED_TRIGGER_BITS = 25.0
HSP_OVERLAP = 10
SUM_MIN_EVALUE = 1.0
SUM_MIN_SCORE = 30
SUM_TOP_SCORES = 5
MAX_EVALUE = 10.0
MAX_M8_ROWS = 500
MAX_ALIGNMENTS = 100

# fixed values: quality encodings
PHRED_OFFSET, PHRED_CAP, PHRED_CODES = 33, 60, (33, 93)
SOLEXA_OFFSET, SOLEXA_CAP, SOLEXA_CODES = 64, 40, (59, 104)

# fixed values: adaptor clipping
ADAPTOR_HEAD, ADAPTOR_MATCHES, ADAPTOR_MIN_OVERLAP = 14, 11, 5

# fixed values: distances at which recall weights change shape
RECALL_HALF_DISTANCE = 49.38
RECALL_FLAT_DISTANCE = 24.0

# ---------------------------------------------------------------------------
# derived from the values above

COORDINATES = {
    line.split()[0]: [float(x) for x in line.split()[1:]]
    for line in _COORDINATES_TEXT.strip().splitlines()
}
POINT_WIDTH = 8


def _mirror(text: str) -> list[list[int]]:
    rows = [[int(x) for x in line.split()[1:]] for line in text.strip().splitlines()]
    n = len(rows)
    return [[rows[max(i, j)][min(i, j)] for j in range(n)] for i in range(n)]


BLOSUM62 = _mirror(_BLOSUM62_TEXT)
# dissimilarity of two residues: self scores minus twice the cross score
BLOSUM_DISTANCE = [
    [BLOSUM62[i][i] + BLOSUM62[j][j] - 2 * BLOSUM62[i][j] for j in range(20)]
    for i in range(20)
]
# squared distance of two residue coordinates
COORDINATE_DISTANCE_SQ = [
    [sum((x - y) ** 2 for x, y in zip(COORDINATES[a], COORDINATES[b])) for b in RESIDUES]
    for a in RESIDUES
]
# no two different residues lie closer than this (squared)
MIN_RESIDUE_DISTANCE_SQ = min(
    COORDINATE_DISTANCE_SQ[i][j] for i in range(20) for j in range(20) if i != j
)


def group_codes(alphabet: str) -> str:
    """One digit or letter per residue, in RESIDUES order: its group's code."""
    groups = REDUCED_ALPHABETS[alphabet]
    symbols = "0123456789ABCDEFGHIJ"
    return "".join(
        next(symbols[g] for g, members in enumerate(groups) if r in members) for r in RESIDUES
    )


def reduced_blosum(alphabet: str = "octet") -> list[list[float]]:
    """Mean BLOSUM62 score between the members of every two groups."""
    groups = [[RESIDUES.index(r) for r in g] for g in REDUCED_ALPHABETS[alphabet]]
    return [
        [sum(BLOSUM62[i][j] for i in a for j in b) / (len(a) * len(b)) for b in groups]
        for a in groups
    ]


def raw_score_from_bits(bits: float, gapped: bool) -> float:
    """The raw score that is worth so many bits."""
    lam, k = (GAPPED_KA if gapped else UNGAPPED_KA)[:2]
    return (bits * math.log(2) + math.log(k)) / lam


UNGAPPED_DROP = raw_score_from_bits(UNGAPPED_DROP_BITS, gapped=False)
GAPPED_DROP = raw_score_from_bits(GAPPED_DROP_BITS, gapped=True)
GAPPED_TRIGGER = raw_score_from_bits(GAPPED_TRIGGER_BITS, gapped=False)
