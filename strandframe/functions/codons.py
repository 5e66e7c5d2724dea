"""Genetic codes, codon arrays and translation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandframe.functions.residues import blocks, col, kmers

BASES = "TCAG"
# The standard genetic code, codons in TCAG order (TTT, TTC, TTA, ...).
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Differences of the alternative genetic codes from the standard one.
CODE_CHANGES = {
    1: "",
    2: "AGA* AGG* ATAM TGAW",
    3: "ATAM CTAT CTCT CTGT CTTT TGAW",
    4: "TGAW",
    5: "AGAS AGGS ATAM TGAW",
    6: "TAAQ TAGQ",
    9: "AAAN AGAS AGGS TGAW",
    10: "TGAC",
    11: "",
    12: "CTGS",
    13: "AGAG AGGG ATAM TGAW",
    14: "AAAN AGAS AGGS TAAY TGAW",
    16: "TAGL",
    21: "AAAN AGAS AGGS ATAM TGAW",
    22: "TAGL TCA*",
    23: "TTA*",
    24: "AGAS AGGK TGAW",
    25: "TGAG",
    26: "CTGA",
    27: "TAGQ TAAQ",
    28: "TAGQ TAAQ",
    29: "TAGY TAAY",
    30: "TAGE TAAE",
    31: "TGAW",
}
# Species whose nuclear code is not the standard one.
SPECIES_CODE = {
    "tetrther": 6, "paratetr": 6, "candalbi": 12, "candcyli": 12, "candmeli": 12, "candpara": 12, "candrugo": 12,
}


def code_string(code: int = 1) -> str:
    """64 amino acids of a genetic code in TCAG order."""
    out = list(STANDARD)
    for change in CODE_CHANGES[code].split():
        i = codon_index(change[:3])
        out[i] = change[3]
    return "".join(out)


def codon_index(codon: str) -> int:
    return sum(BASES.index(b) * 4 ** (2 - i) for i, b in enumerate(codon))


def tron_string(code: int = 1) -> str:
    """Like :func:`code_string` with serine AGY as J and the stops TAA/TAG as O, TGA as U."""
    out = []
    for i, aa in enumerate(code_string(code)):
        middle_g = BASES[i // 4 % 4] == "G"
        out.append({"S": "J" if middle_g else "S", "*": "U" if middle_g else "O"}.get(aa, aa))
    return "".join(out)


def digits(c) -> Column:
    return F.translate(col(c), BASES, "0123")


def _lookup(words: Column, table: str) -> Column:
    """Array of three-digit base-4 words to one character each through a 64-entry array."""
    values = F.array(*[F.lit(x) for x in table])

    def pick(word: Column) -> Column:
        v = word.cast("int")
        return F.element_at(values, (F.floor(v / 100) * 16 + F.floor(v / 10) % 10 * 4 + v % 10 + 1).cast("int"))

    return F.array_join(F.transform(words, pick), "")


def translate(c, code: int = 1, frame: int = 0) -> Column:
    """Protein of one reading frame of an unambiguous nucleotide sequence; stops are ``*``."""
    s = F.substring(digits(c), frame + 1, 2**31 - 1) if frame else digits(c)
    return _lookup(blocks(s, 3), code_string(code))


def tron(c, code: int = 1) -> Column:
    """One amino code per nucleotide position (every overlapping triplet)."""
    return _lookup(kmers(digits(c), 3), tron_string(code))


def codon_number(codon: Column) -> Column:
    """Base-4 number of a codon, 0..63 in TCAG order."""
    d = digits(codon)
    return sum(F.substring(d, i + 1, 1).cast("int") * 4 ** (2 - i) for i in range(3))


def codon_text(number: Column) -> Column:
    """Inverse of :func:`codon_number`."""
    base = F.array(*[F.lit(b) for b in BASES])
    return F.concat(*[F.element_at(base, (F.floor(number / 4**p) % 4 + 1).cast("int")) for p in (2, 1, 0)])
