"""Residue-level column expressions (one pass over a string, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# IUPAC nucleotide letters in the order of their 4-bit masks 1..15
# (A=1, C=2, G=4, T=8, an ambiguous letter is the OR of its bases).
IUPAC = "ACMGRSVTWYHKDBN"
# IUPAC complement pairs.
COMPLEMENT_FROM = "ACGTUMRWSYKVHDBN"
COMPLEMENT_TO = "TGCAAKYWSRMBDHVN"
# Amino acid letters and molecular weights (Da); B and Z are averages.
AMINO = "ARNDCQEGHILKMFPSTWYVBZX"
AMINO_WEIGHT = [
    89.09, 174.20, 132.12, 133.10, 121.15, 146.15, 147.13, 75.07, 155.16, 131.17, 131.17, 146.19,
    149.21, 165.19, 115.13, 105.09, 119.12, 204.23, 181.19, 117.15, 132.61, 146.64, 128.16,
]
WATER = 18.015
# Reduced amino acid alphabets, classes separated by "|".
REDUCED = {
    "LLQZ1.2": "MFILVAW|CYQHPGTSNRKDE",
    "LLQZ1.4": "MFILV|ACW|YQHPGTSNRK|DE",
    "LLQZ1.6": "MFILV|A|C|WYQHP|GTSN|RK|DE",
    "LLQZ2.3": "IMVLFWY|GPCAST|NHQEDRK",
    "LLQZ2.7": "IMVL|FWY|G|P|CAST|NHQED|RK",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters(c) -> Column:
    """Whole text reduced to its ASCII letters, upper case."""
    return F.upper(F.regexp_replace(col(c), "[^A-Za-z]", ""))


def nucleotide(c) -> Column:
    """Project letters on ACGT by alphabet position modulo four."""
    return F.translate(col(c), LETTERS, ("ACGT" * 7)[:26])


def aligned(c) -> Column:
    """Aligned row: letters stay in place, everything else is a gap."""
    return F.upper(F.regexp_replace(col(c), "[^A-Za-z]", "-"))


def ungap(c) -> Column:
    return F.translate(col(c), "-", "")


def complement(c) -> Column:
    return F.translate(col(c), COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(c) -> Column:
    return F.reverse(complement(c))


def count_in(c, chars: str) -> Column:
    """Number of characters of ``c`` that belong to ``chars``."""
    return F.length(col(c)) - F.length(F.translate(col(c), chars, ""))


def count_not_in(c, chars: str) -> Column:
    return F.length(F.translate(col(c), chars, ""))


def kmers(c, k: int) -> Column:
    """All overlapping words of length ``k`` in order, as an array, in linear time."""
    return F.regexp_extract_all(col(c), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def blocks(c, k: int) -> Column:
    """Consecutive non-overlapping words of length ``k`` from the left."""
    return F.regexp_extract_all(col(c), F.lit(f".{{{k}}}"), F.lit(0))


def reduce_alphabet(c, name: str = "LLQZ1.6") -> Column:
    """Replace each amino acid by the first member of its class."""
    classes = REDUCED[name].split("|")
    source = "".join(classes)
    target = "".join(cls[0] * len(cls) for cls in classes)
    return F.translate(col(c), source, target)


def iupac_mask(c) -> Column:
    """4-bit base mask of an IUPAC letter (U is T); 0 when it is not one."""
    return F.instr(F.lit(IUPAC), F.translate(col(c), "U", "T"))


def molecule_type(c) -> Column:
    """DNA, RNA, TRON or PROTEIN from the letter composition of the whole sequence."""
    s = col(c)
    total = F.length(s)
    nuc = count_in(s, "ACGTU")
    plain = count_not_in(s, "NX")
    marks = count_in(s, "JU")
    return (
        F.when(total == count_in(s, "N"), F.lit("DNA"))
        .when(nuc * 100 > plain * 75, F.when(count_in(s, "T") >= count_in(s, "U"), "DNA").otherwise("RNA"))
        .when((marks > 0) & ((marks + count_in(s, "O")) * 100 > total * 5), F.lit("TRON"))
        .otherwise(F.lit("PROTEIN"))
    )


def gcg_checksum(c) -> Column:
    """Sum of character code times its position in a cycle of 57, modulo 10000."""
    weighted = F.transform(F.split(F.upper(col(c)), ""), lambda ch, i: (i % 57 + 1) * F.ascii(ch))
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x) % 10000


# Class letters of element patterns and their residues.
CLASSES = {"o": "CFILMVWY", "j": "DEHKNQR", "+": "HKR", "_": "DEQN", "@": "ILVM", "$": "FYW", ".": "AGPST"}


def prosite_regex(pattern: str) -> str:
    """Compile an element pattern such as ``[ST]-x(2)-{P}-R`` to a Java regex.

    ``x`` any residue, ``[..]`` any of, ``{..}`` none of, ``(n)`` / ``(n,m)``
    repeats, ``<`` / ``>`` anchors; the letters of ``CLASSES`` stand for their residues.
    A full stop at the end closes the pattern.
    """
    out = []
    for part in pattern.removesuffix(".").split("-"):
        head = "^" if part.startswith("<") else ""
        tail = "$" if part.endswith(">") else ""
        part = part.strip("<>")
        repeat = ""
        if part.endswith(")"):
            part, _, count = part[:-1].partition("(")
            repeat = "{" + count + "}"
        negated, part = part.startswith("{"), part.strip("[]{}")
        letters = "".join(CLASSES.get(c, c) for c in part)
        part = "." if letters == "x" else f"[{'^' * negated}{letters}]" if negated or len(letters) > 1 else letters
        out.append(head + part + repeat + tail)
    return "".join(out)


def iupac_regex(pattern: str) -> str:
    """Nucleotide pattern with ambiguity letters as a regex of base classes."""
    parts = []
    for ch in pattern:
        mask = IUPAC.index("T" if ch == "U" else ch) + 1
        bases = "".join(b for bit, b in ((1, "A"), (2, "C"), (4, "G"), (8, "T")) if mask & bit)
        parts.append(bases if len(bases) == 1 else f"[{bases}]")
    return "".join(parts)


def overlapping_hits(c, regex: str) -> Column:
    """Number of possibly overlapping matches."""
    return F.regexp_count(col(c), F.lit(f"(?={regex})"))
