"""Column functions on nucleotide and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements.
IUPAC, IUPAC_COMPLEMENT = "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN"


def reverse_complement(s: Column) -> Column:
    """Reverse complement of A, C, G, T, N in both cases; anything else becomes X."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTNacgtn]", "X"), "ACGTNacgtn", "TGCANtgcan"))


def iupac_complement(s: Column) -> Column:
    """Complement of upper-case IUPAC codes, base by base."""
    return F.translate(s, IUPAC, IUPAC_COMPLEMENT)


def iupac_reverse_complement(s: Column) -> Column:
    return F.reverse(iupac_complement(s))


def iupac_mask(c: Column) -> Column:
    """Four-bit set (A 1, C 2, G 4, T 8) of an IUPAC code: its place in the list of codes; 0 for anything else."""
    return F.instr(F.lit(IUPAC), F.upper(c))


def shift_quality(q: Column, by: int) -> Column:
    """Qualities moved by ``by`` codes, not below 33."""
    return F.array_join(F.transform(F.split(q, ""), lambda c: F.char(F.greatest(F.ascii(c) + by, F.lit(33)))), "")


def quality_offset(lowest: Column) -> Column:
    """Encoding offset told by the lowest quality code of a file: 33 below code 59, else 64."""
    return F.when(lowest < 59, 33).otherwise(64)


def lowest_quality(q: Column) -> Column:
    return F.ascii(F.array_min(F.split(q, "")))


def highest_quality(q: Column) -> Column:
    return F.ascii(F.array_max(F.split(q, "")))


def accept_quality(q: Column, least: int) -> Column:
    """Whether at least half of the qualities reach the code ``least``."""
    return F.size(F.filter(F.split(q, ""), lambda c: F.ascii(c) >= least)) * 2 >= F.length(q)


def error_probability(q: Column, offset: int = 33) -> Column:
    """Error probability of a one-character quality; each other base has a third of it."""
    return F.pow(F.lit(10.0), -(F.ascii(q) - offset) / 10.0)


def base_distribution(q: Column, founder: Column, offset: int = 33) -> Column:
    """Probabilities of calling A, C, G and T where the read's base is ``founder``."""
    e = error_probability(q, offset)
    return F.transform(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: F.when(b == founder, 1 - e).otherwise(e / 3))


def wrap(s: Column, width: int) -> Column:
    """Lines of ``width`` characters; 0 keeps one line."""
    return s if width <= 0 else F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def windows(s: Column, n: int) -> Column:
    """All substrings of length ``n``, with their positions: array of (pos, w)."""
    last = F.length(s) - n
    found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(n)).alias("w")))
    return F.when(last >= 0, found).otherwise(F.expr("cast(array() as array<struct<pos:int,w:string>>)"))


#: Letters of a piece of a sequence, about: short enough that finding a window in it is cheap.
PIECE = 256


def pieces(s: Column, overlap: int, width: int = PIECE) -> Column:
    """Pieces of ``width`` letters, each with the ``overlap`` letters that follow it; none for an empty text.

    Linear in the text, so that windows are found in short strings whatever the
    sequence's length. ``overlap`` is at most ``width``.
    """
    cut = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return F.get(F.transform(F.array(cut), lambda c: F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(F.left(b, F.lit(overlap)), F.lit(""))))), F.lit(0))


def difference(reference: Column, s: Column, same_orientation: Column | None = None) -> Column:
    """``.`` where ``s`` agrees with ``reference``, else the base of ``s``; of the opposite orientation ``,`` and lower case."""
    same = F.lit(True) if same_orientation is None else same_orientation
    dot = F.when(same, ".").otherwise(",")
    return F.array_join(F.zip_with(F.split(reference, ""), F.split(s, ""), lambda a, b: F.when(a == b, dot).when(same, b).otherwise(F.lower(b))), "")


# Names of strands and of positions relative to a gene.
STRANDS = {"+": "POS", "POS": "POS", "-": "NEG", "NEG": "NEG", "POS_NEG": "POS_NEG", ".": "NON_STRANDED", "NON_STRANDED": "NON_STRANDED"}
RELATIONS = ("HEAD", "TAIL", "EXON", "PARTIAL_EXON", "INTRON")


def strand_name(s: Column) -> Column:
    """POS, NEG, POS_NEG or NON_STRANDED of what a file has for it; null for anything else."""
    return F.get(F.array(*[F.lit(v) for v in STRANDS.values()]), F.array_position(F.array(*[F.lit(k) for k in STRANDS]), s).cast("int") - 1)


def strand_print(name: Column) -> Column:
    """A strand's name as it is printed: POS_NEG is BOTH."""
    return F.when(name == "POS_NEG", "BOTH").when(name.isin(*STRANDS.values()), name)


def strand_of_symbol(c: Column) -> Column:
    """Strand of a one-character symbol: + 1 p P are POS, - 0 n N are NEG, others NON_STRANDED."""
    return F.when(c.isin("+", "1", "p", "P"), "POS").when(c.isin("-", "0", "n", "N"), "NEG").otherwise("NON_STRANDED")


def relation_name(s: Column) -> Column:
    """A position relative to a gene; null for anything unknown."""
    return F.when(s.isin(*RELATIONS), s)


def two_bit(s: Column) -> Column:
    """Number whose base-4 digits are a sequence of up to 31 bases (A 0, C 1, G 2, T 3; anything else counts as A)."""
    digits = F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "A"), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("long")


def from_two_bit(n: Column, length: int) -> Column:
    """The sequence of ``length`` bases of a number made by ``two_bit``."""
    return F.translate(F.lpad(F.conv(n.cast("string"), 10, 4), length, "0"), "0123", "ACGT")
