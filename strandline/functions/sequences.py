"""Expressions over sequences, alignment rows, descriptions and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of protein letters; fixed values of the encoding (20 unknown, 31 gap).
PROTEIN_CODES = {
    "A": 0, "R": 1, "N": 2, "D": 3, "C": 4, "Q": 5, "E": 6, "G": 7, "H": 8, "I": 9, "L": 10, "K": 11, "M": 12, "F": 13, "P": 14, "S": 15, "T": 16, "W": 17, "Y": 18,
    "V": 19, "X": 20, "B": 3, "J": 20, "O": 20, "U": 4, "Z": 6, "-": 31,
}
RNA_CODES = {"A": 21, "G": 22, "C": 23, "U": 24, "N": 25, "-": 31}
DNA_CODES = {"A": 26, "G": 27, "C": 28, "T": 29, "N": 30, "-": 31}


def as_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def aligned(seq: Column) -> Column:
    """An alignment row without its insertions (lower-case letters)."""
    return F.regexp_replace(seq, "[a-z]", "")


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def codes(seq: Column, table: dict = PROTEIN_CODES, other: int = 20) -> Column:
    """Codes of the aligned columns."""
    m = as_map(table)
    return F.transform(letters(aligned(seq)), lambda c: F.coalesce(F.try_element_at(m, c), F.lit(other)))


def deletions(seq: Column) -> Column:
    """Number of insertions before each aligned column: the lengths of the lower-case runs between aligned letters."""
    # Each aligned letter closes a piece; what stands before it in its piece was inserted.
    return F.transform(F.regexp_extract_all(seq, F.lit("([a-z]*)[^a-z]"), F.lit(1)), lambda run: F.length(run))


def deletion_value(d: Column) -> Column:
    return F.atan(d / 3) * (2 / 3.141592653589793)


def has_deletion(d: Column) -> Column:
    return F.least(F.greatest(d, F.lit(0)), F.lit(1))


# The least and greatest length of a UniProt accession, and the lengths of the two halves of an entry name
# (uniprot.org, help pages "accession_numbers" and "entry_name"; headers by "fasta-headers"). Letters are capitals.
ACCESSION_LENGTHS, PROTEIN_LENGTH, SPECIES_LENGTH = (6, 10), 10, 5


def _code(text: Column, least: int, most: int) -> Column:
    """Whether the text is capitals and digits alone, of such a length."""
    return F.length(text).between(least, most) & (F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "") == "")


def species(description: Column) -> Column:
    """Species of a UniProt or UniRef100 description, else the empty string.

    UniProt: database|accession|protein_SPECIES, in which the accession may have a numbered copy behind an underscore; a
    cluster member: UniRef100_accession_taxon/range.
    """
    fields, words = F.split(description, r"\|"), F.split(description, "_")
    accession = F.substring_index(F.get(fields, 1), "_", 1)
    protein, organism = F.substring_index(F.get(fields, 2), "_", 1), F.get(F.split(F.get(fields, 2), "_"), 1)
    mnemonic = F.regexp_extract(organism, "^[A-Z0-9]+", 0)
    numbered = F.regexp_replace(F.get(fields, 1), "_[0-9]+$", "") == accession
    entry = F.get(fields, 0).isin("sp", "tr") & _code(accession, *ACCESSION_LENGTHS) & numbered & _code(protein, 1, PROTEIN_LENGTH)
    taxon = F.when((F.get(words, 0) == "UniRef100") & (F.get(words, 1) != ""), F.substring_index(F.get(words, 2), "/", 1))
    return F.coalesce(F.when(entry & (mnemonic != ""), F.left(mnemonic, F.lit(SPECIES_LENGTH))), taxon, F.lit(""))


def hit_indices(seq: Column, start: Column) -> Column:
    """Index of each aligned column in the hit: -1 for a gap, else a running count that insertions use up as well."""
    chars = letters(seq)
    used = F.transform(chars, lambda c, i: F.when(c == "-", -1).otherwise(start - 1 + F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x != "-"))))
    return F.transform(F.filter(F.arrays_zip(chars.alias("c"), used.alias("i")), lambda z: ~z["c"].rlike("[a-z]")), lambda z: z["i"])


def without_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "")


def letters_of_number(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA: chain names of any 64-bit number."""
    state = lambda left, name: F.struct(left.cast("long").alias("left"), name.alias("name"))
    step = lambda s, _: F.when(s["left"] > 0, state(F.floor((s["left"] - 1) / 26), F.concat(F.chr(F.pmod(s["left"] - 1, F.lit(26)) + 65), s["name"]))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), state(n, F.lit("")), step)["name"]


def align_to_query(seq: Column, query: Column) -> Column:
    """A row's columns under a gapped query: letters over a gap become insertions, gaps over a gap go."""
    pairs = F.zip_with(letters(seq), letters(query), lambda s, q: F.when(q != "-", s).when(s != "-", F.lower(s)).otherwise(""))
    return F.array_join(pairs, "")


def with_newline(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def date_or_last(text: Column) -> Column:
    """A yyyy-mm-dd date; 9999-12-31 where it is absent or malformed."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.lit("9999-12-31").cast("date"))


def first_resolution(*candidates: Column) -> Column:
    """The first candidate that is a number other than 0, else -1."""
    return F.coalesce(*[F.nullif(c.try_cast("double"), F.lit(0.0)) for c in candidates], F.lit(-1.0))


def cutoff(query_date: Column, most: str, days: int = 60) -> Column:
    """The latest release a template may have: days before the query's own, and not after the given date."""
    return F.least(F.lit(most).cast("date"), F.date_sub(query_date, days))


def one_hot(code: Column, n: int) -> Column:
    """Array of n zeros with a one at the code; a code outside is all zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == code).cast("int"))


def atom_name_codes(name: Column) -> Column:
    """The first four characters, padded with blanks, as codes from 0 to 63."""
    return F.transform(letters(F.rpad(name, 4, " ")), lambda c: F.least(F.greatest(F.ascii(c) - 32, F.lit(0)), F.lit(63)))
