"""Gene, species and locus names, presets and sequence tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
CANONICAL = f"^C[{ALPHABET}]*[FW]$"
FRAME, LEFT, RIGHT, GAP = 40, 4, 3, 20

# Names that mean a species, and the words for a locus, which may follow T (TR genes) or B (IG genes).
SPECIES = {
    "human": ("human", "hsa", "homosapiens"),
    "mouse": ("mouse", "mmu", "musmusculus"),
}
LOCI = {"TRA": "ALPHA", "TRB": "BETA", "TRG": "GAMMA", "TRD": "DELTA", "IGH": "HEAVY", "IGK": "KAPPA", "IGL": "LAMBDA"}
#: By kind of name: every spelling, as letters and digits in upper case, with what it means.
MEANINGS = {
    "species": {x.upper(): species for species, spellings in SPECIES.items() for x in spellings},
    "locus": {x: locus for locus, word in LOCI.items() for x in (locus, word, ("T" if locus[0] == "T" else "B") + word)},
}
# Prototypes, components, components for reconstruction, by species and locus.
PRESETS = {
    ("human", "TRA"): (2000, 65, 220),
    ("human", "TRB"): (2000, 65, 260),
    ("human", "TRG"): (1000, 25, 100),
    ("human", "TRD"): (2000, 65, 280),
    ("human", "IGH"): (2000, 65, 300),
    ("human", "IGK"): (1000, 20, 65),
    ("human", "IGL"): (1000, 20, 65),
    ("mouse", "TRA"): (2000, 50, 150),
    ("mouse", "TRB"): (2000, 55, 225),
}
FALLBACK_PRESET = (2000, 60, 250)


def strip_allele(name: Column) -> Column:
    """The gene name before ``*``, without blanks; empty for null or blank."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"^\s*([^*\s]+)", 1)


def allele_with_default(name: Column, default: str = "01") -> Column:
    """The name with its allele, ``default`` where it has none; empty if there is no gene."""
    base = strip_allele(name)
    allele = F.regexp_extract(F.coalesce(name, F.lit("")), r"\*\s*([^\s]+)", 1)
    return F.when(base == "", "").otherwise(F.concat(base, F.lit("*"), F.when(allele == "", default).otherwise(allele)))


def allele_to_major(name: Column) -> Column:
    """The gene with allele 01."""
    return F.concat(strip_allele(name), F.lit("*01"))


def meant(kind: str, name: Column) -> Column:
    """The ``species`` or ``locus`` that a name stands for, whatever its case, blanks, hyphens and underscores; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in MEANINGS[kind].items() for x in pair])
    return F.try_element_at(known, F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s_-]+", "")))


def _meant_here(kind: str, name: str | None) -> str:
    found = MEANINGS[kind].get("".join(c for c in (name or "").upper() if not c.isspace() and c not in "_-"))
    if found is None:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(set(MEANINGS[kind].values())))}")
    return found


def normalize_species(name: str | None) -> str:
    """``meant`` for one species on the driver; ValueError if unknown."""
    return _meant_here("species", name)


def normalize_locus(name: str | None) -> str:
    """``meant`` for one locus on the driver; ValueError if unknown."""
    return _meant_here("locus", name)


def preset(species: str, locus: str) -> tuple[int, int, int]:
    """Numbers of prototypes and components for a species and locus by any of their names, or the general ones."""
    return PRESETS.get((normalize_species(species), normalize_locus(locus)), FALLBACK_PRESET)


def with_locus(locus: Column, v_call: Column) -> Column:
    """The locus, or else the first three letters of the V gene."""
    return F.coalesce(locus, F.substring(v_call, 1, 3))


def longest_common_suffix(values: Column) -> Column:
    """Longest common suffix of the non-empty strings of an array; empty if there is none."""
    given = F.filter(values, lambda s: F.length(s) > 0)
    both = lambda a, b: F.coalesce(F.array_max(F.filter(F.transform(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.when(F.right(a, n) == F.right(b, n), n)), lambda n: n.isNotNull())), F.lit(0))
    return F.when(F.size(given) == 0, "").otherwise(F.aggregate(F.slice(given, 2, F.greatest(F.size(given) - 1, F.lit(0))), F.get(given, F.lit(0)), lambda s, x: F.right(s, both(s, x))))


def normalize_functionality(raw: Column) -> Column:
    """One pair of brackets, then one of parentheses taken off; ``P`` if nothing is left."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^\[(.*)\]$", "$1"), r"^\((.*)\)$", "$1")
    return F.when(F.trim(inner) == "", "P").otherwise(F.trim(inner))


def tokens(sequence: Column) -> Column:
    """A sequence as 40 token ids: short ones from the left, others framed by their first 4 and last 3.

    The middle is cut to 33; gaps and unknown letters are 20; null is all gaps.
    """
    ascii_only = F.regexp_replace(F.coalesce(sequence, F.lit("")), r"[^\x00-\x7F]", "")
    code = F.transform(F.filter(F.split(ascii_only, ""), lambda c: c != ""), lambda c: F.when(F.position(c, F.lit(ALPHABET)) > 0, F.position(c, F.lit(ALPHABET)) - 1).otherwise(GAP))
    gaps = lambda k: F.array_repeat(F.lit(GAP), k)
    cap = FRAME - LEFT - RIGHT

    def framed(code: Column) -> Column:
        n = F.size(code)
        middle = F.slice(code, LEFT + 1, F.least(F.greatest(n - LEFT - RIGHT, F.lit(0)), F.lit(cap)))
        long = F.concat(F.slice(code, 1, LEFT), middle, gaps(F.lit(cap) - F.size(middle)), F.slice(code, F.greatest(n - RIGHT + 1, F.lit(1)), RIGHT))
        return F.when(n <= LEFT + RIGHT, F.concat(code, gaps(F.lit(FRAME) - n))).otherwise(long)

    return F.get(F.transform(F.array(code), framed), F.lit(0))  # the letters are read once, whatever the frame takes of them


def tokens_to_sequence(ids: Column) -> Column:
    """The letters of token ids without gaps."""
    return F.array_join(F.transform(F.filter(ids, lambda x: x < GAP), lambda x: F.substring(F.lit(ALPHABET), x + 1, F.lit(1))), "")


def one_hot(ids: Column) -> Column:
    """For every token an array of 21 with a single 1.0."""
    return F.transform(ids, lambda t: F.transform(F.sequence(F.lit(0), F.lit(GAP)), lambda k: F.when(k == t, 1.0).otherwise(0.0)))


def mutate(sequence: Column, seed: Column, different: bool = True) -> Column:
    """One substitution at an interior position, drawn by a hash of ``seed``; two letters or fewer stay.

    ``different`` forces another letter; else the letter drawn may be the old one.
    """
    n = F.length(sequence)
    at = (F.pmod(F.xxhash64(seed, F.lit("place")), F.greatest(n - 2, F.lit(1))) + 2).cast("int")
    old = F.position(F.substring(sequence, at, F.lit(1)), F.lit(ALPHABET))
    draw = F.pmod(F.xxhash64(seed, F.lit("letter")), F.lit(19 if different else 20)).cast("int")
    new = F.when(F.lit(different) & (old > 0) & (draw >= old - 1), draw + 2).otherwise(draw + 1)
    letter = F.substring(F.lit(ALPHABET), new, F.lit(1))
    return F.when(n <= 2, sequence).otherwise(F.overlay(sequence, letter, at))


def mutate_places(sequence: Column, seed: Column, k: Column) -> Column:
    """``k`` substitutions at different interior places, at most all of them, drawn by hashes of ``seed``; a letter drawn may be the old one."""
    n = F.length(sequence)
    places = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    order = F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(seed, F.lit("place"), i).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(order, F.lit(1), F.greatest(k, F.lit(0))), lambda x: x["i"])
    letter = lambda i: F.substring(F.lit(ALPHABET), F.pmod(F.xxhash64(seed, F.lit("letter"), i), F.lit(20)).cast("int") + 1, F.lit(1))
    return F.when(n > 2, F.aggregate(chosen, sequence, lambda s, i: F.overlay(s, letter(i), i))).otherwise(sequence)


def prototype_hash(frame, order: str = "proto_idx", sequence: str = "junction_aa") -> Column:
    """Aggregate: 16 hex digits over the sequences in order, each followed by NUL (a prototype set has a fixed, small size)."""
    rows = F.array_sort(F.collect_list(F.struct(order, sequence)))
    return F.substring(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r[sequence], F.lit("\x00"))), ""), 256), 1, 16)
