"""Scalar functions over lineage strings, accessions and file names (expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of the ten-rank form and their prefixes; the seven-rank form leaves out l, k and S.
RANKS = ("d", "l", "k", "p", "c", "o", "f", "g", "s", "S")


def rank_token(lineage: Column, rank: str) -> Column:
    """`g__Name` of a lineage; null where the rank is missing or bare."""
    token = F.regexp_extract(lineage, f"(?:^|;)({rank}__[^;]*)", 1)
    return F.when(F.length(token) > 3, token)


def taxon_bucket(lineage: Column, rank: str = "g", keep_bare: bool = False) -> Column:
    """The token of the rank, else of the next coarser one that is there (family, order, class). A token without a name counts as there:
    it gives __unclassified__, or with keep_bare (as re-sharding does) itself."""
    coarser = {"g": "gfoc"}.get(rank, f"{rank}oc")
    token = F.coalesce(*[F.nullif(F.regexp_extract(lineage, f"({r}__[^;]*)", 1), F.lit("")) for r in coarser])
    named = token if keep_bare else F.when(F.length(token) > 3, token)
    return F.coalesce(named, F.lit("__unclassified__"))


def strip_source(accession: Column) -> Column:
    return F.regexp_replace(accession, "^(RS|GB)_", "")


def accession_stem(accession: Column) -> Column:
    """GCF_/GCA_ accessions without what follows their last point."""
    a = strip_source(accession)
    return F.when(a.rlike("^GC[FA]_"), F.regexp_replace(a, r"\.[^.]*$", "")).otherwise(a)


def strip_extensions(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.(gz|fasta|fna|faa|fa))+$", "")


def ten_ranks(lineage: Column, accession: Column) -> Column:
    """Ten-rank form of a lineage of seven ranks. Missing or bare ranks from l to g take the name of the rank above; a missing species is
    the accession's stem; the strain rank always repeats the species. Lineages that have rank l are in that form and stay."""
    given = F.coalesce(lineage, F.lit(""))
    out, above = [], F.lit("")
    for r in RANKS:
        own = F.substring(rank_token(given, r), 4, 1 << 20)
        if r == "s":
            above = F.coalesce(own, accession_stem(accession))
        elif r != "S":
            above = F.coalesce(own, above)
        out.append(F.concat(F.lit(f"{r}__"), above))
    return F.when(given.startswith("l__") | given.contains(";l__"), given).otherwise(F.concat_ws(";", *out))


# Prefixes of release ranks by the names of the other source's ranks, the clades that fill rank l, and the
# tokens that name no taxon.
SOURCE_RANKS = {"superkingdom": "d", "kingdom": "k", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s", "subspecies": "S"}
LINEAGE_CLADES = ("Opisthokonta", "Viridiplantae", "SAR", "Discoba", "Amoebozoa", "Haptista", "Cryptista", "Rhodophyta")
GENERIC_TOKENS = ("unclassified", "environmental samples", "other sequences", "artificial sequences", "cellular organisms", "root", "metagenomes", "unidentified")


def ranked_lineage(lineage: Column, accession: Column) -> Column:
    """Ten-rank form of a lineage of array<struct<rank, name>>, root first, with the ranks of a taxonomy dump.

    The last taxon of a rank counts, the first clade of LINEAGE_CLADES fills rank l; missing ranks from l to g take the name above; a
    missing species is the genus and " unclassified", and where there is no genus either, the accession stands at every rank below d.
    """
    def last(rank: str) -> Column:
        names = F.transform(F.filter(lineage, lambda x: x["rank"] == rank), lambda x: x["name"])
        return F.nullif(F.try_element_at(names, F.lit(-1)), F.lit(""))

    by_prefix = {p: last(rank) for rank, p in SOURCE_RANKS.items()}
    clades = F.transform(F.filter(lineage, lambda x: x["name"].isin(*LINEAGE_CLADES)), lambda x: x["name"])
    by_prefix["l"] = F.try_element_at(clades, F.lit(1))
    names: dict[str, Column] = {"d": by_prefix["d"]}
    for above, r in zip("dlkpcof", "lkpcofg", strict=True):
        names[r] = F.coalesce(by_prefix[r], names[above])
    alone = by_prefix["s"].isNull() & names["g"].isNull()
    species = F.coalesce(by_prefix["s"], F.concat(names["g"], F.lit(" unclassified")), accession)
    out = [F.concat(F.lit("d__"), F.coalesce(names["d"], F.lit("")))]
    out += [F.concat(F.lit(f"{r}__"), F.when(alone, accession).otherwise(F.coalesce(names[r], F.lit("")))) for r in "lkpcofg"]
    out += [F.concat(F.lit("s__"), species), F.concat(F.lit("S__"), species)]
    return F.concat_ws(";", *out)


# Names that each genome type goes by; anything else is nuclear.
GENOME_TYPES = {"mitochondrion": ("mitochondrion", "mitochondria", "mt"), "plastid": ("plastid", "chloroplast", "cp"), "plasmid": ("plasmid",), "virus": ("virus", "viral"), "phage": ("phage",)}


def genome_type(text: Column) -> Column:
    out = F
    for name, known in GENOME_TYPES.items():
        out = out.when(text.isin(*known), name)
    return out.otherwise("nuclear")


def shown(value: Column, digits: int = 4) -> Column:
    """Fixed decimals, NA for null or NaN."""
    return F.when(value.isNull() | F.isnan(value), "NA").otherwise(F.format_string(f"%.{digits}f", value))
