"""Column functions: seeded keys, identifiers, text clean-up, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tie_key(seed: int, *columns: str | Column) -> Column:
    """A reproducible random sort key of a row's own key: independent of partitions, order and engine."""
    return F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns], F.lit(str(seed))))


def draw(n: Column, seed: int, *columns: str | Column) -> Column:
    """A reproducible random integer in 1..n of a row's own key (32 bits of its md5)."""
    return (F.conv(F.substring(tie_key(seed, *columns), 1, 8), 16, 10).cast("long") % n + 1).cast("long")


def rank_to_bin(rank: Column, n: Column, bins: int) -> Column:
    """ceil(rank / n * bins), in double and in that order of operations."""
    return F.ceil(rank.cast("double") / n * F.lit(float(bins))).cast("int")


def split_clean(text: Column, separator: str = ";") -> Column:
    """The distinct, trimmed, non-empty parts of a separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != ""))


def strip_suffix(text: Column, mark: str) -> Column:
    """What precedes the first ``mark`` (a version or an isoform suffix); all of it where there is none."""
    return F.split_part(text, F.lit(mark), F.lit(1))


def parse_head(text: Column) -> tuple[Column, Column]:
    """(layer, head) of a name like ``l1h3`` in either case; null where it isn't one."""
    pattern = r"^[lL](\d+)[hH](\d+)$"
    fits = text.rlike(pattern)
    return F.when(fits, F.regexp_extract(text, pattern, 1).cast("int")), F.when(fits, F.regexp_extract(text, pattern, 2).cast("int"))


def human_size(mb: Column) -> Column:
    """Megabytes as text: GB with two digits from 1024 MB on, else MB with one digit."""
    return F.when(mb >= 1024, F.format_string("%.2f GB", mb / 1024.0)).otherwise(F.format_string("%.1f MB", mb))


def first_filled(text: Column, *others: Column) -> Column:
    """The first that is neither null nor empty; else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, *others)], F.lit(""))


def ensembl_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"ENSG\d+"), F.lit(0))


def gene_name(header: Column) -> Column:
    """The ``GN=`` token of a FASTA header; null where there is none."""
    return F.nullif(F.regexp_extract(header, r"GN=(\S+)", 1), F.lit(""))


def kegg_id(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("up:"), F.lit("")), F.lit("path:"), F.lit(""))


def pathway_name(text: Column, species: str = " - Homo sapiens") -> Column:
    return F.trim(F.split_part(text, F.lit(species), F.lit(1)))


def truncated(sequence: Column, longest: int = 2048) -> Column:
    return F.substring(sequence, 1, longest)


def names_fingerprint(names: Column) -> Column:
    """The first 16 hex digits of the sha1 of an ordered array of names, each closed by a NUL."""
    return F.substring(F.sha1(F.concat(F.array_join(names, "\0"), F.lit("\0"))), 1, 16)
