"""Metadata joins, identifier mapping, vocabularies and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import strip_suffix
from tessera.operators.binning import places
from tessera.operators.pairs import canonical_pairs


def attach_metadata(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """Left join of metadata; a key's first row by ``order`` counts, columns it lacks are left out silently."""
    wanted = [c for c in columns or right.columns if c in right.columns and c != key]
    first = right.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").select(key, *wanted)
    return left.join(first, key, "left")


def class_map(table: DataFrame, column: str, mapping: dict[str, str], name: str, curated: list[str] | None = None) -> DataFrame:
    """A looked-up class, null where unmapped or not among the curated classes."""
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col(column)]
    return table.withColumn(name, found if curated is None else F.when(found.isin(curated), found))


def expand_ids(links: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return links.join(mapping, key)


def unmapped(links: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return links.select(key).distinct().join(mapping.select(key), key, "left_anti")


def alias_pairs(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(a, b): both ends of (i, j) mapped to all their aliases (id, alias), as distinct canonical pairs.

    The distinct alias pairs are made after each side was reduced to distinct (edge end, alias).
    """
    left = edges.join(aliases.select(F.col("id").alias("i"), F.col("alias").alias("x")), "i").select("j", "x").distinct()
    return canonical_pairs(left.join(aliases.select(F.col("id").alias("j"), F.col("alias").alias("y")), "j").select("x", "y").distinct(), "x", "y")


def expand_complex(column: Column, prefix: str = "COMPLEX:", separator: str = "_") -> Column:
    """The members of a complex name, or the name alone, as an array."""
    return F.when(column.startswith(prefix), F.split(F.substring(column, len(prefix) + 1, 1_000_000), separator)).otherwise(F.array(column))


def complex_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    both = edges.select(F.explode(a).alias("x"), F.col(b)).select("x", F.explode(b).alias("y"))
    return canonical_pairs(both.where("x <> '' and y <> ''"), "x", "y")


def one_sided_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes of (g1, g2) as a nested loop finds them: first ends that are mapped, second ends only beside such a one."""
    a = edges.join(mapping.select(F.col("g").alias("g1"), F.col("acc").alias("x")), "g1")
    b = a.join(mapping.select(F.col("g").alias("g2"), F.col("acc").alias("y")), "g2")
    return a.select(F.col("x").alias("acc")).union(b.select("y")).distinct()


def missing_vectors(features: DataFrame, vectors: DataFrame, key: str, show: int = 10) -> DataFrame:
    """(n_missing, first): how many features lack a vector, and the first of them in order (null where none does)."""
    gone = features.select(key).distinct().join(vectors.select(key), key, "left_anti")
    first = gone.orderBy(key).limit(show).agg(F.nullif(F.array_join(F.sort_array(F.collect_list(key)), ","), F.lit("")).alias("first"))
    return gone.agg(F.count("*").alias("n_missing")).crossJoin(first)


def require_vectors(features: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The features with their vectors; raises with the number and the first ten of those that have none."""
    gone = missing_vectors(features, vectors, key).first()
    if gone.n_missing:
        raise ValueError(f"{gone.n_missing} features have no vector: {gone['first']}")
    return features.join(vectors, key)


def alphabetical(names: DataFrame, name: str) -> DataFrame:
    """(name, place): distinct names in the order of their bytes, from 0, however many share a prefix."""
    return places(names.where(F.col(name).isNotNull()), name)


def restrict_universe(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(idx, name, place): the entries of a vocabulary (idx, name) that a list of names has, renumbered in the vocabulary's own order.

    Unknown names are ignored; a name given twice counts once.
    """
    kept = vocabulary.join(wanted.select("name"), "name", "left_semi")
    return kept.join(places(kept, "idx"), "idx").select("idx", "name", "place")


def shared_universe(model: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, idx, label_idx, place): names that two vocabularies (idx, name) share, with both indices and their places in the first one's order."""
    kept = restrict_universe(model, labels)
    return kept.join(labels.select(F.col("idx").alias("label_idx"), "name"), "name").select("name", "idx", "label_idx", "place")


def known_accessions(entries: DataFrame, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Without rows whose accession is null, empty or marked unknown; isoform suffixes go."""
    kept = entries.where(F.coalesce(F.col(column), F.lit("")) != "").where(F.col(column) != unknown)
    return kept.withColumn(column, strip_suffix(F.col(column), "-"))


def vocabulary_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, fresh (only new) or dropped (only old)."""
    a, b = old.select(key).distinct().withColumn("o", F.lit(1)), new.select(key).distinct().withColumn("n", F.lit(1))
    status = F.when(F.col("o").isNull(), "fresh").when(F.col("n").isNull(), "dropped").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def keep_known(table: DataFrame, key: str, *vocabularies: DataFrame) -> DataFrame:
    return reduce(lambda t, v: t.join(v.select(key), key, "left_semi"), vocabularies, table)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(both, only_left, only_right) distinct keys."""
    return vocabulary_diff(left, right, key).agg(F.count_if(F.col("status") == "matched").alias("both"), F.count_if(F.col("status") == "dropped").alias("only_left"), F.count_if(F.col("status") == "fresh").alias("only_right"))


def priority_pick(entries: DataFrame, key: str, reviewed: Column, in_model: Column, order: str) -> DataFrame:
    """One entry a key: reviewed and in the model, else in the model, else reviewed, else the first."""
    rank = F.when(reviewed & in_model, 0).when(in_model, 1).when(reviewed, 2).otherwise(3)
    return entries.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(rank, order))).where("__n = 1").drop("__n")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """The primary mapping, and the fallback's rows for keys the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def pair_spotcheck(ids: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, shared) of all pairs of a short list, with 0 where they share nothing."""
    pairs = ids.select(F.col("p").alias("a")).join(ids.select(F.col("p").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(shared.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "shared"), ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def nodes(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
