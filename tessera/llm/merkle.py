"""A Merkle manifest of a table: a tree a group of rows, a tree over the groups' roots, and a proof a row.

A leaf is the digest of a row's fields.  In each group leaves ascend by id; while more than one node is left,
every ``fanout`` consecutive ones (the last run: fewer, even one) become the digest of their concatenation.
The groups' roots, in the order of the groups (null first, then by bytes), are reduced likewise to one root.

Superblocks: a node belongs to the bucket ``place // fanout**levels``, and one ``applyInPandas`` call collapses
``levels`` levels of a bucket, so a bucket is bounded whatever the group, and a hot group is as many buckets as
it needs.  Bucket roots are the nodes of the next round; a round divides the rows by ``fanout**levels`` (2,187), so
there are few.  Rows of groups that fill no bucket share calls.  Proofs come back down by the same buckets: a
bucket's own siblings are put before the proof of its root, which travels once a bucket, not once a row; a row leaves
with the digest of its proof.  No task holds more than some buckets, and the driver only the number of rounds.

Null fields are ``-``; rows with a null id come first in their group and are never altered; rows of one id are
leaves of their own, ordered by leaf; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, write_table
from tessera.operators.ranges import place

FANOUT, LEVELS = 3, 7
NODE = "tree string, idx long, n long, digest string"
PROOF = "array<struct<before:string,after:string>>"
ABOVE = f"tree string, idx long, proof {PROOF}, subroot string, root string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256)


def depth(n: int, fanout: int) -> int:
    """Levels from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(digests: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a bucket level by level, up to its root; ``n`` is the number of nodes in the whole tree."""
    rows = [digests]
    for _ in range(min(levels, depth(n, fanout))):
        below = rows[-1]
        rows.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return rows


def buckets(pdf: pd.DataFrame, span: int) -> Iterator[tuple[str, int, int, pd.DataFrame]]:
    """(tree, bucket, nodes in the tree, rows by place) of each bucket in a call."""
    for (tree, bucket), part in pdf.groupby(["tree", pdf["idx"] // span], sort=False):
        yield tree, int(bucket), int(part["n"].iloc[0]), part.sort_values("idx")


def dealt(nodes: DataFrame, small: int, span: int) -> DataFrame:
    """``nodes`` with what a call is made of: a bucket of a tree, or the small trees of a share of ``small`` nodes."""
    share = max(1, -(-small // span))
    key = F.xxhash64("tree")
    return nodes.withColumn("shard", F.when(F.col("n") <= span, F.pmod(key, F.lit(share))).otherwise(key)).withColumn("bucket", F.floor(F.col("idx") / span))


def rise(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The bucket roots, as the nodes of the next round."""
    span = fanout**levels

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(tree, bucket, -(-n // span), collapse(rows["digest"].tolist(), n, fanout, levels)[-1][0]) for tree, bucket, n, rows in buckets(pdf, span)]
        return pd.DataFrame(out, columns=["tree", "idx", "n", "digest"])

    return nodes.select("shard", "bucket", "tree", "idx", "n", "digest").groupBy("shard", "bucket").applyInPandas(up, NODE)


def rounds_of(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Nodes of each round, dealt into calls; the last round has one node a tree, its root."""
    span = fanout**levels
    size = nodes.agg(F.max("n").alias("most"), F.count_if(F.col("n") <= span).alias("small")).first()
    found, most = [dealt(nodes, size.small, span)], size.most or 1
    while most > 1:
        most = -(-most // span)
        above = write_table(rise(found[-1], fanout, levels), "superblocks")
        found.append(dealt(above, above.where(F.col("n") <= span).count(), span))
    return found


def siblings(rows: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """For each level the digests before and after the node's own in its run."""
    out = []
    for level in rows[:-1]:
        lo = at - at % fanout
        out.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + fanout])))
        at //= fanout
    return out


def fall(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, schema: str, emit: Callable[[pd.Series, list[tuple[str, str]], pd.Series], tuple]) -> DataFrame:
    """One row a node: ``emit`` gets the node, its proof to the root of all, and the row of ``above`` for its bucket."""
    span = fanout**levels
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def down(pdf: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        top = {(t.tree, t.idx): t for t in tops.itertuples(index=False)}
        out = []
        for tree, bucket, n, part in buckets(pdf, span):
            rows, over = collapse(part["digest"].tolist(), n, fanout, levels), top[tree, bucket]
            upper = [(x["before"], x["after"]) for x in over.proof]
            for at, node in enumerate(part.itertuples(index=False)):
                out.append(emit(node, siblings(rows, at, fanout) + upper, over))
        return pd.DataFrame(out, columns=columns)

    # A bucket's root meets the bucket: the shard of the node below it is that of its tree in this round.
    keys = nodes.select(F.col("tree").alias("of"), F.col("shard").alias("call"), F.col("bucket").alias("part")).distinct()
    sent = above.join(keys, (F.col("tree") == F.col("of")) & (F.col("idx") == F.col("part")))
    sent = sent.select(F.col("call").alias("shard"), F.col("part").alias("bucket"), *above.columns)
    return nodes.groupBy("shard", "bucket").cogroup(sent.groupBy("shard", "bucket")).applyInPandas(down, schema)


def proofs(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, idx, proof, subroot, root) of each node of the second round, from those of the last one."""

    def emit(node, proof, over) -> tuple:
        return node.tree, node.idx, [{"before": a, "after": b} for a, b in proof], over.subroot, over.root

    for nodes in reversed(rounds[1:-1]):
        above = write_table(fall(nodes, above, fanout, levels, ABOVE, emit), "proofs")
    return above


def manifest(docs: DataFrame, fields: list[str], id_col: str, tree_col: str, altered: Callable[[Column], Column] | None = None, text_col: str = "text", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) a row of ``docs``.

    ``altered`` gives the text as it was found later (null where it is as before): ``folded_root`` is what that row's leaf
    and the proof's digests come to, and ``verified`` whether it is the root.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    later = [altered(F.col(text_col)) if altered and f == text_col else F.col(f) for f in fields]
    own = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("+"), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),  # null first, never null
        leaf([F.col(f) for f in fields]).alias("digest"),
        (F.when(altered(F.col(text_col)).isNotNull(), leaf(later)) if altered else F.lit(None).cast("string")).alias("altered"),
    )
    leaves = write_table(own, "leaves")
    nodes = write_table(place(leaves, ["id", "digest"], "idx", within=["tree"], total="n").withColumn("id", F.col("id").cast("string")), "leaves")
    rounds = rounds_of(nodes, fanout, levels)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    trees = write_table(place(subroots, ["tree"], "idx", total="n").select(F.lit("").alias("tree"), "idx", "n", F.col("subroot").alias("digest"), F.col("tree").alias("id")), "trees")
    over = rounds_of(trees, fanout, levels)
    nothing = F.array().cast(PROOF).alias("proof")
    if len(over) > 1:

        def tops(node, proof, above) -> tuple:
            return node.id, 0, [{"before": a, "after": b} for a, b in proof], node.digest, above.root

        root = over[-1].select("tree", "idx", nothing, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        root = write_table(fall(over[0], proofs(over, root, fanout, levels), fanout, levels, ABOVE, tops), "proofs")
    else:  # one tree, or none
        root = trees.select(F.col("id").alias("tree"), "idx", nothing, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    above = proofs(rounds, root, fanout, levels)

    def row(node, proof, top) -> tuple:
        folded = node.altered if isinstance(node.altered, str) else node.digest
        for before, after in proof:
            folded = sha(before + folded + after)
        return node.id, node.digest, top.subroot, top.root, sha("".join(a + b for a, b in proof)), folded, folded == top.root

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = fall(rounds[0], above, fanout, levels, schema, row)
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in found.columns if c != "id"])


def without_newlines(id_col: str = "doc_id") -> Callable[[Column], Column]:
    """The text without its line feeds, where the unsigned crc32 of the id is even; null (unaltered) elsewhere."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return lambda text: F.when(even, F.replace(text, F.lit("\n"), F.lit("")))
