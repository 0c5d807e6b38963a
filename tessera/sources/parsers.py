"""Text formats of annotation sources, as DataFrame transformations of ``spark.read`` scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ensembl_ids, gene_name

#: Fixed by the format: the 17 columns of a gene association file.
GAF_COLUMNS = (
    "db", "accession", "symbol", "qualifier", "go_id", "reference", "evidence", "with_from", "aspect",
    "name", "synonym", "type", "taxon", "date", "assigned_by", "extension", "product_form",
)


def read_separated(spark: SparkSession, path: str, schema: str, separator: str = "\t", header: bool = True) -> DataFrame:
    """A table with a declared schema; gzip is read as it is."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).csv(path)


def read_range(spark: SparkSession, path: str, low: int, high: int, column: str = "sample") -> DataFrame:
    """The rows of low <= column < high of a long table; files and row groups outside the range are skipped."""
    return spark.read.parquet(path).where((F.col(column) >= low) & (F.col(column) < high))


def expression_source(spark: SparkSession, source) -> DataFrame:
    """A long table (sample, feature, v) from a path, a DataFrame, or a pandas frame."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.parquet(source) if isinstance(source, str) else spark.createDataFrame(source)


def read_manual(spark: SparkSession, path: str, hint: str = "") -> DataFrame:
    """(path, text) of files that have to be put there by hand, gzipped or not by their first bytes; a missing one is an error that says how to get it."""
    import gzip
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column(1)]
            texts = [(gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x).decode() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"{path} is missing. {hint}".strip()) from e
    return files.mapInArrow(run, "path string, text string")


def parse_gaf(lines: DataFrame) -> DataFrame:
    """Annotation lines of at least 15 fields, padded to 17; comments (``!``) are dropped."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("!")).select(parts.alias("f")).where(F.size("f") >= 15)
    return rows.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(GAF_COLUMNS)])


def keep_evidence(rows: DataFrame, codes: list[str]) -> DataFrame:
    return rows.where(F.col("evidence").isin(codes))


def drop_negated(rows: DataFrame, any_case: bool = True) -> DataFrame:
    """Without rows whose qualifier says NOT, in any case or in capitals only; a null qualifier says nothing."""
    q = F.coalesce("qualifier", F.lit(""))
    return rows.where(~(F.upper(q) if any_case else q).contains("NOT"))


def parse_pathways(lines: DataFrame, species: str | None = None) -> DataFrame:
    """(accession, pathway, url, name, evidence, species) from tab-separated lines of six fields or more, trimmed."""
    f = F.split("value", "\t")
    names = ("accession", "pathway", "url", "name", "evidence", "species")
    rows = lines.where(F.size(f) >= 6).select(*[F.trim(f[i]).alias(c) for i, c in enumerate(names)])
    return rows if species is None else rows.where(F.col("species") == species)


def parse_two_columns(lines: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Lines of exactly two tab-separated parts; blank ones are dropped."""
    f = F.split(F.trim("value"), "\t")
    return lines.where((F.trim("value") != "") & (F.size(f) == 2)).select(f[0].alias(a), f[1].alias(b))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, gene, length, sequence, header) of FASTA records; of equal accessions the last of a file wins.

    Records are split where a line starts with ``>``, so a record is one row whatever its number of lines, and a
    ``>`` inside a header stays.
    """
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id())
    records = records.withColumn("value", F.regexp_replace("value", r"^(\s*>)|\r", "")).where(F.trim("value") != "")
    header = F.trim(F.split_part("value", F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s", "")
    sequence = F.when(F.instr("value", "\n") > 0, body).otherwise("")
    accession = F.when(F.size(F.split(header, r"\|")) >= 2, F.split_part(header, F.lit("|"), F.lit(2))).otherwise(F.split_part(header, F.lit(" "), F.lit(1)))
    rows = records.select(accession.alias("accession"), gene_name(header).alias("gene"), F.length(sequence).alias("length"), sequence.alias("sequence"), header.alias("header"), "at")
    last = F.max_by(F.struct("gene", "length", "sequence", "header"), "at")
    return rows.groupBy("accession").agg(last.alias("r")).select("accession", "r.*")


def gene_crossrefs(rows: DataFrame, accession: str, text: str) -> DataFrame:
    """(gene, accession): each Ensembl gene id named in a cross-reference text, without its version."""
    return rows.select(F.explode(F.array_distinct(ensembl_ids(F.col(text)))).alias("gene"), F.col(accession).alias("accession"))


def spectrum_counts(psms: DataFrame, decoy_prefixes: tuple[str, ...] = ("CON__", "REV__")) -> DataFrame:
    """(run, accession, n) from (run, is_decoy, proteins): a match counts for each of its proteins; decoys and contaminants don't."""
    rows = psms.where(~F.coalesce("is_decoy", F.lit(False))).select("run", F.explode("proteins").alias("accession"))
    for prefix in decoy_prefixes:
        rows = rows.where(~F.col("accession").startswith(prefix))
    return rows.groupBy("run", "accession").agg(F.count("*").alias("n"))


def dense_to_long(matrix: DataFrame, sample: str = "sample", values: str = "values") -> DataFrame:
    """(sample, feature, v) from dense rows: 1-based features, values above 0."""
    return matrix.select(F.col(sample).alias("sample"), F.posexplode(values).alias("at", "v")).where("v > 0").select("sample", (F.col("at") + 1).cast("long").alias("feature"), "v")
