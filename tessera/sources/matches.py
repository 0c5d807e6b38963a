"""Search-engine results in three formats as one table of matches.

A file's format is told by its first bytes, never by its name: mzIdentML (XML), mzTab (lines that begin with a section), or a
separated table with a header.  All give (run, is_decoy, proteins), a row a match, the run named by the file; what follows
(``parsers.spectrum_counts``) needs no more.

Files are read by Spark's own line and XML sources, in splits, so a large file is many tasks.  In mzIdentML a match names
its peptide evidence and that its protein by reference, so three kinds of elements are read and joined within
their file.  Matches without a protein have an empty list.  A file of none of the formats is an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the formats: first bytes, sections, and the columns that hold a match's proteins and whether it is a decoy.
MZTAB_HEADER, MZTAB_ROW = "PSH", "PSM"
MZTAB_DECOY = ("opt_global_cv_MS:1002217_decoy_peptide", "opt_global_cv_PRIDE:0000303_decoy_hit", "opt_global_is_decoy")
TABLE_PROTEINS, TABLE_DECOY = "protein_list", "is_decoy"

HEAD = 512


def run_of(path: Column) -> Column:
    """The name of a file without its folder and what follows the first dot."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^/]*)?$", 1)


def formats(spark: SparkSession, path: str) -> dict[str, str]:
    """{file: format} of the files at ``path``, by their first bytes (only these are read)."""
    try:
        files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names, not contents
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(path) from e
    if not files:
        raise ValueError(f"{path} holds no file with content: neither mzIdentML nor mzTab nor a table")
    found = {}
    for file in files:
        place = spark._jvm.org.apache.hadoop.fs.Path(file)
        stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
        try:
            head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD))).removeprefix(b"\xef\xbb\xbf").lstrip()
        finally:
            stream.close()
        first = head.split(b"\n", 1)[0].rstrip(b"\r").split(b"\t")
        if head.startswith(b"<") and b"<MzIdentML" in head:
            found[file] = "mzid"
        elif first[0] in (b"MTD", b"COM", MZTAB_HEADER.encode()):
            found[file] = "mztab"
        elif {TABLE_PROTEINS.encode(), TABLE_DECOY.encode()} <= set(first):
            found[file] = "table"
        else:
            raise ValueError(f"{file} is neither mzIdentML nor mzTab nor a table with {TABLE_PROTEINS} and {TABLE_DECOY}")
    return found


def _truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "t", "yes"), F.lit(False))


def _names(text: Column) -> Column:
    """Names listed with commas, semicolons or as a bracketed, quoted list."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]'\" ]", "")
    return F.array_distinct(F.filter(F.split(bare, "[,;]"), lambda x: (x != "") & (x != "null")))


def read_table(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).csv(files)
    return rows.select(run_of(F.input_file_name()).alias("run"), _truth(F.col(TABLE_DECOY)).alias("is_decoy"), _names(F.col(TABLE_PROTEINS)).alias("proteins"))


def read_mztab(spark: SparkSession, files: list[str]) -> DataFrame:
    """The match section; a match with several proteins has a row for each, which its identifier joins again."""
    lines = spark.read.text(files).select(F.input_file_name().alias("file"), F.split("value", "\t").alias("f"))
    columns = lines.where(F.col("f")[0] == MZTAB_HEADER).groupBy("file").agg(F.first("f").alias("names"))  # one row a file
    rows = lines.where(F.col("f")[0] == MZTAB_ROW).join(F.broadcast(columns), "file", "left")

    def field(name: str) -> Column:
        at = F.array_position("names", name)
        return F.when(at > 0, F.get("f", (at - 1).cast("int")))

    decoy = F.coalesce(*[field(n) for n in MZTAB_DECOY])
    checked = rows.select("file", F.when(F.col("names").isNull(), F.raise_error(F.concat(F.lit("no header of matches in "), "file"))).otherwise(field("PSM_ID")).alias("id"), _truth(decoy).alias("d"), _names(field("accession")).alias("p"))
    whole = checked.groupBy("file", "id").agg(F.bool_and("d").alias("is_decoy"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("proteins"))
    return whole.select(run_of(F.col("file")).alias("run"), "is_decoy", "proteins")


def read_mzid(spark: SparkSession, files: list[str]) -> DataFrame:
    def elements(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(files).withColumn("file", F.input_file_name())

    proteins = elements("DBSequence", "_id string, _accession string").select("file", F.col("_id").alias("protein"), F.col("_accession").alias("accession"))
    evidence = elements("PeptideEvidence", "_id string, _dBSequence_ref string, _isDecoy string").select("file", F.col("_id").alias("evidence"), F.col("_dBSequence_ref").alias("protein"), _truth(F.col("_isDecoy")).alias("d"))
    matches = elements("SpectrumIdentificationItem", "_id string, PeptideEvidenceRef array<struct<_peptideEvidence_ref:string>>")
    named = matches.select("file", F.col("_id").alias("id"), F.explode_outer("PeptideEvidenceRef._peptideEvidence_ref").alias("evidence"))
    met = named.join(evidence, ["file", "evidence"], "left").join(proteins, ["file", "protein"], "left")
    whole = met.groupBy("file", "id").agg(F.coalesce(F.bool_and("d"), F.lit(False)).alias("is_decoy"), F.array_sort(F.collect_set("accession")).alias("proteins"))
    return whole.select(run_of(F.col("file")).alias("run"), "is_decoy", "proteins")


READERS = {"table": read_table, "mztab": read_mztab, "mzid": read_mzid}


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(run, is_decoy, proteins) of all files at ``path``, each in its own format; a match is a decoy if all its evidence is."""
    found = formats(spark, path)
    parts = [read(spark, [f for f, kind in found.items() if kind == name]) for name, read in READERS.items() if name in found.values()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
