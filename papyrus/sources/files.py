"""Single files by name: written from rows, listed and checked by Spark's binary file reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.operators.attempts import valid_payload


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row as a file of its own, in the tasks, to a folder that they share; (name, bytes) of what was written. A name may hold folders. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{base}/{file}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(data or b"")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, bytes long")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, is_pdf, no_paywall) of every file that ends in .pdf, in any case, in the folder and those below it. Folders are no files, whatever their names; empty files are.

    The reader gives no row for an empty file, so those come from the reader's own list of files, which the driver holds in any case.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    listed = spark.createDataFrame([(p,) for p in read.inputFiles()], "path string").select(plain.alias("path"))
    is_pdf, no_paywall = valid_payload(F.col("content"))
    found = read.select(plain.alias("path"), "length", is_pdf.alias("is_pdf"), no_paywall.alias("no_paywall"))
    full = listed.join(found, ["path"], "left")
    return full.select("path", F.substring_index("path", "/", -1).alias("name"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("is_pdf", F.lit(False)).alias("is_pdf"), F.coalesce("no_paywall", F.lit(True)).alias("no_paywall"))
