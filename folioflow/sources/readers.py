"""Sources and sinks: layout relations, uploads, notes, archives, and pluggable decoders."""

from __future__ import annotations

import importlib
import importlib.util
import io
import logging
import os
import shutil
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioflow.functions import text as T
from folioflow.params import PARAMS
from folioflow.schemas import LAYOUT_LINES

log = logging.getLogger(__name__)
#: The compression names of the archive and the presets they stand for.
COMPRESSION = {"menor": "prepress", "media": "ebook", "maior": "screen"}


def read_layout(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Laid-out lines that were extracted before, with the explicit schema."""
    return spark.read.schema(LAYOUT_LINES).format(kind).load(path)


def read_uploads(spark: SparkSession, path: str, route: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files: PDF files with hash, slug and display name; others with the reason."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("original_filename"), "length", "modificationTime", "content").withColumn("route", F.lit(route))
    good = F.lower("original_filename").endswith(".pdf")
    accepted = rows.where(good).select("route", "path", "original_filename", T.slugify(F.col("original_filename")).alias("slug"), T.display_name(F.col("original_filename")).alias("display_name"), T.file_hash(F.col("content")).alias("file_hash"))
    return accepted, rows.where(~good).select("route", "original_filename", F.lit("only PDF files are accepted").alias("error"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of Markdown files, one row each."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as Parquet, (doc_id, note); one file system object per document would not scale."""
    notes.write.mode("overwrite").option("compression", "zstd").parquet(path)


def scanned_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, text) with too little native text, which an OCR adapter has to read."""
    return pages.where(F.length(T.strip(F.coalesce("text", F.lit("")))) < PARAMS.ocr_min_chars)


def recognise(rows: DataFrame, read: Callable[[bytes], str], image: str = "image") -> DataFrame:
    """rows with text, what read makes of each picture, in place of the picture; empty where it fails or there is none.

    read is an adapter of an OCR program; it is called on the executors, a batch of rows at a time.
    """

    def run(batches):
        for batch in batches:
            texts = []
            for picture in batch.column(image).to_pylist():
                try:
                    texts.append(read(picture) if picture else "")
                except Exception as e:  # a figure that can't be read is no reason to lose the document
                    log.warning("picture not read: %s", e)
                    texts.append("")
            kept = [n for n in batch.schema.names if n != image]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "text"])

    fields = [f for f in rows.schema.fields if f.name != image]
    return rows.mapInArrow(run, S.StructType([*fields, S.StructField("text", S.StringType())]))


def splice_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages with the OCR text appended where the native text (without image links) is too short."""
    bare = T.strip(T.sub(F.coalesce("text", F.lit("")), r"!\[\]\([^\n]+\)"))
    met = pages.join(ocr.select("doc_id", "page_index", F.col("text").alias("ocr")), ["doc_id", "page_index"], "left")
    short = (F.length(bare) < PARAMS.ocr_min_chars) & F.col("ocr").isNotNull()
    return met.withColumn("text", F.when(short, T.strip(F.concat_ws("\n\n", F.col("text"), F.col("ocr")))).otherwise(F.col("text"))).drop("ocr")


def archive(note_name: str, note: str, images: dict[str, bytes], original: tuple[str, bytes], level: str = "media") -> bytes:
    """The ZIP of one job: note, images by name, original file; level names the compression of the original."""
    if level not in COMPRESSION:
        raise ValueError(f"unknown compression {level!r}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        z.writestr(note_name, note)
        for name in sorted(images):
            z.writestr(f"images/{name}", images[name])
        z.writestr(*original)
    return out.getvalue()


def compression_command(source: str, target: str, level: str = "media") -> list[str]:
    """The Ghostscript call that compresses a PDF; running it needs that program."""
    return ["gs", "-sDEVICE=pdfwrite", f"-dPDFSETTINGS=/{COMPRESSION[level]}", "-dNOPAUSE", "-dQUIET", "-dBATCH", f"-sOutputFile={target}", source]


def replace_file(path: str, text: str) -> None:
    """A file's new text, whole or not at all: the old one is kept beside it with .bak, the new one is written beside it and moved there."""
    if os.path.exists(path):
        shutil.copy2(path, path + ".bak")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


def keep_original(upload: str, folder: str) -> str:
    """The upload's copy in a job's folder."""
    os.makedirs(folder, exist_ok=True)
    return shutil.copy2(upload, os.path.join(folder, "original.pdf"))


def pairs(spark: SparkSession, notes: str, originals: str) -> DataFrame:
    """(name, text, pdf_path): notes with the files that they come from, met by canonical name."""
    files = spark.read.format("binaryFile").load(originals).select(F.col("path").alias("pdf_path"))
    files = files.where(F.lower("pdf_path").endswith(".pdf")).withColumn("name", T.canonical_name(F.col("pdf_path")))
    return read_notes(spark, notes).withColumn("name", T.canonical_name(F.col("path"))).join(files, "name").select("name", "text", "pdf_path")


class PageRange(InputPartition):
    def __init__(self, path: str, first: int, last: int, doc: int = 0) -> None:
        self.path, self.first, self.last, self.doc = path, first, last, doc


class PdfLayout(DataSource):
    """Laid-out lines of PDF files, one partition for each range of pages; needs a decoder named by the option backend.

    Documents are numbered by their place in the option paths, from the option doc_id on.  The backend is a module with page_count(path) and spans(path, page) -> (width, height, [line of spans]).
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_layout"

    def schema(self):
        return LAYOUT_LINES

    def reader(self, schema):
        return PdfReader(dict(self.options))


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        backend = options.get("backend", "")
        if not backend or importlib.util.find_spec(backend) is None:
            raise RuntimeError(f"no PDF backend {backend!r}: set the option backend to a module with page_count and spans")
        self.options, self.backend = options, backend

    def partitions(self):
        module = importlib.import_module(self.backend)
        step, out = int(self.options.get("pages_per_task", 16)), []
        for doc, path in enumerate(self.options["paths"].split(","), int(self.options.get("doc_id", 0))):
            n = module.page_count(path)
            out += [PageRange(path, a, min(n, a + step), doc) for a in range(0, n, step)]
        return out

    def read(self, partition):
        module = importlib.import_module(self.backend)
        for page in range(partition.first, partition.last):
            width, height, found = module.spans(partition.path, page)
            for k, spans in enumerate(found):
                yield (partition.doc, page, k, True, width, height, spans)
