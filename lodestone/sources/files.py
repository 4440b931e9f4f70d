"""File sources: extension router, text with encoding fallback and page slices, DOCX, images, and their page estimates."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from lodestone.sources import paged

CHARS_PER_PAGE, LINES_PER_PAGE, WORDS_PER_PAGE, SECTIONS_PER_PAGE = 3000, 55, 450, 15
TEXT, IMAGE = (".txt", ".md", ".csv", ".json", ".log"), (".png", ".jpg", ".jpeg", ".webp", ".bmp")
INSPECT_IMAGE, INSPECT_TEXT = (*IMAGE, ".gif", ".svg", ".tiff"), (*TEXT, ".py", ".html", ".js")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def route(path: Column) -> Column:
    """Parser of a path; unknown extensions are read as text."""
    e = extension(path)
    return F.when(e.isin(*TEXT), "text").when(e == ".docx", "docx").when(e == ".pdf", "pdf").when(e.isin(*IMAGE), "image").otherwise("text")


def line_count(text: Column) -> Column:
    """Lines as splitlines counts them; a closing line feed opens no further line."""
    body = F.regexp_replace(text, r"\n$", "")
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(body, "\n", -1)))


def page_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / CHARS_PER_PAGE), F.ceil(line_count(text) / LINES_PER_PAGE)).cast("int")


def page_slice(text: Column, start: int | None, end: int | None) -> Column:
    """Lines of pages start..end; an inverted range, or one past the end, gives the whole text."""
    total = page_estimate(text)
    s = F.lit(max(1, start) if start is not None else 1)
    e = F.least(total, F.lit(end)) if end is not None else total
    s, e = F.when(s > e, 1).otherwise(s), F.when(s > e, total).otherwise(e)
    lines = F.split(text, "\n", -1)
    first = (s - 1) * LINES_PER_PAGE
    cut = F.array_join(F.slice(lines, first + 1, (e - s + 1) * LINES_PER_PAGE), "\n")
    return F.regexp_replace(F.when(first < line_count(text), cut).otherwise(text), r"^\s+|\s+$", "")


def section_pages(words: Column, sections: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / WORDS_PER_PAGE), F.ceil(sections / SECTIONS_PER_PAGE)).cast("int")


def section_slice(sections: Column, total: Column, start: Column, end: Column) -> Column:
    """Proportional slice of a document's sections for pages start..end of total."""
    n = F.size(sections)
    lo = F.floor((start - 1) / total * n).cast("int")
    hi = F.least(n, F.ceil(end / total * n).cast("int"))
    return F.slice(sections, lo + 1, F.greatest(F.lit(0), hi - lo))


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_path, file_type, text_content, char_count, total_pages) of text files."""
    t = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(decoded(F.col("content")), "\r\n?", "\n").alias("raw"))
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return t.select(name.alias("filename"), F.col("path").alias("file_path"), F.ltrim(extension(F.col("path")), F.lit(".")).alias("file_type"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text_content"), F.length("raw").alias("char_count"), page_estimate(F.col("raw")).alias("total_pages"))


def inspect(files: DataFrame) -> DataFrame:
    """(filename, pages, is_image, file_type, rejected) of (filename, content): audio and video are rejected, images have one page."""
    from lodestone.operators.prompts import AUDIO_VIDEO

    e, n = extension(F.col("filename")), F.length("content")
    text = decoded(F.col("content"))
    pages = F.when(e.isin(*INSPECT_IMAGE), 1).when(e.isin(*INSPECT_TEXT), page_estimate(text)).when(e == ".docx", F.round(n / 25000)).when(e == ".pdf", F.round(n / 102400)).otherwise(F.round(n / 3000))
    return files.select("filename", F.greatest(F.lit(1), pages).cast("int").alias("pages"), e.isin(*INSPECT_IMAGE).alias("is_image"), F.when(e.isin(*INSPECT_IMAGE), "image").otherwise(F.substring(e, 2, 20)).alias("file_type"), e.isin(*AUDIO_VIDEO).alias("rejected"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_sections(content: bytes) -> list[str]:
    """Non-blank paragraphs, then each table as lines of "a | b", of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [s for p in body.findall(f"{_W}p") if (s := words(p).strip())]
    for t in body.findall(f"{_W}tbl"):
        lines = [" | ".join(words(c).strip() for c in r.findall(f"{_W}tc")) for r in t.findall(f"{_W}tr")]
        out.append("\n".join(x for x in lines if x.replace("|", "").strip()))
    return [s for s in out if s]


def docx_images(content: bytes) -> list[tuple[str, bytes]]:
    """(file name, bytes) of the images a DOCX file embeds, in order of name and number."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.startswith("word/media/")]
        number = lambda n: int("".join(c for c in n if c.isdigit()) or 0)
        return [(n.rsplit("/", 1)[1], z.read(n)) for n in sorted(names, key=lambda n: (number(n), n))]


def image_section(filename: str, number: int, name: str) -> str:
    """The section that stands for an embedded image."""
    stem = re.sub(r"[^\w]|_", "_", re.sub(r"\.[^.]*$", "", filename))
    ending = "." + name.rpartition(".")[2] if "." in name else ""
    return f"[IMAGE / FIGURE: Embedded Document Graphic {number}]\n[Image URL: /images/{stem}_img{number}{ending}]"


def read_docx_images(spark: SparkSession, path: str) -> DataFrame:
    """(filename, image_no, image_name, image, text): embedded images of DOCX files, with the section that stands for each before the paragraphs."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/\\\\]+)$", 1).alias("filename"), "content")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, n, i) for f, c in zip(b.filename, b.content) for k, (n, i) in enumerate(docx_images(c), 1)]
            yield pd.DataFrame(rows, columns=["filename", "image_no", "image_name", "image"])

    d = files.mapInPandas(opened, "filename string, image_no int, image_name string, image binary")
    stem = F.regexp_replace(F.regexp_replace("filename", r"\.[^.]*$", ""), r"[^\p{L}\p{N}]", "_")
    url = F.concat(F.lit("/images/"), stem, F.lit("_img"), "image_no", F.regexp_extract("image_name", r"(\.[^.]+)$", 1))
    return d.withColumn("text", F.concat(F.lit("[IMAGE / FIGURE: Embedded Document Graphic "), "image_no", F.lit("]\n[Image URL: "), url, F.lit("]")))


def lines_reader(content: bytes) -> list[str]:
    """Pages of a text file, 55 lines each: the plainest page reader."""
    lines = content.decode("utf-8", "replace").splitlines(keepends=True)
    return ["".join(lines[k : k + LINES_PER_PAGE]) for k in range(0, max(len(lines), 1), LINES_PER_PAGE)]


def read_pages(spark: SparkSession, path: str, count, page, *, fallback=None, start: int | None = None, end: int | None = None, per_task: int = 16) -> DataFrame:
    """(file_path, page, text) of paged files by a plug-in reader; pages of one file run in parallel, `per_task` to a task.

    count(content) gives a file's number of pages and page(content, n) the text of page n, from 1. Where either raises,
    `fallback` (the same pair) reads the file or the page; without one, the error stands. An inverted or empty range
    gives all pages. Files of no bytes have no page here. Contents are opened where they are read: none is shuffled.
    """
    pair = paged.WholeContent(*fallback) if fallback else None
    return paged.read(spark, path, paged.WholeContent(count, page), fallback=pair, start=start, end=end, per_task=per_task, empty_files=False)


def page_text(pages: DataFrame) -> DataFrame:
    """(file_path, text_content): pages in order, each after its "[Page n]" mark; blank pages are left out."""
    body = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), F.trim(p["text"])))
    shown = pages.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return shown.groupBy("file_path").agg(F.array_join(body, "\n\n").alias("text_content"))


def read_docx(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(filename, sections, total_pages, text_content) of DOCX files, optionally of a page range; sections are embedded images, then paragraphs, then tables."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/\\]+)$", 1).alias("filename"), "content")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [[image_section(f, k, n) for k, (n, _) in enumerate(docx_images(c), 1)] + docx_sections(c) for f, c in zip(b.filename, b.content, strict=True)]
            yield pd.DataFrame({"filename": b.filename, "sections": both})

    d = files.mapInPandas(opened, "filename string, sections array<string>")
    words = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(F.split(F.trim(s), r"\s+")))
    d = d.withColumn("total_pages", section_pages(words, F.size("sections")))
    s = F.lit(max(1, start or 1))
    e = F.least("total_pages", F.lit(end)) if end is not None else F.col("total_pages")
    s, e = F.when(s > e, 1).otherwise(s), F.when(s > e, F.col("total_pages")).otherwise(e)
    return d.withColumn("text_content", F.array_join(section_slice(F.col("sections"), F.col("total_pages"), s, e), "\n\n"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, channels, data) by Spark's image source."""
    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def on_white(images: DataFrame) -> DataFrame:
    """Images of read_images() with three channels: grey ones repeated, alpha flattened on white; a row without bytes keeps none."""

    @F.pandas_udf("binary")
    def flat(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        def one(raw, n):
            if raw is None or n not in (1, 3, 4):
                return raw
            x = np.frombuffer(raw, "u1").reshape(-1, n)
            if n == 4:
                alpha = x[:, 3:].astype("u2")
                x = ((x[:, :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype("u1")
            return (np.repeat(x, 3, axis=1) if n == 1 else x).tobytes()

        return pd.Series([one(r, int(n)) for r, n in zip(data, channels, strict=True)])

    return images.withColumn("data", flat("data", "channels")).withColumn("channels", F.lit(3))


class PagedText(DataSource):
    """Python data source "paged_text": one row (filename, page, text) per page of text files, in ranges of pages."""

    @classmethod
    def name(cls) -> str:
        return "paged_text"

    def schema(self) -> str:
        return "filename string, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Named(self.options["path"], paged.TextPages(int(self.options.get("lines", LINES_PER_PAGE))))


class _Named(paged.PageRanges):
    def read(self, partition):
        for path, n, text in super().read(partition):
            yield path.rsplit("/", 1)[1], n, text
