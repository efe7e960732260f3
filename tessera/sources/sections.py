"""Sections and tables of documents: Markdown, HTML, and what parsers of DOCX and PDF give."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the word processor's heading styles (fixed values).
STYLES = {"Title": 1, **{f"Heading {k}": k for k in range(1, 7)}}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def markdown_sections(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, level, heading): lines of one to six ``#`` and a heading."""
    lines = docs.select(key, F.posexplode(F.split(body, "\n")).alias("line", "t")).filter(F.col("t").rlike(r"^#{1,6}\s+\S"))
    level = F.length(F.regexp_extract("t", r"^(#{1,6})\s", 1))
    return lines.select(key, (F.col("line") + 1).cast("long").alias("line_no"), level.cast("long").alias("level"), F.trim(F.regexp_replace("t", r"^#{1,6}\s+", "")).alias("heading"))


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cells): cells without tags, white space collapsed."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " ")))
    return rows.select(key, "table_no", F.col("row_no").cast("long").alias("row_no"), plain.alias("cells"))


def section_rows(parsed: DataFrame, key: str, sections: str, untitled: str = "Document") -> DataFrame:
    """(key, heading, level, page_no) of parsed sections (structs of heading, style, level, page_no).

    A level comes from the heading style, else from the section, else it is 1; documents
    without sections are one section.
    """
    table = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])
    rows = parsed.select(key, F.explode_outer(sections).alias("s"))
    level = F.coalesce(F.element_at(table, F.coalesce(F.col("s.style"), F.lit(""))), F.col("s.level"), F.lit(1))
    return rows.select(key, F.coalesce("s.heading", F.lit(untitled)).alias("heading"), level.alias("level"), F.col("s.page_no").alias("page_no"))


def paragraphs(content: bytes | None) -> list[dict]:
    """Paragraphs of a DOCX file with their style names; a file that can't be read has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as file:
            body = ElementTree.fromstring(file.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for p in body.iter(f"{_WORD}p"):
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        name = style.get(f"{_WORD}val", "") if style is not None else ""
        out.append({"text": "".join(t.text or "" for t in p.iter(f"{_WORD}t")), "style": name})
    return out


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, seq, text, style) of DOCX files as ``binaryFile`` reads them; style names get their blank back."""

    @F.pandas_udf("array<struct<text:string,style:string>>")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(paragraphs)

    rows = files.select("path", F.posexplode(read("content")).alias("seq", "p"))
    return rows.select("path", "seq", "p.text", F.regexp_replace("p.style", r"^Heading(\d)$", "Heading $1").alias("style"))


def docx_sections(files: DataFrame, untitled: str = "Document") -> DataFrame:
    """(path, section_no, heading, level, text, n_paragraphs) of DOCX files: what stands between two headings.

    Paragraphs before the first heading are a section of level 1 named ``untitled``; empty ones
    count nowhere. A paragraph is a heading by its style (``STYLES``); a file without paragraphs has no row.
    """
    table = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])
    rows = docx_paragraphs(files).filter(F.trim("text") != "").withColumn("level", F.element_at(table, F.col("style")))
    upto = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a document
    rows = rows.withColumn("section_no", F.count("level").over(upto).cast("int"))
    head, body = F.col("level").isNotNull(), F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("seq", "text"))))
    out = rows.groupBy("path", "section_no").agg(
        F.max(F.when(head, F.col("text"))).alias("heading"),
        F.max("level").alias("level"),
        F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("text"),
        F.count_if(~head).alias("n_paragraphs"),
    )
    return out.withColumns({"heading": F.coalesce("heading", F.lit(untitled)), "level": F.coalesce("level", F.lit(1))}).select("path", "section_no", "heading", "level", "text", "n_paragraphs")
