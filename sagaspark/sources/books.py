"""Books as sources: text files in several encodings, and EPUB archives. One task reads one file; files never meet."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaspark.functions.text import html_text

TITLE = r"^\s*(?:第[0-9０-９零〇一二三四五六七八九十百千两]{1,9}[章回节]|Chapter\s+\S+|序章|楔子|尾声)"
SCHEMA = "path string, title string, text string, error string"


def decode(raw: bytes) -> str:
    """UTF-8, GB 18030 or Big5, the first that fits; anything else is UTF-8 with marks for what doesn't."""
    for name in ("utf-8-sig", "gb18030", "big5"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def epub_text(raw: bytes) -> tuple[str, str]:
    """Title and text of an EPUB: its spine's entries in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        root = ElementTree.fromstring(z.read(opf))
        title = next((e.text or "" for e in root.iter() if e.tag.endswith("}title")), "")
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        order = [items[e.get("idref")] for e in root.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        base = posixpath.dirname(opf)
        return title, "\n\n".join(html_text(decode(z.read(posixpath.normpath(posixpath.join(base, h))))) for h in order)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Books under ``path`` (txt, md, epub): path, title, text, error. A broken file gives a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, raw in zip(f["path"], f["content"]):
                try:
                    title, text = epub_text(raw) if p.lower().endswith(".epub") else (posixpath.basename(p).rpartition(".")[0], decode(raw))
                    rows.append((p, title, text.replace("\r\n", "\n").replace("\r", "\n"), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "title", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,epub}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text with their number and offset: key, no, start, line. Computed within the row, without a shuffle."""
    acc = F.aggregate(F.split(text, "\n"), F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,line:string>>").alias("l")), lambda a, x: F.struct((a.end + F.length(x) + 1).alias("end"), F.concat(a.l, F.array(F.struct(a.end.alias("start"), x.alias("line")))).alias("l")))
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(acc.l).alias("no", "x")).select(key, "no", "x.start", "x.line")


def split_chapters(texts: DataFrame, key: str, text: str, title: str = TITLE, longest: int = 40) -> DataFrame:
    """Chapters by title lines: key, ordinal, title, char_start, char_end.

    Text before the first title belongs to the first chapter; a text without titles is one chapter.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = re.compile(title, re.I)
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                found, at = [], 0
                for ln in t.split("\n"):
                    if len(ln) <= longest and match.match(ln):
                        found.append((at, ln.strip()))
                    at += len(ln) + 1
                found = found or [(0, None)]
                for i, (s, name) in enumerate(found):
                    rows.append((k, i, name, s if i else 0, found[i + 1][0] if i + 1 < len(found) else len(t)))
            yield pd.DataFrame(rows, columns=["k", "ordinal", "title", "char_start", "char_end"])

    kind = dict(texts.dtypes)[key]
    src = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).dropna()
    return src.mapInPandas(cut, f"k {kind}, ordinal int, title string, char_start int, char_end int").withColumnRenamed("k", key)


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows to append to a table so that importing twice changes nothing: the first per key of those it lacks."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    first = incoming.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")
