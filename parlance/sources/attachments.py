"""Text of attachments and rows of live feeds."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from parlance.schema import EXTRACT_MAX_CHARS

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def cap(text: str, limit: int = EXTRACT_MAX_CHARS) -> str:
    """Lines trimmed, blank ones dropped, cut to ``limit``."""
    return "\n".join(x.strip() for x in text.splitlines() if x.strip())[:limit].rstrip()


def docx_text(data: bytes) -> str:
    """A document's paragraphs, then the cells of its tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    cells = [" ".join(said(p) for p in c.iter(f"{_W}p")) for t in body.iter(f"{_W}tbl") for c in t.iter(f"{_W}tc")]
    return "\n".join([*(said(p) for p in body.findall(f"{_W}p")), *cells])


def pdf_text(data: bytes) -> str | None:
    """A PDF's text where a reader is installed; null where not."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


#: Readers by kind: a function of a file's bytes that gives text, or null where it can't. Others (OCR) may be added.
READERS: dict[str, Callable[[bytes], str | None]] = {"docx": docx_text, "pdf": pdf_text, "txt": lambda data: data.decode("utf-8", "replace")}


def kind_of(name: str, data: bytes) -> str | None:
    """By the name's ending, else by how the file begins."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending in READERS:
        return ending
    return "pdf" if data[:5] == b"%PDF-" else "docx" if data[:4] == b"PK\x03\x04" else None


def extract(spark: SparkSession, path: str) -> DataFrame:
    """(path, outcome, text): text, empty, unsupported or error for each file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, data in zip(part["path"], part["content"], strict=True):
                kind = kind_of(name, data)
                try:
                    found = READERS[kind](data) if kind else None
                    text = None if found is None else cap(found)
                    out.append((name, "unsupported" if found is None else "text" if text else "empty", text or None))
                except Exception as e:  # noqa: BLE001  any broken file is an outcome of its own
                    out.append((name, "error", f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "outcome", "text"])

    return files.mapInPandas(run, "path string, outcome string, text string")
