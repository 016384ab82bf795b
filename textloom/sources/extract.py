"""Files of any kind to pages: a router over extractors, which external tools can join."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import images
from textloom.functions import text as T
from textloom.sources.mail import messages_of
from textloom.sources.sheets import sheet_pages

Extractor = Callable[[bytes], list[str]]


def text_pages(content: bytes) -> list[str]:
    """A text file's pages: form feeds part them."""
    return content.decode("utf-8", "replace").split("\f")


def mail_texts(content: bytes) -> list[str]:
    found = list(messages_of(content))
    head = "\n".join(f"page {i}: {m['subject'] or '(no subject)'}" for i, m in enumerate(found, 2))
    return [f"{len(found)} messages\n{head}", *(m["body"] for m in found)]


def workbook_texts(content: bytes) -> list[str]:
    return [text for _, text in sheet_pages(content)]


def embedded_images(content: bytes) -> list[bytes]:
    """The JPEG images that a PDF holds as they are, or deflated, in order; without a renderer they are its pages."""
    out = []
    for found in re.finditer(rb"<<(?:(?!>>\s*stream).)*?/Subtype\s*/Image.*?>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        data = found[1]
        if b"/FlateDecode" in found[0][:2000] and data[:2] != b"\xff\xd8":
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        if data[:3] == b"\xff\xd8\xff":
            out.append(data)
    return out


BUILT_IN: dict[str, Extractor] = {"text": text_pages, "email": mail_texts, "spreadsheet": workbook_texts}


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None, ocr=None) -> DataFrame:
    """(path, kind, page, text, error) of files (path, content; content_type if there).

    The kind is told by name, type, and, where these tell nothing, first bytes.
    ``extractors`` (kind -> function of the bytes) join or replace the built-in ones:
    PDF and office files need one.  Images go to ``ocr.read``; those too small for a
    page are refused, as are opaque and minified files.  What cannot be read is one
    row with its error and no page.  An unknown kind is read as text.
    """
    table = {**BUILT_IN, **(extractors or {})}
    served = F.col("content_type") if "content_type" in files.columns else F.lit("")
    by_name = T.document_kind(F.col("path"), served)
    rows = files.select("path", "content", F.when(by_name == "unknown", T.sniffed_kind(F.col("content"))).otherwise(by_name).alias("kind"), T.opaque(F.col("content")).alias("opaque"))

    def read(kind: str, content: bytes, opaque: bool) -> list[str]:
        if kind == "image":
            if images.too_small(content):
                raise ValueError("the image is too small to be a page")
            if ocr is None:
                raise ValueError("no engine for images")
            return [ocr.read(content)[0]]
        if kind in ("unknown", "text"):
            if opaque:
                raise ValueError("the file is opaque")
            if kind == "unknown" and max(map(len, content.split(b"\n")), default=0) >= 5000:
                raise ValueError("the file is minified")
            return table["text"](content)
        if kind not in table:
            raise ValueError(f"no extractor for {kind}")
        return table[kind](content)

    def run(batches):
        for batch in batches:
            out = []
            for path, content, kind, opaque in zip(batch["path"], batch["content"], batch["kind"], batch["opaque"]):
                try:
                    out += [(path, kind, i, text, None) for i, text in enumerate(read(kind, bytes(content or b""), bool(opaque)), 1)]
                except Exception as error:  # an extractor's fault is the file's, not the job's
                    out.append((path, kind, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "kind", "page", "text", "error"]).astype({"page": "Int32"})

    return rows.mapInPandas(run, "path string, kind string, page int, text string, error string")
