"""Spreadsheet workbooks (zip and XML) as one page of tab-joined rows a sheet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.findall(f"{_MAIN}si")]


def _cell(cell: ElementTree.Element, strings: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return cell.findtext(f"{_MAIN}is/{_MAIN}t") or ""
    value = cell.findtext(f"{_MAIN}v") or ""
    if cell.get("t") != "s":
        return value
    at = value.strip()
    return strings[int(at)] if at.isdigit() and int(at) < len(strings) else ""


def sheet_pages(content: bytes) -> list[tuple[int, str]]:
    """(page, text) of each sheet whose part is there; numbers count all sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names, strings = set(book.namelist()), _strings(book)
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for page, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), 1):
            target = links.get(sheet.get(_LINK), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                rows = ElementTree.fromstring(book.read(part)).iterfind(f"{_MAIN}sheetData/{_MAIN}row")
                body = "\n".join("\t".join(_cell(c, strings) for c in row.iterfind(f"{_MAIN}c")) for row in rows)
                out.append((page, f"## {sheet.get('name') or f'Sheet {page}'}\n\n{body.strip()}"))
        return out


def read_sheets(files: DataFrame) -> DataFrame:
    """path, page, text, error for workbooks (path, content), as the binaryFile source gives them.

    A file that is no workbook is one row with its error and no page; null content too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, page, text, None) for page, text in sheet_pages(content or b"")]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    rows.append((path, None, None, f"{type(error).__name__}: {error}"))
            found = pd.DataFrame(rows, columns=["path", "page", "text", "error"])
            yield found.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")
