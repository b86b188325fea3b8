"""Text out of files: plain, HTML, CSV, office documents, archives, databases. Standard library only.

Extractors are plain functions from bytes to (page, text) pairs, kept in a registry by extension; ``extract`` runs them
over a listing with Arrow batches. An unreadable file gives one row without text, never an error.
"""

from __future__ import annotations

import csv
import html
import io
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import TYPE_CHECKING
from xml.etree import ElementTree

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    import pandas as pd

Pages = list[tuple[int, str]]
SKIPPED = ("script", "style", "head", "noscript", "nav", "footer")
#: Guards against archives that unpack into too much: entries, bytes of all, bytes of one.
MOST_ENTRIES, MOST_BYTES, MOST_ENTRY = 500, 50 * 1024 * 1024, 20 * 1024 * 1024
SQLITE_ROWS = 500


class _Stripper(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0
        self.title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n§SECTION: ")
            self.title = True
        elif tag in ("p", "br", "div", "li", "tr", "table", "section", "article"):
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.title and re.fullmatch("h[1-6]", tag):
            self.parts.append("§\n")
            self.title = False

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def plain(content: bytes) -> Pages:
    return [(1, content.decode("utf-8", "replace"))]


def html_text(text: str) -> str:
    """Readable text of a page: no scripts, styles, navigation or footers, headings as section marks, blanks squeezed."""
    stripper = _Stripper()
    stripper.feed(text)
    stripper.close()
    lines = (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in html.unescape("".join(stripper.parts)).splitlines())
    return "\n".join(line for line in lines if line)


def csv_rows(text: str) -> list[str]:
    """One line of text per row: 'CSV row n: name=value | …'; other widths than the header's use c1, c2, …; blank rows fall
    out but are counted, so that n tells the row of the file."""
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text))]
    head, out = rows[0] if rows else [], []
    for n, row in enumerate(rows[1:], 1):
        if not any(row):
            continue
        names = head if len(row) == len(head) else [f"c{k}" for k in range(1, len(row) + 1)]
        out.append(f"CSV row {n}: " + " | ".join(f"{a}={b}" for a, b in zip(names, row)))
    return out


def _xml_paragraphs(data: bytes, paragraph: str, text: str) -> list[str]:
    root = ElementTree.fromstring(data)
    found = ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}" + text)) for p in root.iter() if p.tag.endswith("}" + paragraph))
    return [f for f in found if f.strip()]


def docx(content: bytes) -> Pages:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(1, "\n".join(_xml_paragraphs(z.read("word/document.xml"), "p", "t")))]


def pptx(content: bytes) -> Pages:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return [(k, f"Slide {k}\n" + "\n".join(_xml_paragraphs(z.read(n), "p", "t"))) for k, n in enumerate(names, 1)]


def xlsx(content: bytes) -> Pages:
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(space + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(space + "si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(space + "sheet")] if "xl/workbook.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        pages = []
        for k, name in enumerate(sheets):
            lines = [f"Sheet: {titles[k] if k < len(titles) else k + 1}"]
            for row in ElementTree.fromstring(z.read(name)).iter(space + "row"):
                cells = []
                for cell in row.iter(space + "c"):
                    value = cell.find(space + "v")
                    inline = "".join(t.text or "" for t in cell.iter(space + "t"))
                    raw = value.text if value is not None and value.text else ""
                    cells.append(shared[int(raw)] if cell.get("t") == "s" and raw else inline or raw)
                if any(cells):
                    lines.append("\t".join(cells))
            pages.append((k + 1, "\n".join(lines)))
        return pages


def sqlite(content: bytes) -> Pages:
    """Every table of a database, at most SQLITE_ROWS rows of each, columns joined by bars."""
    with tempfile.NamedTemporaryFile(suffix=".db") as file:
        file.write(content)
        file.flush()
        base = sqlite3.connect(f"file:{file.name}?mode=ro&immutable=1", uri=True)
        try:
            pages = []
            tables = [r[0] for r in base.execute("select name from sqlite_master where type = 'table' order by name")]
            for k, name in enumerate(tables, 1):
                quoted = '"' + name.replace('"', '""') + '"'
                rows = base.execute(f"select * from {quoted} limit {SQLITE_ROWS}")
                lines = [f"Table: {name}", " | ".join(c[0] for c in rows.description)]
                lines += [" | ".join("" if v is None else str(v) for v in row) for row in rows]
                pages.append((k, "\n".join(lines)))
            return pages
        finally:
            base.close()


def bookmarks(content: bytes) -> Pages | None:
    """The bookmarks of a browser's database, 'folder | title | url' by folder and date; None where it is no such database."""
    with tempfile.NamedTemporaryFile(suffix=".db") as file:
        file.write(content)
        file.flush()
        base = sqlite3.connect(f"file:{file.name}?mode=ro&immutable=1", uri=True)
        try:
            rows = base.execute(
                "select coalesce(f.title, ''), coalesce(b.title, ''), p.url from moz_bookmarks b join moz_places p on p.id = b.fk "
                "left join moz_bookmarks f on f.id = b.parent where b.type = 1 order by f.title, b.dateAdded, b.id"
            ).fetchall()
            return [(1, "\n".join(" | ".join(map(str, r)) for r in rows))]
        except sqlite3.OperationalError:
            return None
        finally:
            base.close()


EXTRACTORS: dict[str, Callable[[bytes], Pages]] = {
    "html": lambda b: [(1, html_text(b.decode("utf-8", "replace")))], "htm": lambda b: [(1, html_text(b.decode("utf-8", "replace")))],
    "csv": lambda b: [(k, line) for k, line in enumerate(csv_rows(b.decode("utf-8", "replace")), 1)],
    "docx": docx, "pptx": pptx, "xlsx": xlsx, "db": lambda b: bookmarks(b) or sqlite(b), "sqlite": lambda b: bookmarks(b) or sqlite(b),
}


def archive(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(inner path, bytes) of an archive's readable entries: no folders, links, encrypted or nested archives, no paths upward."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n, info in enumerate(z.infolist()):
            parts = info.filename.replace("\\", "/").split("/")
            linked = (info.external_attr >> 16) & 0o170000 == 0o120000
            if n >= MOST_ENTRIES or info.is_dir() or linked or info.flag_bits & 1 or ".." in parts or info.filename.startswith("/") or info.filename.lower().endswith(".zip"):
                continue
            total += info.file_size
            if info.file_size > MOST_ENTRY or total > MOST_BYTES:
                continue
            yield info.filename, z.read(info)


def read(path: str, content: bytes) -> list[tuple[str, int, str | None]]:
    """(source, page, text) of one file; entries of an archive are 'archive > inner'."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if suffix == "zip":
            return [(f"{path} > {inner}", page, text) for inner, data in archive(content) for _, page, text in read(inner, data)]
        return [(path, page, text) for page, text in EXTRACTORS.get(suffix, plain)(content)] or [(path, 0, None)]
    except Exception:  # noqa: BLE001  an unreadable file is listed without text
        return [(path, 0, None)]


def extract(listing: DataFrame) -> DataFrame:
    """(source, page, text, content_extracted) of the files of a listing (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            rows = [(s, p, t, int(t is not None)) for path, content in zip(batch["path"], batch["content"]) for s, p, t in read(path, bytes(content))]
            yield pd.DataFrame(rows, columns=["source", "page", "text", "content_extracted"])

    return listing.select("path", "content").mapInPandas(run, "source string, page int, text string, content_extracted int")
