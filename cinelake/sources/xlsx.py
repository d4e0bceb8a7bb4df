"""A workbook from DataFrames, written with the standard library; rows stream to the driver one partition at a time."""

from __future__ import annotations

import itertools
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

# The colour of each status, and the columns that hold one.
COLOURS = {
    "OK": "E2F0D9", "SAFE": "E2F0D9", "HIGH_CONFIDENCE": "E2F0D9", "HIGH_CONFIDENCE / MERGED": "E2F0D9", "LEGACY": "FCE4D6", "REVIEW": "FFF2CC",
    "UNPARSED": "FFF2CC", "NO_MATCH": "FFF2CC", "MISMATCH": "F4CCCC", "ERROR": "F4CCCC",
}
STATUSES = {
    "Status", "Filename Standard", "Resolution Match", "Audio Match", "Channels Match", "Audio Feature Match", "Video Match", "Metadata Check",
    "Rename Status", "Match Status", "TMDb Match",
}
# The colours of labels and of lines between cells, and the columns whose numbers have three decimals.
LABELS, LINES = "1F4E78", "D6E2EA"
SIZES = {"Size GiB"}
#: Rows that a sheet of the format can hold, the labels included, and characters (of UTF-16) of a cell.
MOST_ROWS, MOST_TEXT = 1 << 20, 32_767
_FILLS = sorted(set(COLOURS.values()))
_CELL, _SIZE = 2 + len(_FILLS), 3 + len(_FILLS)
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column_name(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _text(value) -> str:
    """Text as a cell can hold it: without control characters, cut with a mark where it is too long."""
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    if len(text) > MOST_TEXT // 2 and len(units := text.encode("utf-16-le", "replace")) > 2 * MOST_TEXT:
        text = units[: 2 * (MOST_TEXT - 1)].decode("utf-16-le", "ignore") + "…"
    return text


def _cell(ref: str, value, label: str = "") -> str:
    style = _SIZE if label in SIZES else _CELL
    if value is None or value == "" or value is False:
        return f'<c r="{ref}" s="{style}"/>'
    if value is True:
        value = "YES"
    if isinstance(value, int | float):
        return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    text = _text(value)
    if label in STATUSES and text in COLOURS:
        style = 2 + _FILLS.index(COLOURS[text])
    return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _styles() -> str:
    """Cell formats: 0 none, 1 labels, from 2 the statuses' colours, then plain cells, then sizes."""
    fill = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>'
    side = lambda c: "".join(f'<{s} style="thin"><color rgb="FF{c}"/></{s}>' for s in ("left", "right", "top", "bottom"))
    middle = '<alignment vertical="center"/>'
    xfs = ['<xf fontId="0" fillId="0" borderId="0"/>', '<xf fontId="1" fillId="2" borderId="2" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>']
    xfs += [f'<xf fontId="0" fillId="{i + 3}" borderId="1" applyFill="1" applyBorder="1" applyAlignment="1"><alignment horizontal="center"/></xf>' for i in range(len(_FILLS))]
    xfs += [f'<xf fontId="0" fillId="0" borderId="1" applyBorder="1" applyAlignment="1">{middle}</xf>', f'<xf numFmtId="164" fontId="0" fillId="0" borderId="1" applyNumberFormat="1" applyBorder="1" applyAlignment="1">{middle}</xf>']
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.000"/></numFmts><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
        f'<fills count="{3 + len(_FILLS)}"><fill/><fill><patternFill patternType="gray125"/></fill>{fill(LABELS)}{"".join(map(fill, _FILLS))}</fills>'
        f'<borders count="3"><border/><border>{side(LINES)}</border><border>{side(LABELS)}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(xfs)}">{"".join(xfs)}</cellXfs></styleSheet>'
    )


def _sheet(out, df: DataFrame, rows: Iterator, widths: dict[str, int], fixed: int, most: int) -> bool:
    """Writes rows as one sheet, as many as it can hold; whether there are more."""
    put = lambda x: out.write(x.encode())
    pane = f'<pane {f'xSplit="{fixed}" ' if fixed else ""}ySplit="1" topLeftCell="{column_name(fixed)}2" activePane="bottom{"Right" if fixed else "Left"}" state="frozen"/>'
    columns = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{widths.get(c, widths.get("", 18))}" customWidth="1"/>' for k, c in enumerate(df.columns))
    put(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews><cols>{columns}</cols><sheetData>')
    n = 1
    while n < most and (row := next(rows, None)) is not None:
        if n == 1:
            put('<row r="1" ht="34" customHeight="1">' + "".join(f'<c r="{column_name(k)}1" t="inlineStr" s="1"><is><t>{escape(c)}</t></is></c>' for k, c in enumerate(df.columns)) + "</row>")
        n += 1
        put(f'<row r="{n}">' + "".join(_cell(f"{column_name(k)}{n}", v, df.columns[k]) for k, v in enumerate(row)) + "</row>")
    if n == 1:
        put('<row r="1"><c r="A1" t="inlineStr"><is><t>No rows</t></is></c></row>')
    put("</sheetData>" + (f'<autoFilter ref="A1:{column_name(len(df.columns) - 1)}{n}"/>' if n > 1 else "") + "</worksheet>")
    return n == most


def write_workbook(path: str, sheets: dict[str, DataFrame], widths: dict[str, dict[str, int]] | None = None, fixed: dict[str, int] | None = None, most: int = MOST_ROWS) -> None:
    """Writes one sheet per DataFrame: bold labels, frozen first row (and ``fixed`` columns), filter, coloured statuses, column
    widths (18 if not given, or what "" says). No rows: "No rows". Rows past what a sheet holds go on in further sheets with
    a number after the name."""
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in sheets.items():
            rows, part, more = df.toLocalIterator(), 1, True
            while more:
                end = f" ({part})" if part > 1 else ""
                names.append(name[: 31 - len(end)] + end)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                    more = _sheet(out, df, rows, (widths or {}).get(name, {}), (fixed or {}).get(name, 0), most)
                if more:  # unless the last row was the sheet's last, too
                    head = next(rows, None)
                    more, rows, part = head is not None, itertools.chain([head], rows), part + 1
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        )
        rels = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{rels}">{links}<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles())
