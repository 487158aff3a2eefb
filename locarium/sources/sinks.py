"""Writers: partitions, JSON arrays, envelopes, indexes, spreadsheets."""

from __future__ import annotations

import json
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions.text import csv_guard

#: A pretty JSON array or a sheet is one file that people read; larger results go to :func:`write_lines`.
MOST_ROWS = 100_000


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write them with write_lines")
    return found


def dump(rows: list[dict]) -> str:
    """A pretty JSON array with letters as they are and a last line end (SK1)."""
    return json.dumps(rows, ensure_ascii=False, indent=2) + "\n"


def write_if_changed(path: str, text: str) -> bool:
    """Write a file unless it has that text (SK3, M8)."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return True


def write_json_array(rows: DataFrame, path: str) -> bool:
    """One sorted JSON array in one file (SK1, SK3, SK9, SK10); rows come in the frame's order."""
    return write_if_changed(path, dump([r.asDict(True) for r in _bounded(rows)]))


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, in parallel: the form for any size."""
    rows.write.mode("overwrite").json(path)


def write_partitions(rows: DataFrame, path: str, keys: list[str], changed: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Write only the changed partitions (SK2), and return them. ``changed``: keys and change, as
    :func:`locarium.operators.merge.changed_partitions` finds them. Nothing is written in a dry run (SK11)."""
    if changed is not None:
        rows = rows.join(F.broadcast(changed.where("change <> 'orphan'").select(*keys)) if changed.count() <= MOST_ROWS else changed.select(*keys), keys, "left_semi")
    touched = rows.select(*keys).distinct()
    if not dry_run:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)
    return touched


def delete_orphans(spark, path: str, keys: list[str], orphans: DataFrame) -> int:
    """Delete stored partitions that have no rows now (SK2): folders, as many as there are orphans."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for r in _bounded(orphans.select(*keys)):
        p = fs_path(path + "/" + "/".join(f"{k}={r[k]}" for k in keys))
        gone += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return gone


def split_to(rows: DataFrame, path: str, keys: list[str]) -> None:
    """The inverse of combining; refuses a target that exists (SK4)."""
    rows.write.mode("errorifexists").partitionBy(*keys).json(path)


def corrections(changes: DataFrame, input_file: str, generated_at: str, how: str) -> str:
    """The envelope of a run's changes (SK5)."""
    rows = [r.asDict(True) for r in _bounded(changes)]
    return json.dumps({"input_file": input_file, "generated_at": generated_at, "how_to_apply": how, "change_count": len(rows), "changes": rows}, ensure_ascii=False, indent=2) + "\n"


def clean_folder(path: str) -> None:
    """Remove plain files of an earlier run; dot and lock files stay (SK7)."""
    os.makedirs(path, exist_ok=True)
    for name in os.listdir(path):
        if os.path.isfile(f"{path}/{name}") and not name.startswith((".", "~")):
            os.remove(f"{path}/{name}")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet runs (SK6)."""
    rows.select(*[csv_guard(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sitemap_entry(base: Column, ident, updated) -> Column:
    """One link with its date, if there is one (SK8)."""
    date = F.nullif(F.trim(_c(updated)), F.lit(""))
    return F.concat(F.lit("<loc>"), base, F.lit("?place="), _c(ident), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), date, F.lit("</lastmod>")), F.lit("")))


def index_line(name, city, ident) -> Column:
    """One line of a text index, without a stray comma (SK8)."""
    return F.concat(F.lit("- "), F.concat_ws(", ", _c(name), F.nullif(F.trim(_c(city)), F.lit(""))), F.lit(" ("), _c(ident), F.lit(")"))


def write_xlsx(rows: DataFrame, path: str, title: str) -> None:
    """A minimal sheet (SK6): a bold frozen header, a filter, guarded cells; one workbook for people to read."""
    names = rows.columns
    data = _bounded(rows)

    def cell(v, style=0):
        text = "" if v is None else str(v)
        if text[:1] in "=+-@" and isinstance(v, str) and text:
            text = "'" + text
        return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = ["<row>" + "".join(cell(n, 1) for n in names) + "</row>", *("<row>" + "".join(cell(v) for v in r) + "</row>" for r in data)]
    last = ""
    n = len(names)
    while n:
        n, k = divmod(n - 1, 26)
        last = chr(65 + k) + last
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}{len(data) + 1}"/></worksheet>'
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(title[:31])}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
