"""Excel workbooks: read as rows of cells, and written as a sink.

Reading goes through Spark's binaryFile source, so that any store Spark reads will do; a task takes a workbook apart and
streams its rows, holding the archive, its shared strings and a batch. Writing is a Python data source: tasks write whole
workbooks into a staging folder, the commit moves those of the tasks that count, and an abort leaves none.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.operators.storage import ship

#: A cell is its kind (texto, numero, data, logico, erro) and its text; a missing one is null.
CELL = "struct<tipo:string,texto:string>"
ROWS = f"arquivo string, planilha string, indice int, linha long, celulas array<{CELL}>, erro string"
# Fixed values of the format: rows of a sheet, columns, number formats that are dates, and the day that serial 0 stands for.
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
EPOCH, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
_BATCH = 2_000
#: Rows that a workbook holds before they are written.
_HELD = 500


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _is_date_code(code: str) -> bool:
    """Whether a number format shows a date: letters of dates outside quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())
    return bool(re.search("[dmyhs]", bare))


def _texts(source) -> Iterator[str]:
    """The shared strings in order; runs of rich text are joined, phonetic hints left out."""
    parts: list[str] = []
    hint = 0
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        kind = _name(e.tag)
        if kind == "rPh":
            hint += 1 if event == "start" else -1
        elif event == "end" and kind == "t" and not hint:
            parts.append(e.text or "")
        elif event == "end" and kind == "si":
            yield "".join(parts)
            parts = []
            e.clear()


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    codes = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if _name(e.tag) == "numFmt"}
    formats = next((e for e in root if _name(e.tag) == "cellXfs"), [])
    ids = [int(e.get("numFmtId") or 0) for e in formats]
    return [_is_date_code(codes[i]) if i in codes else i in DATE_FORMATS for i in ids]


def _column(ref: str) -> int:
    """The column (from 0) of a reference such as BC12."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _number_text(text: str) -> str:
    """A number as it is read back: whole ones without a point."""
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


@lru_cache(maxsize=1 << 14)
def _date_text(serial: float, epoch: datetime.datetime) -> str:
    moment = epoch + datetime.timedelta(milliseconds=round(serial * 86_400_000))
    return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(sep=" ", timespec="seconds")


def _sheet_paths(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """Names and paths of the worksheets in the workbook's order, and whether days count from 1904."""
    targets = {}
    if "xl/_rels/workbook.xml.rels" in book.namelist():
        for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = e.get("Target") or ""
            targets[e.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [(e.get("name") or "", targets.get(next((v for k, v in e.attrib.items() if _name(k) == "id"), ""), "")) for e in root.iter() if _name(e.tag) == "sheet"]
    from_1904 = any(_name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    return [(n, p) for n, p in sheets if p in book.namelist()], from_1904


def rows_of_book(raw: bytes, first_only: bool = False, most_rows: int = MOST_ROWS) -> Iterator[tuple[str, int, int, list]]:
    """Sheet name, sheet index, row number and cells of every row that has a cell, sheet by sheet.

    With first_only the first sheet, and where it is full (most_rows) those that go on with it under its name and a number;
    their rows are counted on.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        sheets, from_1904 = _sheet_paths(book)
        epoch, dates = EPOCH_1904 if from_1904 else EPOCH, _date_styles(book)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                shared = list(_texts(f))
        before = last = 0
        for index, (name, path) in enumerate(sheets):
            if first_only and index:
                if name != f"{sheets[0][0]} ({index + 1})" or last < most_rows:
                    break
                before += most_rows
            for last, cells in _rows_of_sheet(book, path, shared, dates, epoch):
                yield name, index, before + last, cells


def _rows_of_sheet(book: zipfile.ZipFile, path: str, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> Iterator[tuple[int, list]]:
    """_rows(), by a quick path for what WorkbookWriter writes; from the first row on that has another form, by the parser."""
    n = 0
    with book.open(path) as f:
        for row in _plain_rows(f, shared, dates, epoch):
            if row is None:
                break
            n += 1
            yield row
        else:
            return
    with book.open(path) as f:
        yield from islice(_rows(f, shared, dates, epoch), n, None)


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: How a sheet of ours begins and ends, and its rows and cells: no markup but ours, no line ends that a parser changes.
_HEAD, _TAIL = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode(), b"</sheetData></worksheet>"
_TEXT = r"[^<>\x00-\x08\x0B-\x1F\uFFFE\uFFFF]*"
_CELL = rf'<c r="([A-Z]{{1,3}})[0-9]+"(?: s="([0-9]+)")?(?: t="([a-zA-Z]+)")?>(?:<v>({_TEXT})</v>|<is><t xml:space="preserve">({_TEXT})</t></is>)</c>'
_PLAIN_CELL = re.compile(_CELL)
_PLAIN_ROW = re.compile(f'<row r="([0-9]+)">((?:{re.sub(r"[(](?![?])", "(?:", _CELL)})*)</row>')
_ENTITY = re.compile("&(?:(amp|lt|gt);)?")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">"}
_BLOCK = 1 << 20


def _plain_rows(source, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> Iterator[tuple[int, list] | None]:
    """Rows of a sheet in WorkbookWriter's form; None, and no more, where it has another."""
    if source.read(len(_HEAD)) != _HEAD:
        yield None
        return
    rest = b""
    while block := source.read(_BLOCK):
        rest += block
        end = rest.rfind(b"</row>") + 6
        if end < 6:
            if len(rest) > 64 * _BLOCK:
                break
            continue
        try:
            text = rest[:end].decode()
        except UnicodeDecodeError:
            break
        rest, at = rest[end:], 0
        while at < len(text):
            row = _PLAIN_ROW.match(text, at)
            if row is None:
                yield None
                return
            at, cells = row.end(), []
            for column, style, kind, value, inline in _PLAIN_CELL.findall(row[2]):
                raw = value or inline
                if "&" in raw:
                    if any(e is None for e in (m[1] for m in _ENTITY.finditer(raw))):
                        yield None
                        return
                    raw = _ENTITY.sub(lambda m: _ENTITIES[m[1]], raw)
                k = _place(column)
                if k >= MOST_COLUMNS:
                    continue
                if k != len(cells):
                    cells.extend([None] * (k - len(cells)))
                cells[k:] = [_value(kind or "n", raw, int(style or 0), shared, dates, epoch)]
            if cells:
                yield int(row[1]), cells
    if rest != _TAIL:
        yield None


@lru_cache(maxsize=1 << 15)
def _place(letters: str) -> int:
    return _column(letters)


def _rows(source, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> Iterator[tuple[int, list]]:
    number, held = 0, None
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        kind = _name(e.tag)
        if event == "start":
            if kind == "sheetData":
                held = e
            continue
        if kind != "row":
            continue
        number = int(e.get("r") or number + 1)
        cells: list = []
        for c in e:
            if _name(c.tag) != "c":
                continue
            at = _column(c.get("r")) if c.get("r") else len(cells)
            value = _cell(c, shared, dates, epoch)
            if value is None or not 0 <= at < MOST_COLUMNS:
                continue
            cells.extend([None] * (at - len(cells)))
            cells[at:] = [value]
        if cells:
            yield number, cells
        if held is not None:
            held.clear()  # rows that were read


def _cell(c, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> tuple[str, str] | None:
    kind, text = c.get("t") or "n", None
    for part in c:
        if _name(part.tag) == "v":
            text = part.text or ""
        elif _name(part.tag) == "is":
            text = "".join(t.text or "" for t in part.iter() if _name(t.tag) == "t")
    if text is None:
        return None
    return _value(kind, text, int(c.get("s") or 0), shared, dates, epoch)


def _value(kind: str, text: str, style: int, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> tuple[str, str]:
    if kind in ("str", "inlineStr"):
        return "texto", text
    if kind == "s":
        return "texto", shared[int(text)]
    if kind == "b":
        return "logico", "true" if text == "1" else "false"
    if kind == "e":
        return "erro", text
    if kind == "d":
        return "data", text[:19].replace("T", " ").removesuffix(" 00:00:00")
    if style < len(dates) and dates[style]:
        return "data", _date_text(float(text), epoch)
    return "numero", _number_text(text)


def read(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """Rows (ROWS) of all sheets of the workbooks under a path, or of the first ones.

    Rows without cells are left out; linha is the row's own number. A file that is no workbook gives one row with erro.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,XLSX}").load(path).select("path", "content")
    types = pa.schema([("arquivo", pa.string()), ("planilha", pa.string()), ("indice", pa.int32()), ("linha", pa.int64()), ("celulas", pa.list_(pa.struct([("tipo", pa.string()), ("texto", pa.string())]))), ("erro", pa.string())])

    def take_apart(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                out: list[tuple] = []
                try:
                    for name, index, number, cells in rows_of_book(raw.as_py(), first_only):
                        out.append((path, name, index, number, cells, None))
                        if len(out) == _BATCH:
                            yield _batch(out, types)
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, OverflowError) as e:
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                if out:
                    yield _batch(out, types)

    return files.mapInArrow(take_apart, ROWS)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    cells = [c for row in columns[4] for c in row or ()]
    offsets, n = [], 0
    for row in columns[4]:
        offsets.append(None if row is None else n)
        n += len(row or ())
    parts = [pa.array([c and c[k] for c in cells], pa.string()) for k in (0, 1)]
    structs = pa.StructArray.from_arrays(parts, fields=list(types.field(4).type.value_type), mask=pa.array([c is None for c in cells], pa.bool_()))
    lists = pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), structs)
    return pa.RecordBatch.from_arrays([lists.cast(t.type) if k == 4 else pa.array(c, t.type) for k, (c, t) in enumerate(zip(columns, types))], schema=types)


_PARTS = {
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/styles.xml": '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Characters that XML can't hold.
_UNFIT = re.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
_SPECIAL = re.compile(r"[&<>]|[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")


def column_name(n: int) -> str:
    """Letters of a column (from 0)."""
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


@lru_cache(maxsize=1 << 15)
def _letters(n: int) -> str:
    return column_name(n)


@lru_cache(maxsize=1 << 14)
def _serial(text: str) -> str:
    serial = (datetime.datetime.fromisoformat(text) - EPOCH) / datetime.timedelta(days=1)
    return str(int(serial)) if serial == int(serial) else repr(serial)


def _cell_xml(ref: str, kind: str | None, text: str | None) -> str:
    if text is None:
        return ""
    if kind == "numero":
        return f'<c r="{ref}"><v>{float(text)!r}</v></c>' if "." in text or "e" in text.lower() else f'<c r="{ref}"><v>{int(text)}</v></c>'
    if kind == "data":
        return f'<c r="{ref}" s="1"><v>{_serial(text)}</v></c>'
    if kind == "logico":
        return f'<c r="{ref}" t="b"><v>{int(text == "true")}</v></c>'
    if _SPECIAL.search(text):
        text = escape(_UNFIT.sub("", text))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


class _Book:
    """One workbook that is being written, row by row; a sheet that is full goes on in another of its name."""

    def __init__(self, out, most_rows: int):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        self.rows: list[str] = []
        self.most, self.sheets, self.sheet, self.base, self.row, self.part = most_rows, [], None, None, 0, 0

    def _open(self, name: str) -> None:
        self._close_sheet()
        self.sheets.append(name)
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True)
        self.sheet.write(_HEAD)
        self.row = 0

    def _close_sheet(self) -> None:
        if self.sheet is not None:
            self._flush()
            self.sheet.write(_TAIL)
            self.sheet.close()

    def _flush(self) -> None:
        self.sheet.write("".join(self.rows).encode())
        self.rows = []

    def add(self, name: str, kinds: list, texts: list) -> None:
        if name != self.base:
            self.base, self.part = name, 1
            self._open(name)
        elif self.row == self.most:
            self.part += 1
            self._open(f"{name} ({self.part})")
        self.row += 1
        inner = "".join([_cell_xml(f"{_letters(k)}{self.row}", *c) for k, c in enumerate(zip(kinds, texts))])
        self.rows.append(f'<row r="{self.row}">{inner}</row>')
        if len(self.rows) == _HELD:
            self._flush()

    def close(self) -> None:
        self._close_sheet()
        n = range(1, len(self.sheets) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n)
        self.zip.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        named = "".join(f'<sheet name={quoteattr(s[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, self.sheets))
        self.zip.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rId0" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        for name, text in _PARTS.items():
            self.zip.writestr(name, text)
        self.zip.close()


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WorkbookWriter(DataSourceArrowWriter):
    """Writes batches of arquivo, planilha and celulas, in the order in which they come; a workbook's rows come together."""

    def __init__(self, path: str, overwrite: bool, most_rows: int):
        self.path, self.overwrite, self.most_rows = path, overwrite, most_rows
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator) -> _Written:
        store, root = self._store()
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        files, book, out, name = [], None, None, None
        try:
            for batch in iterator:
                cells = batch.column("celulas")
                kinds, texts = (pc.struct_field(pc.list_flatten(cells), n).to_pylist() for n in ("tipo", "texto"))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)).tolist()
                for file, sheet, start, end in zip(batch.column("arquivo").to_pylist(), batch.column("planilha").to_pylist(), [0, *ends], ends):
                    if file != name:
                        if book is not None:
                            book.close()
                            out.close()
                        if not file or "/" in file or file.startswith((".", "_")):
                            raise ValueError(f"no name for a workbook: {file!r}")
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{file}")
                        book, name = _Book(_Counted(out), self.most_rows), file
                        files.append((f"{folder}/{file}", file))
                    book.add(sheet, kinds[start:end], texts[start:end])
            if book is not None:
                book.close()
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        store, root = self._store()
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        try:
            if len(names) != len(set(names)):
                raise ValueError("rows of one workbook came from several tasks")
            there = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.lower().endswith(".xlsx")]
            if self.overwrite:
                for f in there:
                    store.delete_file(f.path)
            elif {f.base_name for f in there} & set(names):
                raise ValueError("a workbook of that name is there already")
            for staged, name in files:
                store.move(staged, f"{root}/{name}")
        finally:
            self._sweep(store, root)

    def abort(self, messages) -> None:
        self._sweep(*self._store())

    def _sweep(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class _Counted:
    """An output stream that a zip archive can be written to without going back."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class WorkbookSource(DataSource):
    """Format `ledgerloom_xlsx`; option `path`, and `most_rows` for sheets smaller than the format's."""

    @classmethod
    def name(cls) -> str:
        return "ledgerloom_xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if not {"arquivo", "planilha", "celulas"} <= set(schema.names):
            raise ValueError("workbooks are written from arquivo, planilha and celulas")
        return WorkbookWriter(self.options["path"], overwrite, int(self.options.get("most_rows", MOST_ROWS)))


def write(rows: DataFrame, path: str, *order: str, mode: str = "append", most_rows: int = MOST_ROWS) -> None:
    """Writes rows (arquivo, planilha, celulas and the columns of order) as workbooks under a path.

    Sheets and their rows stand in the order of `order`, in which a sheet's rows must come together. Each workbook is
    written by one task, as a stream; workbooks are dealt by name. A task that fails leaves no file.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(WorkbookSource)
    dealt = rows.repartition("arquivo").sortWithinPartitions("arquivo", *order).select("arquivo", "planilha", F.col("celulas").cast(f"array<{CELL}>").alias("celulas"))
    dealt.write.format("ledgerloom_xlsx").option("path", path).option("most_rows", str(most_rows)).mode(mode).save()
