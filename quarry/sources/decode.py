"""Per-file decoders (pure Python, run inside Spark tasks by ``quarry.sources.files``).

Each decoder turns one file's bytes into records: ``(rec_no, orig_row, cells)`` where
``cells`` is the ordered list of ``(pos, key, value)``. The stdlib does the decoding:
``csv``, ``json``, ``zipfile`` and ``xml.etree``.

Modes follow the two code paths of the reference:
* ``live``  - header is record 1, keys ``lower(trim)``; JSON must be a top-level array
  or object whose array values become rows; nested values read as "Array".
* ``lib``   - delimiter and header detection (F22, F23), slug keys (F27), JSON
  ``rows`` / ``data`` envelopes (S07, S08), nested values space-joined (F07).
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
import sys
import zipfile
from itertools import chain, islice
from xml.etree import ElementTree as ET

from ..functions.constants import (DELIMITER_SAMPLE_BYTES, MSG_JSON_INVALID, MSG_UNSUPPORTED)

PHP_TRIM = " \t\n\r\x00\x0b"
_NUMERIC = re.compile(r"^[ \t\n\r\x0b\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0b\f]*$")


def php_trim(s: str) -> str:
    return s.strip(PHP_TRIM)


def ascii_lower(s: str) -> str:
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def is_numeric(s: str) -> bool:
    return bool(_NUMERIC.match(s))


def php_float_str(x: float) -> str:
    """PHP 8 ``(string)$float`` (shortest round-trip digits, E notation outside 1e-4..1e15)."""
    if math.isnan(x):
        return "NAN"
    if math.isinf(x):
        return "INF" if x > 0 else "-INF"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    r = repr(x)
    if "e" in r:
        mant, exp = r.split("e")
        if "." not in mant:
            mant += ".0"
        return f"{mant}E{int(exp):+d}"
    return r


def php_scalar(v, nested: str = "join") -> str:
    """``(string)`` of a decoded JSON value: true -> '1', false / null -> ''."""
    if v is None or v is False:
        return ""
    if v is True:
        return "1"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return php_float_str(v)
    if isinstance(v, str):
        return v
    if nested == "array":
        return "Array"
    vals = [x[1] for x in v.pairs] if isinstance(v, _Obj) else v
    return " ".join(php_scalar(x, "array") for x in vals)


def _is_blank(v) -> bool:
    """Whether a nested value, its members joined by blanks, is blank."""
    if isinstance(v, (_Obj, list)):
        members = [x for _, x in v.pairs] if isinstance(v, _Obj) else v
        return all(_is_blank(x) for x in members)
    return php_trim(php_scalar(v)) == ""


class _Digits(str):
    """An integer as its digits: PHP turns what doesn't fit 64 bits into a float."""

    def __new__(cls, digits: str):
        if len(digits) < 19 or -(1 << 63) <= int(digits[:25]) < 1 << 63 and len(digits) < 21:
            return str.__new__(cls, int(digits))
        return str.__new__(cls, php_float_str(float(digits)))


class _Obj:
    """A JSON object with its key order and repeated keys kept."""

    __slots__ = ("pairs",)

    def __init__(self, pairs):
        self.pairs = pairs


def _cells_from_pairs(pairs, key_fn, nested: str) -> list[tuple[int, str, str]]:
    out = []
    for i, (k, v) in enumerate(pairs):
        out.append((i, key_fn(str(k)), _live_value(v) if nested == "array" else php_scalar(v, nested)))
    return out


def _live_value(v) -> str:
    """A nested value reads as 'Array', unless it holds nothing: then it is blank, as the
    blank test joins its members."""
    return "" if isinstance(v, (_Obj, list)) and _is_blank(v) else php_scalar(v, "array")


def _live_key(k: str) -> str:
    return ascii_lower(php_trim(k))


def slug(h: str) -> str:
    """F27 ``sanitize_title_with_dashes`` (our definition)."""
    s = re.sub(r"<[^>]*>", "", h).lower()
    s = re.sub(r"[^a-z0-9 _-]", "", s)
    s = re.sub(r"[ ]+", "-", s)
    s = re.sub(r"-+", "-", s)
    return s.strip("-")


def detect_delimiter(sample: bytes) -> str:
    """F22 over the first 4096 bytes: the most frequent one, of equal ones the first here."""
    return max(",;\t", key=sample[:DELIMITER_SAMPLE_BYTES].decode("latin-1").count)


def looks_like_header(row: list[str]) -> bool:
    """at least half of the cells, blank ones included, hold text that is no number."""
    full = [t for t in (php_trim(c or "") for c in row) if t]
    return bool(row) and 2 * sum(not is_numeric(t) for t in full) >= len(row)


def _text(content: bytes, strip_bom: bool) -> str:
    return content.decode("utf-8-sig" if strip_bom else "utf-8", errors="replace")


# ---------------------------------------------------------------------------
# CSV
# ---------------------------------------------------------------------------
def _csv_rows(content, strip_bom: bool, delimiter: str):
    """Rows of a CSV file, read as they are asked for: memory is a row, not the file's text."""
    import pyarrow as pa

    csv.field_size_limit(sys.maxsize)  # cells of any length
    text = io.TextIOWrapper(pa.BufferReader(content), "utf-8-sig" if strip_bom else "utf-8", errors="replace", newline="")
    return csv.reader(text, delimiter=delimiter)


def read_csv(content, mode: str = "live", strip_bom: bool = True, delimiter: str | None = None,
             has_header: bool | None = None):
    """Returns (iterator of records, has_header). Records: (rec_no, orig_row, cells).

    The file is read once before the first record comes, so one that can't be read to its end
    fails before it has given any."""
    if mode == "live":
        rows = lambda: _csv_rows(content, strip_bom, delimiter or ",")
        names = next(rows(), None)
        if names is None:
            return iter(()), False
        for _ in rows():
            pass
        header = [_live_key(h) for h in (names or [""])]
        return ((idx, idx + 2, [(i, h, data[i] if i < len(data) else "") for i, h in enumerate(header)])
                for idx, data in enumerate(islice(rows(), 1, None))), True
    delim = delimiter or detect_delimiter(bytes(content[:DELIMITER_SAMPLE_BYTES]))
    rows = lambda: _csv_rows(content, strip_bom, delim)
    # library parser (S03): first non-BOM-blank record is the header candidate
    first, head, n = None, None, 0
    for i, r in enumerate(rows()):
        n = i + 1
        if first is None and r and not (len(r) == 1 and php_trim(r[0]) == ""):
            first, head = i, r
    if not n:
        return iter(()), False
    hh = has_header
    if hh is None:
        hh = first is not None and n >= 2 and looks_like_header(head)
    if hh and first is not None:
        names = [slug(php_trim(h)) or php_trim(h) for h in head]

        def named():
            for idx, r in enumerate(rows()):
                if idx == first:  # Q7 fixed: skip the header's own ordinal
                    continue
                cells = [(i, n, php_trim(r[i]) if i < len(r) else "") for i, n in enumerate(names)]
                for j in range(len(names), len(r)):
                    cells.append((j, str(j), php_trim(r[j])))
                yield idx, idx + 1, cells
        return named(), True
    return ((idx, idx + 1, [(i, str(i), php_trim(v)) for i, v in enumerate(r)]) for idx, r in enumerate(rows())), False


def decode_csv(content: bytes, mode: str = "live", strip_bom: bool = True, delimiter: str | None = None,
               has_header: bool | None = None):
    """Returns (records, has_header, error), with all records in a list."""
    recs, hh = read_csv(content, mode, strip_bom, delimiter, has_header)
    return list(recs), hh, None


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------
def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def _loads(text: str):
    # integers of any length; NaN and Infinity aren't JSON
    return json.loads(text, object_pairs_hook=_Obj, parse_int=_Digits, parse_constant=_refuse)


def decode_json(content: bytes, mode: str = "live", strip_bom: bool = True):
    text = _text(content, strip_bom)
    try:
        doc = _loads(text)
    except ValueError:
        return [], False, (MSG_JSON_INVALID if mode == "live" else None)
    if mode == "live":
        if isinstance(doc, _Obj):
            items = [v for _, v in doc.pairs]
        elif isinstance(doc, list):
            items = doc
        else:
            return [], False, MSG_JSON_INVALID
        out = []
        for item in items:
            if isinstance(item, _Obj):
                cells = _cells_from_pairs(item.pairs, _live_key, "array")
            elif isinstance(item, list):
                cells = [(i, str(i), _live_value(v)) for i, v in enumerate(item)]
            else:
                continue  # non-array items are skipped silently
            idx = len(out)
            out.append((idx, idx + 1, cells))
        return out, False, None
    # library parser (S07 + S08 + F07)
    rows = _envelope_rows(doc)
    out = []
    for idx, r in enumerate(rows):
        if isinstance(r, _Obj):
            cells = [(i, str(k), php_trim(php_scalar(v))) for i, (k, v) in enumerate(r.pairs)]
        elif isinstance(r, list):
            cells = [(i, str(i), php_trim(php_scalar(v))) for i, v in enumerate(r)]
        else:
            cells = [(0, "0", php_trim(php_scalar(r)))]
        out.append((idx, idx + 1, cells))
    return out, False, None


def _envelope_rows(doc) -> list:
    if isinstance(doc, _Obj):
        d = {}
        for k, v in doc.pairs:
            d[k] = v
        for key in ("rows", "data"):
            if key in d and isinstance(d[key], (list, _Obj)):
                v = d[key]
                return [x for _, x in v.pairs] if isinstance(v, _Obj) else v
        return [v for _, v in doc.pairs]
    if isinstance(doc, list):
        return doc
    return []


def is_rows_shape(doc) -> bool:
    """A list -> true; for an object the first non-integer key decides:
    nested value -> true, scalar -> false; empty -> true."""
    if isinstance(doc, list):
        return True
    if not isinstance(doc, _Obj):
        return False
    for k, v in doc.pairs:
        if not re.fullmatch(r"-?(0|[1-9][0-9]*)", k):
            return isinstance(v, (list, _Obj))
    return True


# ---------------------------------------------------------------------------
# XLSX (active sheet, raw values, formulas as text)
# ---------------------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n


def _col_letter(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def read_xlsx_grid(content: bytes) -> dict[int, dict[int, str]]:
    """{row_number: {column_number: text}} of the active sheet."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    sheet_path = "xl/worksheets/sheet1.xml"
    if "xl/workbook.xml" in names:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        view = wb.find("m:bookViews/m:workbookView", _NS)
        active = int(view.get("activeTab", "0")) if view is not None else 0
        sheets = wb.findall("m:sheets/m:sheet", _NS)
        if sheets and "xl/_rels/workbook.xml.rels" in names:
            rid = sheets[min(active, len(sheets) - 1)].get(f"{{{_NS['r']}}}id")
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for rel in rels.findall("rel:Relationship", _NS):
                if rel.get("Id") == rid:
                    target = rel.get("Target").lstrip("/")
                    sheet_path = target if target.startswith("xl/") else "xl/" + target
    root = ET.fromstring(z.read(sheet_path))
    grid: dict[int, dict[int, str]] = {}
    for row in root.iter(f"{{{_NS['m']}}}row"):
        rn = int(row.get("r"))
        cells = grid.setdefault(rn, {})
        for c in row.findall("m:c", _NS):
            col = _col_index(c.get("r", "")) or (max(cells) + 1 if cells else 1)
            t = c.get("t", "n")
            f = c.find("m:f", _NS)
            v = c.find("m:v", _NS)
            if f is not None and f.text:
                val = "=" + f.text
            elif t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            elif t == "b" and v is not None:
                val = "1" if v.text == "1" else ""
            elif v is not None and v.text is not None:
                val = v.text
                if t == "n":
                    try:
                        val = php_float_str(float(val)) if re.search(r"[.eE]", val) else str(int(val))
                    except ValueError:
                        pass
            else:
                val = ""
            cells[col] = val
    return grid


def decode_xlsx(content: bytes, mode: str = "live"):
    grid = read_xlsx_grid(content)
    if not grid:
        return [], True, None
    high_row = max(grid)
    high_col = max((max(r) for r in grid.values() if r), default=0)
    head = grid.get(1, {})
    if mode == "live":
        header = [_live_key(head.get(c, "")) for c in range(1, high_col + 1)]
    else:
        header = []
        for c in range(1, high_col + 1):
            s = slug(head.get(c, ""))
            header.append(s if s != "" else _col_letter(c))
    out = []
    for r in range(2, high_row + 1):
        row = grid.get(r, {})
        cells = [(c - 1, header[c - 1], row.get(c, "")) for c in range(1, high_col + 1)]
        out.append((r - 2, r, cells))
    return out, True, None


def decode_file(name: str, content: bytes, mode: str = "live", strip_bom: bool = True,
                delimiter: str | None = None, has_header: bool | None = None):
    """S01 routing by lower-cased extension. Returns (records, has_header, error), those of CSV
    files as an iterator; whatever goes wrong in a file is that file's error and ends no other file."""
    ext = ascii_lower(name.rsplit(".", 1)[-1]) if "." in name.rsplit("/", 1)[-1] else ""
    try:
        if ext == "csv" or (mode == "lib" and ext == "txt"):
            return *read_csv(content, mode, strip_bom, delimiter, has_header), None
        content = bytes(content)
        if ext == "json":
            return decode_json(content, mode, strip_bom)
        if ext == "xlsx":
            return decode_xlsx(content, mode)
        if ext == "xls":
            return [], False, "PhpSpreadsheet error: legacy .xls workbooks are not supported"
        if mode == "lib":
            recs, hh = read_csv(content, mode, strip_bom, delimiter, has_header)
            one = next(recs, None)
            return (chain([one], recs), hh, None) if one else decode_json(content, mode, strip_bom)
        return [], False, MSG_UNSUPPORTED
    except csv.Error as e:
        return [], False, f"CSV error: {e}"
    except RecursionError:
        return [], False, MSG_JSON_INVALID
    except Exception as e:
        return [], False, f"{'PhpSpreadsheet error: ' if ext == 'xlsx' else ''}{type(e).__name__}: {e}"
