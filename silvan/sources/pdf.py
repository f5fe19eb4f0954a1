"""Text of PDF files as lines: objects, Flate streams, and text operators with their places.

A file is one row and one task, as its objects refer to each other. Objects are found by their marks, the last definition
of a number counting, which is what the cross-reference tables of an updated file say; objects inside object streams are
taken from there. A page's content draws strings at places; strings of one height are a line, in the order of their
places, with a space where there is a gap; a step down of more than `PARAGRAPH` sizes of the font is an empty line. Codes become characters by the font's ToUnicode map, else as one byte of Windows' Latin alphabet.

Not read: encrypted files (an error), other filters than Flate (the stream is left out), fonts without a map whose codes
are no Latin letters, writing that isn't from left to right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: In sizes of the font: a step down that is an empty line, a gap that is a space, an average character's width.
PARAGRAPH, GAP, WIDTH = 1.8, 0.15, 0.5
#: A kerning that is a space, in thousandths of the font's size.
KERNED_SPACE = -180

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, such as /Font."""


class Ref(int):
    """A reference to an object by its number."""


class Operator(bytes):
    """A word that is none of the values."""


def _string(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1] in b"01234567" else b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.S)


def values(data: bytes, at: int = 0) -> Iterator[object]:
    """Numbers, names, strings (bytes), lists, dicts, references and operators from a place on."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(data, at):
        t = m.group()
        if t[:1] == b"%":
            continue
        if t in (b"[", b"<<"):
            stack.append([])
            continue
        if t in (b"]", b">>"):
            if len(stack) == 1:
                return
            inner = stack.pop()
            value: object = inner if t == b"]" else dict(zip(inner[::2], inner[1::2], strict=False))
        elif t[:1] in b"(<":
            value = _string(t)
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), t[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            value = float(t) if b"." in t else int(t)
        elif t == b"R" and len(stack[-1]) > 1 and all(isinstance(v, int) for v in stack[-1][-2:]):
            value = Ref(stack[-1][-2])
            del stack[-1][-2:]
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(t, Operator(t))
        if len(stack) > 1:
            stack[-1].append(value)
        elif isinstance(value, Operator) or not isinstance(value, int) or isinstance(value, Ref):
            yield from stack[0]
            stack[0].clear()
            yield value
        else:
            stack[0].append(value)  # a number may begin a reference
    yield from stack[0]


class Document:
    """The objects of a file, and its pages in order."""

    def __init__(self, data: bytes):
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        self.data = data
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.inner: dict[int, object] = {}
        for number in list(self.places):
            found = self.get(Ref(number))
            if isinstance(found, dict) and found.get("Type") == "ObjStm":
                body, first = self.stream(Ref(number)), found["First"]
                heads = [int(x) for x in body[:first].split()]
                for inner, offset in zip(heads[::2], heads[1::2], strict=False):
                    self.inner.setdefault(inner, next(values(body, first + offset), None))

    def get(self, value: object) -> object:
        """What a value refers to."""
        seen = set()
        while isinstance(value, Ref) and value not in seen:
            seen.add(value)
            number = int(value)
            value = next(values(self.data, self.places[number]), None) if number in self.places else self.inner.get(number)
        return value

    def stream(self, ref: object) -> bytes:
        """A stream's content, empty if its filter isn't known."""
        if not isinstance(ref, Ref) or int(ref) not in self.places:
            return b""
        head = self.get(ref)
        begin = self.data.find(b"stream", self.places[int(ref)]) + 6
        begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
        length = self.get(head.get("Length")) if isinstance(head, dict) else None
        end = begin + length if isinstance(length, int) else -1
        if end < 0 or not self.data[end : end + 12].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", begin)
        raw = self.data[begin:end]
        filters = self.get(head.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f not in ("FlateDecode", "Fl"):
                return b""
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        roots = [d for d in map(self.get, map(Ref, [*self.places, *self.inner])) if isinstance(d, dict) and d.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(ref: object, resources: object, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > 64:
                return
            resources = node.get("Resources", resources)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, resources, depth + 1)
            else:
                out.append({**node, "Resources": resources})

        if roots:
            walk(roots[-1].get("Pages"), None, 0)
        return out

    def characters(self, font: object) -> tuple[int, dict[int, str] | None]:
        """Bytes of a code, and the characters of codes by the font's map; None without one."""
        font = self.get(font) or {}
        body = self.stream(font.get("ToUnicode"))
        wide = 2 if font.get("Subtype") == "Type0" else 1
        if not body:
            return wide, None
        out, held = {}, []
        text = lambda b: b.decode("utf-16-be", "replace")
        for v in values(body):
            if v == b"endbfchar":
                out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
            elif v == b"endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(low, min(high, low + 0xFFFF) + 1):
                        out[k] = text(c[k - low]) if isinstance(c, list) else text(c[:-2] + (int.from_bytes(c[-2:], "big") + k - low).to_bytes(2, "big"))
            if isinstance(v, Operator):
                held = []
            elif isinstance(v, bytes | list):
                held.append(v)
        return wide, out


def _times(m: list[float], n: list[float]) -> list[float]:
    """The matrix product of two transformations, as PDF writes them."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l]


def strings(document: Document, page: dict) -> list[tuple[float, float, float, str]]:
    """x, y, size, text of the strings that a page draws, in the order in which it does."""
    content = document.get(page.get("Contents"))
    parts = content if isinstance(content, list) else [page.get("Contents")]
    resources = document.get(page.get("Resources")) or {}
    fonts = document.get(resources.get("Font")) or {}
    known: dict[str, tuple[int, dict[int, str] | None]] = {}
    out, operands = [], []
    one = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    outer, saved = one, []
    matrix, line, size, leading, font = one, one, 1.0, 0.0, ""

    def decoded(raw: bytes) -> str:
        if font not in known:
            known[font] = document.characters(fonts.get(font))
        wide, table = known[font]
        if table is None:
            return raw.decode("cp1252", "replace")
        return "".join(table.get(int.from_bytes(raw[k : k + wide], "big"), "") for k in range(0, len(raw), wide))

    def show(items: list) -> None:
        nonlocal matrix
        text, advance = "", 0.0
        for item in items:
            if isinstance(item, bytes):
                more = decoded(item)
                text, advance = text + more, advance + len(more) * WIDTH * size
            elif isinstance(item, int | float):
                text, advance = text + (" " if item < KERNED_SPACE and text and not text.endswith(" ") else ""), advance - item / 1000 * size
        at = _times(matrix, outer)
        if text:
            out.append((at[4], at[5], size * (abs(at[3]) or abs(at[1]) or 1.0), text))
        matrix = _times([1, 0, 0, 1, advance, 0], matrix)

    def move(x: float, y: float) -> None:
        nonlocal matrix, line
        matrix = line = _times([1, 0, 0, 1, x, y], line)

    for value in values(b"\n".join(document.stream(p) for p in parts)):
        if not isinstance(value, Operator):
            operands.append(value)
            continue
        op, args, operands = bytes(value), operands, []
        try:
            if op == b"BT":
                matrix = line = one
            elif op == b"Tf":
                font, size = args[-2], float(args[-1])
            elif op == b"TL":
                leading = float(args[-1])
            elif op in (b"Td", b"TD"):
                leading = -float(args[1]) if op == b"TD" else leading
                move(*args)
            elif op == b"Tm":
                matrix = line = [float(v) for v in args]
            elif op == b"T*":
                move(0, -leading)
            elif op in (b"Tj", b"TJ"):
                show(args[-1] if isinstance(args[-1], list) else [args[-1]])
            elif op in (b"'", b'"'):
                move(0, -leading)
                show([args[-1]])
            elif op == b"cm":
                outer = _times([float(v) for v in args], outer)
            elif op == b"q":
                saved.append(outer)
            elif op == b"Q" and saved:
                outer = saved.pop()
        except (IndexError, TypeError, ValueError):
            continue  # an operator without its operands draws nothing
    return out


def page_lines(drawn: list[tuple[float, float, float, str]]) -> list[str]:
    """The lines of a page from its strings: by height from the top, then from the left."""
    rows: list[list[tuple[float, float, float, str]]] = []
    for s in sorted(drawn, key=lambda s: (-s[1], s[0])):
        if rows and abs(rows[-1][0][1] - s[1]) <= 0.3 * max(s[2], 1e-9):
            rows[-1].append(s)
        else:
            rows.append([s])
    out: list[str] = []
    for k, row in enumerate(rows):
        if k and rows[k - 1][0][1] - row[0][1] > PARAGRAPH * max(row[0][2], 1e-9):
            out.append("")
        text, end = "", None
        for x, _, size, part in sorted(row, key=lambda s: s[0]):
            if end is not None and x > end + GAP * size and not text.endswith(" ") and not part.startswith(" "):
                text += " "
            text, end = text + part, x + len(part) * WIDTH * size
        out.append(text.rstrip())
    return out


def text_of(data: bytes) -> str:
    """A file's text: lines of its pages, with a form feed after each page."""
    document = Document(data)
    return "".join("\n".join(page_lines(strings(document, page))) + "\n\f" for page in document.pages())


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """file, text of PDF files (a path or glob that Spark reads), one row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([text_of(content)])], ["file", "text"])

    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("file"), "content").mapInArrow(run, "file string, text string")
