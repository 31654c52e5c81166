"""Cells of legacy binary workbooks: BIFF8 records in a compound file, read with bounds checks and the standard library alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Record types of the format.
BOF, EOF_, CONTINUE, SHEET, SST, LABEL_SST, LABEL, NUMBER, RK, MULTI_RK, BOOL_ERROR, FORMULA, STRING, PASSWORD = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0x2F


class Compound:
    """A compound file: sectors, their chains, and named streams."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, small_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small_shift != 6:
            raise ValueError("sectors of an unknown size")
        self.size = 1 << shift
        directory, self.cutoff, small_fat = struct.unpack_from("<I4xII", data, 48)
        more, n_more = struct.unpack_from("<II", data, 68)
        places = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while more < END and n_more and more not in seen:
            seen.add(more)
            *part, more = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            places += part
        self.fat: list[int] = []
        for at in places:
            if at < END:
                self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(at))
        raw = self.chain(directory)
        entries = [self._entry(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        root = next((e for e in entries if e[1] == 5), None)
        self.small = self.chain(root[2]) if root else b""
        table = self.chain(small_fat) if small_fat < END else b""
        self.small_fat = struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])
        self.streams = {name: (start, n) for name, kind, start, n in entries if kind == 2}

    def sector(self, at: int) -> bytes:
        start = (at + 1) * self.size
        if start + self.size > len(self.data) + self.size - 1 or start >= len(self.data):
            raise ValueError("a sector outside the file")
        return self.data[start : start + self.size].ljust(self.size, b"\0")

    @staticmethod
    def _entry(raw: bytes) -> tuple[str, int, int, int]:
        length = min(64, struct.unpack_from("<H", raw, 64)[0])
        start, size = struct.unpack_from("<II", raw, 116)
        return raw[: max(0, length - 2)].decode("utf-16-le", "replace"), raw[66], start, size

    def _walk(self, start: int, table) -> Iterator[int]:
        at, steps = start, 0
        while at < END:
            if at >= len(table) or steps > len(table):
                raise ValueError("a broken chain of sectors")
            yield at
            at, steps = table[at], steps + 1

    def chain(self, start: int) -> bytes:
        return b"".join(self.sector(at) for at in self._walk(start, self.fat))

    def stream(self, name: str) -> bytes | None:
        if name not in self.streams:
            return None
        start, size = self.streams[name]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        return b"".join(self.small[at * 64 : at * 64 + 64] for at in self._walk(start, self.small_fat))[:size]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Place, type and body of each record."""
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield at, kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


def _strings(parts: list[bytes]) -> list[str]:
    """The shared strings. Characters may be cut by the end of a record, behind which the next one says anew how wide they are."""
    (count,) = struct.unpack_from("<4xI", parts[0])
    part, at, out = 0, 8, []

    def need(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
                if part >= len(parts):
                    raise ValueError("shared strings are cut")
            more = parts[part][at : at + n - len(got)]
            got, at = got + more, at + len(more)
        return got

    while len(out) < count and (at < len(parts[part]) or part + 1 < len(parts)):
        n, flags = struct.unpack("<HB", need(3))
        runs = struct.unpack("<H", need(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", need(4))[0] if flags & 4 else 0
        wide, text = flags & 1, ""
        while len(text) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
                if part >= len(parts):
                    raise ValueError("shared strings are cut")
                wide, at = parts[part][0] & 1, 1
            here = min(n - len(text), (len(parts[part]) - at) // (2 if wide else 1))
            if not here:
                raise ValueError("shared strings are cut")
            raw = need(here * (2 if wide else 1))
            text += raw.decode("utf-16-le", "surrogatepass") if wide else raw.decode("latin-1")
        need(4 * runs + extra)
        out.append(text)
    return out


def _text(raw: bytes, at: int) -> str:
    """A string with a length of two bytes."""
    n, flags = struct.unpack_from("<HB", raw, at)
    return raw[at + 3 : at + 3 + 2 * n].decode("utf-16-le", "replace") if flags & 1 else raw[at + 3 : at + 3 + n].decode("latin-1")


def _packed(rk: int) -> float:
    """A number in 30 bits: the upper ones of a double, or a whole one; perhaps in hundredths."""
    value = float(rk >> 2 if rk < 1 << 31 else (rk >> 2) - (1 << 30)) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def _cells(stream: bytes, start: int, shared: list[str]) -> dict[tuple[int, int], object]:
    found: dict[tuple[int, int], object] = {}
    depth, waits = 0, None
    for _, kind, raw in records(stream, start):
        if kind == BOF:
            depth += 1
        elif kind == EOF_:
            depth -= 1
            if not depth:
                break
        elif depth != 1:  # a chart inside a sheet
            continue
        elif kind == LABEL_SST:
            row, column, _, which = struct.unpack_from("<HHHI", raw)
            found[row, column] = shared[which]
        elif kind == LABEL:
            found[struct.unpack_from("<HH", raw)] = _text(raw, 6)
        elif kind == NUMBER:
            row, column, _, value = struct.unpack_from("<HHHd", raw)
            found[row, column] = value
        elif kind == RK:
            row, column, _, rk = struct.unpack_from("<HHHI", raw)
            found[row, column] = _packed(rk)
        elif kind == MULTI_RK:
            row, first = struct.unpack_from("<HH", raw)
            for i in range((len(raw) - 6) // 6):
                found[row, first + i] = _packed(struct.unpack_from("<I", raw, 4 + 6 * i + 2)[0])
        elif kind == BOOL_ERROR:
            row, column, _, value = struct.unpack_from("<HHHB", raw)
            found[row, column] = value
        elif kind == FORMULA:
            row, column = struct.unpack_from("<HH", raw)
            if raw[12:14] != b"\xff\xff":
                found[row, column] = struct.unpack_from("<d", raw, 6)[0]
            elif raw[6] == 0:
                waits = row, column  # its text is in the next record
            elif raw[6] in (1, 2):
                found[row, column] = raw[8]
        elif kind == STRING and waits:
            found[waits], waits = _text(raw, 0), None
    return found


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Each worksheet's name and the values of its rows, in order; empty cells are left out."""
    file = Compound(data)
    stream = file.stream("Workbook")
    if stream is None:
        raise ValueError("no workbook of this format in the file")
    named, parts, last = [], [], 0
    for _, kind, raw in records(stream):
        if kind == PASSWORD:
            raise ValueError("the workbook is encrypted")
        if kind == SHEET:
            place, _, what, n, wide = struct.unpack_from("<IBBBB", raw)
            name = raw[8 : 8 + 2 * n].decode("utf-16-le", "replace") if wide & 1 else raw[8 : 8 + n].decode("latin-1")
            if what == 0:
                named.append((name, place))
        elif kind == SST or kind == CONTINUE and last in (SST, CONTINUE) and parts:
            parts.append(raw)
        elif kind == EOF_:
            break
        last = kind
    shared, out = _strings(parts) if parts else [], []
    for name, place in named:
        rows: dict[int, list[str]] = {}
        for (row, _), value in sorted(_cells(stream, place, shared).items()):
            if value != "":
                rows.setdefault(row, []).append(str(value))
        out.append((name, list(rows.values())))
    return out
