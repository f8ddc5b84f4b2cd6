"""Legacy workbooks (BIFF8 in an OLE container): values only; formulas and encryption are refused."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Record numbers of the format.
BOF, EOF, FILEPASS, BOUNDSHEET, SST, CONTINUE = 0x0809, 0x000A, 0x002F, 0x0085, 0x00FC, 0x003C
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA = 0x00FD, 0x0204, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006
_ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


class BiffError(ValueError):
    """A legacy workbook that can't be read."""


def workbook_stream(data: bytes) -> bytes:
    """The stream named Workbook, put together along its chain of sectors."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise BiffError("no OLE container")
    size = 1 << struct.unpack_from("<H", data, 30)[0]
    n_fat, directory, _, cutoff, mini_fat, n_mini, difat, n_difat = struct.unpack_from("<I", data, 44) + struct.unpack_from("<I", data, 48) + (0,) + struct.unpack_from("<IIIII", data, 56)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    blocks = list(struct.unpack_from("<109I", data, 76))
    while n_difat and difat < 0xFFFFFFFC:
        more = struct.unpack(f"<{size // 4}I", sector(difat))
        blocks += more[:-1]
        difat, n_difat = more[-1], n_difat - 1
    fat = [x for b in blocks[:n_fat] if b < 0xFFFFFFFC for x in struct.unpack(f"<{size // 4}I", sector(b))]

    def chain(first: int, table: list[int]) -> Iterator[int]:
        seen = set()
        while first < 0xFFFFFFFC:
            if first in seen or first >= len(table):
                raise BiffError("broken sector chain")
            seen.add(first)
            yield first
            first = table[first]

    entries = b"".join(map(sector, chain(directory, fat)))
    root = None
    for at in range(0, len(entries), 128):
        length = struct.unpack_from("<H", entries, at + 64)[0]
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        first, total = struct.unpack_from("<II", entries, at + 116)
        if entries[at + 66] == 5:
            root = first
        if name in ("Workbook", "Book"):
            if total >= cutoff:
                return b"".join(map(sector, chain(first, fat)))[:total]
            small = b"".join(map(sector, chain(root, fat)))
            mini = [x for b in chain(mini_fat, fat) for x in struct.unpack(f"<{size // 4}I", sector(b))]
            return b"".join(small[i * 64 : i * 64 + 64] for i in chain(first, mini))[:total]
    raise BiffError("no workbook stream")


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield at, kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Strings:
    """Shared strings over records that go on in others; characters that go on begin with a new width flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
            got = self.parts[self.k][self.at : self.at + n - len(out)]
            self.at += len(got)
            out += got
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = self.parts[self.k][0] & 1
            m = min(n, (len(self.parts[self.k]) - self.at) // (1 + wide))
            out += self.take(m * (1 + wide)).decode("utf-16-le" if wide else "latin-1")
            n -= m
        self.take(4 * runs + extra)
        return out


def _number(raw: int) -> float | int:
    value = float(raw >> 2 if raw < 0x80000000 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    value = value / 100 if raw & 1 else value
    return int(value) if value == int(value) else value


def biff_sheets(data: bytes) -> Iterator[tuple[str, list[tuple[int, list, list]]]]:
    """(name, [(row number, values, error cells)]) of each sheet, as the OOXML reader gives them."""
    stream = workbook_stream(data)
    names, strings, parts, open_sst = [], [], [], False
    for _, kind, body in _records(stream):
        if kind == FILEPASS:
            raise BiffError("encrypted workbook")
        if kind == BOUNDSHEET:
            at, n, wide = struct.unpack_from("<I", body)[0], body[6], body[7] & 1
            names.append((at, body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")))
        if kind == SST or (kind == CONTINUE and open_sst):
            parts.append(body)
        open_sst = kind in (SST, CONTINUE) and bool(parts) and (kind == SST or open_sst)
        if kind == EOF:
            break
    if parts:
        reader = _Strings(parts)
        count = struct.unpack("<II", reader.take(8))[1]
        strings = [reader.string() for _ in range(count)]
    for at, name in names:
        cells: dict[int, dict[int, object]] = {}
        errors: dict[int, list[str]] = {}
        for _, kind, body in _records(stream, at):
            if kind == EOF:
                break
            if kind == FORMULA:
                raise BiffError(f"formula in sheet {name}")
            if kind in (LABELSST, LABEL, NUMBER, RK, BOOLERR, MULRK):
                row, column = struct.unpack_from("<HH", body)
                put = cells.setdefault(row, {})
                if kind == LABELSST:
                    put[column] = strings[struct.unpack_from("<I", body, 6)[0]]
                elif kind == LABEL:
                    n, wide = struct.unpack_from("<HB", body, 6)
                    put[column] = body[9 : 9 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1")
                elif kind == NUMBER:
                    value = struct.unpack_from("<d", body, 6)[0]
                    put[column] = int(value) if value == int(value) else value
                elif kind == RK:
                    put[column] = _number(struct.unpack_from("<I", body, 6)[0])
                elif kind == MULRK:
                    for k in range((len(body) - 6) // 6):
                        put[column + k] = _number(struct.unpack_from("<I", body, 6 + 6 * k)[0])
                elif body[7]:
                    put[column] = _ERRORS.get(body[6], f"#ERR{body[6]}")
                    errors.setdefault(row, []).append(f"{column}={put[column]}")
                else:
                    put[column] = bool(body[6])
        yield name, [(r + 1, [c.get(i) for i in range(max(c) + 1)], errors.get(r, [])) for r, c in sorted(cells.items())]
