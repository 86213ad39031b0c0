"""Directories of ZIP archives, read by ranges and without extraction.

Only what locates members is read: the end record, the ZIP64 end record where sizes or
counts need it, the central directory, and the local header of a wanted member.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
# An end record is 22 bytes and may carry a comment of 65,535 bytes.
TAIL = 22 + 65_535


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0 is stored
    packed: int  # bytes in the archive
    size: int
    header: int  # where the local header starts


def members(file, length: int) -> list[Member]:
    """All members named by the central directory of an open archive of ``length`` bytes."""
    start, size, count = _directory(file, length)
    data = file.read_at(size, start)
    out, at = [], 0
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, name, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
        (header,) = struct.unpack_from("<I", data, at + 42)
        raw = data[at + 46 : at + 46 + name]
        full, packed, header = _wide(data[at + 46 + name : at + 46 + name + extra], full, packed, header)
        out.append(Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, full, header))
        at += 46 + name + extra + comment
    return out


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = file.read_at(30, member.header)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header where the directory says")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name + extra


def _directory(file, length: int) -> tuple[int, int, int]:
    tail_at = max(0, length - TAIL)
    tail = file.read_at(length - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature was part of a comment
    if at < 0:
        raise ValueError("not a ZIP archive")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 in (count,) or FULL32 in (size, start):
        locator = file.read_at(20, tail_at + at - 20)
        if locator[:4] != LOCATOR:
            raise ValueError("a ZIP64 directory is announced but not there")
        record = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != END64:
            raise ValueError("the ZIP64 end record is damaged")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    return start, size, count


def _wide(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int, int]:
    """Replace fields that are full by those of the ZIP64 extra field, which come in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return tuple(next(values) if v == FULL32 else v for v in (full, packed, header))
        at += 4 + size
    return full, packed, header
