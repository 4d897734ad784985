"""Blocked gzip: a file of small gzip members, each of which says in its header how long it is.

Any gzip reader unpacks such a file. As members are short and independent, a task can find the first that begins in its range of
bytes and unpack from there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

#: Fixed values of the format. First bytes of a member with extra fields; name of the field that holds its length less one;
#: bytes of text in a member; the empty member at the end.
MAGIC, FIELD, TEXT_BYTES = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 65_280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: A member's largest length; what is read at once.
LARGEST, READ_BYTES = 1 << 16, 4 << 20


class NotBlocked(ValueError):
    """A member without a length."""


def member_length(head: bytes) -> int | None:
    """Of the member that begins here, if it names one."""
    if head[:4] != MAGIC or len(head) < 18:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        if head[at : at + 4] == FIELD:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + int.from_bytes(head[at + 2 : at + 4], "little")
    return None


def unpacked(member: bytes) -> bytes:
    text = zlib.decompress(member[12 + int.from_bytes(member[10:12], "little") : -8], -15)
    if zlib.crc32(text) != int.from_bytes(member[-8:-4], "little"):
        raise zlib.error("a member's checksum is wrong")
    return text


def find_member(f, at: int, stop: int) -> int | None:
    """Where the first member begins that begins in [at, stop): it unpacks, and any gzip member or the end of the file follows."""
    f.seek(at)
    window = f.read(min(stop - at, LARGEST) + 2 * LARGEST)
    place = window.find(MAGIC)
    while 0 <= place < stop - at:
        length = member_length(window[place : place + LARGEST])
        after = window[place + length : place + length + 2] if length else b""
        if length and (after == MAGIC[:2] or (not after and place + length == len(window))):
            try:
                unpacked(window[place : place + length])
                return at + place
            except zlib.error:
                pass
        place = window.find(MAGIC, place + 1)
    return None


def members(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, its text) of the members from ``at`` on."""
    f.seek(at)
    held = b""
    while True:
        if len(held) < LARGEST and (more := f.read(READ_BYTES)):
            held += more
        if not held:
            return
        place = 0
        while len(held) - place >= 18:
            length = member_length(held[place : place + LARGEST])
            if length is None:
                raise NotBlocked(f"no blocked gzip at byte {at + place}")
            if place + length > len(held):
                break
            yield at + place, unpacked(held[place : place + length])
            place += length
        if not place and not more:
            raise NotBlocked(f"a broken member at byte {at}")
        held, at = held[place:], at + place


def is_blocked(head: bytes) -> bool:
    return member_length(head) is not None


class BlockedWriter:
    """Packs what is written into members."""

    def __init__(self, f, level: int = 6):
        self.f, self.level, self.held = f, level, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= TEXT_BYTES:
            self._pack(bytes(self.held[:TEXT_BYTES]))
            del self.held[:TEXT_BYTES]

    def _pack(self, text: bytes) -> None:
        for level in (self.level, 0):
            packer = zlib.compressobj(level, zlib.DEFLATED, -15)
            body = packer.compress(text) + packer.flush()
            if len(body) + 26 <= LARGEST:
                break
        head = MAGIC + bytes(5) + b"\xff\x06\x00" + FIELD + (len(body) + 25).to_bytes(2, "little")
        self.f.write(head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little"))

    def close(self) -> None:
        if self.held:
            self._pack(bytes(self.held))
            self.held.clear()
        self.f.write(END)
