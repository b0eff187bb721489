"""A sentencepiece model file read without the library: pieces, scores, and the normaliser.

`Normalizer` does longest-prefix normalisation through the compiled character map (a
double-array trie over UTF-8 bytes) and records, for every byte it writes, the source byte
that it stands for.
"""

from __future__ import annotations

import struct

import numpy as np

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def fields(blob: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at, n = 0, len(blob)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    while at < n:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = 8
            if kind == 5:
                size = 4
            elif kind == 2:
                size, at = varint(at)
            value, at = blob[at : at + size], at + size
        yield key >> 3, value


class Normalizer:
    def __init__(self, spec: dict):
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        charsmap = spec.get(2, b"")
        self.units, self.strings = [], b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = np.frombuffer(charsmap, dtype="<u4", count=size // 4, offset=4).tolist()
            self.strings = charsmap[4 + size :]

    @property
    def plain(self) -> bool:
        """Only spaces change, one by one: no character map, nothing squeezed."""
        return not len(self.units) and not self.squeeze and self.escape and self.dummy

    def _longest(self, source: bytes, at: int) -> tuple[bytes, int]:
        """What the longest mapped prefix at a place becomes, and how many bytes it takes."""
        units, found, took = self.units, None, 0
        if units:
            node = _offset(units[0])
            for k in range(at, len(source)):
                node ^= source[k]
                unit = units[node]
                if unit & 0x800000FF != source[k]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    found, took = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is not None:
            return self.strings[found : self.strings.index(b"\0", found)], took
        lead = source[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        char = source[at : at + size]
        try:
            char.decode("utf-8")
        except UnicodeDecodeError:
            return "�".encode(), 1
        return char, size

    def _spaces_only(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The same for a map without entries, where the longest prefix is one character and stands for itself."""
        mark = SPACE.encode()
        b = np.frombuffer(source, dtype=np.uint8)
        char = np.maximum.accumulate(np.where(b & 0xC0 != 0x80, np.arange(len(b), dtype=np.int64), 0))
        align = np.repeat(char, np.where(b == 0x20, len(mark), 1))
        return mark + source.replace(b" ", mark), np.concatenate((np.zeros(len(mark), np.int64), align, [len(b)]))

    def __call__(self, source: bytes) -> tuple[bytes, list[int]]:
        """Normalised UTF-8, and for each of its bytes (and its end) the source byte."""
        if self.plain and source and _valid(source):
            return self._spaces_only(source)
        parts, at, n = [], 0, len(source)
        while at < n:
            to, took = self._longest(source, at)
            parts.append((to, at, took))
            at += took
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        if not parts:
            return b"", [n]
        mark = SPACE.encode() if self.escape else b" "
        out, align = bytearray(), []
        if self.dummy:
            out += mark
            align += [parts[0][1]] * len(mark)
        spaced = self.squeeze
        kept_to = parts[-1][1] + parts[-1][2]
        for to, at, took in parts:
            if self.squeeze and spaced:
                to = to.lstrip(b" ")
            if to:
                for byte in to:
                    piece = mark if byte == 0x20 else bytes((byte,))
                    out += piece
                    align += [at] * len(piece)
                spaced = to.endswith(b" ")
        if self.squeeze:
            while out.endswith(mark):
                kept_to = align[-len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        return bytes(out), [*align, kept_to]


def _valid(source: bytes) -> bool:
    try:
        source.decode()
    except UnicodeDecodeError:
        return False
    return True


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class ModelFile:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.blob = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.trainer, norm = {}, {}
        for number, value in fields(self.blob):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                self.trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.normalizer = Normalizer(norm)
        self.byte_fallback = bool(self.trainer.get(35, 0))

    @property
    def by_word(self) -> bool:
        """No piece has a space mark after another character, so what stands before a mark never joins what follows it."""
        inner = any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED))
        return not inner and USER_DEFINED not in self.kinds and not self.trainer.get(24, 0)
