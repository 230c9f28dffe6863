"""64-bit bit-difference fingerprints (SimHash) and the block tables to look them up."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_IDEOGRAPH = "぀-ヿ㐀-鿿豈-﫿฀-๿"
_UNITS = re.compile(f"[{_IDEOGRAPH}]|[^\\W_{_IDEOGRAPH}]+")
_SINGLE, _WORD = re.compile(f"[{_IDEOGRAPH}]"), re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Compatibility form, case-folded; typographic signs and spacing are left to units()."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold()


def units(text: str) -> list[str]:
    """Words, or single characters of scripts without spaces, of a normal() text."""
    if not text.isascii() and _SINGLE.search(text):
        return _UNITS.findall(text)
    return _WORD.findall(text.replace("_", " "))


class Hasher:
    """64-bit hashes of units, remembered within a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


class _Characters:
    """Tables by code point: a random odd value (0 for what parts units), and 2 for characters that are units by themselves, 1 for others of words."""

    def __init__(self, size: int):
        self.kind = np.fromiter(map(str.isalnum, map(chr, range(size))), np.uint8, size)
        self.kind[[ord(m[0]) for m in _SINGLE.finditer("".join(map(chr, range(0x10000))))]] = 2
        with np.errstate(over="ignore"):
            value = (np.arange(1, size + 1, dtype=np.uint64) * _MIX) ^ np.uint64(0x5851F42D4C957F2D)
            value ^= value >> np.uint64(32)
            value *= np.uint64(0xC2B2AE3D27D4EB4F)
            value ^= value >> np.uint64(29)
        self.value = np.where(self.kind > 0, value | np.uint64(1), np.uint64(0))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of an odd number and of its inverse, modulo 2**64."""
        if len(self.up) < n:
            size, base = max(4096, 2 * n), 0x9FB21C651E98DF25
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_CHARACTERS: list[_Characters] = []  # the first two planes, made when needed, or all of them


def _tables() -> _Characters:
    if not _CHARACTERS:
        _CHARACTERS.append(_Characters(0x20000))
    return _CHARACTERS[0]


class Units:
    """The units() of a normal() text as arrays: their hashes and first code points."""

    def __init__(self, text: str):
        tables = _tables()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.intp)
        if len(codes) and int(codes.max()) >= len(tables.kind):
            tables = _CHARACTERS[0] = _Characters(0x110000)
        kind = tables.kind.take(codes)
        begins = kind > 0
        self._codes, self._inside = codes, begins.copy()
        begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        self._starts = starts = np.flatnonzero(begins)
        self.first = codes.take(starts)
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        up, down = tables.powers(len(codes))
        # a unit's sum of values times powers, moved to the first power; what follows it up to the next one counts 0
        hashes = np.add.reduceat(tables.value.take(codes) * up, starts) * down.take(starts)
        hashes ^= hashes >> np.uint64(32)
        hashes *= _MIX
        hashes ^= hashes >> np.uint64(29)
        self.hashes = hashes

    def lengths(self) -> np.ndarray:
        """Characters of each unit."""
        return np.add.reduceat(self._inside.view(np.uint8), self._starts, dtype=np.int64) if len(self._starts) else np.zeros(0, np.int64)

    def letters(self) -> bytes:
        """The characters of all units without a gap, four bytes each."""
        return self._codes.compress(self._inside).astype(np.int32).tobytes()


class _Normal:
    """Tables by code point as _Characters has them, first of what normal() makes of the character, then, from `size` on, of the character itself.

    apart: 1 for characters of which normal() isn't known without the text
    around them, or is several characters that belong to units.
    """

    def __init__(self, plain: _Characters):
        self.size = size = len(plain.kind)
        characters = list(map(chr, range(size)))
        parts = [d.split() for d in map(unicodedata.decomposition, characters) if d and d[0] != "<"]
        joining = {chr(int(p[1], 16)) for p in parts if len(p) > 1} | set(map(chr, range(0x1100, 0x1200)))
        self.to = np.arange(size, dtype=np.int32)
        self.apart = np.zeros(size, np.uint8)
        hidden = np.zeros(size, bool)
        for i, c in enumerate(characters):
            form = c if i < 128 else unicodedata.normalize("NFKC", c)
            folded = form.casefold()
            if i >= 128 and any(unicodedata.combining(x) or x in joining for f in form for x in (f, unicodedata.normalize("NFKD", f)[0])):
                self.apart[i] = 1
            elif len(folded) == 1 and ord(folded) < size:
                self.to[i] = ord(folded)
            elif any(map(str.isalnum, folded)):
                self.apart[i] = 1
            else:
                hidden[i] = True
        kind, value = plain.kind.take(self.to), plain.value.take(self.to)
        kind[hidden], value[hidden] = 0, 0
        self.kind, self.value = np.concatenate([kind, plain.kind]), np.concatenate([value, plain.value])
        self.to = np.concatenate([self.to, np.arange(size, dtype=np.int32)])


_NORMAL: list[_Normal] = []


class Texts:
    """The units() of the normal() forms of many texts as arrays: their hashes and first code points; those of text k are at offsets[k] to offsets[k + 1]."""

    def __init__(self, texts: list[str]):
        forms = [t if t.isascii() else t.replace("ß", "ss") for t in texts]
        codes = self._codes("\n".join(forms))
        ends = np.cumsum(np.fromiter(map(len, forms), np.int64, len(forms)) + 1)
        apart = np.flatnonzero(_NORMAL[0].apart.take(codes))
        if len(apart):
            rows = np.unique(np.searchsorted(ends, apart, "right")).tolist()
            own = [self._codes(normal(texts[k]) + "\n") for k in rows]
            parts, at = [], 0
            sizes = np.diff(ends, prepend=0)
            for k, x in zip(rows, own):
                parts += [codes[at : ends[k] - sizes[k]], x + _NORMAL[0].size]
                at, sizes[k] = ends[k], len(x)
            codes = np.concatenate([*parts, codes[at:]])
            ends = np.cumsum(sizes)
        tables = _NORMAL[0]
        kind = tables.kind.take(codes)
        inside = kind > 0
        begins = inside.copy()
        begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        starts = np.flatnonzero(begins)
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.searchsorted(starts, ends)])
        self.first = tables.to.take(codes.take(starts))
        self._characters, self._inside, self._starts, self._to = codes, inside, starts, tables.to
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        up, down = _tables().powers(len(codes))
        values = tables.value.take(codes)
        values *= up
        hashes = np.add.reduceat(values, starts)
        hashes *= down.take(starts)
        hashes ^= hashes >> np.uint64(32)
        hashes *= _MIX
        hashes ^= hashes >> np.uint64(29)
        self.hashes = hashes

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.intp)
        if len(codes) and int(codes.max()) >= len(_tables().kind):
            _CHARACTERS[0] = _Characters(0x110000)
        if not _NORMAL or _NORMAL[0].size < len(_tables().kind):
            _NORMAL[:] = [_Normal(_tables())]
        return codes

    def lengths(self) -> np.ndarray:
        """Characters of each unit."""
        return np.add.reduceat(self._inside.view(np.uint8), self._starts, dtype=np.int64) if len(self._starts) else np.zeros(0, np.int64)

    def letters(self) -> list[np.ndarray]:
        """Of each text the characters of all units without a gap, four bytes each."""
        letters = self._to.take(self._characters.compress(self._inside))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths())]).take(self.offsets).tolist()
        return [letters[a:b] for a, b in zip(at, at[1:])]


def grouped(texts: list[str], most: int = 1 << 17):
    """Ranges of texts with about `most` characters."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def simhash(features: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashed features; 0 for none."""
    if not len(features):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(features).view(np.uint8).reshape(-1, 8), axis=1)
    packed = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(features))
    return int(packed.view(np.int64)[0])


def wide_simhash(features: np.ndarray, words: int) -> np.ndarray:
    """Signed 64-bit words of a SimHash of words x 64 bits of hashed features; zeros for none."""
    if not len(features):
        return np.zeros(words, np.int64)
    with np.errstate(over="ignore"):
        mixed = (np.ascontiguousarray(features)[:, None] + np.arange(1, words + 1, dtype=np.uint64) * _MIX) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(words * 64, np.int64)
    for lo in range(0, len(mixed), 255):  # a byte holds the sum of 255 bits
        sums += np.add.reduce(np.unpackbits(mixed[lo : lo + 255].view(np.uint8), axis=1).view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(sums * 2 > len(features)).view(np.int64)


def wide_simhashes(features: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """wide_simhash() of the features at offsets[k] to offsets[k + 1], a row for each k; none may be empty."""
    counts = np.diff(offsets)
    parts = -(-counts // 255)  # a byte holds the sum of 255 bits
    owner = np.repeat(np.arange(len(counts)), parts)
    firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(parts)[:-1]])
    starts = offsets[owner] + 255 * (np.arange(len(owner)) - firsts[owner])
    edges = np.append(starts, len(features))
    steps = np.arange(1, words + 1, dtype=np.uint64) * _MIX
    sums = np.empty((len(starts), words * 64), np.uint8)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 2048, "right")) - 1)
        mixed = (features[edges[lo] : edges[hi], None] + steps) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1).view(np.uint64)
        sums[lo:hi] = np.add.reduceat(bits, starts[lo:hi] - starts[lo], axis=0).view(np.uint8)
        lo = hi
    sums = np.add.reduceat(sums, firsts, axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > counts[:, None], axis=1).view(np.int64)


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of the streams at offsets[k] to offsets[k + 1], none of which is shorter than width, and their offsets."""
    out = shingles(hashes, width)
    if len(offsets) > 2 and width > 1:
        whole = np.ones(len(out), bool)
        whole[(offsets[1:-1, None] - np.arange(1, width)).ravel()] = False
        out = out.compress(whole)
    return out, offsets - (width - 1) * np.arange(len(offsets))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width units; of the whole stream if it is shorter."""
    n = len(hashes)
    width = max(1, min(width, n))
    if width > 4 and n:  # sums of hashes times powers, moved to the first power
        up, down = _tables().powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])])
        out = (sums[width:] - sums[: n - width + 1]) * down[: n - width + 1]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return out
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            out ^= hashes[k : n - width + 1 + k]
            out *= _MIX
            out ^= out >> np.uint64(29)
    return out


def block_keys(fingerprint: Column, blocks: int = 4) -> Column:
    """Array of the fingerprint's rotated blocks, each tagged with its number: exact lookup keys.

    Two fingerprints with fewer than `blocks` different bits share one.
    """
    width = 64 // blocks
    keys = [F.shiftleft(F.lit(k).cast("long"), 58).bitwiseXOR(F.shiftrightunsigned(fingerprint, k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(blocks)]
    return F.array(*keys)


def hamming(a: Column, b: Column) -> Column:
    """Number of different bits."""
    return F.bit_count(a.bitwiseXOR(b))
