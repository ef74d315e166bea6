"""Words and their hashes for whole batches of texts, as numpy arrays.

A word is a maximal run of letters, digits, combining marks and '_' of the
lower-cased text; everything else separates words. A letter of a script that is
written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word
of its own, with the marks that follow it. ``words`` is the plain form of the
same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; a longer text is scanned alone and whole.
CHUNK = 1 << 21

#: First and last code points of the scripts and extensions that are written without spaces.
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
_SEPARATOR, _LETTER, _OWN, _MARK = range(4)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(first code points of the stretches of one kind beyond ASCII, their kinds)."""
    kind = np.array([{"L": _LETTER, "N": _LETTER, "M": _MARK}.get(unicodedata.category(chr(c))[0], _SEPARATOR) for c in range(0x80, 0x110000)], np.uint8)
    for a, b in _ALONE:
        part = kind[a - 0x80 : b + 1 - 0x80]
        part[part == _LETTER] = _OWN
    at = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    return (at + 0x80).astype(np.int64), kind[at]


_FROM, _KIND = _kinds()


def _class(*kinds: int) -> str:
    ends = np.append(_FROM[1:], 0x110000) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, k in zip(_FROM.tolist(), ends.tolist(), _KIND.tolist()) if k in kinds)


_PLAIN = re.compile(f"[{_class(_OWN)}][{_class(_MARK)}]*|[0-9a-z_{_class(_LETTER, _MARK)}]+")
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz_":
    _WORD[_c] = True
_WORD[128:] = True


def words(text: str | None) -> list[str]:
    return _PLAIN.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


def sql_words(column: str) -> str:
    """DuckDB text of the list of a column's words."""
    pattern = _PLAIN.pattern
    return f"regexp_extract_all(lower({column}), '{re.sub(r'.U([0-9a-f]{8})', lambda m: chr(92) + 'x{' + m[1].lstrip('0') + '}', pattern)}')"


def sql_mix(h: str) -> str:
    """DuckDB text of ``mix`` of an UBIGINT expression, by nested lambdas over a list of one."""
    wide = "CAST({} AS UHUGEINT) * CAST({} AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT)"
    out = f"[xor({h}, {h} >> 33)]"
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out = f"list_transform(list_transform({out}, lambda y: CAST({wide.format('y', c)} AS UBIGINT)), lambda y: xor(y, y >> 33))"
    return f"({out})[1]"


def sql_word_hash(word: str) -> str:
    """DuckDB text of a word's hash, for words of at most 256 bytes."""
    byte, step = (f"[{', '.join(map(str, x[:256].tolist()))}]" for x in (_BYTE, _STEP))
    part = f"CAST({byte}[CAST('0x' || substr(hex({word}), 2 * i - 1, 2) AS INT) + 1] AS UHUGEINT) * CAST({step}[i] AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT)"
    return f"CAST((list_sum(list_transform(range(1, strlen({word}) + 1), lambda i: CAST({part} AS HUGEINT))) + strlen({word})) % 18446744073709551616 AS UBIGINT)"


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Scan:
    """Rows lo..hi-1 of a batch: word hashes in order, and where each row's words begin (n+1 offsets)."""

    lo: int
    hi: int
    hashes: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.offsets))


def _beyond_ascii(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of separators beyond ASCII, bytes before which a word ends) of UTF-8 data."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0xFF >> (size + 1))
    for k in range(1, 4):
        has = size > k
        point[has] = point[has] << 6 | data[lead[has] + k] & 0x3F
    kind = _KIND[np.searchsorted(_FROM, point, side="right") - 1]
    gone = kind == _SEPARATOR
    apart = np.repeat(lead[gone], size[gone])
    apart = apart + np.arange(len(apart)) - np.repeat(np.cumsum(size[gone]) - size[gone], size[gone])
    # marks that follow a letter beyond ASCII at once go with it
    group = np.ones(len(lead), bool)
    group[1:] = (kind[1:] != _MARK) | (lead[:-1] + size[:-1] != lead[1:]) | np.isin(lead[1:], starts)
    heads = np.flatnonzero(group)
    last = np.append(heads[1:], len(lead)) - 1
    own = kind[heads] == _OWN
    return apart, np.concatenate([lead[heads[own]], (lead + size)[last[own]]])


def _scan(data: np.ndarray, starts: np.ndarray, lo: int) -> Scan:
    """data: bytes of some rows; starts: n+1 byte offsets of rows in it."""
    n = len(starts) - 1
    mask = _WORD[data]
    apart, ends = _beyond_ascii(data, starts)
    mask[apart] = False
    idx = np.flatnonzero(mask)
    if not len(idx):
        return Scan(lo, lo + n, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
    head = np.empty(len(data) + 1, dtype=bool)
    head[0] = True
    head[1:-1] = ~mask[:-1]
    head[starts] = True
    head[ends] = True
    first = np.flatnonzero(head[idx])
    lengths = np.diff(np.append(first, len(idx)))
    local = np.arange(len(idx)) - np.repeat(first, lengths)
    h = mix(np.add.reduceat(_BYTE[data[idx]] * _STEP[local & 4095], first) + lengths.astype(np.uint64))
    return Scan(lo, lo + n, h, np.searchsorted(idx[first], starts).astype(np.int64))


def scans(texts: pa.Array) -> Iterator[Scan]:
    """Scans of consecutive rows that cover all rows of ``texts``; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(low):
        return
    bufs = low.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(low):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
        yield _scan(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo)
        lo = hi
