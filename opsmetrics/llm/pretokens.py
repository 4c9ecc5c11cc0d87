"""Parts of texts as byte-level vocabularies cut them before they merge, found with numpy for many texts at once.

A text is cut at the places where the fixed expression ``PATTERN`` of such vocabularies cuts it. Its alternatives depend
on the kind of each character only (letter, number, white space, other), on plain spaces and on seven contractions, so
they are decided for all characters of a slice by array operations. The kinds come from the library's own expressions,
so that they agree with the version of Unicode the library has.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import raw

OTHER, LETTER, NUMBER, SPACE = range(4)
# Fixed value: contractions that stand as parts of their own.
ONE = "stmd"
TWO = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point, as the tiktoken library's expressions see it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = bytes(tiktoken.Encoding(f"kind {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[points(found)] = kind
    return out


def points(data: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


class Parts:
    """The parts of a slice of texts.

    ``distinct`` are the different ones as strings, ``of`` gives the place in it of each part in order, and
    ``lo``/``hi`` are the range of parts of each text. An empty text has none. Equal hashes are compared character by
    character, so that two different parts are never taken for one.
    """

    def __init__(self, texts: pa.Array):
        data, offs = raw(texts)
        whole = data.tobytes()
        text = whole.decode("utf-8")
        if len(text) == len(data):
            self.cp, edges = data, offs
        else:
            self.cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            begun = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
            edges = begun[offs]
        self.edges = edges
        self.start = np.flatnonzero(self._cuts(edges))
        self.end = np.append(self.start[1:], len(self.cp))
        bound = np.searchsorted(self.start, edges)
        self.lo, self.hi = bound[:-1], bound[1:]
        self._distinct(text)

    def _cuts(self, edges: np.ndarray) -> np.ndarray:
        """True where a part starts."""
        cp, n = self.cp, len(self.cp)
        kind = kinds()[cp]
        cut = np.zeros(n, dtype=bool)
        if n == 0:
            return cut
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        first = np.zeros(n + 1, dtype=bool)
        first[edges] = True
        first = first[:n]
        cut |= first
        # a run of white space leaves its last character to what follows; a plain space joins it
        after = np.flatnonzero(cut[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
        cut[after - 1] = True
        cut[after[cp[after - 1] == 32]] = False
        # an apostrophe alone, where a part starts, takes the letters of a contraction
        mark = np.flatnonzero(cut[:-1] & (cp[:-1] == 39) & (kind[1:] == LETTER) & ~first[1:])
        if len(mark):
            wide = np.append(cp, [0, 0]).astype(np.uint32)
            a, b = wide[mark + 1], wide[mark + 2]
            b[np.append(first, [True, True])[mark + 2]] = 0
            one = np.isin(a, [ord(c) for c in ONE])
            two = np.zeros(len(mark), dtype=bool)
            for x, y in TWO:
                two |= (a == ord(x)) & (b == ord(y))
            for some, size in ((one, 1), (two & ~one, 2)):
                at = mark[some]
                cut[at + 1] = False
                ends = at + 1 + size
                cut[ends[ends < n]] = True
        return cut

    def holds(self, marked: np.ndarray) -> np.ndarray:
        """Whether each text has a character that is true in ``marked``, a table over code points."""
        upto = np.zeros(len(self.cp) + 1, dtype=np.int64)
        np.cumsum(marked[self.cp], out=upto[1:])
        return np.diff(upto[self.edges]) > 0

    def _distinct(self, text: str) -> None:
        first, self.of = distinct_spans(self.cp, self.start, self.end)
        self.distinct = [text[x:y] for x, y in zip(self.start[first].tolist(), self.end[first].tolist())]


def distinct_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first span of each different content, the place among these of each span).

    Contents are told apart by hash; every span is then compared with the first one of its hash, value by value, and if
    two ever differ, contents themselves are used as keys.
    """
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sums of values times powers of an odd number: equal contents at different places differ by a power only
    powers = _powers(len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers[0][: len(values)], out=total[1:])
    hashes = (total[end] - total[start]) * powers[1][start]
    coded = pa.array(hashes).dictionary_encode()
    of = coded.indices.to_numpy().astype(np.int64)
    first = _firsts(of, len(coded.dictionary))
    size, like = end - start, first[of]
    own = values if start[0] == 0 and end[-1] == len(values) and (start[1:] == end[:-1]).all() else gathered(values, start, size)
    if not ((size == size[like]).all() and (own == gathered(values, start[like], size)).all()):
        places: dict[bytes, int] = {}
        of = np.array([places.setdefault(values[x:y].tobytes(), len(places)) for x, y in zip(start.tolist(), end.tolist())], dtype=np.int64)
        first = _firsts(of, len(places))
    return first, of


def _firsts(of: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, dtype=np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return first


_BASE = 0x5851F42D4C957F2D
_HELD: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_HELD[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            full[0] = 1
            _HELD[k] = np.multiply.accumulate(full)
    return _HELD


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` of each start and size, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]
