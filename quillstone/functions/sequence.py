"""The ratio of ``difflib.SequenceMatcher(None, a, b)`` without its walk over all pairs of places.

A second text below ``POPULAR`` characters is held as a matrix of bits, a row for each place of the first text and a column for each
of its own: shifting all rows by a row and a column at once tells where a run of equal characters goes on, and the lowest bit that is left
is the longest run that starts first.  From ``POPULAR`` characters on only characters that are rare in the second text begin a run, so the runs
are sought from their places alone.  Both follow the matcher's rules, popular characters included.
"""

from __future__ import annotations

from bisect import bisect_left

#: From this length on a character that makes up more than a hundredth of the second text begins no run.
POPULAR = 200


class Second:
    """A second text, prepared for any number of first ones."""

    __slots__ = ("text", "width", "rows", "rare")

    def __init__(self, text: str):
        self.text, size = text, len(text)
        self.width = size // 8 + 1  # bytes of a row; its last bit is never set, so no run goes on in the next row
        self.rows: dict[str, bytes] = {}
        self.rare: dict[str, list[int]] = {}
        if size < POPULAR:
            places: dict[str, int] = {}
            for j, c in enumerate(text):
                places[c] = places.get(c, 0) | 1 << j
            self.rows = {c: bits.to_bytes(self.width, "little") for c, bits in places.items()}
            return
        for c in set(text):
            if text.count(c) <= size // 100 + 1:
                found, at = [], text.find(c)
                while at >= 0:
                    found.append(at)
                    at = text.find(c, at + 1)
                self.rare[c] = found

    def matched(self, first: str, least: float = 0.0) -> int:
        """Characters in matching blocks; -1 as soon as they are known to be fewer than ``least``."""
        if not first or not self.text:
            return -1 if least > 0 else 0
        return self._dense(first, least) if len(self.text) < POPULAR else self._sparse(first, least)

    def ratio(self, first: str) -> float:
        size = len(first) + len(self.text)
        return 2.0 * self.matched(first) / size if size else 1.0

    def _dense(self, a: str, least: float) -> int:
        b, width, none = self.text, self.width, bytes(self.width)
        bits, get = 8 * width, self.rows.get
        cells = int.from_bytes(b"".join([get(c, none) for c in a]), "little")
        if not cells:
            return -1 if least > 0 else 0
        total, room = 0, min(len(a), len(b))
        todo = [(cells, 0, len(a), 0, len(b))]
        while todo:
            cells, alo, ahi, blo, bhi = todo.pop()
            h, v = ahi - alo, bhi - blo
            room -= h if h < v else v
            size, runs, moved = 1, cells, cells
            while True:
                moved >>= bits + 1
                longer = runs & moved
                if not longer:
                    break
                runs = longer
                size += 1
            at = (runs & -runs).bit_length() - 1
            i, j = at // bits, at % bits
            total += size
            if i and j:
                if i == 1:
                    total += a[alo] in b[blo : blo + j]
                elif j == 1:
                    total += b[blo] in a[alo : alo + i]
                else:
                    left = cells & ((1 << (i * bits)) - 1)
                    if left:
                        left &= int.from_bytes(((1 << j) - 1).to_bytes(width, "little") * i, "little")
                        if left:
                            todo.append((left, alo, alo + i, blo, blo + j))
                            room += i if i < j else j
            i += size
            j += size
            if i < h and j < v:
                if h - i == 1:
                    total += a[ahi - 1] in b[blo + j : bhi]
                elif v - j == 1:
                    total += b[bhi - 1] in a[alo + i : ahi]
                else:
                    right = cells >> (i * bits + j)
                    if right:
                        right &= int.from_bytes(((1 << (v - j)) - 1).to_bytes(width, "little") * (h - i), "little")
                        if right:
                            todo.append((right, alo + i, ahi, blo + j, bhi))
                            room += min(h - i, v - j)
            if total + room < least:
                return -1
        return total if total >= least else -1

    def _sparse(self, a: str, least: float) -> int:
        b, rare = self.text, self.rare
        seeds = []
        for c in rare.keys() & set(a) if len(a) > 64 else {c for c in a if c in rare}:
            at, js = a.find(c), rare[c]
            while at >= 0:
                seeds.append((at, js))
                at = a.find(c, at + 1)
        if not seeds:  # only the run at both beginnings is left
            total = 0
            for x, y in zip(a, b):
                if x != y:
                    break
                total += 1
            return total if total >= least else -1
        seeds.sort()
        places = [i for i, _ in seeds]
        follows = set(places)
        total, room = 0, min(len(a), len(b))
        todo = [(0, len(a), 0, len(b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            room -= min(ahi - alo, bhi - blo)
            i, j, size, last, before = alo, blo, 0, -2, {}
            for x, ys in seeds[bisect_left(places, alo) : bisect_left(places, ahi)]:
                if x == last + 1 and before:
                    now = {y: before.get(y - 1, 0) + 1 for y in ys if blo <= y < bhi}
                    for y, k in now.items():
                        if k > size:
                            i, j, size = x - k + 1, y - k + 1, k
                else:
                    now = {y: 1 for y in ys if blo <= y < bhi} if x + 1 in follows or not size else None
                    if now and not size:
                        i, j, size = x, next(iter(now)), 1
                before, last = now, x
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
            if size:
                total += size
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                    room += min(i - alo, j - blo)
                if i + size < ahi and j + size < bhi:
                    todo.append((i + size, ahi, j + size, bhi))
                    room += min(ahi - i - size, bhi - j - size)
            if total + room < least:
                return -1
        return total if total >= least else -1


def trigrams(text: str) -> set[str]:
    """``text.ngrams(.., 3)`` as a set."""
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) > 3 else {text} if text else set()


__all__ = ["POPULAR", "Second", "trigrams"]
