"""The best windows of every chunk by containment, shared trigrams, terms and the sequence matcher (AUD-07, AUD-08).

Blocks of chunks meet blocks of windows of their section in one task each, so no row is made for a pair.  Trigram sets are met by matrix products;
what a pair can still reach is bounded by its shared trigrams and characters, and the matcher sees only pairs that can reach the best
``keep`` places that the block has found.  It stops as soon as too few characters are left to match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.sequence import POPULAR, Second
from quillstone.operators.matching import block_counts, dealt_blocks

#: Bytes of chunks that windows meet at a time, and of windows in a block, at least and at most.
CHUNK_BYTES = 1 << 16
WINDOW_BYTES = (1 << 18, 4 << 20)
WINDOWS_AT_ONCE = 256
CELLS_AT_ONCE = 8_000_000
#: Weights of the matcher's ratio and of the trigrams in the similarity of two texts.
RATIO, GRAMS = 0.45, 0.55
#: Scores are rounded to six places.
ROUNDED = 2e-6


@dataclass(frozen=True)
class Measure:
    """How a pair is scored.

    parts: chunk columns held against the window's text, with the least that their value counts for in the score; ``titles``: a chunk column
    held against the window's first line, likewise.  ``total(*values, share, matched, known)`` gives the score of a pair and ``totals`` those of arrays, known
    where the window has a text; values are the title's, if there is one, then the parts'.  A place's windows count once among the best ``keep``; ``order`` breaks ties.
    """

    parts: tuple[tuple[str, float], ...]
    total: Callable[..., float]
    totals: Callable[..., np.ndarray]
    place: tuple[str, ...]
    order: tuple[str, ...]
    keep: int
    titles: tuple[str, float] | None = None
    zeros: bool = True


def title_known(title: str, first: str, text: str) -> float | None:
    """What a title scores where no sequence matcher is needed."""
    if not title or not text:
        return 0.0
    if title == first:
        return 1.0
    if title in first or first in title:
        return 0.88
    return 0.76 if title in text else None


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


#: Bits of a character in the number of a trigram; the highest bit marks texts of less than three characters, which are their own only gram.
CHARACTER = 21


def _codes(points: np.ndarray) -> np.ndarray:
    wide = points.astype(np.uint64)
    return wide[:-2] | wide[1:-1] << np.uint64(CHARACTER) | wide[2:] << np.uint64(2 * CHARACTER) if len(wide) > 2 else np.zeros(0, np.uint64)


def _short(text: str) -> int:
    return sum(ord(c) << CHARACTER * i for i, c in enumerate(text)) | 1 << 63


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, as numbers, and how often it has each."""
    if len(text) < 3:
        return np.array([_short(text)] if text else [], np.uint64), np.ones(min(1, len(text)), int)
    return np.unique(_codes(_points([text])[0]), return_counts=True)


def _gram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, trigram) of the distinct trigrams of all texts."""
    points, starts = _points(texts)
    known = np.unique(points)
    if len(points) < 3 or len(known) ** 3 * len(texts) >= 1 << 63:
        parts = [_grams(t)[0] for t in texts]
        return np.repeat(np.arange(len(texts)), [len(p) for p in parts]), np.concatenate(parts)
    size = len(known)
    at = np.searchsorted(known, points)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    inside = row[:-2] == row[2:]
    keys = (((row[:-2] * size + at[2:]) * size + at[1:-1]) * size + at[:-2])[inside]
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    keys, low = np.divmod(keys, size)
    keys, middle = np.divmod(keys, size)
    rows, top = np.divmod(keys, size)
    wide = known.astype(np.uint64)
    codes = wide[low] | wide[middle] << np.uint64(CHARACTER) | wide[top] << np.uint64(2 * CHARACTER)
    short = [(i, _short(t)) for i, t in enumerate(texts) if 0 < len(t) < 3]
    if short:
        rows = np.concatenate([rows, np.array([i for i, _ in short])])
        codes = np.concatenate([codes, np.array([c for _, c in short], np.uint64)])
    return rows, codes


def _counts(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    """How often every text holds each character of the alphabet."""
    points, starts = _points(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(starts))
    at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    known = alphabet[at] == points
    return np.bincount(rows[known] * len(alphabet) + at[known], minlength=len(texts) * len(alphabet)).reshape(len(texts), -1).astype(np.float32)


class Block:
    """Chunks prepared to meet windows, and the best places that they have found."""

    def __init__(self, measure: Measure, chunks: pa.Table):
        self.measure = measure
        self.size = chunks.num_rows
        self.texts = sorted({t for c, _ in measure.parts for t in chunks[c].to_pylist()})
        number = {t: i for i, t in enumerate(self.texts)}
        self.part = [np.array([number[t] for t in chunks[c].to_pylist()]) for c, _ in measure.parts]
        self.titles = chunks[measure.titles[0]].to_pylist() if measure.titles else []
        terms = [t or [] for t in chunks["_terms"].to_pylist()]
        self.terms = sorted({t for own in terms for t in own if t is not None})
        place = {t: i for i, t in enumerate(self.terms)}
        self.held = np.zeros((len(self.terms), self.size), np.float32)
        for c, own in enumerate(terms):
            for t in own:
                if t is not None:
                    self.held[place[t], c] += 1
        self.asked = np.array([len(t) for t in terms], float)
        grams, term_grams = [_grams(t) for t in self.texts], [_grams(t)[0] if len(t) > 2 else np.zeros(0, np.uint64) for t in self.terms]
        self.vocabulary = np.unique(np.concatenate([g for g, _ in grams] + term_grams))
        self.gram_counts = np.zeros((len(self.vocabulary), len(self.texts)), np.float32)
        for i, (g, n) in enumerate(grams):
            self.gram_counts[np.searchsorted(self.vocabulary, g), i] = n
        self.term_grams = np.zeros((len(self.vocabulary), len(self.terms)), np.float32)
        for i, g in enumerate(term_grams):
            self.term_grams[np.searchsorted(self.vocabulary, g), i] = 1
        self.term_sizes = self.term_grams.sum(0)
        self.gram_sets = (self.gram_counts > 0).astype(np.float32)
        self.gram_sizes = self.gram_sets.sum(0)
        self.lengths = np.array([len(t) for t in self.texts], float)
        self.alphabet = np.unique(_points(self.texts)[0]) if any(self.texts) else np.zeros(1, np.uint32)
        self.counts = _counts(self.texts, self.alphabet)
        self.firsts = [t[:1] for t in self.texts]
        slopes = [s for _, s in measure.parts]
        same = [[sum(s for s, other in zip(slopes, self.part) if other[c] == own[c]) for c in range(self.size)] for own in self.part]
        self.slopes = [[measure.titles[1]] * self.size, *same] if measure.titles else same  # parts of the same text fall together
        self.best: list[dict] = [{} for _ in range(self.size)]
        self.found: list[list[tuple]] = [[] for _ in range(self.size)]

    def facts(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Similarity where containment decides it (else -1), share of trigrams, most matched characters, each window by distinct text; terms held by chunk."""
        n, m = len(texts), len(self.texts)
        rows, codes = _gram_rows(texts)
        sizes = np.bincount(rows, minlength=n).astype(float)
        seen = np.zeros((n, max(1, len(self.vocabulary))), np.float32)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == codes
            seen[rows[hit], at[hit]] = 1
            shared, spots, words = seen @ self.gram_sets, seen @ self.gram_counts, seen @ self.term_grams
        else:
            shared, spots, words = (np.zeros((n, k), np.float32) for k in (m, m, len(self.terms)))
        shared = shared.astype(float)
        union = sizes[:, None] + self.gram_sizes[None, :] - shared
        jaccard = np.divide(shared, union, out=np.zeros((n, m)), where=union > 0)
        lengths = np.array([len(t) for t in texts], float)
        counts = _counts(texts, self.alphabet)
        most = np.empty((n, m))
        for i in range(m):
            np.minimum(counts, self.counts[i]).sum(1, out=most[:, i], dtype=float)
        long = np.flatnonzero(lengths >= POPULAR)
        if len(long):
            # every block but one at both beginnings holds a rare character; of its characters all but two begin a shared trigram
            few = counts[long]
            few = np.where(few <= lengths[long, None] // 100 + 1, few, 0)
            for i in range(m):
                seeds = np.minimum(few, self.counts[i]).sum(1)
                begin = np.array([texts[w][:1] == self.firsts[i] for w in long])
                blocks = seeds + begin
                most[long, i] = np.minimum(most[long, i], np.where(blocks > 0, spots[long, i] + 2 * blocks, 0))
        settled = np.full((n, m), -1.0)
        blank = (lengths[:, None] == 0) | (self.lengths[None, :] == 0)
        short = (lengths[:, None] < 3) | (self.lengths[None, :] < 3)
        for w, i in zip(*(x.tolist() for x in np.nonzero(~blank & (short | (shared == self.gram_sizes[None, :]) | (shared == sizes[:, None]))))):
            if self.texts[i] in texts[w]:
                settled[w, i] = 1.0
            elif texts[w] in self.texts[i]:
                settled[w, i] = len(texts[w]) / len(self.texts[i])
        settled[blank] = 0.0
        hits = np.zeros((n, len(self.terms)), np.float32)
        for w, i in zip(*(x.tolist() for x in np.nonzero(words == self.term_sizes[None, :]))):  # the text has all trigrams of the term
            hits[w, i] = self.terms[i] in texts[w]
        return settled, jaccard, most, (hits @ self.held).astype(float)

    def meet(self, begin: int, texts: list[str], firsts: list[str], places: list[tuple], orders: list[tuple]) -> None:
        """Finds what these windows, numbered from ``begin``, bring to the best of every chunk."""
        measure = self.measure
        settled, jaccard, most, matched = self.facts(texts)
        lengths = np.array([len(t) for t in texts], float)
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = 2.0 * most / (lengths[:, None] + self.lengths[None, :])
        highest = np.where(settled >= 0, settled, RATIO * ratio + GRAMS * jaccard)
        share = np.divide(matched, self.asked[None, :], out=np.zeros(matched.shape), where=self.asked[None, :] > 0)
        values = [highest[:, p] for p in self.part]
        titles: dict[str, list[float | None]] = {}
        if measure.titles:
            top = np.empty((len(texts), self.size))
            for c, title in enumerate(self.titles):
                if title not in titles:
                    titles[title] = [title_known(title, first, text) for first, text in zip(firsts, texts)]
                top[:, c] = [1.2 * min(len(title), len(f)) / (len(title) + len(f)) if v is None else v for v, f in zip(titles[title], firsts)]
            values.insert(0, top)
        high = measure.totals(*values, share, matched, lengths[:, None] > 0)
        seconds: list[Second | None] = [None] * len(texts)
        starts: dict[str, Second] = {}
        for c in range(self.size):
            best, rows = self.best[c], self.found[c]
            order = np.argsort(-high[:, c], kind="stable")
            upper = high[order, c].tolist()
            known = titles[self.titles[c]] if measure.titles else None
            for w, reach in zip(order.tolist(), upper):
                least = min(best.values()) - ROUNDED if len(best) == measure.keep else -1.0
                if reach < least or (reach <= 0 and not measure.zeros):
                    break
                score, own = reach, [float(v[w, c]) for v in values]
                hit, part_share, any_text = float(matched[w, c]), float(share[w, c]), bool(texts[w])
                ratios: dict[int, float] = {}
                for k in range(len(own)):
                    title = measure.titles is not None and k == 0
                    if title:
                        if known[w] is not None:
                            continue
                        a, b, weight, base = self.titles[c], firsts[w], 0.6, 0.0
                    else:
                        i = self.part[k - (measure.titles is not None)][c]
                        if settled[w, i] >= 0:
                            continue
                        a, b, weight, base = self.texts[i], texts[w], RATIO, GRAMS * jaccard[w, i]
                    if title or i not in ratios:
                        # below this ratio the score cannot reach ``least``, as the part counts for its slope at least
                        needed = 0.0 if score >= 1.0 - 1e-9 or least < 0 else (own[k] - base - (score - least) / self.slopes[k][c]) / weight
                        if title:
                            second = starts.get(b) or starts.setdefault(b, Second(b))
                        else:
                            second = seconds[w] = seconds[w] or Second(b)
                        total = second.matched(a, needed * (len(a) + len(b)) / 2 - 1e-6)
                        if total < 0:
                            score = -1.0
                            break
                        ratio = 2.0 * total / (len(a) + len(b))
                        if not title:
                            ratios[i] = ratio
                    else:
                        ratio = ratios[i]
                    own[k] = float(weight * ratio + base)
                    score = measure.total(*own, part_share, hit, any_text)
                    if score < least:
                        break
                if score < least:
                    continue
                rows.append((score, orders[w], begin + w, hit, part_share, *own))
                where = places[w]
                if where in best or len(best) < measure.keep:
                    best[where] = max(score, best.get(where, 0.0))
                elif score > min(best.values()):
                    del best[min(best, key=best.get)]
                    best[where] = score

            if len(rows) > 1000:
                self.found[c] = self.among_best(c)

    def among_best(self, c: int) -> list[tuple]:
        """A chunk's rows that can still be among the best; of rows that are equal in all values those of the first ``keep`` places."""
        measure, best = self.measure, self.best[c]
        least = min(best.values()) - ROUNDED if len(best) == measure.keep else -1.0
        at = [measure.order.index(p) for p in measure.place]
        out, groups = [], {}
        for row in sorted((r for r in self.found[c] if r[0] >= least), key=lambda r: r[1]):
            seen = groups.setdefault((row[0], *row[3:]), set())
            place = tuple(row[1][i] for i in at)
            if place in seen or len(seen) < measure.keep:
                seen.add(place)
                out.append(row)
        return out


def nearest_windows(
    chunks: DataFrame, windows: DataFrame, measure: Measure, names: list[str], carried: list[str], size: Column,
    chunk_bytes: int = CHUNK_BYTES, window_bytes: tuple[int, int] = WINDOW_BYTES,
) -> DataFrame:
    """(chunk_id, ``carried`` columns of the window, matched, _share, ``names``): pairs that can be among the best ``keep`` places of their chunk, with the values of
    title and parts under ``names``; no other pair can be.

    chunks(chunk_id, section_id, _terms and the columns of ``measure``); windows(section_id, _text, _first where there are titles, ``carried``, places).  ``size`` is a
    window's number of bytes, or a bound of it.
    """
    lefts = [c for c, _ in measure.parts] + ([measure.titles[0]] if measure.titles else [])
    asked = chunks.select("chunk_id", "section_id", "_terms", *lefts)
    weight = F.lit(100) + sum((F.length(c) for c in lefts), F.lit(0))
    counts = block_counts(windows.select("section_id", size.alias("_size")), F.col("_size"), asked, weight, "section_id", window_bytes, chunk_bytes)
    spread = windows.withColumn("_spread", F.xxhash64(*measure.order))  # the lines of one document go to many parts
    left, right = dealt_blocks(spread, "_spread", asked, "chunk_id", "section_id", counts, 8 * windows.sparkSession.sparkContext.defaultParallelism)
    kinds = {**dict(windows.dtypes), "chunk_id": dict(chunks.dtypes)["chunk_id"]}
    schema = ", ".join([f"{c} {kinds[c]}" for c in ["chunk_id", *carried]] + ["matched double", "_share double"] + [f"{n} double" for n in names])

    def meet(some: pa.Table, asks: pa.Table) -> pa.Table:
        rows, block = [], None
        if some.num_rows and asks.num_rows:
            block = Block(measure, asks)
            step = max(16, min(WINDOWS_AT_ONCE, CELLS_AT_ONCE // max(1, len(block.vocabulary))))
            for at in range(0, some.num_rows, step):
                part = some.slice(at, step)
                firsts = part["_first"].to_pylist() if measure.titles else []
                places, orders = (list(zip(*(part[c].to_pylist() for c in some_columns))) for some_columns in (measure.place, measure.order))
                block.meet(at, part["_text"].to_pylist(), firsts, places, orders)
            rows = [(c, *row[2:]) for c in range(block.size) for row in block.among_best(c)]
        picked = some.select(carried).take(pa.array([r[1] for r in rows], pa.int64()))
        columns = [asks["chunk_id"].take(pa.array([r[0] for r in rows], pa.int64())), *picked.columns]
        columns += [pa.array([r[k] for r in rows], pa.float64()) for k in range(2, 4 + len(names))]
        return pa.table(columns, names=["chunk_id", *carried, "matched", "_share", *names])

    return left.cogroup(right).applyInArrow(meet, schema)


__all__ = ["Measure", "nearest_windows", "title_known"]
