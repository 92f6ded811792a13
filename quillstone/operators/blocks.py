"""Top-k of additive token scores, block of cards against block of questions.

A block is an Arrow table that Spark dealt to one task.  Shared tokens of all its (card, question) pairs are counted by
products of 0/1 matrices for frequent tokens and by postings for rare ones; what a pair can still reach is bounded by its
focused tokens first, so body tokens are counted only where the bound beats the questions' k-th best.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CARDS_AT_ONCE = 256
QUESTIONS_AT_ONCE = 2048
COLUMNS_AT_ONCE = 2048
PAIRS_AT_ONCE = 4_000_000
#: A token is counted by matrix when it joins more than one in this many pairs.
DENSE = 64


class Tokens:
    """Token ids of rows in order; ids beyond the vocabulary are left out."""

    def __init__(self, lists: pa.ChunkedArray, vocabulary: pa.Array):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        known = found >= 0
        self.ids = found[known].astype(np.int64)
        self.sizes = np.bincount(rows[known], minlength=len(sizes))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, token id) of every token of these rows."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        places = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[rows], sizes)
        return places, self.ids[at]


def shared_counts(left: tuple[np.ndarray, np.ndarray], n: int, right: tuple[np.ndarray, np.ndarray], m: int, words: int) -> np.ndarray:
    """Numbers of shared tokens of ``n`` rows with ``m`` rows."""
    (left_row, left_id), (right_row, right_id) = left, right
    result = np.zeros((n, m), np.float32)
    in_right = np.bincount(right_id, minlength=words)
    met = np.bincount(left_id, minlength=words) * in_right
    dense = met * DENSE > n * m
    columns = np.flatnonzero(dense)
    for start in range(0, len(columns), COLUMNS_AT_ONCE):
        part = columns[start : start + COLUMNS_AT_ONCE]
        place = np.full(words, -1)
        place[part] = np.arange(len(part))
        sides = []
        for rows, ids, size in ((left_row, left_id, n), (right_row, right_id, m)):
            kept = place[ids] >= 0
            side = np.zeros((size, len(part)), np.float32)
            side[rows[kept], place[ids[kept]]] = 1
            sides.append(side)
        result += sides[0] @ sides[1].T
    rare = (met[left_id] > 0) & ~dense[left_id]
    if rare.any():
        rows, ids = left_row[rare], left_id[rare]
        holders = right_row[np.argsort(right_id, kind="stable")]
        first = np.cumsum(in_right) - in_right
        ends = np.cumsum(in_right[ids])
        cuts = np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, ends[-1] + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        a = 0
        for b in [*(cuts + 1), len(ids)]:
            b = min(b, len(ids))
            if b > a:
                times = in_right[ids[a:b]]
                stop = np.cumsum(times)
                other = holders[np.arange(stop[-1]) - np.repeat(stop - times, times) + np.repeat(first[ids[a:b]], times)]
                result += np.bincount(np.repeat(rows[a:b], times) * m + other, minlength=n * m).reshape(n, m)
                a = b
    return result


def first_of_each(question: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries of every question: highest score, then lowest place."""
    order = np.lexsort((place, -score, question))
    sorted_questions = question[order]
    begins = np.searchsorted(sorted_questions, sorted_questions)
    return order[np.arange(len(order)) - begins < k]


def best_pairs(
    focused: Tokens,
    body: Tokens,
    asked: Tokens,
    words: int,
    cards: np.ndarray,
    parts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    most: np.ndarray,
    points: tuple[float, float, float, float],
    k: int,
) -> tuple[np.ndarray, ...]:
    """(card, question, focused count, body count) of the best ``k`` ``cards``, given in rank order of ties, of every question.

    ``parts(cards, questions)`` gives the terms added before, after and last, as matrices; ``most`` bounds their sum for each card.
    ``points`` are those of a focused token and their cap, of a body token and their cap.
    """
    each, cap, body_each, body_cap = points
    rest = np.maximum.accumulate(most[cards][::-1])[::-1] if len(cards) else most[:0]
    found = []
    total = len(asked.sizes)
    for start in range(0, total, QUESTIONS_AT_ONCE):
        questions = np.arange(start, min(total, start + QUESTIONS_AT_ONCE))
        sizes = asked.sizes[questions]
        reach = np.minimum(cap, each * sizes) + np.minimum(body_cap, body_each * sizes)
        floor = np.zeros(len(questions))
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64))
        for at in range(0, len(cards), CARDS_AT_ONCE):
            alive = np.flatnonzero(reach + rest[at] + 1e-6 > floor)
            if not len(alive):
                break
            some = cards[at : at + CARDS_AT_ONCE]
            q_tokens = asked.of(questions[alive])
            in_focus = shared_counts(focused.of(some), len(some), q_tokens, len(alive), words)
            before, after, last = parts(some, questions[alive])
            focus_points = np.minimum(cap, each * in_focus.astype(np.float64))
            bound = before + focus_points + np.minimum(body_cap, body_each * sizes[alive]) + after + last
            open_ = bound + 1e-6 > floor[alive]
            ci, qi = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(ci):
                continue
            in_body = shared_counts(body.of(some[ci]), len(ci), asked.of(questions[alive[qi]]), len(qi), words)
            cut = np.ix_(ci, qi)
            score = before[cut] + focus_points[cut] + np.minimum(body_cap, body_each * in_body.astype(np.float64)) + after[cut] + last[cut]
            r, c = np.nonzero(score > floor[alive[qi]])
            if not len(r):
                continue
            hit = (alive[qi[c]], at + ci[r], score[r, c], in_focus[ci[r], qi[c]].astype(np.int64), in_body[r, c].astype(np.int64))
            kept = tuple(np.concatenate(pair) for pair in zip(kept, hit))
            order = first_of_each(kept[0], kept[2], kept[1], k)
            kept = tuple(x[order] for x in kept)
            full = np.bincount(kept[0], minlength=len(questions)) == k
            lowest = np.full(len(questions), np.inf)
            np.minimum.at(lowest, kept[0], kept[2])
            floor[full] = lowest[full]
        found.append((cards[kept[1]], questions[kept[0]], kept[3], kept[4]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))
