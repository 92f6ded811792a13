"""Text similarity that needs a sequence matcher (TXT-17)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.functions.sequence import Second, trigrams
from quillstone.functions.text import ngrams


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks, junk heuristic included; null where either side is null.

    Spark evaluates a Python function for every row, also in the branches of a
    CASE, so callers pass null where the ratio is not needed.
    """
    second, ratios = Second(""), []
    for a, b in zip(left, right):
        if a is None or b is None:
            ratios.append(None)
            continue
        if b != second.text:  # what is known of the second text is kept while it repeats
            second = Second(b)
        ratios.append(second.ratio(a))
    return pd.Series(ratios, dtype="float64")


@F.pandas_udf(DoubleType())
def mixed_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """0.45 sequence + 0.55 trigram Jaccard; null where either side is null."""
    known, grams, values = None, set(), []
    for a, b in zip(left, right):
        if a is None or b is None:
            values.append(None)
            continue
        if a != known:  # a question stands beside many texts in turn
            known, grams = a, trigrams(a)
        others = trigrams(b)
        both = len(grams & others)
        values.append(0.45 * Second(b).ratio(a) + 0.55 * (both / (len(grams) + len(others) - both)))
    return pd.Series(values, dtype="float64")


def best_ratios(
    rows: DataFrame, key: str, place: list[str], parts: list[tuple[str, str, str, float]], high: str, total: Callable[..., float], extra: list[str], keep: int
) -> DataFrame:
    """``rows`` with ``{name}_ratio`` of every part (null where ``{name}_known`` is not), less rows that cannot be among their key's best.

    parts: name, left text, right text and the weight of the ratio in the part's value, ``{name}_base`` + weight * ratio.  ``total`` gives a
    row's score from the parts' values and the ``extra`` columns, ``high`` is its upper bound.  A task knows the ``keep`` best scores
    over different places that it has measured of a key; rows whose bound is below all of them are not measured.  As every part is
    measured the bound falls, and a row is left as soon as it is below.
    """
    fields = [StructField(f"{name}_ratio", DoubleType()) for name, *_ in parts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}  # key -> place -> score, ``keep`` places at most
        matchers: dict = {}
        for frame in frames:
            frame = frame.sort_values([high], ascending=False, kind="stable")
            columns = {c: frame[c].tolist() for c in {key, *place, high, *extra, *[x for _, a, b, _ in parts for x in (a, b)], *[f"{n}_{k}" for n, *_ in parts for k in ("known", "base")]}}
            chosen, ratios = [], []
            for i in range(len(frame)):
                floor = best.setdefault(columns[key][i], {})
                least = min(floor.values()) - 2e-6 if len(floor) == keep else -1.0  # scores are rounded to six places
                if columns[high][i] < least:
                    continue
                found, values, others = [], [], [columns[c][i] for c in extra]
                for name, left, right, weight in parts:
                    known, base = columns[f"{name}_known"][i], columns[f"{name}_base"][i]
                    a, b = columns[left][i], columns[right][i]
                    if known is None or known != known:
                        found.append((a, b, base, weight))
                        values.append(base + weight * 2 * min(len(a), len(b)) / (len(a) + len(b)))
                    else:
                        found.append(None)
                        values.append(known)
                row = [None] * len(parts)
                for at, part in enumerate(found):
                    if part and total(*values, *others) >= least:
                        a, b, base, weight = part
                        matcher = matchers.setdefault(at, SequenceMatcher(None))
                        if matcher.b != b:
                            matcher.set_seq2(b)
                        matcher.set_seq1(a)
                        values[at] = base + weight * matcher.quick_ratio()
                        if total(*values, *others) >= least:
                            row[at] = matcher.ratio()
                            values[at] = base + weight * row[at]
                score = total(*values, *others)
                if score < least:
                    continue
                chosen.append(i)
                ratios.append(row)
                where = tuple(columns[c][i] for c in place)
                if where in floor or len(floor) < keep:
                    floor[where] = max(score, floor.get(where, 0.0))
                elif score > min(floor.values()):
                    del floor[min(floor, key=floor.get)]
                    floor[where] = score
            out = frame.iloc[chosen].copy()
            for at, field in enumerate(fields):
                out[field.name] = pd.Series([r[at] for r in ratios], dtype="float64", index=out.index)
            yield out

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *fields]))


def gram_jaccard(left: Column, right: Column, size: int = 3) -> Column:
    a, b = ngrams(left, size), ngrams(right, size)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_similarity(left: Column, right: Column) -> Column:
    """TXT-17 on compact texts: containment first, else 0.45 sequence + 0.55 trigram Jaccard."""
    plain = (left == "") | (right == "") | F.contains(right, left) | F.contains(left, right)
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(F.contains(right, left), F.lit(1.0))
        .when(F.contains(left, right), F.length(right) / F.length(left))
        .otherwise(mixed_similarity(F.when(~plain, left), F.when(~plain, right)))
    )


def settled(left: Column, right: Column) -> Column:
    """Similarity where containment decides it, else null."""
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(F.contains(right, left), F.lit(1.0))
        .when(F.contains(left, right), F.length(right) / F.length(left))
    )


def ratio_bound(left: Column, right: Column) -> Column:
    """The matcher can match at most the characters of the shorter text."""
    return 2 * F.least(F.length(left), F.length(right)) / (F.length(left) + F.length(right))


__all__ = ["best_ratios", "gram_jaccard", "mixed_similarity", "ratio_bound", "sequence_ratio", "settled", "text_similarity"]
