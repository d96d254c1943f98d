"""Periodic runs of words, by Kolpakov and Kucherov's method.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends.  A suffix automaton gives the
LZ factors of the words.  A run either touches a factor's border, and Main's algorithm finds it from common extensions around
that border, or it lies strictly inside a factor, and is copied from the factor's earlier occurrence, whose runs are known by then.

Only runs of at least ``min_exponent`` periods are wanted, and each of their words occurs at least so often in them.  So the
words are first cut at those that occur more rarely, which splits no run and hides none of its neighbours; what is left is factorised.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.words import split_words

#: Rounds of cutting at rare words; more would be as right, and cut little more.
CUTS = 6


def suffix_automaton(letters: Sequence[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of each state, and the place at which its words first end."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, ends, last = [-1], [0], [-1], 0
    for i, c in enumerate(letters):
        new = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(i + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] > lengths[p] + 1:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                ends.append(ends[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = links[p]
                links[q] = q = twin
            links[new] = q
        last = new
    return nexts, ends


def lz_factors(letters: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of each factor: the longest stretch that also starts further left, or one new letter (-1)."""
    nexts, ends = suffix_automaton(letters)
    out, i, n = [], 0, len(letters)
    while i < n:
        state, j = 0, i
        while j < n:
            to = nexts[state][letters[j]]
            if ends[to] >= j:
                break
            state, j = to, j + 1
        out.append((i, max(j, i + 1), ends[state] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def common_prefixes(letters: Sequence[int]) -> np.ndarray:
    """For each place, how many letters from there on agree with the beginning."""
    n = len(letters)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and letters[k] == letters[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, dtype=np.int64)


def _around(letters: list[int], low: int, border: int, high: int, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """Long enough runs within [low, high) that touch the border, by (start, end): smallest period.

    A run has a whole period on one side of the border at least, so all are found from the words that agree from the border,
    and from a place p further right or left, onwards and backwards.
    """
    left, right, n = letters[low:border], letters[border:high], len(letters)
    a, b = len(left), len(right)
    ahead = common_prefixes([*right, -2, *left, *right])  # with the right side: of itself, then of all
    back = common_prefixes([*left[::-1], -2, *right[::-1], *left[::-1]])  # the same, backwards
    found: dict[tuple[int, int], int] = {}
    p = np.arange(1, b + 1)
    forward = (p, border - back[a + 1 + b - p], border + p + np.append(ahead[1:b], 0))
    p = np.arange(1, a + 1)
    backward = (p, border - p - np.append(back[1:a], 0), border + ahead[b + 1 + a - p])
    for periods, starts, ends in (forward, backward):
        long = ends - starts >= np.maximum(min_length, min_exponent * periods)
        for q, s, e in zip(periods[long].tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            if (s == 0 or letters[s - 1] != letters[s - 1 + q]) and (e == n or letters[e] != letters[e - q]):
                found[s, e] = min(q, found.get((s, e), q))
    return found


def runs_of(letters: list[int], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of numbers >= 0 that are long enough, by start, then period."""
    word = [*letters, -1]  # a last factor of its own, so that runs at the end touch a border, too
    found: list[tuple[int, int, int]] = []
    before = 0
    for start, end, earlier in lz_factors(word):
        if start and 2 * (end - before) >= min_length:  # a run that ends in this factor starts less than 2 * |last| + |this| before it
            low = max(0, start - 2 * (start - before) - (end - start))
            for (s, e), q in _around(word, low, start, end, min_length, min_exponent).items():
                run, at = (s, e, q), bisect_left(found, (s, e, q))
                if at == len(found) or found[at] != run:
                    found.insert(at, run)
        if earlier >= 0:
            at, stop = bisect_left(found, (earlier + 1,)), earlier + end - start
            while at < len(found) and found[at][0] < stop:
                s, e, q = found[at]
                if e < stop:
                    insort(found, (s + start - earlier, e + start - earlier, q))
                at += 1
        before = start
    return sorted(found, key=lambda r: (r[0], r[2]))


def pieces(words: list[bytes], min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Stretches that hold all long enough runs: their words occur often enough in them, up to CUTS rounds."""
    out, todo, whole = [], [(0, len(words), 0)], b"\x01" * min_length
    while todo:
        low, high, cuts = todo.pop()
        part = words[low:high]
        counts = Counter(part)
        if len(part) < min_length or max(counts.values()) < min_exponent:
            continue
        often = bytes([counts[w] >= min_exponent for w in part])
        if cuts == CUTS or b"\x00" not in often:
            out.append((low, high))
            continue
        at = often.find(whole)
        while at >= 0:
            end = often.find(b"\x00", at)
            end = len(often) if end < 0 else end
            todo.append((low + at, low + end, cuts + 1))
            at = often.find(whole, end)
    return sorted(out)


def runs_of_words(words: list[bytes], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of words that are long enough, by start, then period."""
    out = []
    for low, high in pieces(words, max(min_length, 2), min_exponent):
        numbers: dict[bytes, int] = {}
        letters = [numbers.setdefault(w, len(numbers)) for w in words[low:high]]
        out += [(s + low, e + low, q) for s, e, q in runs_of(letters, min_length, min_exponent)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for s, e, q in runs:
        kept[s + q : e] = False
    return [words[i] for i in np.flatnonzero(kept)]


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, key: str = "doc_id") -> DataFrame:
    """Per row of docs (key, text, others are left out): key, runs array<struct<start, length, period: long>>, collapsed string.

    Runs of at least ``min_length`` words and ``min_exponent`` (2 or more) periods, by start, then period; ``collapsed`` holds the
    words that no run contains after its first period, joined by one blank.  A null or empty text has no runs and collapses to
    an empty text.  Rows are judged one by one, so repeated rows and keys, and null keys, give rows of their own.
    A task holds one text at a time, and some hundreds of bytes for each word of its periodic stretches.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    schema = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            runs, kept = [], []
            for text in texts:
                words = split_words(text)
                found = runs_of_words(words, min_length, min_exponent)
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found])
                kept.append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"runs": runs, "collapsed": kept})

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = docs.select(F.col(key), F.pandas_udf(find, schema)(F.col("text").cast("string")).alias("found"))
    return found.select(key, "found.runs", "found.collapsed")
