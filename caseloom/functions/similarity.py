"""Near-duplicate text comparison.

The ratio is the longest-matching-blocks ratio of the standard library, including its rule that
characters in more than one position out of a hundred are no anchors in texts of 200 and more.  No
built-in expression gives that number, so it is the one place where rows visit Python, in Arrow
batches, and only for texts whose length and letter counts leave the threshold within reach.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import fixed_values as fixed
from caseloom.functions.text import col_of, normalize_text


REMEMBERED_PAIRS = 100_000
CHECK_EVERY = 128
AUTOJUNK_CHARS = 200  # from here on frequent letters are no anchors
CHUNK_SHARE = 0.2  # of the letters between two anchors that a chunk spans


def most_blocks(length: int, anchors: int, other: int, threshold: float) -> int:
    """The most matching blocks that a text can have with another of ``other`` letters at the threshold.

    A block has an anchor of the second text, which has ``anchors``, or is a beginning that both share, of which
    there is one: each further search starts where the letters differ.  In texts with all letters as anchors, blocks
    are parted by letters that do not match, and these are few.
    """
    if length >= AUTOJUNK_CHARS:
        return anchors + 1
    return int((1.0 - threshold) * (length + other) + 1e-6) + 1


def count_anchors(text: str) -> int:
    """Places of letters that are no more frequent than the rule for anchors allows."""
    if len(text) < AUTOJUNK_CHARS:
        return len(text)
    often = np.bincount(_codes(text), minlength=128)
    return int(often[often <= len(text) // 100 + 1].sum())


class _Meetings:
    """Places (i, j) at which two texts have the same anchor letter, by i and then j, and the run of such places that ends there."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        often = np.bincount(b)
        if len(b) >= AUTOJUNK_CHARS:
            often[often > len(b) // 100 + 1] = 0
        self.often = np.append(often, 0)
        a = np.minimum(a, len(often))
        self.spots = np.flatnonzero(self.often[a])
        self.letters = a[self.spots]
        kept = np.flatnonzero(self.often[b])
        self.there = kept[np.argsort(b[kept], kind="stable")]
        self.starts = np.cumsum(self.often) - self.often

    def within(self, a_low: int, a_high: int, b_low: int, b_high: int, most: int):
        """Those in a part of the texts as arrays ``i, j, run``; none if there are more than ``most``."""
        lo, hi = np.searchsorted(self.spots, (a_low, a_high))
        spots, letters = self.spots[lo:hi], self.letters[lo:hi]
        first, count = np.zeros(len(self.often), np.int64), np.zeros(len(self.often), np.int64)
        for letter in np.unique(letters).tolist():
            start = self.starts[letter]
            ends = np.searchsorted(self.there[start : start + self.often[letter]], (b_low, b_high))
            first[letter], count[letter] = start + ends[0], ends[1] - ends[0]
        counts = count[letters]
        total = int(counts.sum())
        if total > most:
            return None
        i = np.repeat(spots, counts)
        j = self.there[np.repeat(first[letters] - np.cumsum(counts) + counts, counts) + np.arange(total)]
        diagonal = np.argsort(j - i, kind="stable")
        x, d = i[diagonal], (j - i)[diagonal]
        fresh = np.ones(total, bool)
        fresh[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)
        since = np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
        run = np.empty(total, np.int64)
        run[diagonal] = np.arange(total) - since + 1
        return i, j, run

    def longest(self, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[int, int, int]:
        """First of the longest runs in a part with too many places to list, one place of ``a`` after another."""
        i, j, size = a_low, b_low, 0
        lo, hi = np.searchsorted(self.spots, (a_low, a_high))
        runs, before = np.zeros(b_high - b_low + 1, np.int32), -1
        last = np.zeros(0, np.int64)
        for at, letter in zip(self.spots[lo:hi].tolist(), self.letters[lo:hi].tolist()):
            start = self.starts[letter]
            found = self.there[start : start + self.often[letter]]
            found = found[slice(*np.searchsorted(found, (b_low, b_high)))] - b_low
            grown = runs[found] + 1 if at == before + 1 else np.ones(len(found), np.int32)
            runs[last + 1] = 0
            runs[found + 1] = grown
            if len(grown):
                top = int(grown.argmax())
                if grown[top] > size:
                    size = int(grown[top])
                    i, j = at - size + 1, int(found[top]) + b_low - size + 1
            last, before = found, at
        return i, j, size


MOST_MEETINGS = 1_000_000  # listed at once, some 60 bytes each
FEW_MEETINGS = 48  # searched without numpy


def _matched_letters(a: str, b: str) -> int:
    """How many letters the longest-matching-blocks rule matches.

    The blocks are those of the standard library.  Where anchors meet is listed once; a search then looks at the
    meetings of its part of the texts, instead of all letters there.
    """
    meetings = _Meetings(*(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b)))
    total, queue = 0, [(0, len(a), 0, len(b), None)]
    while queue:
        a_low, a_high, b_low, b_high, places = queue.pop()
        if places is None:
            places = meetings.within(a_low, a_high, b_low, b_high, MOST_MEETINGS)
        i, j, size = a_low, b_low, 0
        if places is None:
            i, j, size = meetings.longest(a_low, a_high, b_low, b_high)
        elif isinstance(places, list):
            for x, y, run in places:
                run = min(run, x - a_low + 1, y - b_low + 1)
                if run > size:
                    i, j, size = x - run + 1, y - run + 1, run
        elif len(places[0]):
            runs = np.minimum(places[2], np.minimum(places[0] - (a_low - 1), places[1] - (b_low - 1)))
            top = int(runs.argmax())
            size = int(runs[top])
            i, j = int(places[0][top]) - size + 1, int(places[1][top]) - size + 1
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
            size += 1
        if not size:
            continue
        total += size
        for part in ((a_low, i, b_low, j), (i + size, a_high, j + size, b_high)):
            if part[0] < part[1] and part[2] < part[3]:
                queue.append((*part, _places_within(places, *part)))
    return total


def _places_within(places, a_low: int, a_high: int, b_low: int, b_high: int):
    """Those of the listed places that lie in a part, as a list where they are few."""
    if places is None:
        return None
    if isinstance(places, list):
        return [p for p in places if a_low <= p[0] < a_high and b_low <= p[1] < b_high]
    rows = slice(*np.searchsorted(places[0], (a_low, a_high)))
    inside = (places[1][rows] >= b_low) & (places[1][rows] < b_high)
    kept = tuple(p[rows][inside] for p in places)
    return list(zip(*(k.tolist() for k in kept))) if len(kept[0]) <= FEW_MEETINGS else kept


def matching_ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, the same number in less time."""
    if not a and not b:
        return 1.0
    if a.startswith(b) or b.startswith(a):
        # The first match is the earliest of the longest, which then lies at the same place in both
        # texts, and so grows to all of the shorter one.
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return 2.0 * _matched_letters(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matching_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def text_similarity_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratio of two texts after ``normalize_text``; the order of the two matters."""
    return _ratio_udf(normalize_text(a), normalize_text(b))


def is_near_duplicate(
    a: Column | str, b: Column | str, threshold: float = fixed.NEAR_DUPLICATE_RATIO
) -> Column:
    """Whether two texts reach the ratio: equal ones without Python, hopeless ones by their lengths."""
    na, nb = normalize_text(a), normalize_text(b)
    la, lb = F.length(na), F.length(nb)
    hopeless = 2.0 * F.least(la, lb) < threshold * (la + lb) - 1e-6

    near = plain_texts_are_near(threshold)
    open_case = (na != "") & (nb != "") & (na != nb) & ~hopeless
    # Only open cases carry their texts to Python.
    asked = near(F.when(open_case, na), F.when(open_case, nb))
    return F.when((na == "") | (nb == ""), False).when(na == nb, True).otherwise(asked)


def plain_texts_are_near(threshold: float):
    """A function of two columns of different, normalised texts: whether they reach the ratio; null reaches none."""

    @F.pandas_udf(T.BooleanType())
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        comparer = _Comparer(threshold)
        for left, right in batches:
            yield pd.Series([comparer.pair(x, y) for x, y in zip(left, right)], dtype=bool)

    return near


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


_FACTOR = 0x9E3779B97F4A7C15


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring letters; equal ones have equal hashes."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, len(codes)), out=sums[1:])
        hashes = sums[size:] - sums[:-size]
        hashes *= _powers(pow(_FACTOR, -1, 1 << 64), len(hashes))
    return hashes


def _powers(factor: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a factor, modulo 2 ** 64."""
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def _positions(codes: np.ndarray) -> dict[int, int]:
    """Per letter a bit set of its places in the text, as one integer."""
    return {
        int(letter): int.from_bytes(np.packbits(codes == letter, bitorder="little"), "little")
        for letter in np.unique(codes)
    }


def _may_share(a: np.ndarray, b: np.ndarray, needed: float) -> bool:
    """Whether the longest common subsequence of two texts can have ``needed`` letters.

    Matching blocks never cross, so together they are a common subsequence.  Its length grows one
    letter of ``b`` at a time, all places of ``a`` at once in the bits of an integer, and the count
    stops as soon as the letters left cannot make up for those missing.
    """
    places, full = _positions(a), (1 << len(a)) - 1
    open_places, left = full, len(b)
    for at in range(0, len(b), CHECK_EVERY):
        for letter in b[at : at + CHECK_EVERY].tolist():
            met = open_places & places.get(letter, 0)
            open_places = ((open_places + met) | (open_places - met)) & full
        left = len(b) - min(at + CHECK_EVERY, len(b))
        if len(a) - open_places.bit_count() + left < needed:
            return False
    return True


class _Comparer:
    """Compares texts of one task, remembering outcomes of recent pairs.

    Letter counts, shared chunks and then common subsequences bound the ratio from above, so few texts that are no
    near-duplicates are matched block by block.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.outcome = lru_cache(maxsize=REMEMBERED_PAIRS)(self._compare)
        self.texts: dict[bytes, str] = {}
        self.parts: dict[tuple, object] = {}

    def _remembered(self, key: tuple, make):
        if key not in self.parts:
            self.parts[key] = make()
        return self.parts[key]

    def _shares_chunks(self, candidate: bytes, kept: bytes, needed: float) -> bool:
        """Whether enough chunks of the second text occur in the first.

        The second text is cut into chunks of ``size`` letters.  A block of ``n`` letters holds at least
        ``(n + 2 - 2 * size) / size`` of them whole, and there are at most ``most_blocks``; so ``needed`` letters in blocks
        have that many chunks together, and each occurs in the first text.
        """
        a, b = self.texts[candidate], self.texts[kept]
        if len(b) < AUTOJUNK_CHARS:
            return True
        blocks = self._remembered((kept, "anchors"), lambda: count_anchors(b)) + 1
        size = 1 + int(CHUNK_SHARE * len(b) / blocks)
        wanted = (needed - 2.0 * (size - 1) * blocks) / size
        if size < 3 or wanted <= 0:
            return True
        chunks = self._remembered((kept, "chunks"), lambda: _window_hashes(_codes(b), size)[::size].copy())
        # Hashes take eight bytes a letter, substrings far more; unequal ones that meet only let a pair pass.
        there = self._remembered((candidate, size), lambda: np.unique(_window_hashes(_codes(a), size)))
        if not len(there):
            return False
        place = np.minimum(np.searchsorted(there, chunks), len(there) - 1)
        return int((there[place] == chunks).sum()) >= wanted

    def _compare(self, candidate: bytes, kept: bytes) -> bool:
        a, b = self.texts[candidate], self.texts[kept]
        needed = self.threshold * (len(a) + len(b)) / 2.0 - 1e-6
        if a.startswith(b) or b.startswith(a):
            return matching_ratio(a, b) >= self.threshold
        if not self._shares_chunks(candidate, kept, needed):
            return False
        if not _may_share(_codes(a), _codes(b), needed):
            return False
        return matching_ratio(a, b) >= self.threshold

    def pair(self, a: str | None, b: str | None) -> bool:
        """Outcome for one pair of different texts."""
        if a is None or b is None:
            return False
        codes = [_codes(t) for t in (a, b)]
        letters = [np.bincount(c, minlength=128)[:128] for c in codes]
        if 2.0 * np.minimum(*letters).sum() < self.threshold * (len(a) + len(b)) - 1e-6:
            return False
        keys = [md5(c, usedforsecurity=False).digest() for c in codes]
        self.texts, self.parts = dict(zip(keys, (a, b))), {}
        return self.outcome(*keys)

    def repeats(self, texts: Iterable[str]) -> list[list[int]]:
        """For each text the 1-based positions of the others it nearly repeats."""
        texts = list(texts)
        codes = [_codes(t) for t in texts]
        letters = np.stack([np.bincount(c, minlength=128)[:128] for c in codes])
        keys = [md5(c, usedforsecurity=False).digest() for c in codes]
        self.texts, self.parts = dict(zip(keys, texts)), {}
        shared = np.minimum(letters[:, None, :], letters[None, :, :]).sum(2)
        total = letters.sum(1)[:, None] + letters.sum(1)[None, :]
        within_reach = 2.0 * shared >= self.threshold * total - 1e-6

        def repeated(i: int, j: int) -> bool:
            if i == j or not texts[i] or not texts[j]:
                return False
            if keys[i] == keys[j]:
                return True
            return bool(within_reach[i, j]) and self.outcome(keys[i], keys[j])

        places = range(len(texts))
        return [[j + 1 for j in places if repeated(i, j)] for i in places]


def near_duplicates(texts: Column | str, threshold: float = fixed.NEAR_DUPLICATE_RATIO) -> Column:
    """``array<array<int>>``: per text of an array the positions of the texts it nearly repeats.

    ``texts`` holds texts already in ``normalize_text`` form.  At a threshold of 1 only equal texts
    qualify and no Python is involved.
    """
    texts = col_of(texts)
    if threshold >= 1.0:
        numbered = F.transform(texts, lambda t, i: F.struct(t.alias("text"), (i + 1).alias("at")))
        return F.transform(
            numbered,
            lambda mine: F.transform(
                F.filter(
                    numbered,
                    lambda other: (other["text"] == mine["text"])
                    & (other["at"] != mine["at"])
                    & (mine["text"] != ""),
                ),
                lambda other: other["at"],
            ),
        )

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def compare(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        comparer = _Comparer(threshold)
        for batch in batches:
            yield pd.Series([comparer.repeats(t) for t in batch], dtype=object)

    return compare(texts)
