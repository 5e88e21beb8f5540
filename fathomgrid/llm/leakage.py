"""Passages of held-out items inside a corpus: size-partitioned MinHash containment search, verified on exact shingles.

Documents are cut into segments of two blocks of shingles, so that a passage
always lies within one segment, however long the document is. Segments are
partitioned by their number of shingles. A larger segment dilutes a passage
more, so its class compares more minima; with one row per band, a segment and
a window of an item are candidates when any minimum agrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5


@dataclass(frozen=True)
class Containment:
    """least: words of a passage. per_edit: at most one edit in so many words. block: shingles in a block (a segment has two). window, step: shingles of an item's windows and their distance.
    classes: (most shingles of a segment, minima compared); chosen so that a passage with all its edits, which keeps nine shingles of 25 words, is missed with a probability below 1 in 10,000.
    most_chars: bound on the items that one pass broadcasts; more items take several passes."""

    least: int = 25
    per_edit: int = 10
    block: int = 32
    window: int = 32
    step: int = 8
    classes: tuple[tuple[int, int], ...] = ((16, 48), (32, 64), (64, 96))
    most_chars: int = 20_000_000


_BROKEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n[ \t]*(?:[>#*|;%/+-]+[ \t]*)*(?=\w)|­|[​‌‍⁠﻿]")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*+>|\]\([^()\s]*\)|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text in lower case, without punctuation, markup, line marks and hyphenation at line ends."""
    if not text:
        return []
    if "-" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    if "<" in text or "](" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


class _Numbers(dict):
    """A 64-bit number per word, the same everywhere."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return n


def shingles(numbers: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words."""
    n = len(numbers) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (numbers[i : i + n] + (h >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scatter(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = h * factor
    return x ^ (x >> np.uint64(31))


class Items:
    """The windows' minima of all items, for look-up, and the items' words, for verification."""

    def __init__(self, rows: list[tuple[int, str]], how: Containment):
        number, self.how = _Numbers(), how
        self.words, self.at = {}, {}
        windows, owners = [], []
        for item, text in rows:
            w = np.array([number[x] for x in words(text)], np.uint64)
            if len(w) < how.least:
                continue
            h = shingles(w)
            self.words[item] = w
            places: dict[int, list[int]] = {}
            for i, x in enumerate(h.tolist()):
                places.setdefault(x, []).append(i)
            self.at[item] = places
            for s in sorted({*range(0, max(1, len(h) - how.window + 1), how.step), max(0, len(h) - how.window)}):
                windows.append(h[s : s + how.window])
                owners.append(item)
        self.factors = _factors(max(m for _, m in how.classes))
        self.keys, self.owners, self.maybe = [], [], []
        owner = np.array(owners, np.int64)
        for f in self.factors:
            k = np.array([_scatter(w, f).min() for w in windows], np.uint64)
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.owners.append(owner[order] if len(order) else owner)
            seen = np.zeros(1 << 16, bool)
            seen[((k >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.maybe.append(seen)

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(place in docs, item): some segment of the document agrees with some window of the item in a minimum."""
        how, found = self.how, set()
        sizes = np.array([len(h) for h in docs])
        tops = [0] + [c for c, _ in how.classes[:-1]] + [2**62]
        for (lo, hi), (_, minima) in zip(zip(tops, tops[1:]), how.classes):
            mine = np.flatnonzero((sizes > lo) & (sizes <= hi))
            if not len(mine):
                continue
            h = np.concatenate([docs[i] for i in mine])
            blocks = [range(0, sizes[i], how.block) for i in mine]
            many = np.array([len(b) for b in blocks])
            base = np.concatenate(([0], np.cumsum(sizes[mine])[:-1]))
            starts = np.concatenate([np.arange(0, sizes[i], how.block) + o for i, o in zip(mine, base)])
            doc = np.repeat(mine, many)
            joint = np.flatnonzero(np.append(doc[1:] == doc[:-1], False))
            for f, keys, owners, maybe in zip(self.factors[:minima], self.keys, self.owners, self.maybe):
                low = np.minimum.reduceat(_scatter(h, f), starts)
                low[joint] = np.minimum(low[joint], low[joint + 1])
                hit = np.flatnonzero(maybe[((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int64)])
                if not len(hit):
                    continue
                a, b = np.searchsorted(keys, low[hit], "left"), np.searchsorted(keys, low[hit], "right")
                for x, i, j in zip(hit[b > a], a[b > a], b[b > a]):
                    found.update((int(doc[x]), int(o)) for o in owners[i:j])
        return found

    def holds(self, item: int, doc: np.ndarray, h: np.ndarray, order: np.ndarray) -> bool:
        """Whether the document has a passage of the item: exact runs of common shingles, chained over few edits."""
        how, mine, places = self.how, self.words[item], self.at[item]
        keys = np.array(list(places), np.uint64)
        sorted_h = h[order]
        a, b = np.searchsorted(sorted_h, keys, "left"), np.searchsorted(sorted_h, keys, "right")
        pairs = sorted((j - i, i) for k, x, y in zip(keys[b > a].tolist(), a[b > a], b[b > a]) for j in order[x:y].tolist() for i in places[k])
        runs: list[list[int]] = []  # item start, document start, words
        for diagonal, i in pairs:
            if runs and runs[-1][1] - runs[-1][0] == diagonal and i <= runs[-1][0] + runs[-1][2] - SHINGLE + 1:
                runs[-1][2] = i + SHINGLE - runs[-1][0]
            else:
                runs.append([i, i + diagonal, SHINGLE])
        runs.sort(key=lambda r: (r[1], r[0]))
        for first in range(len(runs)):
            i0, j0, n = runs[first]
            i1, j1, edits = i0 + n, j0 + n, 0
            if self._enough(mine, doc, i0, i1, j0, j1, edits):
                return True
            for i, j, n in runs[first + 1 :]:
                if j - j1 > 2 * how.per_edit:
                    break
                if i + n <= i1 or j + n <= j1 or abs((j - i) - (j1 - i1)) > how.per_edit or i - i1 > 2 * how.per_edit:
                    continue
                over = max(0, i1 - i, j1 - j)
                i, j, n = i + over, j + over, n - over
                if n <= 0:
                    continue
                edits += _distance(mine[i1:i], doc[j1:j])
                i1, j1 = i + n, j + n
                if self._enough(mine, doc, i0, i1, j0, j1, edits):
                    return True
        return False

    def _enough(self, mine: np.ndarray, doc: np.ndarray, i0: int, i1: int, j0: int, j1: int, edits: int) -> bool:
        """Whether a chain, or the chain and what follows one more edit at either end, is a passage."""
        how = self.how
        fits = lambda n, e: n >= how.least and e * how.per_edit <= n
        if fits(i1 - i0, edits):
            return True
        if i1 - i0 < how.least - 2 * SHINGLE:
            return False
        before = _beyond(mine[:i0][::-1], doc[:j0][::-1])
        after = _beyond(mine[i1:], doc[j1:])
        n = i1 - i0
        return any(fits(n + x, edits + e) for x, e in ((before, 1), (after, 1), (before + after, 2)) if x)


def _beyond(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a covered by one edit (changed, added or left out) and the equal words that follow it."""
    best = 0
    for da, db in ((1, 1), (0, 1), (1, 0)):
        x, y = a[da : da + SHINGLE], b[db : db + SHINGLE]
        m = min(len(x), len(y))
        same = x[:m] == y[:m]
        n = m if same.all() else int(np.argmin(same))
        if n:
            best = max(best, n + da)
    return best


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short runs of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _pass(documents: DataFrame, rows: list[tuple[int, str]], how: Containment) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(rows)  # most_chars at most
    built: list[Items] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Items(shared.value, how))
        items, number = built[0], _Numbers()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [np.fromiter(map(number.__getitem__, words(t)), np.uint64) for t in batch.column(1).to_pylist()]
            prints = [shingles(w) for w in texts]
            orders: dict[int, np.ndarray] = {}
            out = []
            for d, item in sorted(items.candidates(prints)):
                if d not in orders:
                    orders[d] = np.argsort(prints[d], kind="stable")
                if items.holds(item, texts[d], prints[d], orders[d]):
                    out.append((ids[d], item))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["doc_id", "item_id"])

    return documents.mapInArrow(run, "doc_id long, item_id long")


def leaked(documents: DataFrame, items: DataFrame, how: Containment = Containment()) -> DataFrame:
    """(doc_id, item_id): the document holds a passage of at least how.least words of the item, with at most one edit in how.per_edit words.

    documents (doc_id, text), items (item_id, text). Layout doesn't count. A
    null or short text holds nothing; an item of fewer words than a passage
    is never found. The corpus is read once per most_chars of items and is
    not shuffled; only found pairs are.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    its = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = its.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // how.most_chars))
    found = None
    for i in range(passes):
        some = its if passes == 1 else its.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        part = _pass(docs, [tuple(r) for r in some.distinct().collect()], how)
        found = part if found is None else found.unionByName(part)
    return found.distinct()
