"""Passages of evaluation items inside documents, by q-gram lemma filtering and banded alignment.

Texts are folded to letters and digits alone. Every q-gram of a document is looked up in an index of the passages'
q-grams. One edit budget runs through all stages: in a row of words that counts, up to the share `odd` of the words is
changed, missing or mistyped, and one insertion may lie within it. By the q-gram lemma such a row keeps common q-grams
over most of its other words, all of them in one of the overlapping bands of diagonals; a pair of item and document,
and then a band of it, stays only where its q-grams leave a row of words within the budget. The bands that stay are
aligned by edit distance, and the rows are read off the alignments' paths.

The items are the query set: they are taken in blocks of bounded size, each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_out
from .textnorm import letters

GOOD = 0.6  # share of a word's letters that have to be covered
NEVER = 2**60
CELLS = 8_000_000  # numbers of a matrix that a step works on at once


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts as numbers, and where each text starts (one more for the end)."""
    starts = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    chars = chars.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h = h * np.uint64(0x100000001B3) + chars[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class PassageIndex:
    """The q-grams of a block of passages, the bounds of their words, and the letters that a row covers at least."""

    def __init__(self, items: list[tuple[int, str]], q: int, words: int, odd: float = 0.15):
        self.q, self.words, self.odd = q, words, odd
        self.ids, texts, self.bounds, least = [], [], [], []
        for item, passage in items:
            parts = [w for w in (letters(x) for x in passage.split()) if w]
            if len(parts) < words:
                continue
            self.ids.append(item)
            texts.append("".join(parts))
            self.bounds.append(np.cumsum([0, *map(len, parts)]))
            least.append(fewest_letters(self.bounds[-1], words, odd))
        # a q-gram covers q letters at most
        self.least = np.array(least, np.int64)
        self.need = -(-self.least // q)
        self.chars, self.starts = codes(texts)
        self.size = np.diff(self.starts)
        self.n_words = np.array([len(b) - 1 for b in self.bounds], np.int64)
        # bounds of all items' words in one array
        self.word_at = np.cumsum([0, *(len(b) for b in self.bounds)])
        self.all_bounds = np.concatenate([np.zeros(0, np.int64), *self.bounds])
        h = grams(self.chars, q)
        place = np.arange(len(h))
        item = np.searchsorted(self.starts, place, "right") - 1
        inside = place + q <= self.starts[item + 1] if len(h) else np.zeros(0, bool)
        order = np.flatnonzero(inside)[np.argsort(h[inside], kind="stable")]
        self.item, self.place = item[order], (place - self.starts[item])[order] if len(h) else place
        self.distinct, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        # entries of a q-gram are in the order of items, so those of a range of items are found by one number
        self.entry = np.repeat(np.arange(len(self.distinct)), self.count) * max(len(self.ids), 1) + self.item
        # a small table of hash prefixes spares most look-ups
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.distinct >> np.uint64(44)).astype(np.int64)] = True

    def known(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in all characters, number of the q-gram) of each q-gram of the texts that a passage has too."""
        h = grams(chars, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)]) if len(self.distinct) else np.zeros(0, np.int64)
        k = np.searchsorted(self.distinct, h[at])
        k[k == len(self.distinct)] = 0
        ok = self.distinct[k] == h[at] if len(at) else np.zeros(0, bool)
        at, k = at[ok], k[ok]
        doc = np.searchsorted(starts, at, "right") - 1
        ok = at + self.q <= starts[doc + 1]
        return doc[ok], at[ok], k[ok]

    def hits(self, doc: np.ndarray, at: np.ndarray, k: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place, place in passage) of each of these q-grams in each item from `low` to before `high`."""
        first, n = self.first[k], self.count[k]
        if high is not None:
            first = np.searchsorted(self.entry, k * len(self.ids) + low)
            n = np.searchsorted(self.entry, k * len(self.ids) + high) - first
        entry = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(doc, n), self.item[entry], np.repeat(at, n), self.place[entry]


def fewest_letters(bounds: np.ndarray, words: int, odd: float) -> int:
    """Letters that any row of `words` or more words covers at least, if up to the share `odd` of them isn't covered
    and the others are to GOOD. A longer row can be cut into rows of `words` up to twice as many words, one of which
    has no more odd words for its length, and among these the shortest for each number of odd words tells."""
    size = np.diff(bounds)
    fewest = int(bounds[-1])
    for m in range(int(odd * words), int(odd * (2 * words - 1)) + 1):
        length = next(n for n in range(words, 2 * words) if int(odd * n + 1e-9) >= m)
        if length <= len(size):
            each = np.sort(np.lib.stride_tricks.sliding_window_view(size, length), 1)[:, : length - m]
            fewest = min(fewest, int(np.ceil(GOOD * each - 1e-9).sum(1).min()))
    return fewest


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of n[0] numbers, then those of the next, and so on."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def good_words(index: PassageIndex, item: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Which words of the items are covered to GOOD, one item's words after the other's; `covered` marks the covered
    letters of the items in the same way, as numbers 0 and 1."""
    n = index.n_words[item]
    ends = index.all_bounds[spans(index.word_at[item] + 1, n)] + np.repeat(np.cumsum(index.size[item]) - index.size[item], n)
    total = np.cumsum(covered, dtype=np.int32)[ends - 1]
    return np.diff(total, prepend=0) >= GOOD * np.diff(ends, prepend=0) - 1e-9


def holds_row(good: np.ndarray, sizes: np.ndarray, words: int, odd: float) -> np.ndarray:
    """Whether a row of `words` or more words, of which at most the share `odd` isn't good, lies in each of the lists
    of these sizes, one after the other in `good`. Rows up to twice as long tell, as a longer one holds one of these."""
    total = np.concatenate(([0], np.cumsum(~good)))
    first = np.cumsum(sizes) - sizes
    found = (sizes - (total[first + sizes] - total[first])) >= words - int(odd * words + 1e-9)
    at = np.flatnonzero(found)
    place = spans(first[at], sizes[at])
    owner = np.repeat(at, sizes[at])
    room = first[owner] + sizes[owner] - place
    found[:] = False
    for n in range(words, 2 * words):
        fits = room >= n
        place, owner, room = place[fits], owner[fits], room[fits]
        found[owner[total[place + n] - total[place] <= int(odd * n + 1e-9)]] = True
    return found


def promising(index: PassageIndex, group: np.ndarray, item: np.ndarray, ppos: np.ndarray) -> np.ndarray:
    """Of each of the groups 0, 1, ... with these items, whether its q-grams leave a row of words within the budget,
    whatever diagonals they lie on. `group` and `ppos` are of hits, in any order."""
    keep = np.zeros(len(item), bool)
    size = index.size[item]
    edge = np.concatenate(([0], np.cumsum(size)))
    a = 0
    while a < len(item):
        b = max(int(np.searchsorted(edge, edge[a] + 8 * CELLS, "right")) - 1, a + 1)
        whole = a == 0 and b == len(item)
        g, p = (group, ppos) if whole else (group[(here := (group >= a) & (group < b))], ppos[here])
        covered = np.zeros(int(edge[b] - edge[a]), np.uint8)
        covered[edge[g] - edge[a] + p] = 1
        reach = 1
        while reach < index.q:  # a q-gram never leaves its passage
            by = min(reach, index.q - reach)
            covered[by:] |= covered[:-by].copy()
            reach += by
        # most are told by their number of letters
        at = a + np.flatnonzero(np.add.reduceat(covered, edge[a:b] - edge[a], dtype=np.int32) >= index.least[item[a:b]])
        if len(at):
            covered = covered[spans(edge[at] - edge[a], size[at])]
            keep[at] = holds_row(good_words(index, item[at], covered), index.n_words[item[at]], index.words, index.odd)
        a = b
    return keep


def banded(passage: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Alignments by edit distance within bands of diagonals: (matched, shift), row x passage character.

    An edit is a character that is changed, left out or put in; a row of characters put in costs at most as much as
    `longest` of them.

    `passage` is row x character; `text` row x character holds the text from the place `low` of the band's lowest
    shift on, so that passage character i may meet the text's characters i to i + width - 1. The ends of the text
    cost nothing. `matched` marks the passage characters that meet an equal one on the path of least cost, `shift`
    the diagonal of each, -1 where it is left out.
    """
    rows, n = passage.shape
    step = np.arange(width, dtype=np.int32)
    cost = np.zeros((n + 1, rows, width), np.int16)
    same = np.empty((n, rows, width), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, width, axis=1)
    before = np.zeros((rows, width), np.int32)
    for i in range(n):
        same[i] = view[:, i] == passage[:, i, None]
        now = before + ~same[i]
        np.minimum(now[:, :-1], before[:, 1:] + 1, out=now[:, :-1])  # the passage character is left out
        # text characters are put in
        now = np.minimum(np.minimum.accumulate(now - step, 1) + step, np.minimum.accumulate(now, 1) + longest)
        cost[i + 1] = now
        before = now
    matched, shift = np.zeros((rows, n), bool), np.full((rows, n), -1, np.int32)
    all_ = np.arange(rows)
    j = before.argmin(1)
    for i in range(n, 0, -1):
        now, above, eq = cost[i], cost[i - 1], same[i - 1]
        while True:
            here = now[all_, j]
            diagonal = here == above[all_, j] + ~eq[all_, j]
            right = np.minimum(j + 1, width - 1)
            left_out = ~diagonal & (j < width - 1) & (here == above[all_, right] + 1)
            put_in = ~diagonal & ~left_out
            if not put_in.any():
                break
            far = np.flatnonzero(put_in & ~((j > 0) & (here == now[all_, j - 1] + 1)))
            j = np.where(put_in, j - 1, j)
            if len(far):
                from_ = (now[far] + longest == here[far, None]) & (step <= j[far, None])
                j[far] = width - 1 - from_[:, ::-1].argmax(1)
        matched[:, i - 1] = diagonal & eq[all_, j]
        shift[:, i - 1] = np.where(diagonal, j, -1)
        j = np.where(left_out, right, j)
    return matched, np.where(shift >= 0, shift + low[:, None], -1)


def in_runs(matched: np.ndarray, shift: np.ndarray, q: int) -> np.ndarray:
    """The matched characters that lie in runs of `q` or more on one diagonal."""
    n = matched.shape[1]
    opens = np.ones_like(matched)
    opens[:, 1:] = ~matched[:, :-1] | ~matched[:, 1:] | (shift[:, 1:] != shift[:, :-1])
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(opens, place, 0), 1)
    closes = np.ones_like(matched)
    closes[:, :-1] = opens[:, 1:]
    last = np.minimum.accumulate(np.where(closes, place, n)[:, ::-1], 1)[:, ::-1]
    return matched & (last - first + 1 >= q)


def longest_row(good: np.ndarray, odd: float, after: np.ndarray | None = None) -> int:
    """Words of the longest row that starts and ends with a good word and of which at most the share `odd` isn't good.

    With `after`, the good words on a band that an insertion leads to, the row begins on the first band and changes
    to the other one at one place.
    """
    n = len(good)
    after = good if after is None else after
    part = round(odd * 10_000)
    k = np.arange(n + 1)
    bad = [np.concatenate(([0], np.cumsum(~g))) for g in (good, after)]
    start = np.where(np.append(good, False), 10_000 * bad[0] - part * k, -NEVER)
    end = np.where(np.append(False, after), 10_000 * bad[1] - part * k, NEVER)
    if after is good:
        least = np.minimum.accumulate(end[::-1])[::-1]
        return max(int((np.searchsorted(least, start, "right") - 1 - k).max()), 0)
    rise = np.diff(bad[0] - bad[1])
    most = 0
    # the best place to change is where the first band stops being the better one
    for c in np.flatnonzero((np.append(rise, 1) > 0) & (np.append(-1, rise) <= 0)):
        least = np.minimum.accumulate(end[c:][::-1])[::-1] + 10_000 * (bad[0][c] - bad[1][c])
        j = np.searchsorted(least, start[: c + 1], "right") - 1
        most = max(most, int((c + j - k[: c + 1])[j >= 0].max(initial=0)))
    return most


def bands_of(shift: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hit, cell) of the overlapping bands of diagonals: a band is two neighbouring cells of `width` shifts, named by
    the lower, and each hit lies in two of them. Of the bands of a group with the same hits the lower one is left out."""
    cell = shift // width
    base = int(cell.min(initial=0)) - 2
    span = int(cell.max(initial=0)) - base + 3
    here = group * span + (cell - base)
    taken = np.unique(here)
    one = np.arange(len(cell))
    # the band from the cell below is needed only if that cell has hits, the own band unless the next cell is empty and the one below isn't
    below, above = np.isin(here - 1, taken), np.isin(here + 1, taken)
    return np.concatenate((one[below], one[above | ~below])), np.concatenate((cell[below] - 1, cell[above | ~below]))


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, a place of each number): equal keys have one number from 0 on, in their order."""
    bound = int(key.max(initial=0)) + 1
    if bound <= 16_000_000:
        first = np.full(bound, -1)
        first[key] = np.arange(len(key))
        taken = first >= 0
        return (np.cumsum(taken) - 1)[key], first[taken]
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return number, first


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = int(b.min(initial=0))
    return a * (int(b.max(initial=0)) - low + 1) + (b - low)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each of the values (0 or more) occurs among them."""
    bound = int(values.max(initial=0)) + 1
    if bound <= 16_000_000:
        return np.bincount(values, minlength=bound)[values]
    _, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[number]


def _leaks_of_hits(index: PassageIndex, chars: np.ndarray, starts: np.ndarray, hits: tuple, band: int, insertion: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, words in a row) of the pairs among these hits; a pair's hits are all here."""
    doc, item, place, ppos = hits
    if not len(doc):
        return
    key = (doc - doc.min()) * len(index.ids) + item
    keep = occurrences(key) >= index.need[item]
    doc, item, place, ppos, key = doc[keep], item[keep], place[keep], ppos[keep], key[keep]
    pair, first = numbered(key)
    keep = promising(index, pair, item[first], ppos)[pair]
    doc, item, place, ppos, pair = doc[keep], item[keep], place[keep], ppos[keep], pair[keep]
    if not len(doc):
        return
    # bands wide enough for a row with an insertion
    shift = place - ppos
    hit, cell = bands_of(shift, pair, insertion + band)
    region, first = numbered(_both(pair[hit], cell))
    keep = promising(index, region, item[hit[first]], ppos[hit])[region]
    hit = np.unique(hit[keep])
    doc, item, pair, shift = doc[hit], item[hit], pair[hit], shift[hit]
    if not len(doc):
        return
    # narrow bands, each aligned by itself
    half = max(band // 2, 1)
    hit, cell = bands_of(shift, pair, half)
    _, first = numbered(_both(pair[hit], cell))
    doc, item, pair, cell = doc[hit[first]], item[hit[first]], pair[hit[first]], cell[first]
    order = np.argsort(index.size[item], kind="stable")
    doc, item, pair, cell = doc[order], item[order], pair[order], cell[order]
    width = 2 * half
    good: list[np.ndarray] = []
    while len(good) < len(doc):
        a = len(good)
        b = min(a + max(CELLS // (int(index.size[item[a]]) * width), 1), int(np.searchsorted(index.size[item], 2 * index.size[item[a]], "right")))
        n = int(index.size[item[b - 1]])
        low = cell[a:b] * half
        at = np.arange(n)
        inside = at < index.size[item[a:b]][:, None]
        p = np.where(inside, index.chars[np.minimum(index.starts[item[a:b]][:, None] + at, len(index.chars) - 1)], 1)
        where = low[:, None] + np.arange(n + width - 1)
        inside = (where >= starts[doc[a:b]][:, None]) & (where < starts[doc[a:b] + 1][:, None])
        t = np.where(inside, chars[np.clip(where, 0, len(chars) - 1)], 0)
        runs = in_runs(*banded(p, t, low, width, index.q), index.q)[np.arange(n) < index.size[item[a:b]][:, None]]
        good += np.split(good_words(index, item[a:b], runs.view(np.uint8)), np.cumsum(index.n_words[item[a:b]])[:-1])
    by_pair: dict[int, list[int]] = {}
    for x in np.lexsort((cell, pair)):
        by_pair.setdefault(int(pair[x]), []).append(int(x))
    for rows in by_pair.values():
        i = int(item[rows[0]])
        flags = [good[x] for x in rows]
        most = max(longest_row(f, index.odd) for f in flags)
        for x, f in enumerate(flags):
            for y in range(x + 1, len(flags)):
                if (cell[rows[y]] - cell[rows[x]]) * half > insertion:
                    break
                if (f | flags[y]).sum() > most * (1 - index.odd):
                    most = max(most, longest_row(f, index.odd, flags[y]))
        if most >= index.words:
            yield int(doc[rows[0]]), i, most


def find_leaks(index: PassageIndex, texts: list[str], band: int = 48, insertion: int = 240, hits: int = 2_000_000) -> Iterator[tuple[int, int, int]]:
    """(text, item, words in a row) of each text that holds enough words of an item in a row.

    At most about `hits` common q-grams are held at once: texts are taken in groups, a text with more in ranges of
    items, and nothing is left out.
    """
    chars, starts = codes(texts)
    doc, at, k = index.known(chars, starts)
    if not len(doc):
        return
    total = np.concatenate(([0], np.cumsum(index.count[k])))
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    a = 0
    while a < len(texts):
        b = max(int(np.searchsorted(total[edge], total[edge[a]] + hits, "right")) - 1, a + 1)
        part = slice(edge[a], edge[b])
        parts = max(int(-(-(total[edge[b]] - total[edge[a]]) // hits)), 1)
        cuts = np.linspace(0, len(index.ids), min(parts, len(index.ids)) + 1).astype(int)
        for low, high in zip(cuts, cuts[1:], strict=False):
            found = index.hits(doc[part], at[part], k[part], *((int(low), int(high)) if len(cuts) > 2 else ()))
            yield from _leaks_of_hits(index, chars, starts, found, band, insertion)
        a = b


def pieces(text: str, longest: int, overlap: int) -> list[str]:
    """A text in pieces of at most `longest` characters that overlap by `overlap`."""
    if len(text) <= longest:
        return [text]
    return [text[i : i + longest] for i in range(0, len(text) - overlap, longest - overlap)]


def leaked_items(
    documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", passage: str = "passage",
    words: int = 20, q: int = 8, odd: float = 0.15, band: int = 48, insertion: int = 240, block_chars: int = 8_000_000, piece_chars: int = 200_000,
) -> DataFrame:
    """(item_id, doc_id, n_words): documents that hold at least `words` words of an item's passage in a row.

    Case, punctuation, spacing, markup and lookalike characters don't count; up to the share `odd` of the words in
    the row may be changed, missing or mistyped, and one insertion of up to `insertion` letters may lie within it,
    besides shorter ones that shift the text by less than `band` letters in all.
    n_words is the longest such row. Items and documents without text or id, and passages of fewer words, give no rows; a
    document or item that comes twice is reported once. Texts are searched whole: long ones in pieces of `piece_chars`
    that overlap by more than a row can take. `block_chars` bounds the passages that are sent to the executors at once
    (one longer passage is a block of its own); larger sets of items take several passes. Other columns are ignored.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(passage).alias("passage")).where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    total = asked.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    schema = "item_id long, doc_id long, n_words int"
    held = spread_out(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL"))
    result = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(sorted((r.item_id, r.passage) for r in rows))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(shared.value, q, words, odd)
            overlap = 2 * int(index.size.max(initial=0)) + insertion + 2 * band
            longest = max(piece_chars, 4 * overlap)
            for b in batches:
                found: list[tuple[int, int, int]] = []
                owner, plain, size = [], [], 0
                rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                for n, (i, t) in enumerate(rows):
                    for piece in pieces(letters(t), longest, overlap):
                        owner.append(i)
                        plain.append(piece)
                        size += len(piece)
                    if size >= 1_000_000 or n == len(rows) - 1:
                        found += [(index.ids[m], owner[d], w) for d, m, w in find_leaks(index, plain, band, insertion)]
                        owner, plain, size = [], [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["item_id", "doc_id", "n_words"])

        one = held.mapInArrow(search, schema)
        result = one if result is None else result.unionByName(one)
    return result.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))
