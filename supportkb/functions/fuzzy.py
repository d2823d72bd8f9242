"""Partial ratio: the best similarity between a term and any window of a text.

For a needle of m characters and a window of w ≤ m characters (windows are truncated at the two
ends of the longer string) the ratio is 200·LCS/(m+w). The kernel is the bit-parallel LCS run over
all windows of all texts of an Arrow batch at once: m steps of four numpy operations each.

Where only the best rows of a term are wanted, a task keeps them as it reads (``best_hits``): what its worst kept row
scores is the least that a further text has to reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_BLOCK, _PART, _SKIP = 32_768, 65_536, 256
_KEPT = 500_000     # entries a task keeps at most before it hands them on
_WIDTHS = [(8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)]


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class TextBatch:
    """Texts laid end to end with gaps as wide as the longest needle, characters numbered once.
    Number 0 stands for the gap and for no character."""

    def __init__(self, texts: list[np.ndarray], longest: int):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.gap = longest
        gap = np.zeros(longest, dtype=np.uint32)
        pieces, at, self.starts = [gap], longest, np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            self.starts[i] = at
            pieces += [t, gap]
            at += len(t) + longest
        self.ends = self.starts + self.lengths
        flat = np.concatenate(pieces)
        self.chars, numbers = np.unique(flat, return_inverse=True)
        self.numbers = numbers.astype(np.intp)

    def masks(self, needle: np.ndarray) -> list[np.ndarray]:
        """Per 64 characters of the needle: for each text position the bits where its character
        stands. The word is as narrow as the needle allows."""
        kind = next((k for n, k in _WIDTHS if len(needle) <= n), np.uint64)
        at = np.searchsorted(self.chars, needle)
        known = (at < len(self.chars)) & (self.chars[np.minimum(at, len(self.chars) - 1)] == needle) & (needle != 0)
        out = []
        for lo in range(0, len(needle), 64):
            table = np.zeros(len(self.chars), dtype=kind)
            for i in range(lo, min(lo + 64, len(needle))):
                if known[i]:
                    table[at[i]] |= kind(1 << (i - lo))
            out.append(table.take(self.numbers, mode="clip"))
        return out


def _window_lcs(masks: list[np.ndarray], m: int, lo: int, hi: int) -> np.ndarray:
    """LCS of the needle with the m-wide windows that start at positions lo..hi-1."""
    kind = masks[0].dtype.type
    full = np.iinfo(kind).max
    state = [np.full(hi - lo, full, dtype=kind) for _ in masks]
    if len(masks) == 1:
        s, mask = state[0], masks[0]
        u, total = np.empty_like(s), np.empty_like(s)
        for step in range(m):       # u lies inside s, so s ^ u is s without u
            np.bitwise_and(s, mask[lo + step:hi + step], out=u)
            np.add(s, u, out=total)
            np.bitwise_xor(s, u, out=s)
            np.bitwise_or(s, total, out=s)
        return np.bitwise_count(~s & kind((1 << m) - 1))
    for step in range(m):
        carry = None
        for w, mask in enumerate(masks):
            s = state[w]
            u = s & mask[lo + step:hi + step]
            total = s + u
            over = total < s
            if carry is not None:
                total = total + carry
                over |= (total == 0) & (carry == 1)
            carry = over.astype(kind)
            state[w] = total | (s & ~u)
    n = np.zeros(hi - lo, dtype=np.int32)
    for w, s in enumerate(state):
        bits = min(m - 64 * w, 64)
        n += np.bitwise_count(~s & kind((1 << bits) - 1))
    return n


def _best_windows(lcs: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int, cutoff: float) -> np.ndarray:
    """Best ratio per text of the windows counted in ``lcs``. Only the m - 1 windows at either end are narrower than m, and the
    narrowest of them cannot reach the cutoff."""
    edges = np.stack([starts, ends - m + 1], axis=1).ravel()
    best = 200.0 * np.maximum.reduceat(np.append(lcs, lcs.dtype.type(0)), edges)[::2] / (m + m)
    w = np.arange(max(1, int(cutoff * m / (200.0 - cutoff) - 1e-6)), m)
    if len(w):
        for at in (starts[:, None] - m + w, ends[:, None] - w):
            best = np.maximum(best, (200.0 * lcs[at] / (m + w)).max(axis=1))
    return best


def batch_ratios(batch: TextBatch, needle: np.ndarray, cutoff: float = 0.0) -> np.ndarray:
    """Best ratio per text; 0 for texts shorter than the needle.

    Texts that hold too few of the needle's characters to reach ``cutoff`` are skipped unseen:
    LCS ≤ characters present and w ≥ LCS give LCS ≥ cutoff·m/(200-cutoff)."""
    m = len(needle)
    best = np.zeros(len(batch.lengths))
    fits = np.flatnonzero(batch.lengths >= m)
    if not len(fits):
        return best
    masks = batch.masks(needle)
    if cutoff > 0:
        need = cutoff * m / (200.0 - cutoff)
        edges = np.stack([batch.starts[fits], batch.ends[fits]], axis=1).ravel()
        present = sum(np.bitwise_count(np.bitwise_or.reduceat(x, edges)[::2]).astype(np.int64) for x in masks)
        fits = fits[present >= need]
    if not len(fits):
        return best
    # Runs of neighbouring texts are scored together, up to a block that stays in cache.
    starts, ends = batch.starts[fits], batch.ends[fits]
    apart = (np.diff(ends // _BLOCK) > 0) | (starts[1:] - ends[:-1] > batch.gap + _SKIP)
    bounds = [0, *(np.flatnonzero(apart) + 1).tolist(), len(fits)]
    for i, j in zip(bounds, bounds[1:]):
        lo = int(starts[i]) - (m - 1)
        lcs = _window_lcs(masks, m, lo, int(ends[j - 1]))
        best[fits[i:j]] = _best_windows(lcs, starts[i:j] - lo, ends[i:j] - lo, m, cutoff)
    return best


def inside_ratios(texts: list[np.ndarray], needle: np.ndarray) -> np.ndarray:
    """Best ratio of each text with the windows of the needle, for texts no longer than the needle: the text slides.

    Bits are places in the needle, so all texts of a length and all windows are one matrix."""
    m = len(needle)
    if m > 64:
        return np.array([batch_ratios(TextBatch([needle], len(t)), t)[0] for t in texts])
    kind = next(k for n, k in _WIDTHS if m <= n)
    chars, number = np.unique(needle, return_inverse=True)
    places = np.zeros(len(chars), dtype=kind)
    np.bitwise_or.at(places, number, (1 << np.arange(m, dtype=np.uint64)).astype(kind))
    lengths, best = np.array([len(t) for t in texts]), np.zeros(len(texts))
    for k in np.unique(lengths).tolist():
        lo, hi = np.maximum(np.arange(1 - k, m), 0), np.minimum(np.arange(1 - k, m) + k, m)
        window = np.array([((1 << h) - 1) ^ ((1 << l) - 1) for l, h in zip(lo.tolist(), hi.tolist())], dtype=kind)
        same = np.flatnonzero(lengths == k)
        piece = max(1, _BLOCK // len(window))
        for at in range(0, len(same), piece):
            members = same[at:at + piece]
            codes = np.stack([texts[i] for i in members])
            found = np.minimum(np.searchsorted(chars, codes), len(chars) - 1)
            masks = np.where((chars[found] == codes) & (codes != 0), places[found], kind(0))
            state = np.full((len(members), len(window)), np.iinfo(kind).max, dtype=kind)
            for step in range(k):
                u = state & (masks[:, step, None] & window)
                state = (state + u) | (state & ~u)
            best[members] = (200.0 * np.bitwise_count(~state & window) / (k + (hi - lo))).max(axis=1)
    return best


def partial_ratio(a: str, b: str) -> float:
    """Symmetric partial ratio of two non-empty strings."""
    x, y = _codes(a), _codes(b)
    if len(x) > len(y):
        x, y = y, x
    best = batch_ratios(TextBatch([y], len(x)), x)[0]
    if len(x) == len(y):
        best = max(best, batch_ratios(TextBatch([x], len(y)), y)[0])
    return float(best)


def _parts(members: list[int], lengths: list[int], longest: int) -> Iterator[list[int]]:
    """The members in pieces of neighbours that stay in cache."""
    part, size = [], 0
    for i in members:
        part.append(i)
        size += lengths[i] + longest
        if size >= _PART:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Part:
    """Texts to be scored against several needles; they are encoded when the first needle asks for it."""

    def __init__(self, texts: list[str], longest: int):
        self.texts, self.longest, self.codes, self.batch = texts, longest, None, None

    def ratios(self, needle: np.ndarray, cutoff: float) -> np.ndarray:
        if self.batch is None:
            self.codes = [_codes(t) for t in self.texts]
            self.batch = TextBatch(self.codes, self.longest)
        scores = batch_ratios(self.batch, needle, cutoff)
        short = np.flatnonzero(self.batch.lengths <= len(needle))       # roles swap for short texts
        if len(short):
            scores[short] = np.maximum(scores[short], inside_ratios([self.codes[k] for k in short], needle))
        return scores


def score_batch(texts: pd.Series, packs: pd.Series, cutoff: float) -> list[list[dict]]:
    """For each text, the terms of its pack that reach the cutoff. Rows that share a pack share
    the work."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    groups: dict[tuple, list[int]] = {}
    for i, (text, pack) in enumerate(zip(texts, packs)):
        if text:
            groups.setdefault(tuple(pack), []).append(i)
    lengths = [len(t or "") for t in texts]
    for pack, members in groups.items():
        needles = [_codes(t) for t in pack]
        longest = max(len(n) for n in needles)
        for rows in _parts(members, lengths, longest):
            part = _Part([texts.iloc[i] for i in rows], longest)
            for term, needle in zip(pack, needles):
                scores = part.ratios(needle, cutoff)
                for k in np.flatnonzero(scores >= cutoff):
                    out[rows[k]].append({"term": term, "score": float(scores[k])})
    return out


_MILLION = 1_000_000
_PERFECT = 100 * _MILLION


def _millionths(score: float) -> int:
    return int(np.floor(score * _MILLION + 0.5))


_key = lambda row: (row is not None, row)      # nulls first, as Spark orders


class _Kept:
    """The best ``top`` rows so far of one term, by score, then row. ``score`` and ``row`` are the last one's when there are as many:
    a further row has to come before it."""

    def __init__(self, top: int):
        self.top, self.rows, self.score, self.row = top, {}, 0, None

    def put(self, row, score: int) -> None:
        if score < self.score or (score == self.score and self.row is not None and _key(row) >= self.row):
            return
        if score > self.rows.get(row, -1):
            self.rows[row] = score
            if len(self.rows) >= 2 * self.top:
                self.trim()

    def trim(self) -> None:
        best = sorted(self.rows.items(), key=lambda x: (-x[1], _key(x[0])))[:self.top]
        self.rows = dict(best)
        if len(best) == self.top:
            self.score, self.row = best[-1][1], _key(best[-1][0])


def best_hits(cutoff: float, top: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over scope, slot, pack_no, layer, row_ord, _text, pack: per scope, layer and term of the packs the ``top`` rows
    of the task with the best partial ratio ≥ cutoff (in millionths), lower row_ord on ties, as scope, layer, row_ord, term, _s.

    Rows left out have ``top`` other rows of the same scope, layer and term before them, so no query that asks the term misses them."""

    def score(kept: dict, scope, layer, rows: list, part: _Part, pack: list[str], needles: list[np.ndarray]) -> None:
        least = min(map(_key, rows))
        for term, needle in zip(pack, needles):
            best = kept.get((scope, layer, term))
            if best is None:
                best = kept[scope, layer, term] = _Kept(top)
            if best.score == _PERFECT and least >= best.row:
                continue
            m = len(needle)
            if best.score > _millionths(200.0 * (m - 1) / (2 * m - 1)) and "\0" not in term:    # only a whole match is better
                for row, text in zip(rows, part.texts):
                    if term in text or text in term:
                        best.put(row, _PERFECT)
            else:
                floor = max(cutoff, (best.score - 1) / _MILLION)
                scores = part.ratios(needle, floor)
                for k in np.flatnonzero(scores >= floor).tolist():
                    best.put(rows[k], _millionths(scores[k]))
            best.trim()

    def emit(kept: dict) -> Iterator[pa.RecordBatch]:
        for best in kept.values():
            best.trim()
        hits = [(scope, layer, row, term, s) for (scope, layer, term), best in kept.items() for row, s in best.rows.items()]
        for lo in range(0, len(hits), 10_000):
            columns = zip(*hits[lo:lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, _Kept] = {}
        for batch in batches:
            scope, slot, pack_no, layer, row_ord, texts = (batch.column(i).to_pylist() for i in range(6))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(scope, slot, pack_no, layer)):
                if texts[i]:
                    groups.setdefault(key, []).append(i)
            lengths = [len(t or "") for t in texts]
            for (of, _, _, where), members in groups.items():
                pack = batch.column(6)[members[0]].as_py()
                needles = [_codes(t) for t in pack]
                longest = max(len(n) for n in needles)
                for part in _parts(members, lengths, longest):
                    score(kept, of, where, [row_ord[i] for i in part], _Part([texts[i] for i in part], longest), pack, needles)
                if len(kept) * top > _KEPT:
                    yield from emit(kept)
                    kept = {}
        yield from emit(kept)

    return run
