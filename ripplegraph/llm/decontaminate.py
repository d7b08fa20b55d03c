"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows. A text region within k edits of a window of n characters keeps
at least n + 1 - q - k*q of the window's q-grams, and all of them lie on diagonals (text position
minus window position) in a band of k + 1. Every document is scanned once: its q-grams are looked up
in the index of the windows, hits are counted in overlapping diagonal bands (2k + 2 wide, every
k + 1), bands that reach the bound are kept, and each is verified by banded alignment, so what is
returned is exact for the edit budget.

The budget is `rate` of the window's length. Matching ignores ASCII case and kinds of white space.
Lengths and edits count UTF-8 bytes; reported positions are code points.

The index of the benchmark is sent to every task only in chunks of checked size (`chunk_chars`); a
larger benchmark is scanned in several passes over the documents, and one chunk is held at a time. No
document is shuffled.

Defined cases: null or empty texts and items match nothing. Items shorter than a window match as a whole,
those of 12 to 47 bytes with as many edits of their rate as leave a q-gram that must be shared (none under
24 bytes, one under 36), those under 12 bytes exactly and between bytes that are no letters or digits;
items shorter than `least` bytes are ignored. An empty benchmark or no documents: no rows. Repeated documents are
reported each; repeated windows of an item are reported as one region per item and place. Texts of any
length are searched whole. Other columns than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q = 12
FOLD = common.LOWER.copy()
FOLD[[9, 10, 11, 12, 13]] = 32
_BITS = 20


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes at every position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    data = np.ascontiguousarray(data)
    at = lambda i: np.ndarray((n,), "<u8", data, i, (1,))
    h = at(0) * np.uint64(0x9E3779B97F4A7C15) + at(Q - 8) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


class Index:
    """Windows of benchmark items and the inverted list of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], window: int, rate: float, least: int):
        self.items, self.windows, self.at, self.tiny, self.window = [], [], [], [], window
        whole = []
        for item, text in items:
            raw = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
            if len(raw) < max(1, least):
                continue
            if len(raw) < Q:
                self.tiny.append((item, raw.tobytes()))
                continue
            if len(raw) > window:
                whole.append((item, raw))
            starts = list(range(0, max(1, len(raw) - window + 1), window // 2))
            if len(raw) > window and starts[-1] + window < len(raw):
                starts.append(len(raw) - window)
            for s in starts:
                self.items.append(item)
                self.windows.append(raw[s : s + window])
                self.at.append(s)
        self.n = len(self.windows)  # from here on: whole items, searched for a window anywhere
        for item, raw in whole:
            self.items.append(item)
            self.windows.append(raw)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        size = np.minimum(self.size, window)
        self.edits = (rate * size).astype(np.int64)
        self.edits = np.where(size < 4 * Q, np.minimum(self.edits, size // Q - 1), self.edits)
        self.bound = size + 1 - Q - self.edits * Q
        if (self.bound < 1).any():
            raise ValueError("the edit rate leaves no q-gram that must be shared")
        hashes = [grams(w) for w in self.windows]
        all_h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(all_h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, first = np.unique(all_h[order], return_index=True)
        self.first = np.append(first, len(all_h))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, lowest diagonal of the band) of the bands of a batch that reach the bound."""
        none = np.empty(0, np.int64)
        h = grams(data)
        if not len(h) or not len(self.keys):
            return none, none
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[at])
        ok = self.keys[np.minimum(key, len(self.keys) - 1)] == h[at]
        at, key = at[ok], key[ok]
        row = np.searchsorted(offsets, at, side="right")
        inside = at + Q <= offsets[np.minimum(row, len(offsets) - 1)]
        at, key = at[inside], key[inside]
        counts = self.first[key + 1] - self.first[key]
        entry = _runs(self.first[key], counts)
        window, diagonal = self.owner[entry], np.repeat(at, counts) - self.place[entry]
        step = self.edits[window] + 1
        shift = 1 << 32  # diagonals start at minus an item's length
        band = (diagonal + shift) // step
        both_w, both_b = np.concatenate([window, window]), np.concatenate([band, band - 1])
        pair, n = np.unique(both_w * (1 << 40) + both_b, return_counts=True)
        w, b = pair >> 40, pair & ((1 << 40) - 1)
        kept = n >= self.bound[w]
        w, b = w[kept], b[kept]
        return w, b * (self.edits[w] + 1) - shift

    def verify(self, w: int, low: int, data: np.ndarray, start: int, end: int) -> tuple[int, int, int] | None:
        """Best (start, end, edits) of the window within a band of the document data[start:end]."""
        k, n = int(self.edits[w]), int(self.size[w])
        a, b = max(start, low - k), min(end, low + 2 * k + 2 + n + k)
        if b - a < n - k:
            return None
        region, window = data[a:b], self.windows[w]
        exact = region.tobytes().find(window.tobytes())
        if exact >= 0:
            return a + exact, a + exact + n, 0
        d = align(window, region)
        j = int(np.argmin(d))
        if d[j] > k:
            return None
        back = align(window[::-1], region[:j][::-1])
        length = int(np.flatnonzero(back == back.min())[0])
        return a + j - length, a + j, int(d[j])

    def anywhere(self, w: int, low: int, data: np.ndarray, start: int, end: int) -> tuple[int, int, int, int] | None:
        """(start, end, edits) of a window at any offset of a whole item within a band of the document data[start:end], and its diagonal."""
        k, size, item = int(self.edits[w]), self.window, self.windows[w]
        mine, n = grams(item), len(item) - Q + 1
        a, b = max(start, low), min(end, low + 2 * k + 1 + len(item))
        theirs = grams(data[a:b])
        hits = np.zeros(n + 1, np.int64)
        for d in range(low, low + 2 * k + 2):
            p, stop = max(0, a - d), min(n, a - d + len(theirs))
            if p < stop:
                hits[p + 1 : stop + 1] += theirs[p + d - a : stop + d - a] == mine[p:stop]
        total = np.cumsum(hits)
        count = total[size - Q + 1 :] - total[: n - (size - Q)]
        offsets = np.flatnonzero(count >= self.bound[w])
        offsets = offsets[np.argsort(-count[offsets], kind="stable")]
        wide = size + 4 * k + 2
        for at in (0, *range(8, len(offsets), 256)):
            some = offsets[at : 8 if at == 0 else at + 256]
            place = (low - k + some)[:, None] + np.arange(wide)
            inside = (place >= start) & (place < end)
            region = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 256).astype(np.int16)
            d = align_many(item[some[:, None] + np.arange(size)].astype(np.int16), region) if len(some) else np.full((1, 1), k + 1)
            if d.min() <= k:
                o = int(some[int(np.argmin(d.min(1)))])
                x, y = max(start, low - k + o), min(end, low - k + o + wide)
                window, text = item[o : o + size], data[x:y]
                last = align(window, text)
                j = int(np.argmin(last))
                back = align(window[::-1], text[:j][::-1])
                length = int(np.flatnonzero(back == back.min())[0])
                return x + j - length, x + j, int(last[j]), x + j - length - o
        return None

    def exactly(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, start, end) of the items that are too short for q-grams."""
        raw = data.tobytes() if self.tiny else b""
        for item, word in self.tiny:
            at = raw.find(word)
            while at >= 0:
                row, end = int(np.searchsorted(offsets, at, side="right")) - 1, at + len(word)
                first, last = int(offsets[row]), int(offsets[row + 1])
                if end <= last and (at == first or not _WORD[raw[at - 1]]) and (end == last or not _WORD[raw[end]]):
                    yield row, item, at, end
                at = raw.find(word, at + 1)


#: Bytes of letters and digits; those of other scripts count as letters.
_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def align_many(windows: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """align() of each row."""
    j = np.arange(regions.shape[1] + 1, dtype=np.int16)
    d = np.zeros((len(regions), regions.shape[1] + 1), np.int16)
    for i in range(windows.shape[1]):
        e = d + 1
        np.minimum(e[:, 1:], d[:, :-1] + (regions != windows[:, i : i + 1]), out=e[:, 1:])
        e[:, 0] = i + 1
        d = np.minimum.accumulate(e - j, axis=1) + j
    return d


def align(window: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Edits of the window against the best part of the region that ends at each position."""
    j = np.arange(len(region) + 1)
    d = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(window):
        e = d + 1
        e[1:] = np.minimum(e[1:], d[:-1] + (region != c))
        e[0] = i + 1
        d = np.minimum.accumulate(e - j) + j
    return d


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (counts[0] of them), first[1], ..."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first - (ends - counts), counts)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = 120,
    rate: float = 0.06,
    least: int = 1,
    chunk_chars: int = 4_000_000,
    id_cols: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): regions of documents that hold a window of a benchmark item; `id_cols` (long) name a document."""
    common.prepare(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where(F.col("item").isNotNull() & F.col("item_id").isNotNull())
    chars = items.agg(F.sum(F.length("item"))).first()[0] or 0
    chunks = max(1, -(-chars // chunk_chars))
    out = None
    for chunk in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(chunks)) == chunk).collect()  # about chunk_chars
        shared = spark.sparkContext.broadcast(Index(sorted((r["item_id"], r["item"]) for r in rows), window, rate, least))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in (some for b in batches for some in common.slices(b, text_col, 2000, 4 << 20)):
                raw, offsets = common.bytes_of(common.column(batch, text_col))
                data = FOLD[raw]
                found: dict[tuple[int, int, int], tuple[int, int]] = {(row, item, a): (0, b) for row, item, a, b in index.exactly(data, offsets)}
                known: dict[tuple[int, int], list[int]] = {}  # diagonals of what was found; whole items come last
                for w, low in zip(*(x.tolist() for x in index.candidates(data, offsets)), strict=True):
                    for row in range(max(0, int(np.searchsorted(offsets, low, side="right")) - 1), len(batch)):
                        if offsets[row] > low + 3 * index.edits[w] + 2 + index.size[w]:
                            break
                        k, seen = int(index.edits[w]), known.setdefault((row, index.items[w]), [])
                        if w < index.n:
                            hit = index.verify(w, low, data, int(offsets[row]), int(offsets[row + 1]))
                        elif any(low - k <= x <= low + 3 * k + 2 for x in seen):
                            continue
                        else:
                            hit = index.anywhere(w, low, data, int(offsets[row]), int(offsets[row + 1]))
                        if hit:
                            seen.append(hit[0] - index.at[w] if w < index.n else hit[3])
                            key = (row, index.items[w], hit[0])
                            found[key] = min(found.get(key, (1 << 30, 0)), (hit[2], hit[1]))
                lead = (raw & 0xC0) != 0x80
                chars = lambda row, at, lead=lead, offsets=offsets: int(lead[offsets[row] : at].sum())
                ids = [common.column(batch, c) for c in id_cols]
                rows = [(*(c[row].as_py() for c in ids), item, chars(row, a), chars(row, b), e) for (row, item, a), (e, b) in sorted(found.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=names)

        names = [*id_cols, "item_id", "start", "end", "edits"]
        part = docs.select(*(F.col(c).cast("long").alias(c) for c in id_cols), text_col).mapInArrow(scan, ", ".join(f"`{c}` long" for c in names))
        if chunks > 1:  # one index at a time is held
            part = common.cut(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item found in it: regions, the smallest edits, first start and last end."""
    found = leaks(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_regions"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )
