"""De-duplication of byte passages with a logarithmic family of suffix arrays.

Each batch of texts gets a sparse suffix array: the suffixes at positions that every window of
``width`` bytes chooses by the least hash of its ``core``-byte pieces, in the order of the fingerprint of
their first ``core`` bytes (only long equal beginnings matter, so any fixed order of beginnings will do;
a fingerprint is shipped instead of the bytes). Spark deals the arrays to ranges of fingerprints. In each
range the arrays of the batches arrive one by one, are merge-scanned against the levels that are
there, and levels of equal size are merged, so a batch is scanned against logarithmically many. Suffixes
found in several documents are then extended to whole windows: first the stretch of all windows that
chose a suffix is compared at once, and only stretches that differ, though a suffix with enough bytes to
its left or right is shared, are compared window by window. Whole copies of a text are told apart first.
Texts, stretches and windows are equal if two independent hashes of their bytes (128 bits, 96, and 96) are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import exchange as X
from .texts import MULTIPLIER, Rolling, byte_codes, cuts, mix, text_buffers

#: Bytes of a suffix that order it.
CORE = 16


class Levels:
    """Sorted arrays of (fingerprint, document), sizes growing geometrically; at most one of each size class."""

    def __init__(self):
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, key: np.ndarray, doc: np.ndarray) -> None:
        """A new sorted array: scan it against every level, then merge levels of one size class."""
        hit = np.zeros(len(key), bool)
        for there, docs, hits in self.levels.values():
            left, right = np.searchsorted(there, key, "left"), np.searchsorted(there, key, "right")
            size = right - left
            mine = np.repeat(np.arange(len(key)), size)
            theirs = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + left[mine]
            other = docs[theirs] != doc[mine]
            hit[mine[other]] = True
            hits[theirs[other]] = True
        level = (key, doc, hit)
        while len(level[0]) and (size := len(level[0]).bit_length()) in self.levels:
            both = [np.concatenate(x) for x in zip(self.levels.pop(size), level)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(x[order] for x in both)
        if len(level[0]):
            self.levels[size] = level

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and fingerprints that were met in another document too."""
        doc = [np.zeros(0, np.int64), *(d[h] for _, d, h in self.levels.values())]
        key = [np.zeros(0, np.uint64), *(k[h] for k, _, h in self.levels.values())]
        return np.concatenate(doc), np.concatenate(key)


class Stretches:
    """For a cut of texts: the chosen suffixes and, for each, the stretch of windows [first, last] that chose it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, core: int):
        self.width, self.core, self.offsets, self.data = width, core, offsets, data
        self.rolling = Rolling(byte_codes()[data])
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.row = none
        self.key = np.zeros(0, np.uint64)
        if len(data) < width:
            return
        piece = self.rolling.windows(core)
        # the hash decides, then the leftmost place
        least = (mix(piece) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(piece), dtype=np.uint64)
        span, have = width - core + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        lengths = np.diff(offsets)
        fits = np.ones(len(data), bool)
        short = np.minimum(lengths, width - 1)  # the last starts of each text, which no window fits
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, offsets[1:] - short, 1)
        np.add.at(cover, offsets[1:], -1)
        fits &= np.cumsum(cover[:-1]) == 0
        starts = np.flatnonzero(fits[: len(least)])
        if not len(starts):
            return
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
        begin = np.flatnonzero(new)
        self.at, self.first, self.last = at[begin], starts[begin], starts[np.r_[begin[1:], len(starts)] - 1]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.key = piece[self.at] & np.uint64(0xFFFFFFFFFFFF0000)

    def second(self) -> Rolling:
        """Other hashes of the same bytes."""
        return Rolling(byte_codes(lane=1)[self.data])

    def contexts(self, take: np.ndarray, rolling: Rolling | None = None) -> np.ndarray:
        """A hash of all bytes of the stretch and of where its suffix stands in it."""
        first, last = self.first[take], self.last[take]
        return mix((rolling or self.rolling).slices(first, last + self.width) + (self.at[take] - first).astype(np.uint64) * np.uint64(MULTIPLIER))

    @property
    def more(self) -> int:
        """Of a window's bytes outside the core, at least so many stand on one side of it."""
        return (self.width - self.core + 1) // 2

    def extended(self, take: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the core with ``more`` bytes to its left (or right), and the places in take that have them."""
        at, row = self.at[take], self.row[take]
        begin, end = (at - self.more, at + self.core) if left else (at, at + self.core + self.more)
        inside = np.flatnonzero((begin >= self.offsets[row]) & (end <= self.offsets[row + 1]))
        return self.rolling.slices(begin[inside], end[inside]) & np.uint64(0xFFFFFFFFFFFF0000), inside

    def windows(self, take: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the stretches with the left, or the right, extension of the core: start and row."""
        first, last = self.first[take], self.last[take]
        first = np.where(left, first, np.maximum(first, self.at[take] + self.core + self.more - self.width))
        last = np.where(right, last, np.minimum(last, self.at[take] - self.more))
        count = np.maximum(last - first + 1, 0)
        which = np.repeat(np.arange(len(take)), count)
        return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count), self.row[take][which]

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two hashes of whole texts that hold a window, and their rows."""
        row = np.flatnonzero(np.diff(self.offsets) >= self.width)
        digest, data = xxhash.xxh3_128_digest, self.data
        both = np.frombuffer(b"".join(digest(data[a:b]) for a, b in zip(self.offsets[row].tolist(), self.offsets[row + 1].tolist())), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1], row


def _differing(ext: np.ndarray, ctx: np.ndarray, doc: np.ndarray):
    """Distinct (ext, ctx) with the least doc, in order; whether ext has several ctx; which are its first and last."""
    order = np.lexsort((doc, ctx, ext))
    ext, ctx, doc = ext[order], ctx[order], doc[order]
    if not len(ext):
        return ext, ctx, doc, np.zeros(0, bool), np.zeros(0, bool)
    keep = np.r_[True, (ext[1:] != ext[:-1]) | (ctx[1:] != ctx[:-1])]
    ext, ctx, doc = ext[keep], ctx[keep], doc[keep]
    first = np.r_[True, ext[1:] != ext[:-1]]
    last = np.r_[first[1:], True]
    return ext, ctx, doc, ~(first & last), first | last


def remove_repeated_bytes(docs: DataFrame, width: int = 50, core: int = CORE, buckets: int | None = None, texts: bool = False) -> DataFrame:
    """Bytes covered by a ``width``-byte string that also starts in a document with a smaller doc_id, removed.

    Input: ``doc_id``, ``text`` (UTF-8 bytes); other columns are not looked at. Output per row: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and ``kept`` (the bytes; null unless
    ``texts``). A null text is empty. A text with a null doc_id keeps all bytes and removes none elsewhere.
    Rows with one doc_id count as one document. Texts shorter than ``width``, and an empty table, lose nothing.
    """
    if not 0 < core < width:
        raise ValueError("core must be shorter than width")
    n = buckets or X.default_buckets(docs)
    table = X.bucketed(docs, n)

    def stretches(data, offsets):
        for i, j in cuts(offsets):
            lo, hi = offsets[i], offsets[j]
            yield i, Stretches(data[lo:hi], offsets[i : j + 1] - lo, width, core)

    def fingerprints(data, offsets):
        for i, found in stretches(data, offsets):
            yield X.SENT, found.key, found.row + i, None
            key, val, row = found.texts()
            yield X.SENT_TEXT, key, row + i, val

    def index(frame):
        """The family of one range of fingerprints."""
        if (rows := X.passed(frame, n)) is not None:
            return rows
        family = Levels()
        for doc, key in frame.loc[frame["tag"] == X.SENT, ["doc", "key"]].itertuples(index=False):
            family.add(X.unpacked_keys(key), X.unpacked(doc, np.int64))
        doc, key = family.shared()
        rows = X.spread(X.SHARED, X.doc_bucket(doc, n), doc, key)
        doc, key, val = X.gathered(frame, X.SENT_TEXT, with_val=True)
        key, doc, least, _, _ = X.distinct_pairs(key, doc, val)
        later = doc > least
        return rows + X.spread(X.COPY, X.doc_bucket(doc[later], n), doc[later], key[later])

    def opened(texts_: pa.Table, found: pa.Table):
        """What a bucket of texts and the rows for them hold."""
        doc, null = X.doc_ids(texts_.column("doc_id"))
        frame = found.to_pandas()
        members = {tag: X.Members(X.pair_codes(*X.gathered(frame, tag))) for tag in (X.SHARED, X.COPY, X.DROP_RUN, X.EDGE_LEFT, X.EDGE_RIGHT, X.DROP_WINDOW)}
        return frame, members, doc, null, *text_buffers(texts_.column("text"))

    def copies(cut: Stretches, i: int, doc: np.ndarray, null: np.ndarray, members: X.Members) -> np.ndarray:
        """Which rows of the cut are whole copies of a smaller document's text."""
        out = np.zeros(len(cut.offsets) - 1, bool)
        key, _, row = cut.texts()
        out[row] = members.of(X.pair_codes(doc[row + i], key)) & ~null[row + i]
        return out

    def carried(frame, *tags: int) -> list[tuple]:
        """Rows that a later stage needs."""
        return [(n + int(b), *row) for b, *row in frame.loc[frame["tag"].isin(tags), list(X.NAMES)].itertuples(index=False, name=None)]

    def extend(key_group, texts_: pa.Table, found: pa.Table) -> pa.Table:
        frame, members, doc, null, data, offsets = opened(texts_, found)
        ctx_all, second_all, doc_all = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        sides: dict[bool, list] = {side: [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))] for side in (True, False)}
        for i, cut in stretches(data, offsets) if len(members[X.SHARED].codes) else ():
            own = cut.row + i
            whole = copies(cut, i, doc, null, members[X.COPY])
            take = np.flatnonzero(members[X.SHARED].of(X.pair_codes(doc[own], cut.key)) & ~null[own] & ~whole[cut.row])
            if not len(take):
                continue
            ctx, ids = cut.contexts(take), doc[own[take]]
            ctx_all.append(ctx)
            second_all.append(cut.contexts(take, cut.second()) & X.SECOND)
            doc_all.append(ids)
            for side in sides:
                ext, which = cut.extended(take, side)
                sides[side].append((ext, ctx[which] & np.uint64(0xFFFFFFFFFFFF0000), ids[which]))
        ctx, ids, least, _, second = X.distinct_pairs(*map(np.concatenate, (ctx_all, doc_all, second_all)))
        later = ids > least
        rows = carried(frame, X.COPY)
        rows += X.spread(X.DROP_RUN, n + X.doc_bucket(ids[later], n), ids[later], ctx[later])
        rows += X.spread(X.SENT_CONTEXT, X.key_bucket(ctx[~later], n), ids[~later], ctx[~later], second[~later])
        for side, parts in sides.items():
            ext, ctx, ids, several, ends = _differing(*map(np.concatenate, zip(*parts)))
            rows += X.spread(X.EDGE_LEFT if side else X.EDGE_RIGHT, n + X.doc_bucket(ids[several], n), ids[several], ctx[several])
            rows += X.spread(X.SENT_LEFT if side else X.SENT_RIGHT, X.key_bucket(ext[ends], n), ids[ends], ext[ends], ctx[ends])
        return pa.Table.from_batches([X.as_batch(rows)])

    def contexts(frame):
        if (rows := X.passed(frame, n)) is not None:
            return rows
        doc, ctx, second = X.gathered(frame, X.SENT_CONTEXT, with_val=True)
        ctx, doc, least, _, _ = X.distinct_pairs(ctx, doc, second)
        later = doc > least
        rows = X.spread(X.DROP_RUN, X.doc_bucket(doc[later], n), doc[later], ctx[later])
        for sent, edge in ((X.SENT_LEFT, X.EDGE_LEFT), (X.SENT_RIGHT, X.EDGE_RIGHT)):
            doc, ext, ctx = X.gathered(frame, sent, with_val=True)
            _, ctx, doc, several, _ = _differing(ext, ctx, doc)
            rows += X.spread(edge, X.doc_bucket(doc[several], n), doc[several], ctx[several])
        return rows

    def expand(key_group, texts_: pa.Table, found: pa.Table) -> pa.Table:
        frame, members, doc, null, data, offsets = opened(texts_, found)
        hashes, seconds, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, cut in stretches(data, offsets) if len(members[X.EDGE_LEFT].codes) or len(members[X.EDGE_RIGHT].codes) else ():
            own = cut.row + i
            ctx = cut.contexts(np.arange(len(own)))
            short = X.pair_codes(doc[own], ctx & np.uint64(0xFFFFFFFFFFFF0000))
            left, right = members[X.EDGE_LEFT].of(short), members[X.EDGE_RIGHT].of(short)
            whole = copies(cut, i, doc, null, members[X.COPY])
            take = np.flatnonzero((left | right) & ~members[X.DROP_RUN].of(X.pair_codes(doc[own], ctx)) & ~null[own] & ~whole[cut.row])
            starts, rows = cut.windows(take, left[take], right[take])
            if len(starts):
                hashes.append(cut.rolling.slices(starts, starts + width))
                seconds.append(cut.second().slices(starts, starts + width))
                ids.append(doc[rows + i])
        rows = carried(frame, X.COPY, X.DROP_RUN)
        return pa.Table.from_batches([X.as_batch(rows + X.windows_sent(*map(np.concatenate, (hashes, ids, seconds)), n))])

    def finish(key_group, texts_: pa.Table, found: pa.Table) -> pa.Table:
        _, members, doc, null, data, offsets = opened(texts_, found)
        runs, windows, whole = (members[tag] for tag in (X.DROP_RUN, X.DROP_WINDOW, X.COPY))
        out: dict = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, j in cuts(offsets):
            lo, hi = offsets[i], offsets[j]
            part, bounds = data[lo:hi], offsets[i : j + 1] - lo
            cover = np.zeros(len(part) + 1, np.int64)
            if len(runs.codes) or len(windows.codes) or len(whole.codes):
                cut = Stretches(part, bounds, width, core)
                same = np.flatnonzero(copies(cut, i, doc, null, whole))
                np.add.at(cover, bounds[same], 1)
                np.add.at(cover, bounds[same + 1], -1)
                own = cut.row + i
                if len(runs.codes):
                    take = np.flatnonzero(runs.of(X.pair_codes(doc[own], cut.contexts(np.arange(len(own))))) & ~null[own])
                    np.add.at(cover, cut.first[take], 1)
                    np.add.at(cover, cut.last[take] + width, -1)
                if len(windows.codes) and len(part) >= width:
                    codes = cut.rolling.windows(width)
                    codes ^= np.repeat(mix(doc[i:j].view(np.uint64)), np.diff(bounds))[: len(codes)]
                    starts = np.flatnonzero(windows.of(codes))
                    rows = np.searchsorted(bounds, starts, "right") - 1
                    starts = starts[(starts + width <= bounds[rows + 1]) & ~null[rows + i]]
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + width, -1)
            gone = np.cumsum(cover[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = bounds[:-1][np.diff(bounds) > 0]
            opens[inner] = gone[inner]
            sums = [np.r_[0, np.cumsum(x)] for x in (gone, opens)]
            removed, spans = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            for r in range(j - i):
                a, b = bounds[r], bounds[r + 1]
                kept = (part[a:b][~gone[a:b]] if removed[r] else part[a:b]).tobytes()
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if texts else None)
            out["doc_id"] += [None if null[r] else int(doc[r]) for r in range(i, j)]
            out["n_bytes"] += np.diff(bounds).tolist()
            out["n_removed"] += removed.tolist()
            out["n_spans"] += spans.tolist()
        kinds = (*[pa.int64()] * 4, pa.string(), pa.binary())
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    suffixes = X.settle(X.send(docs, fingerprints, n), index)
    extended = X.settle(X.meet(table, suffixes, extend, X.ROWS), contexts)
    windows = X.settle(X.meet(table, extended, expand, X.ROWS), X.windows_settled(n))
    return X.meet(table, windows, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
