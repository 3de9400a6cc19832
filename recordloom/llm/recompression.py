"""Substring de-duplication by recompression.

The words of a text are its first symbols. A round names runs of equal symbols, then pairs of
neighbours (one bit of a symbol's name says whether it may begin or end a pair). A name is a hash of
what it stands for, so every task of every machine gives equal passages the same names without a
dictionary to share. How far a symbol depends on its surroundings is tracked exactly: inside equal
windows the interior symbols are equal. Each window picks, by the least name, one of its interior
symbols of the highest level that has any; only these symbols (with the words that decide them) are
exchanged. Symbols shared by several documents reveal where windows may repeat; those windows, and no
others, are then compared across documents, by two independent hashes of their words (96 bits).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .texts import MULTIPLIER, Rolling, cuts, mix, space_table, text_buffers, word_bounds, word_codes

#: Rounds of naming runs and pairs.
ROUNDS = 2
_NONE = np.int64(-1)
_FAR = np.int64(1 << 60)


@dataclass
class Symbols:
    """Symbols of one level. Words lo..hi decide a symbol's name and bounds; lo < 0 or hi far: a text's edge does."""

    name: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def before(self, values: np.ndarray, edge: np.int64) -> np.ndarray:
        """values of the symbol to the left in the same text, else edge."""
        out = np.full(len(values), edge, values.dtype)
        same = self.row[1:] == self.row[:-1]
        out[1:][same] = values[:-1][same]
        return out

    def after(self, values: np.ndarray, edge: np.int64) -> np.ndarray:
        out = np.full(len(values), edge, values.dtype)
        same = self.row[1:] == self.row[:-1]
        out[:-1][same] = values[1:][same]
        return out


def name_runs(x: Symbols) -> Symbols:
    """Each run of equal symbols becomes one; both neighbours must be known to know where it ends."""
    if not len(x.name):
        return x
    first = np.r_[True, (x.name[1:] != x.name[:-1]) | (x.row[1:] != x.row[:-1])]
    at = np.flatnonzero(first)
    last = np.r_[at[1:], len(first)] - 1
    count = (last - at + 1).astype(np.uint64)
    name = np.where(count > 1, mix(x.name[at] + count * np.uint64(MULTIPLIER)), x.name[at])
    return Symbols(name, x.row[at], x.before(x.lo, _NONE)[at], x.after(x.hi, _FAR)[last])


def name_pairs(x: Symbols) -> Symbols:
    """A symbol of class 0 and a following one of class 1 become one symbol."""
    if not len(x.name):
        return x
    one = (mix(x.name) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(one), bool)
    joins[:-1] = ~one[:-1] & one[1:] & (x.row[1:] == x.row[:-1])
    second = np.r_[False, joins[:-1]]
    keep = np.flatnonzero(~second)
    pair = joins[keep]
    after = np.minimum(keep + 1, len(one) - 1)
    name = np.where(pair, mix(x.name[keep] * np.uint64(3) + mix(x.name[after])), x.name[keep])
    lo = np.where(pair | ~one[keep], x.lo[keep], x.before(x.lo, _NONE)[keep])
    hi = np.where(pair, x.hi[after], np.where(one[keep], x.hi[keep], x.after(x.hi, _FAR)[keep]))
    return Symbols(name, x.row[keep], lo, hi)


def window_keys(codes: np.ndarray, row: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, Rolling]:
    """Window starts, the key of each window's chosen symbol, and the hashes of the words."""
    rolling = Rolling(codes)
    at = np.arange(len(codes), dtype=np.int64)
    starts = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1]) if len(codes) >= width else at[:0]
    key = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return starts, key, rolling
    levels, level = [], Symbols(codes, row, at, at + 1)
    for _ in range(rounds):
        level = name_pairs(name_runs(level))
        levels.append(level)
    open_ = np.arange(len(starts))
    for depth, level in reversed(list(enumerate(levels, 1))):
        usable = (level.lo >= 0) & (level.hi < _FAR) & (level.hi - level.lo <= width)
        name, lo, hi = mix(level.name[usable]), level.lo[usable], level.hi[usable]
        if not len(lo) or not len(open_):
            continue
        # symbols decided inside window t are those from the first with lo >= t to the last with hi <= t + width
        begin = np.r_[0, np.cumsum(np.bincount(lo, minlength=len(codes) + 1))][starts[open_]]
        end = np.cumsum(np.bincount(hi, minlength=len(codes) + 1))[starts[open_] + width]
        best = np.full(len(open_), np.iinfo(np.uint64).max, np.uint64)
        order = (name & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
        live, step = np.flatnonzero(begin < end), 0
        while len(live):
            best[live] = np.minimum(best[live], order[begin[live] + step])
            step += 1
            live = live[begin[live] + step < end[live]]
        chosen = np.flatnonzero(begin < end)
        symbol = (best[chosen] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key[open_[chosen]] = (rolling.slices(lo[symbol], hi[symbol]) ^ name[symbol]) + np.uint64(depth)
        open_ = open_[begin >= end]
    # a window without an interior symbol (inside one long run, say) stands for itself
    key[open_] = rolling.slices(starts[open_], starts[open_] + width)
    return starts, key & np.uint64(0xFFFFFFFFFFFF0000), rolling


def _cut_words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, row = word_bounds(data, offsets, space_table())
    return starts, ends, row, word_codes(data, starts, ends)


def _windows_of(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return Rolling(codes).slices(starts, starts + width) if len(starts) else np.zeros(0, np.uint64)


def remove_repeated_windows(docs: DataFrame, width: int = 13, buckets: int | None = None, texts: bool = False) -> DataFrame:
    """Words covered by a window of ``width`` words that also starts in a document with a smaller doc_id, removed.

    Input: ``doc_id``, ``text``; other columns are not looked at. Output per row: doc_id, n_words,
    n_removed, kept_sha256 of the kept words joined by one space, and ``kept`` (that text; null unless
    ``texts``). A null text has no words. A text with a null doc_id is neither smaller nor larger than
    another, so it keeps all words. Rows with one doc_id count as one document that is compared with
    others only. Shorter texts than a window, and an empty table, lose nothing.
    """
    n = buckets or X.default_buckets(docs)
    table = X.bucketed(docs, n)

    def fingerprints(data, offsets):
        for i, j in cuts(offsets):
            lo, hi = offsets[i], offsets[j]
            _, _, row, codes = _cut_words(data[lo:hi], offsets[i : j + 1] - lo)
            starts, key, _ = window_keys(codes, row, width)
            if len(starts):
                row = row[starts]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
                yield X.SENT, key[new], row[new] + i, None

    def shared(frame):
        if (rows := X.passed(frame, n)) is not None:
            return rows
        doc, key = X.gathered(frame, X.SENT)
        key, doc, _, many, _ = X.distinct_pairs(key, doc)
        return X.spread(X.SHARED, X.doc_bucket(doc[many], n), doc[many], key[many])

    def compare(key_group, texts_: pa.Table, found: pa.Table) -> pa.Table:
        """The windows whose symbol is shared."""
        doc, key = X.gathered(found.to_pandas(), X.SHARED)
        members = X.Members(X.pair_codes(doc, key))
        hashes, seconds, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        doc, null = X.doc_ids(texts_.column("doc_id"))
        data, offsets = text_buffers(texts_.column("text"))
        for i, j in cuts(offsets) if len(members.codes) else ():
            lo, hi = offsets[i], offsets[j]
            begin, end, row, codes = _cut_words(data[lo:hi], offsets[i : j + 1] - lo)
            starts, key, rolling = window_keys(codes, row, width)
            own = row[starts] + i
            take = members.of(X.pair_codes(doc[own], key)) & ~null[own]
            if take.any():
                hashes.append(rolling.slices(starts[take], starts[take] + width))
                seconds.append(_windows_of(word_codes(data[lo:hi], begin, end, lane=1), starts[take], width))
                ids.append(doc[own[take]])
        return pa.Table.from_batches([X.as_batch(X.windows_sent(*map(np.concatenate, (hashes, ids, seconds)), n))])

    def finish(key_group, texts_: pa.Table, found: pa.Table) -> pa.Table:
        doc, key = X.gathered(found.to_pandas(), X.DROP_WINDOW)
        members = X.Members(X.pair_codes(doc, key))
        out: dict = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        doc, null = X.doc_ids(texts_.column("doc_id"))
        data, offsets = text_buffers(texts_.column("text"))
        for i, j in cuts(offsets):
            lo, hi = offsets[i], offsets[j]
            part, bounds = data[lo:hi].copy(), offsets[i : j + 1] - lo
            starts, ends, row, codes = _cut_words(part, bounds)
            gone = np.zeros(len(starts) + 1, np.int64)
            if len(codes) >= width and len(members.codes):
                rolling = Rolling(codes)
                at = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
                own = row[at] + i
                drop = at[members.of(X.pair_codes(doc[own], rolling.slices(at, at + width))) & ~null[own]]
                np.add.at(gone, drop, 1)
                np.add.at(gone, drop + width, -1)
            kept = np.cumsum(gone[:-1]) == 0
            # kept words and one blank after each but the text's last
            of, s, e = row[kept], starts[kept], ends[kept].copy()
            inner = np.r_[of[1:] == of[:-1], False] if len(of) else np.zeros(0, bool)
            part[e[inner]] = 0x20
            e[inner] += 1
            cover = np.zeros(len(part) + 1, np.int64)
            cover[s] += 1
            np.add.at(cover, e, -1)
            mask = np.cumsum(cover[:-1]) > 0
            n_all, n_kept = np.bincount(row, minlength=j - i), np.bincount(of, minlength=j - i)
            for r in range(j - i):
                a, b = bounds[r], bounds[r + 1]
                text = part[a:b][mask[a:b]].tobytes()
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                out["kept"].append(text.decode() if texts else None)
            out["doc_id"] += [None if null[r] else int(doc[r]) for r in range(i, j)]
            out["n_words"] += n_all.tolist()
            out["n_removed"] += (n_all - n_kept).tolist()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    candidates = X.settle(X.send(docs, fingerprints, n), shared)
    windows = X.settle(X.meet(table, candidates, compare, X.ROWS), X.windows_settled(n))
    return X.meet(table, windows, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
