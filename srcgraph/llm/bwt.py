"""Operator 5: passages that repeat across documents, by merging Burrows-Wheeler transforms of shards.

Texts are cut into phrases at anchors that depend on the words around them alone
(the least three-word hash of every window of ``ANCHOR`` words), so equal
passages are cut alike, whatever stands around them. The transforms are those of
phrase sequences, an alphabet of hashes, about seven times shorter than the words.

1. A repeat of ``min_words`` words holds whole phrases of ``least_core`` words at
   least. Phrase runs of that size, the seeds, meet in a sorted shuffle; a phrase
   at which no seed begins that several documents share can begin no repeat.
2. A shard (a batch of documents) sorts the suffixes that begin with shared seeds,
   equal ones once, bucket by bucket of the seed, and ships their transform. The
   number of buckets follows the number of seeds.
3. In a bucket the transforms of all shards are merged by refining their
   interleave: each round places the suffixes by their first phrase and the
   present place of what follows it, so that the order is right to one phrase
   more; rounds touch what the one before changed. No suffix is compared or sorted
   again. The round in which a boundary appears is the common prefix at it;
   intervals between boundaries whose suffixes come from several documents are the
   repeats. What each suffix shares goes back to its shard.
4. Where all windows of ``min_words`` words that begin in a phrase are shared, they
   are certain. Of the others those that the common prefix leaves open are hashed
   and met in a shuffle; of certain ones only the first document's take part.

The result is exact, word for word: the union of all windows of ``min_words`` words
that some other document holds too.

Defined cases
-------------
* Case and punctuation don't count. Null, empty and short texts (fewer than
  ``min_words`` words) repeat nothing.
* A repeat within one document only is not reported. Repeated rows and equal ids
  are different documents here, so a copied row repeats as a whole.
* Null ids are carried, as the document's and as the peer's.
* Long texts are searched whole, and any number of documents may share a passage:
  equal suffixes of a shard travel once, and groups are judged as a stream.
* An empty table gives an empty result. Extra columns are ignored.
* Rows are told apart by their place, so ``docs`` must be a stable table (files, or
  written out); a row whose text differs between the two scans raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.llm.common import U64, chunks, materialise, mix, powers, raw_text, release, rolling, words

MIN_WORDS = 50
ANCHOR = 16
GRAM = 3
#: Suffixes of a bucket, about.
BUCKET_ROWS = 1 << 16
#: Words that are marked at a time.
MARKED = 1 << 22


def least_core(min_words: int) -> int:
    """Words of whole phrases that a repeat of ``min_words`` words holds at least."""
    core = min_words - 2 * ANCHOR - GRAM + 2
    if core < 1:
        raise ValueError(f"a repeat must have {2 * ANCHOR + GRAM - 1} words to hold a phrase")
    return core


# ---------------------------------------------------------------- phrases
def parse(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, words) of the phrases of each text."""
    _, _, row, h = words(buf, offs)
    n = len(h)
    if not n:
        return row, h, row
    cut = np.append(True, row[1:] != row[:-1])
    g = rolling(h, GRAM)
    if len(g) >= ANCHOR:
        view = np.lib.stride_tricks.sliding_window_view(g, ANCHOR)
        at = np.arange(len(view)) + view.argmin(axis=1)
        whole = row[: len(view)] == row[ANCHOR + GRAM - 2 :]
        cut[at[whole]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * p[:n], out=total[1:])
    sym = mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64))
    return row[start], np.maximum(sym, U64(1)), end - start


def _parse_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = raw_text(batch.column(3))
            for lo, hi in chunks(offs):
                row, sym, n = parse(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                long = np.bincount(row, weights=n, minlength=hi - lo) >= min_words
                row, sym, n = row[long[row]], sym[long[row]], n[long[row]]
                some, first = np.unique(row, return_index=True)
                ends = np.append(first, len(row)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (sym.view(np.int64), n.astype(np.int16))]
                kept = [batch.column(k).slice(lo, hi - lo).take(pa.array(some)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], ["rid", "doc_id", "mark", "syms", "lens"])

    return run


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, n + 1 offsets) of a list array."""
    offs = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], offs - offs[0]


class Phrases:
    """Phrases of a run of documents: ``sym``, ``row``, words before each (``upto``), end of the document (``stop``), end of the seed (``seed_end``, where there ``has`` one)."""

    def __init__(self, sym: np.ndarray, lens: np.ndarray, offs: np.ndarray, core: int):
        self.sym, self.lens, self.offs = sym.view(U64), lens.astype(np.int64), offs
        n = len(sym)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        self.stop = offs[self.row + 1]
        self.upto = np.append(0, np.cumsum(self.lens))
        self.seed_end = np.searchsorted(self.upto, self.upto[:-1] + core, side="left")
        self.has = self.seed_end <= self.stop
        self.seed_end = np.minimum(self.seed_end, n)
        self._p, self._inv = powers(n + 1)
        self._total = np.zeros(n + 1, U64)
        np.cumsum(self.sym * self._p[:n], out=self._total[1:])

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the runs of phrases from ``a`` to before ``b``."""
        return mix((self._total[b] - self._total[a]) * self._inv[a] + (b - a).astype(U64))

    def windows(self, kept: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) of the windows that begin with the ``kept`` seeds: all windows of words that begin in their first phrase, as far as a match can reach."""
        n = len(self.sym)
        # a match ends before the seed of the first place behind that isn't shared does
        off = np.where(kept, n, np.arange(n))
        off = np.minimum(np.minimum.accumulate(off[::-1])[::-1], self.stop) if n else off
        inner = np.minimum(off, max(n - 1, 0))
        reach = np.where((off < self.stop) & self.has[inner], self.seed_end[inner] - 1, self.stop)
        a = np.flatnonzero(kept)
        return a, np.minimum(np.searchsorted(self.upto, self.upto[a] + min_words + self.lens[a] - 1, side="left"), reach[a])


def _seeds(min_words: int):
    core = least_core(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            syms, offs = _lists(batch.column(1))
            p = Phrases(syms, _lists(batch.column(2))[0], offs, core)
            at = np.flatnonzero(p.has)
            rid = batch.column(0).to_numpy()[p.row[at]]
            yield pa.RecordBatch.from_arrays([pa.array(p.hashed(at, p.seed_end[at]).view(np.int64)), pa.array(rid), pa.array((at - offs[p.row[at]]).astype(np.int32))], ["key", "rid", "place"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, rid, place) sorted by key and rid the rows whose key several rids have, each with another such rid; one document's rows are held at a time."""
    key, rid, place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    last = least = None  # a key known to be shared, and its first rid
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rid, place = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, rid, place)))
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        reps = np.diff(np.append(cut, len(key)))
        a, b = np.minimum.reduceat(rid, cut), np.maximum.reduceat(rid, cut)
        if last == key[0]:
            a[0] = least
        yes = a != b
        if last == key[0]:
            yes[0] = True
        low = np.repeat(a, reps)
        # the first document's peer is the second one
        second = np.repeat(np.minimum.reduceat(np.where(rid == low, np.iinfo(np.int64).max, rid), cut), reps)
        at = np.flatnonzero(np.repeat(yes, reps))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(place[at]), pa.array(np.where(rid[at] == low[at], second[at], low[at]))], ["rid", "place", "peer"])
        if yes[-1]:
            last, least, rest = key[-1], a[-1], slice(0, 0)
        else:
            last, least, rest = None, None, slice(cut[-1], None)
        key, rid, place = key[rest], rid[rest], place[rest]


# ---------------------------------------------------------------- shards
def suffix_order(text: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (windows of symbols, each closed by 0) sorted as suffixes that end with their window."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n = len(text)
    longest = int(np.bincount(window).max(initial=1))
    k = 1
    while k < longest:
        nxt = np.zeros(n, np.int64)
        # behind a closing 0 nothing counts; the closing one itself ranks lowest
        nxt[:-k] = np.where(window[k:] == window[:-k], rank[k:] + 1, 0)
        nxt[text == 0] = 0
        rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


#: A piece of a shard in a bucket (its windows' transform), or, at a bucket of its own below 0, the places of the shard's windows.
_SHARD = "bucket bigint, shard bigint, wins binary, bwt binary, heads binary, sizes binary, n_words binary, lows binary, highs binary, rids binary, words binary, lens binary, ends binary"
_NAMES = [x.split()[0] for x in _SHARD.split(", ")]


def _row(**cols: object) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(_NAMES) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([cols[k].tobytes() if isinstance(cols.get(k), np.ndarray) else cols.get(k)], t) for k, t in zip(_NAMES, kinds, strict=True)], _NAMES)


def _shards(min_words: int, buckets: int):
    core = least_core(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            syms, offs = _lists(batch.column(1))
            p = Phrases(syms, _lists(batch.column(2))[0], offs, core)
            hits, hoffs = _lists(batch.column(3))
            kept = np.zeros(len(syms), bool)
            kept[hits + np.repeat(offs[:-1], np.diff(hoffs))] = True
            a, b = p.windows(kept, min_words)
            if not len(a):
                continue
            rid = batch.column(0).to_numpy().astype(np.int64)[p.row[a]]
            _, one, win = np.unique(p.hashed(a, b), return_index=True, return_inverse=True)
            order = np.argsort(win, kind="stable")
            cut = np.searchsorted(win[order], np.arange(len(one)))
            low, high = np.minimum.reduceat(rid[order], cut), np.maximum.reduceat(rid[order], cut)
            start = p.upto[offs[p.row[a]]]
            yield _row(
                bucket=-1 - shard,
                shard=shard,
                wins=win.astype(np.int32),
                rids=rid,
                words=(p.upto[a] - start).astype(np.int32),
                lens=p.lens[a].astype(np.int16),
                ends=(p.upto[p.stop[a]] - start).astype(np.int32),
            )
            a, b = a[one], b[one]
            bucket = (p.hashed(a, p.seed_end[a]) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                n = b[part] - a[part] + 1
                close = np.cumsum(n) - 1
                src = np.repeat(a[part] - (close - n + 1), n) + np.arange(int(n.sum()))
                src[close] = 0
                text = p.sym[src]
                text[close] = 0
                of = np.repeat(np.arange(len(part)), n)
                suf = suffix_order(text, of)
                # the symbol before a suffix, in its own window; 0 before the first
                before = np.append(U64(0), text[:-1])
                before[close - n + 1] = 0
                head = np.zeros(len(text), bool)
                head[close - n + 1] = True
                n_words = p.lens[src]
                n_words[close] = 0
                yield _row(
                    bucket=int(bucket[part[0]]),
                    shard=shard,
                    wins=part.astype(np.int32),
                    bwt=before[suf],
                    heads=np.where(head[suf], of[suf], -1).astype(np.int32),
                    sizes=n.astype(np.int32),
                    n_words=n_words.astype(np.int16),
                    lows=low[part],
                    highs=high[part],
                )
            shard += 1

    return run


# ---------------------------------------------------------------- merge
def merge(bwts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all shards, shard after shard, in merged order; common prefix with the row before, the largest number for equal suffixes).

    A transform leads from the row of a suffix to the row of the one a symbol
    shorter. A round places the suffixes of a block in the order and blocks that
    the shorter ones had in the round before. A block can only change where one
    of those has just changed, so a round touches those blocks alone; the rows of
    a shard keep their own order throughout.
    """
    base = np.cumsum([0] + [len(x) for x in bwts])
    n = int(base[-1])
    deal = [np.argsort(x, kind="stable") for x in bwts]
    # the k-th suffix of a shard begins with the k-th least symbol of its transform, and goes on as the row that holds it
    first = np.concatenate([x[d] for x, d in zip(bwts, deal, strict=True)])
    place_type = np.int32 if n < 1 << 31 else np.int64  # half the memory for all but giant buckets
    after = np.concatenate([(d + b).astype(place_type) for d, b in zip(deal, base[:-1], strict=True)])
    del deal
    goes_on = np.flatnonzero(first != 0).astype(place_type)
    before = np.full(n, -1, place_type)
    before[after[goes_on]] = goes_on
    del goes_on
    order = np.argsort(first, kind="stable").astype(place_type)
    starts = np.flatnonzero(np.append(True, first[order][1:] != first[order][:-1]))[: n]
    lcp = np.full(n, -1, np.int32)
    lcp[starts] = 0
    # a block is named by its first place
    block, size = np.empty(n, place_type), np.zeros(n, place_type)
    size[starts] = np.diff(np.append(starts, n))
    block[order] = np.repeat(starts, size[starts])
    del first, starts
    changed, depth = np.arange(n, dtype=place_type), 0
    while len(changed):
        depth += 1
        hit = before[changed]
        hit = block[hit[hit >= 0]]
        hit = np.unique(hit[size[hit] > 1])
        if not len(hit):
            break
        reps = size[hit]
        place = (np.repeat(hit - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))).astype(place_type)
        rows = order[place]
        # blocks lie in a row, so their names sort them; within one the shorter suffixes' blocks do
        old, rest = block[rows], block[after[rows]]
        by = np.argsort(np.repeat(np.arange(len(hit)), reps) * n + rest, kind="stable")
        rows, rest = rows[by], rest[by]
        order[place] = rows
        split = np.append(False, (old[1:] == old[:-1]) & (rest[1:] != rest[:-1]))
        lcp[place[split]] = depth
        head = np.flatnonzero(split | np.append(True, old[1:] != old[:-1]))
        name = np.repeat(place[head], np.diff(np.append(head, len(place))))
        size[place[head]] = np.diff(np.append(head, len(place)))
        changed = rows[name != old]
        block[rows] = name
    lcp[lcp < 0] = np.iinfo(np.int32).max
    return order, lcp

#: What the windows of a shard share: words, and where that is all of a window the least and the largest rid; or the places as they came.
_ANSWER = "shard bigint, wins binary, shared binary, lows binary, highs binary, rids binary, words binary, lens binary, ends binary"


def _merge_bucket(min_words: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            return t.select(["shard", "wins", "rids", "words", "lens", "ends"]).append_column("shared", pa.nulls(len(t), pa.binary())).append_column("lows", pa.nulls(len(t), pa.binary())).append_column("highs", pa.nulls(len(t), pa.binary())).select([x.split()[0] for x in _ANSWER.split(", ")])

        def raw(name: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]

        order, lcp = merge(raw("bwt", U64))
        heads, low = raw("heads", np.int32), raw("lows", np.int64)
        base = np.cumsum([0] + [len(x) for x in low])
        head = np.concatenate([np.where(h >= 0, h + b, -1) for h, b in zip(heads, base, strict=False)])[order]
        at = np.flatnonzero(head >= 0)
        win = head[at]
        # common prefix of successive whole windows: the least between them
        begin = np.append(0, at + 1)
        near = np.minimum.reduceat(lcp, begin[begin < len(lcp)])[: len(at)]
        low, high, size = (np.concatenate(x) for x in (low, raw("highs", np.int64), raw("sizes", np.int32)))
        total = np.append(0, np.cumsum(np.concatenate(raw("n_words", np.int16)).astype(np.int64)))
        first = np.cumsum(size, dtype=np.int64) - size
        low, high, length, first = low[win], high[win], size[win] - 1, first[win]
        n = len(win)
        # all windows of words that begin in the first phrase
        whole = total[first + length] - total[first] >= min_words - 1 + total[first + 1] - total[first]
        shared, least, most = np.zeros(n, np.int32), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for depth in range(int(length.max(initial=0)), 0, -1):
            # windows that share ``depth`` phrases
            cut = np.flatnonzero((near < depth) | (np.arange(n) == 0))
            a, b = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            reps = np.diff(np.append(cut, n))
            i = np.flatnonzero(np.repeat(a != b, reps) & (length >= depth) & (shared == 0))
            shared[i] = total[first[i] + depth] - total[first[i]]
            i = i[whole[i] & (length[i] == depth)]
            group = np.searchsorted(cut, i, side="right") - 1
            least[i], most[i] = a[group], b[group]
            if shared.all():
                break
        back = np.empty(n, np.int64)
        back[win] = np.arange(n)
        parts = [[x[back[lo:hi]].tobytes() for lo, hi in zip(base[:-1], base[1:], strict=True)] for x in (shared, least, most)]
        none = pa.nulls(len(t), pa.binary())
        return pa.table([t.column("shard"), t.column("wins"), *[pa.array(x, pa.binary()) for x in parts], none, none, none, none], [x.split()[0] for x in _ANSWER.split(", ")])

    return run


_DOC = "rid bigint, starts array<int>, sizes array<int>, peers array<bigint>, asked array<int>, until array<int>"


def _runs(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the stretch of each of the spans [a, b) sorted by row and start; spans that touch are one stretch."""
    if not len(row):
        return row
    # ends grow with the row, so one running maximum serves all
    wide = np.int64(1) << 32
    far = np.maximum.accumulate(row * wide + b)
    return np.cumsum(np.append(True, (row[1:] != row[:-1]) | (row[1:] * wide + a[1:] > far[:-1]))) - 1


def _by_document(min_words: int):
    """Of a shard's places and answers: for each document the certain stretches and the windows of words to ask for."""

    def run(t: pa.Table) -> pa.Table:
        of = {k: t.column(k) for k in t.column_names}
        at = next(i for i in range(len(t)) if of["rids"][i].is_valid)
        raw = lambda k, i, kind: np.frombuffer(of[k][i].as_buffer(), kind)
        win, rid, word, size, total = (raw(k, at, d).astype(np.int64) for k, d in (("wins", np.int32), ("rids", np.int64), ("words", np.int32), ("lens", np.int16), ("ends", np.int32)))
        shared, low, high = np.zeros(int(win.max()) + 1, np.int64), np.full(int(win.max()) + 1, -1, np.int64), np.full(int(win.max()) + 1, -1, np.int64)
        for i in range(len(t)):
            if i != at:
                w = raw("wins", i, np.int32)
                shared[w], low[w], high[w] = raw("shared", i, np.int32), raw("lows", i, np.int64), raw("highs", i, np.int64)
        shared, low, high = shared[win], low[win], high[win]
        new = np.append(True, rid[1:] != rid[:-1])
        first = np.flatnonzero(new)
        row = np.cumsum(new) - 1
        sure = np.flatnonzero(low >= 0)
        part = _runs(row[sure], word[sure], word[sure] + shared[sure])
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(sure) else sure
        begin, stop = word[sure][cut], np.maximum.reduceat((word + shared)[sure], cut) if len(cut) else cut
        peer = np.where(rid == low, high, low)[sure][cut]
        s_at = np.searchsorted(row[sure][cut], np.arange(len(first) + 1))
        # windows of words from where a shared phrase follows soon enough, to where it still reaches far enough
        a = np.maximum(word - ANCHOR + 1, 0)
        b = np.minimum(np.minimum(word, word + shared - (min_words - ANCHOR - GRAM + 1)), total - min_words) + 1
        b = np.maximum(a, b)
        # the first document of a group stands for the others
        skip = (low >= 0) & (low != rid)
        asked, until, q_at = [], [], [0]
        docs = np.append(first, len(row))
        base = np.append(0, np.cumsum(total[first]))
        for lo, hi in chunks(base, MARKED):
            i = slice(docs[lo], docs[hi])
            shift = base[row[i]] - base[lo]
            mark, veto = np.zeros((2, int(base[hi] - base[lo]) + 1), np.int32)
            np.add.at(mark, a[i] + shift, 1)
            np.add.at(mark, b[i] + shift, -1)
            k = np.flatnonzero(skip[i])
            np.add.at(veto, (word[i] + shift)[k], 1)
            np.add.at(veto, np.minimum((word + size)[i], total[i])[k] + shift[k], -1)
            on = (np.cumsum(mark) > 0) & (np.cumsum(veto) <= 0)
            on[-1] = False
            # no stretch goes on into the next document: the last words of one begin no window
            edge = np.flatnonzero(np.diff(on, prepend=False))
            x, y = edge[::2], edge[1::2]
            doc = lo + np.searchsorted(base[lo + 1 : hi + 1] - base[lo], x, side="right")
            asked.append(x + base[lo] - base[doc])
            until.append(y + base[lo] - base[doc])
            q_at += (q_at[-1] + np.searchsorted(doc, np.arange(lo + 1, hi + 1))).tolist()
        lists = [pa.ListArray.from_arrays(pa.array(s_at.astype(np.int32)), pa.array(x.astype(k))) for x, k in ((begin, np.int32), (stop - begin, np.int32), (peer, np.int64))]
        lists += [pa.ListArray.from_arrays(pa.array(np.array(q_at, np.int32)), pa.array(np.concatenate(x).astype(np.int32))) for x in (asked, until)]
        return pa.table([pa.array(rid[first]), *lists], [x.split()[0] for x in _DOC.split(", ")])

    return run


# ---------------------------------------------------------------- words
def _word_windows(min_words: int):
    """Hashes of the windows of words that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = raw_text(batch.column(1))
            asked, qoffs = _lists(batch.column(2))
            until = _lists(batch.column(3))[0]
            for lo, hi in chunks(offs):
                _, _, row, h = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                g = rolling(h, min_words)
                first = np.searchsorted(row, np.arange(hi - lo))
                base = np.repeat(first, np.diff(qoffs[lo : hi + 1]))
                a, b = asked[qoffs[lo] : qoffs[hi]] + base, until[qoffs[lo] : qoffs[hi]] + base
                at = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange(int((b - a).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at].view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(row[at])), pa.array((at - first[row[at]]).astype(np.int32))], ["key", "rid", "place"]
                )

    return run


_KEYED, _PEERED = "key bigint, rid bigint, place int", "rid bigint, place int, peer bigint"


def _met(keyed: DataFrame) -> DataFrame:
    """(rid, place, peer) of the rows of (key, rid, place) whose key several rids have."""
    return keyed.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(_shared, _PEERED)


def intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rid, start, n, peer): stretches of words of row ``rid`` that repeat in row ``peer``, which may overlap; and (rid, doc_id)."""
    text = F.lower(F.col("text").cast("string")).alias("text")
    lean = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("mark"), text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    phrases = materialise(lean.mapInArrow(_parse_batches(min_words), f"rid bigint, doc_id {kind}, mark bigint, syms array<bigint>, lens array<smallint>"))
    seeds = phrases.select("rid", "syms", "lens").mapInArrow(_seeds(min_words), _KEYED)
    hits = materialise(_met(seeds).groupBy("rid").agg(F.collect_list("place").alias("hits")))
    # a bucket is merged in one piece, so their number follows the suffixes
    buckets = 1 + (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) // BUCKET_ROWS
    # sorted, so that a shard made again is the same
    runs = phrases.select("rid", "syms", "lens").join(hits, "rid").sortWithinPartitions("rid")
    merged = runs.mapInArrow(_shards(min_words, buckets), _SHARD).groupBy("bucket").applyInArrow(_merge_bucket(min_words), _ANSWER)
    found = materialise(merged.groupBy("shard").applyInArrow(_by_document(min_words), _DOC))
    release(hits)
    asked = found.where(F.size("asked") > 0).select("rid", "asked", "until").join(phrases.select("rid", F.col("mark").alias("was")), "rid")
    same = F.when(F.col("mark").eqNullSafe(F.col("was")), F.col("text")).otherwise(F.raise_error(F.lit("the documents changed between two scans; write them to a table first")))
    grams = lean.join(asked, "rid").select("rid", same.alias("text"), "asked", "until").mapInArrow(_word_windows(min_words), _KEYED)
    short = _met(grams).select("rid", F.col("place").alias("start"), F.lit(min_words).alias("n"), "peer")
    sure = found.select("rid", F.explode(F.arrays_zip("starts", "sizes", "peers")).alias("s")).select("rid", F.col("s.starts").alias("start"), F.col("s.sizes").alias("n"), F.col("s.peers").alias("peer"))
    return sure.unionByName(short), phrases.select("rid", "doc_id")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, peer_doc_id): the maximal stretches of words of each document that repeat elsewhere, with one document that shares a part."""
    part, ids = intervals(docs, min_words)
    by = W.partitionBy("rid").orderBy("start", "n")
    end = F.col("start") + F.col("n")
    part = part.withColumn("far", F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)))
    part = part.withColumn("island", F.sum(F.when(F.col("far").isNull() | (F.col("start") > F.col("far")), 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = materialise(part.groupBy("rid", "island").agg(F.min("start").alias("start_word"), (F.max(end) - F.min("start")).cast("int").alias("n_words"), F.min("peer").alias("peer")))
    out = whole.join(ids, "rid").drop("rid")
    return out.join(ids.select(F.col("rid").alias("peer"), F.col("doc_id").alias("peer_doc_id")), "peer").select("doc_id", "start_word", "n_words", "peer_doc_id")
