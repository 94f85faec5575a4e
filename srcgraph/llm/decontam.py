"""Operator 10: benchmark decontamination by template canonicalisation.

Words that a re-parameterised question changes are replaced by typed
placeholders, on both sides alike: tokens with a digit by NUM, units after a
number by UNIT, capitalised words inside a sentence by NAME. A capitalised word
that opens a sentence may be a name or not, so its windows are hashed both with
the word and with a wildcard; where the words differ, they are slots. What is left
is the template. Hashes of its windows are joined with those of the benchmark; an item
counts as found where at least ``min_cover`` of its windows occur in a document
and the slots agree: whatever fills a placeholder of the item maps to one value
of the document each time, and different values stay different. A document may
hold an item several times with different values, so matches are judged together
and, where they don't agree, by alignment (equal shift, or a stretch of increasing
positions); one alignment that reaches both is enough, the fullest is reported.

The benchmark's windows are looked up in a hash table broadcast to the tasks
while there are at most ``BROADCAST_WINDOWS`` of them; beyond that the
documents' windows are joined with the benchmark's in a shuffle and only matched
positions are regrouped. Both ways choose an item's windows by the same rule
(``chosen``) and return the same rows.

Defined cases
-------------
* Null, empty and symbol-only texts have no window and match nothing.
* Items shorter than a window are matched whole, from ``min_item`` tokens on;
  shorter ones aren't searched.
* Windows with fewer than half literal tokens say nothing and are left out of both sides.
  An item without any other window is searched by its exact words, all of its windows.
* Ids may be of any type. Repeated items give a row each, repeated documents too. Null ids are carried
  as nulls. An empty table on either side gives an empty result.
* Long texts are searched whole. Extra columns are carried through by ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import U64, chunks, fresh, materialise, mix, raw_text, rolling, words

WINDOW = 8
MIN_COVER = 0.5
MIN_ITEM = 5
MIN_AGREE = 0.75
BROADCAST_WINDOWS = 1 << 20

NUM, UNIT, NAME = U64(1), U64(2), U64(3)
#: A capitalised word that opens a sentence, in ``mark``.
OPENING = U64(4)
#: Forms of windows: placeholders for what changes, or the words as they are, or placeholders for words that open sentences too.
TEMPLATE, EXACT, OPEN = 0, 1, 2
UNITS = """mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards mg g kg lb lbs oz ton tons gram grams kilogram
kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks
month months year years dollar dollars euro euros cent cents percent usd eur degree degrees mph kmh heures heure jours jour ans an stunden stunde tage tag
jahre jahr horas hora días día años año kilometer kilometers gramm meilen""".split()


def _hashes(texts: list[str]) -> np.ndarray:
    buf, offs = raw_text(pa.array(texts))
    return words(buf, offs)[3]


class Tokens:
    """Template tokens of a run of texts: ``row``, ``kind`` (0 literal), ``mark`` (as kind, but OPENING for literals that open a sentence in capitals), ``shape`` (hash, the same for all of a kind) and ``value``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        s, e, row, h = words(buf, offs)
        self.row, self.value, n = row, h, len(h)
        self.kind = np.zeros(n, np.int8)
        opening = np.zeros(n, bool)
        if n:
            def inside(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                total = np.append(0, np.cumsum(mask, dtype=np.int32))
                return total[hi] > total[lo]

            digit = inside((buf >= 48) & (buf <= 57), s, e)
            ends = (buf == 46) | (buf == 33) | (buf == 63) | (buf == 58) | (buf == 10)
            new = np.append(True, row[1:] != row[:-1])
            # "3.50" is one number to a reader: a mark right between digits ends no sentence
            gap = np.append(s[0], e[:-1])
            opens = new | (inside(ends, gap, s) & (s - gap > 1)) | inside(buf == 10, gap, s)
            first, second = buf[s], buf[np.minimum(s + 1, len(buf) - 1)]
            capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            after = np.append(False, digit[:-1]) & ~new
            self.kind[capital & ~opens] = NAME
            self.kind[after & np.isin(h, _UNIT_HASHES)] = UNIT
            self.kind[digit] = NUM
            opening = capital & opens & (self.kind == 0)
        self.mark = np.where(opening, OPENING.astype(np.int8), self.kind)
        self.shape = np.where(self.kind > 0, self.kind.astype(U64), h)

    def windows(self, size: int, form: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows of ``size`` tokens; of templates those that have enough literals, of the form OPEN those that hold such a word."""
        shape = self.value if form == EXACT else self.shape
        if form == OPEN:
            shape = np.where(self.mark == OPENING, OPENING, shape)
        h = rolling(shape, size)
        m = len(h)
        if not m:
            return np.zeros(0, np.int64), h
        good = self.row[:m] == self.row[size - 1 :]
        if form != EXACT:
            literal = np.append(0, np.cumsum((self.mark if form == OPEN else self.kind) == 0))
            good &= 2 * (literal[size:] - literal[:m]) >= size
        if form == OPEN:
            opening = np.append(0, np.cumsum(self.mark == OPENING))
            good &= opening[size:] > opening[:m]
        at = np.flatnonzero(good)
        return at, mix(h[at] + U64(size + 256 * form))


def chosen(tok: Tokens, items: int, window: int, min_item: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(size, form, first tokens, hashes) of the windows that items are searched by: of ``window`` tokens, or the whole of a shorter item."""
    length = np.bincount(tok.row, minlength=items)
    size = np.where(length >= window, window, np.where(length >= min_item, length, 0))
    out, done = [], np.zeros(items, bool)
    for n in sorted({int(x) for x in size if x}):
        for form in (TEMPLATE, OPEN, EXACT):
            at, h = tok.windows(n, form)
            of = tok.row[at]
            # windows with a wildcard stand beside the same ones with the word
            mine = (size[of] == n) & (~done[of] if form != OPEN else True)
            if mine.any():
                out.append((n, form, at[mine], h[mine]))
                done[of[mine]] = True
    return out


_UNIT_HASHES = _hashes(UNITS)


class Benchmark:
    """Templates of the benchmark, sorted by window hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, min_item: int = MIN_ITEM):
        self.ids = [i for i, _ in items]
        buf, offs = raw_text(pa.array([t for _, t in items], pa.string()))
        tok = Tokens(buf, offs)
        self.start = np.searchsorted(tok.row, np.arange(len(items) + 1))
        self.size = np.zeros(len(items), np.int64)
        hashes, item, pos = [], [], []
        self.forms = []
        for n, form, at, h in chosen(tok, len(items), window, min_item):
            of = tok.row[at]
            self.size[of] = n
            self.forms.append((n, form))
            hashes.append(h)
            item.append(of)
            pos.append(at - self.start[of])
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate([np.zeros(0, U64), *hashes])
        self.item, self.pos = np.concatenate([none, *item]), np.concatenate([none, *pos])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos = self.hash[order], self.item[order], self.pos[order]
        self.total = np.bincount(np.unique(np.stack([self.item, self.pos]), axis=1)[0], minlength=len(items))
        self.mark, self.value = tok.mark, tok.value
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.hash & U64((1 << 18) - 1)).astype(np.int64)] = True

    def matches(self, tok: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(token, entry of the sorted windows) of every occurrence."""
        at_all, to_all = [], []
        for n, form in self.forms:
            at, h = tok.windows(n, form)
            maybe = self.sieve[(h & U64((1 << 18) - 1)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.hash, h, side="left"), np.searchsorted(self.hash, h, side="right")
            reps = hi - lo
            at_all.append(np.repeat(at, reps))
            to_all.append(np.repeat(lo, reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *at_all]), np.concatenate([none, *to_all])


def alignments(pos: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Groups of matches that may be one occurrence: those of one shift, and stretches in which the places in item and document go on together."""
    for key, order in ((at - pos, np.lexsort((at, at - pos))), (None, np.lexsort((pos, at)))):
        if key is None:
            p, a = np.diff(pos[order]), np.diff(at[order])
            new = (p <= 0) | (a > p + 2 * size)
        else:
            new = np.diff(key[order]) != 0
        cut = np.flatnonzero(np.append(True, new))
        yield from np.split(order, cut[1:])


def _agreement(pos: np.ndarray, at: np.ndarray, slot: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> float:
    """Share of the slots (matches x window) of a group of matches that agree with the commonest partner of their value."""
    if not slot.any():
        return 1.0
    step = np.arange(slot.shape[1])
    _, one = np.unique(np.stack([(pos[:, None] + step)[slot], (at[:, None] + step)[slot]]), axis=1, return_index=True)
    a, b = mine[slot][one], theirs[slot][one]

    def best(x: np.ndarray, y: np.ndarray) -> int:
        xy, n = np.unique(np.stack([x, y]), axis=1, return_counts=True)
        order = np.lexsort((-n, xy[0]))
        lead = np.append(True, xy[0][order][1:] != xy[0][order][:-1])
        return int(n[order][lead].sum())

    return min(best(a, b), best(b, a)) / len(a)


def judge(total: int, pos: np.ndarray, at: np.ndarray, mark: np.ndarray, mine: np.ndarray, theirs: np.ndarray, min_cover: float, min_agree: float) -> tuple[int, float] | None:
    """(windows found, agreement of slots) if the item is in the document.

    ``pos`` and ``at`` are the places of the matches in item and document; ``mark`` (the item's), ``mine`` and ``theirs`` (matches x window) their marks and values.
    """
    need = min_cover * total
    found = len(np.unique(pos))
    if found < need:
        return None
    # a window may match in two forms
    _, one = np.unique(np.stack([pos, at]), axis=1, return_index=True)
    pos, at, mark, mine, theirs = (x[one] for x in (pos, at, mark, mine, theirs))
    slot = np.where(mark == OPENING, mine != theirs, mark > 0)
    agree = _agreement(pos, at, slot, mine, theirs)
    if agree >= min_agree:
        return found, agree
    best = None
    for g in alignments(pos, at, slot.shape[1]):
        if len(g) >= need and (n := len(np.unique(pos[g]))) >= need:
            agree = _agreement(pos[g], at[g], slot[g], mine[g], theirs[g])
            if agree >= min_agree:
                best = max(best or (0, 0.0), (n, agree))
    return best


_OUT = "rid bigint, item bigint, windows int, cover double, agreement double"


def _scan(bench: Benchmark, min_cover: float, min_agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = raw_text(batch.column(1))
            rid = batch.column(0)
            rows = []
            for lo, hi in chunks(offs):
                tok = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at, to = bench.matches(tok)
                key = tok.row[at] * len(bench.ids) + bench.item[to]
                order = np.argsort(key, kind="stable")
                at, to, key = at[order], to[order], key[order]
                if not len(key):
                    continue
                cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True):
                    item = int(bench.item[to[a]])
                    pos, step = bench.pos[to[a:b]], np.arange(int(bench.size[item]))
                    mine, theirs = pos[:, None] + bench.start[item] + step, at[a:b, None] + step
                    got = judge(int(bench.total[item]), pos, at[a:b], bench.mark[mine], bench.value[mine], tok.value[theirs], min_cover, min_agree)
                    if got:
                        rows.append((rid[lo + int(tok.row[at[a]])].as_py(), bench.ids[item], got[0], round(got[0] / int(bench.total[item]), 6), round(got[1], 6)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["rid", "item", "windows", "cover", "agreement"])

    return run


def _window_rows(pick):
    """Windows of texts with the values of their tokens, for the shuffled join; ``pick`` gives them as ``chosen`` does, from tokens and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = raw_text(batch.column(1))
            for lo, hi in chunks(offs):
                tok = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                start = np.searchsorted(tok.row, np.arange(hi - lo))
                for n, form, at, h in pick(tok, hi - lo):
                    if not len(at):
                        continue
                    span = (at[:, None] + np.arange(n)).ravel()
                    ends = pa.array(np.arange(0, len(span) + 1, n), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, hi - lo).take(pa.array(tok.row[at])),
                            pa.array(np.full(len(at), form, np.int32)),
                            pa.array(h.view(np.int64)),
                            pa.array((at - start[tok.row[at]]).astype(np.int32)),
                            pa.ListArray.from_arrays(ends, pa.array(tok.mark[span].astype(np.int32))),
                            pa.ListArray.from_arrays(ends, pa.array(tok.value[span].view(np.int64))),
                        ],
                        ["key", "form", "hash", "pos", "marks", "values"],
                    )

    return run


def _joined(docs: DataFrame, bench_rows: DataFrame, window: int, min_item: int, min_cover: float, min_agree: float) -> DataFrame:
    """The shuffled way, for a benchmark too large to broadcast: windows of both sides meet on their hash."""
    schema = "key bigint, form int, hash bigint, pos int, marks array<int>, values array<bigint>"
    mine = materialise(bench_rows.mapInArrow(_window_rows(lambda tok, items: chosen(tok, items, window, min_item)), schema))
    # a few sizes and forms
    forms = [tuple(r) for r in mine.select(F.size("values"), "form").distinct().collect()]
    theirs = docs.mapInArrow(_window_rows(lambda tok, _: [(n, form, *tok.windows(n, form)) for n, form in forms]), schema).drop("form")
    mine = mine.select(F.col("key").alias("item"), "hash", F.col("pos").alias("ipos"), F.col("marks").alias("imarks"), F.col("values").alias("ivalues"))
    total = mine.groupBy("item").agg(F.countDistinct("ipos").alias("total"))
    met = theirs.join(mine, "hash").withColumnRenamed("key", "rid")
    seen = met.groupBy("rid", "item").agg(F.countDistinct("ipos").alias("windows")).join(total, "item").where(F.col("windows") >= min_cover * F.col("total")).drop("windows")

    def decide(group: pa.Table) -> pa.Table:
        pos, at = (group.column(c).to_numpy().astype(np.int64) for c in ("ipos", "pos"))
        marks, own, theirs = (group.column(c).combine_chunks().flatten().to_numpy().reshape(len(pos), -1) for c in ("imarks", "ivalues", "values"))
        all_ = group.column("total")[0].as_py()
        got = judge(all_, pos, at, marks, own, theirs, min_cover, min_agree)
        rows = [(group.column("rid")[0].as_py(), group.column("item")[0].as_py(), got[0], round(got[0] / all_, 6), round(got[1], 6))] if got else []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["rid", "item", "windows", "cover", "agreement"])

    return met.join(seen, ["rid", "item"]).groupBy("rid", "item").applyInArrow(decide, _OUT)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, min_cover: float, min_agree: float, min_item: int, limit: int) -> DataFrame:
    """(rid, item_id, windows, cover, agreement); rid is the place of the row in ``docs``."""
    lean = docs.select(F.monotonically_increasing_id().alias("rid"), docs["text"].cast("string").alias("text"))
    items = materialise(benchmark.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("item")))
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.regexp_count("text", F.lit("\\S+")), F.lit(0))), F.lit(0))).first()[0]
    if size <= limit:
        rows = [tuple(r) for r in items.select("item", "text").collect()]
        found = lean.mapInArrow(_scan(Benchmark(rows, window, min_item), min_cover, min_agree), _OUT)
        # ids come from the table: rows made of Python values start a second Python daemon in each executor
        return found.join(F.broadcast(items.select("item", "item_id")), "item").drop("item")
    found = _joined(lean, items.select("item", "text"), window, min_item, min_cover, min_agree)
    return found.join(items.select("item", "item_id"), "item").drop("item")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_cover: float = MIN_COVER, min_agree: float = MIN_AGREE, min_item: int = MIN_ITEM, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows, cover, agreement) of every benchmark item found in a document."""
    found = materialise(_found(docs, benchmark, window, min_cover, min_agree, min_item, limit))
    ids = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id")
    return ids.join(found, "rid").select("doc_id", "item_id", "windows", "cover", "agreement")


def keep_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_cover: float = MIN_COVER, min_agree: float = MIN_AGREE, min_item: int = MIN_ITEM, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns as they were. ``docs`` must be a stable table."""
    rid = fresh(docs, "_rid")
    found = materialise(_found(docs, benchmark, window, min_cover, min_agree, min_item, limit).select(F.col("rid").alias(rid)).distinct())
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(found, rid, "left_anti").drop(rid)
