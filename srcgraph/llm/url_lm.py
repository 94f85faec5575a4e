"""Operator 3: URL filter by a ratio of character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs,
give each URL a log-likelihood. Order ``n`` backs off to ``n - 1`` with the
Witten-Bell weight: contexts followed by many different characters lean on the
shorter one. The difference of the two, divided by the length, is the score;
the threshold is calibrated on held-out accepted URLs so that at most
``max_false`` of them are rejected.

Labels are weak: a URL whose host holds one of the ``seeds`` as a part counts as
rejected, any other as accepted. Every labelled URL counts: in the order of their
hashes each fifth accepted one is held out for the threshold, and all others are
in the models.

The models grow with the table, so they go neither through the driver nor into the
memory of the tasks. A shuffle adds up how often each gram (the characters that the
longest context and its successor take) occurs in either class; those that share
the last two characters of context meet in one task, which settles the difference of
the two models for each of them. Only the two lowest orders, at most 2^16 pairs of
characters, come from the whole. The grams, in order, and their differences are
written to a file in the shared folder, which scoring maps.

Defined cases
-------------
* A null or empty URL has a null score and is not rejected.
* Without a URL of either class nothing is rejected and scores are null.
* Repeated rows are scored alike, each on its own; null ids are carried.
* Long URLs are scored whole. An empty table gives an empty result. Extra columns are ignored.
* A URL that no scan met before (the table changed meanwhile) raises an error.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.llm.common import U64, chunks, materialise, raw_text, release
from srcgraph.runtime import shared_dir

ORDER = 5
MAX_FALSE = 0.002
#: One of so many accepted URLs is held out.
HELD_OUT = 5
#: Orders whose counts come from the whole; grams of higher ones lie with the rest of their last two characters of context.
LOW_ORDERS = 2
#: URLs are ranked in buckets of about so many.
BUCKET = 1 << 14
#: Grams that a task holds before it sends or settles them.
HELD = 1 << 18
SEEDS = ("spam", "casino", "bets", "pills", "viagra", "porn", "xxx", "poker", "payday", "warez", "torrent", "malware", "phish", "adult", "lottery", "ads", "adserver", "tracker")


def _padded(col: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with ``order`` start marks before and an end mark behind each text, first byte of each)."""
    buf, offs = raw_text(col)
    n = len(offs) - 1
    out = np.full(len(buf) + n * (order + 1), 2, np.uint8)
    start = offs[:-1] + np.arange(n) * (order + 1)
    at = np.arange(len(buf)) + np.repeat(np.arange(1, n + 1) * (order + 1) - 1, np.diff(offs))
    out[at] = buf
    out[offs[1:] + np.arange(1, n + 1) * (order + 1) - 1] = 3
    return out, start


def _grams(data: np.ndarray, start: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, packed last ``order + 1`` bytes) of every predicted byte; the packing of a shorter context is its low bytes."""
    head = np.zeros(len(data), bool)
    head[(start[:, None] + np.arange(order)).ravel()] = True
    key = np.zeros(len(data), U64)
    for k in range(order + 1):
        key[k:] |= data[: len(data) - k].astype(U64) << U64(8 * k)
    at = np.flatnonzero(~head)
    return at, key[at]


class Markov:
    """Counts of all contexts up to ``order``, smoothed by Witten and Bell's method."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order = order
        _, keys = _grams(*_padded(pa.array(urls, pa.string()), order), order)
        self.tables = self._tables(*np.unique(keys, return_counts=True), range(order + 1))

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, order: int, low: Markov | None = None) -> Markov:
        """From distinct grams and their numbers; ``low`` has the lowest orders instead."""
        out = cls.__new__(cls)
        out.order = order
        met = counts > 0
        out.tables = [*(low.tables if low else []), *cls._tables(keys[met], counts[met], range(low.order + 1 if low else 0, order + 1))]
        return out

    @staticmethod
    def _tables(keys: np.ndarray, counts: np.ndarray, orders: Sequence[int]) -> list[tuple[np.ndarray, ...]]:
        out = []
        for n in orders:
            gram, at = np.unique(keys & U64((1 << 8 * (n + 1)) - 1), return_inverse=True)
            # sums of whole numbers, exact in doubles
            count = np.bincount(at, weights=counts, minlength=len(gram))
            # grams are ordered by context first, since the predicted byte is the low one
            context, first, kinds = np.unique(gram >> U64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            out.append((gram, count, context, total, kinds.astype(float)))
        return out

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for n, (gram, count, context, total, kinds) in enumerate(self.tables):
            if not len(gram):
                # contexts of higher orders are those of lower ones and more
                break
            x = keys & U64((1 << 8 * (n + 1)) - 1)
            g, has = self._find(gram, x)
            c, known = self._find(context, x >> U64(8))
            seen = np.where(has, count[g], 0.0)
            p = np.where(known, (seen + kinds[c] * p) / (total[c] + kinds[c]), p)
        return np.log(p)


def _means(col: pa.Array, order: int, diff: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of ``diff`` over the characters of each URL, the end mark included; characters are added up in their order."""
    data, start = _padded(col, order)
    at, keys = _grams(data, start, order)
    row = np.searchsorted(start, at, side="right") - 1
    n = len(start)
    return np.bincount(row, weights=diff(keys), minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def score(col: pa.Array, accepted: Markov, rejected: Markov) -> np.ndarray:
    """Mean log-likelihood difference a character, the end mark included; positive leans to rejection."""
    return _means(col, accepted.order, lambda keys: rejected.log_prob(keys) - accepted.log_prob(keys))


def seeded(url: F.Column, seeds: Sequence[str]) -> F.Column:
    host = F.lower(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1))
    return F.coalesce(F.regexp_instr(host, F.lit("(?:^|[.-])(?:" + "|".join(seeds) + ")(?=[.-]|$)")) > 0, F.lit(False))


def labelled(pages: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """(url, good, bad, held) of each distinct URL: how often it is in either model and how often it is held out."""
    url = pages["url"].cast("string")
    each = pages.select(url.alias("url")).where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    each = materialise(each.select("url", "n", F.xxhash64("url").alias("h"), seeded(F.col("url"), seeds).alias("bad")))
    # the rank of an accepted URL by hash: those of the buckets before and those before it in its own
    bits = max(0, math.ceil(math.log2(max(1, each.count() / BUCKET))))
    bucket = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    good = each.where(~F.col("bad")).withColumn("bucket", bucket)
    sizes = sorted((r.bucket, r.n) for r in good.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist()
    offsets = pages.sparkSession.createDataFrame([(b, lo) for (b, _), lo in zip(sizes, before, strict=True)], "bucket bigint, lo bigint")
    end = F.col("lo") + F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "url").rowsBetween(Window.unboundedPreceding, 0))
    ranked = good.join(F.broadcast(offsets), "bucket").withColumn("end", end)
    # of ranks from 0 on those that HELD_OUT divides
    upto = lambda x: F.floor((x + (HELD_OUT - 1)) / F.lit(HELD_OUT))
    ranked = ranked.withColumn("held", upto(F.col("end")) - upto(F.col("end") - F.col("n")))
    none = F.lit(0).cast("bigint")
    out = materialise(ranked.select("url", (F.col("n") - F.col("held")).alias("good"), none.alias("bad"), "held").unionByName(each.where("bad").select("url", none.alias("good"), F.col("n").alias("bad"), none.alias("held"))))
    release(each)
    return out


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _count_batches(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct grams of (url, good, bad) with their numbers in either class."""
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            keys, *n = map(np.concatenate, zip(*held, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, *(np.bincount(at, weights=x, minlength=len(keys)).astype(np.int64) for x in n)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, good, bad = merged()
                held.clear()
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(good), pa.array(bad)], ["gram", "good", "bad"])

        for batch in batches:
            good, bad = (batch.column(i).to_numpy() for i in (1, 2))
            for lo, hi in chunks(raw_text(batch.column(0))[1]):
                data, start = _padded(batch.column(0)[lo:hi], order)
                at, keys = _grams(data, start, order)
                row = np.searchsorted(start, at, side="right") - 1 + lo
                held.append((keys, good[row], bad[row]))
                if sum(len(x[0]) for x in held) > 4 * HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > 2 * HELD:
                        yield from flush()
        yield from flush()

    return run


def _packed(keys: np.ndarray) -> np.ndarray:
    """Grams with the last two characters of context first: the order of the file."""
    return (keys >> U64(8) & U64(0xFFFF)) << U64(48) | keys >> U64(24) << U64(8) | keys & U64(0xFF)


def _write_batches(path: str, places: dict[int, int], total: int, order: int, low: tuple[Markov, Markov]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``pair``; a pair is settled whole, and one that is written twice is written alike."""
        file = os.open(path, os.O_WRONLY)

        def put(data: np.ndarray, at: int) -> None:
            view = memoryview(data.view(np.uint8))
            while view:
                done = os.pwrite(file, view, at)
                view, at = view[done:], at + done

        def settle(parts: list[tuple[np.ndarray, ...]]) -> None:
            pair, keys, good, bad = map(np.concatenate, zip(*parts, strict=True))
            keys = keys.view(U64)
            diff = Markov.of(keys, bad, order, low[1]).log_prob(keys) - Markov.of(keys, good, order, low[0]).log_prob(keys)
            packed = _packed(keys)
            by = np.argsort(packed)
            pair, packed, diff = pair[by], packed[by], diff[by]
            for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1):
                at = places[int(pair[part[0]])]
                put(packed[part], 8 * at)
                put(diff[part], 8 * (total + at))

        held: list[tuple[np.ndarray, ...]] = []
        done = 0
        try:
            for batch in batches:
                cols = tuple(x.to_numpy() for x in batch.columns)
                if not batch.num_rows:
                    continue
                done += batch.num_rows
                # the last pair may go on
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                whole = [*held, tuple(x[:cut] for x in cols)] if cut else held if held and held[-1][0][-1] != cols[0][-1] else []
                if sum(len(x[0]) for x in whole) > HELD:
                    settle(whole)
                    held = [tuple(x[cut:] for x in cols)]
                else:
                    held.append(cols)
            if held:
                settle(held)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["grams"])

    return run


class Ratio:
    """The difference of the two models for every gram of the table, mapped from its file."""

    def __init__(self, path: str, total: int, order: int):
        self.order = order
        self.grams, self.diff = np.memmap(path, U64, "r", shape=total), np.memmap(path, np.float64, "r", 8 * total, total)

    def _diff(self, keys: np.ndarray) -> np.ndarray:
        keys, at = np.unique(_packed(keys), return_inverse=True)
        found = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        if (self.grams[found] != keys).any():
            raise RuntimeError("op3_url_ratio: a URL has changed between two scans of the table")
        return self.diff[found][at]

    def score(self, col: pa.Array) -> np.ndarray:
        """As ``score``; null and empty URLs have 0."""
        out = np.zeros(len(col))
        _, offs = raw_text(col)
        some = np.flatnonzero(np.diff(offs))
        text = col.take(pa.array(some))
        for lo, hi in chunks(raw_text(text)[1]):
            out[some[lo:hi]] = _means(text[lo:hi], self.order, self._diff)
        return out


def _at_rank(values: DataFrame, rank: int) -> float:
    """The value at ``rank`` (from 0, upwards) of (place, n), each ``n`` times; places are doubles as ``_place`` has them."""
    prefix = None
    for shift in (48, 32, 16, 0):
        # 16 bits more of the value each time: all values of the prefix so far, by the next bits
        part = values if prefix is None else values.where(F.shiftright("place", shift + 16) == prefix)
        for p, n in sorted((r.p, r.n) for r in part.groupBy(F.shiftright("place", shift).alias("p")).agg(F.sum("n").alias("n")).collect()):
            if rank < n:
                prefix = p
                break
            rank -= n
    return float(_place(np.array([prefix], np.int64).view(np.float64)).view(np.float64)[0])


def _place(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of these doubles; the same leads back."""
    x = s.view(np.int64)
    return x ^ (x >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


def fit(pages: DataFrame, seeds: Sequence[str] = SEEDS, order: int = ORDER, max_false: float = MAX_FALSE) -> tuple[tuple[str, int, int], float] | None:
    """What ``Ratio`` takes and the calibrated threshold, from all URLs."""
    spark = pages.sparkSession
    url = urlsplit(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise RuntimeError("op3_url_ratio maps its models: spark.checkpoint.dir must be a mounted folder")
    known = labelled(pages, seeds)
    n = known.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("good", "bad", "held"))).first()
    if not n.good or not n.bad:
        release(known)
        return None
    both = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    grams = known.select("url", "good", "bad").mapInArrow(_count_batches(order), "gram bigint, good bigint, bad bigint").groupBy("gram").agg(*both)
    grams = materialise(grams.select(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("pair"), "gram", "good", "bad"))
    top = grams.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(*both).collect()
    keys = np.array([r.gram for r in top], U64)
    low = tuple(Markov.of(keys, np.array([r[c] for r in top]), min(order, LOW_ORDERS - 1)) for c in ("good", "bad"))
    sizes = sorted((r.pair, r.n) for r in grams.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(k for _, k in sizes)
    places = dict(zip((p for p, _ in sizes), np.cumsum([0, *(k for _, k in sizes)]).tolist(), strict=False))
    folder = unquote(url.path)
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/srcgraph-{uuid.uuid4().hex}.grams"
    with open(path, "wb") as f:
        f.truncate(16 * total)
    grams.repartition("pair").sortWithinPartitions("pair").mapInArrow(_write_batches(path, places, total, order, low), "grams bigint").agg(F.sum("grams")).collect()
    release(grams)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Ratio(path, total, order)
        for batch in batches:
            # a zero has one sign only
            yield pa.RecordBatch.from_arrays([pa.array(_place(ratio.score(batch.column(0)) + 0.0)), batch.column(1)], ["place", "n"])

    values = materialise(known.where("held > 0").select("url", "held").mapInArrow(held, "place bigint, n bigint"))
    # an accepted URL at the quantile stays; ties with it stay too
    threshold = max(0.0, _at_rank(values, math.ceil((n.held - 1) * (1 - max_false))))
    release(known, values)
    return (path, total, order), threshold


def classify(pages: DataFrame, **options: object) -> DataFrame:
    """(page_id, url, score, rejected) of every page."""
    model = fit(pages, **options)
    lean = pages.select("page_id", pages["url"].cast("string").alias("url"))
    if model is None:
        return lean.select("page_id", "url", F.lit(None).cast("double").alias("score"), F.lit(False).alias("rejected"))
    at, threshold = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Ratio(*at)
        for batch in batches:
            col = batch.column(1)
            s = ratio.score(col)
            none = np.diff(raw_text(col)[1]) == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), col, pa.array(np.round(s, 6), mask=none), pa.array((s > threshold) & ~none)], ["page_id", "url", "score", "rejected"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return lean.mapInArrow(run, f"page_id {kind}, url string, score double, rejected boolean")
