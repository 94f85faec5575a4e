"""Operator 6: SimHash near-duplicates found with an LSH forest.

Each text gets a 128-bit SimHash of its word pairs; two documents are near
duplicates when their signatures differ in at most ``max_distance`` bits. Equal
signatures are merged first. The others enter several tries, each over its own
random permutation of the bits. A query starts deep in a trie and climbs to
shorter prefixes until its recall target is met: at the target depth ``d`` a
pair at the distance ``max_distance`` shares a prefix with the probability that
``d`` bits drawn without repetition miss all bits that differ, and the number of
tries makes up for the rest, so all pairs that count are searched for alike. Where the trie is sparse it climbs on,
for free, as long as the node it reaches stays small. Every pair below the node
reached is verified on all 128 bits; nothing is capped.

The depth grows with the logarithm of the number of signatures, so the number
of candidates a document stays level and the number of tries grows slowly.
Matches become groups by alternating large-star and small-star steps, written
to the shared folder after each.

Defined cases
-------------
* Texts without a word (null, empty, symbols only) have no signature: they are
  never duplicates and stay.
* A text of one word is signed by that word; the case of letters and
  punctuation don't count.
* Repeated rows and equal ids are separate rows of one group; of equal ids one
  row stays. Null ids can be members of a group and stay only if all are null.
* The document with the smallest id stays (ties: the first row).
* Long texts are signed whole. An empty table gives an empty result. Extra
  columns are carried through by ``keep_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import U64, chunks, fresh, materialise, mix, raw_text, words

BITS = 128
MAX_DISTANCE = 26
#: Recall aimed at for pairs at ``max_distance``; nearer pairs are found more surely.
RECALL = 0.95
#: Signatures below a node up to which a query goes on climbing.
SMALL_NODE = 384
#: Signatures expected below a node at the target depth.
NODE = 256
CLIMB = 4
KEY_BITS = 62
_SEED = 20240607


# ---------------------------------------------------------------- signatures
def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word pairs of each text; of the word where there is only one. At most 65,536 rows."""
    _, _, row, h = words(buf, offs)
    if not len(h):
        return row, h
    last = np.append(row[1:] != row[:-1], True)
    first = np.append(True, last[:-1])
    nxt = np.append(h[1:], U64(0))
    pair = mix(h * U64(0x9E3779B97F4A7C15) + nxt)
    use = ~last | first
    # each distinct pair counts once, so repetition can't drown the rest of a text
    key = np.unique((row[use].astype(U64) << U64(48)) | (np.where(last, h, pair)[use] >> U64(16)))
    return (key >> U64(48)).astype(np.int64), mix((key & U64((1 << 48) - 1)) + U64(1))


def sign(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a signature, their signatures as n x 2 uint64)."""
    row, h = features(buf, offs)
    if not len(h):
        return row, np.zeros((0, 2), U64)
    both = np.empty((len(h), 2), U64)
    both[:, 0] = h
    both[:, 1] = mix(h + U64(0xD6E8FEB86659FD93))
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(start, len(row)))
    ones = np.zeros((len(start), BITS), np.int64)
    step = 1 << 15  # keeps the unpacked bits in cache
    at = np.arange(0, len(h), step)
    for lo in at:
        hi = min(lo + step, len(h))
        bits = np.unpackbits(both[lo:hi].view(np.uint8), axis=1, bitorder="little")
        a = int(np.searchsorted(start, lo, side="right")) - 1
        b = int(np.searchsorted(start, hi, side="left"))
        inner = np.maximum(start[a:b], lo) - lo
        ones[a:b] += np.add.reduceat(bits, inner, axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little")
    return row[start], packed.view(U64)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = raw_text(batch.column(1))
        rid = batch.column(0)
        for lo, hi in chunks(offs, rows=1 << 15):
            row, sig = sign(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            s = sig.view(np.int64)
            yield pa.RecordBatch.from_arrays([rid.slice(lo, hi - lo).take(pa.array(row)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], ["rid", "s0", "s1"])


def signatures(docs: DataFrame, rid: str) -> DataFrame:
    """(rid, s0, s1) of the rows that have one."""
    return docs.select(F.col(rid).alias("rid"), F.lower(docs["text"].cast("string")).alias("text")).mapInArrow(_sign_batches, "rid bigint, s0 bigint, s1 bigint")


# ---------------------------------------------------------------- forest
def shape(n: int, recall: float, aim: int = MAX_DISTANCE) -> tuple[int, int]:
    """(target depth, tries): nodes of about NODE signatures, and tries enough for the recall target at distance ``aim``."""
    depth = max(1, min(KEY_BITS, round(math.log2(max(n, 2) / NODE))))
    # the bits of a prefix are drawn without repetition, as _keys does
    hit = math.prod(max(0, BITS - aim - i) / (BITS - i) for i in range(depth))
    if hit == 0:
        raise ValueError("no prefix of this depth is shared at that distance")
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1)


def _keys(sig: np.ndarray, trial: int) -> np.ndarray:
    """The first KEY_BITS bits of the signatures under a permutation, first bit highest."""
    order = np.random.default_rng([_SEED, trial]).permutation(BITS)[:KEY_BITS]
    bits = np.unpackbits(sig.view(np.uint8), axis=1, bitorder="little")
    key = np.zeros(len(sig), np.int64)
    for b in order:
        key = (key << 1) | bits[:, b]
    return key


def _plant(tries: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).view(U64)
            for k in range(tries):
                key = _keys(sig, k)
                place = (np.int64(k) << top) | (key >> (KEY_BITS - top))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(key), *batch.columns], ["place", "key", "node", "s0", "s1"])

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Smallest member of each component, starting from ``lab``."""
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def near_pairs(key: np.ndarray, sig: np.ndarray, top: int, depth: int, max_distance: int, keep_all: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Matches below one trie node of depth ``top``: every pair if ``keep_all``, else links that span the same groups."""
    order = np.argsort(key, kind="stable")
    key, sig = key[order], sig[order]
    n = len(key)
    end, free = np.zeros(n, np.int64), np.ones(n, bool)
    for d in range(top, depth + 1):
        node = key >> (KEY_BITS - d)
        cut = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        stop = np.append(cut[1:], n)
        size = stop - cut
        good = np.repeat((size <= SMALL_NODE) if d < depth else np.ones(len(size), bool), size) & free
        end[good] = np.repeat(stop, size)[good]
        free &= ~good
    lab = np.arange(n)
    left, right, held = [], [], 0
    s0, s1 = np.ascontiguousarray(sig[:, 0]), np.ascontiguousarray(sig[:, 1])
    room = end - np.arange(n)
    lo, hi, k = 0, n, 1
    while True:
        # only the stretch that still holds nodes larger than k
        alive = np.flatnonzero(room[lo:hi] > k)
        if not len(alive):
            break
        lo, hi = lo + int(alive[0]), lo + int(alive[-1]) + 1
        near = np.bitwise_count(s0[lo:hi] ^ s0[lo + k : hi + k]) + np.bitwise_count(s1[lo:hi] ^ s1[lo + k : hi + k]) <= max_distance
        near &= room[lo:hi] > k
        hit = np.flatnonzero(near) + lo
        if len(hit):
            left.append(hit)
            right.append(hit + k)
            held += len(hit)
            if held > 1 << 18 and not keep_all:
                lab = _labels(n, np.concatenate(left), np.concatenate(right), lab)
                left, right, held = [], [], 0
        k += 1
    if keep_all:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return order[a], order[b]
    if left:
        lab = _labels(n, np.concatenate(left), np.concatenate(right), lab)
    moved = np.flatnonzero(lab != np.arange(n))
    return order[moved], order[lab[moved]]


def _search(top: int, depth: int, max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a partition come sorted by place; a place may span batches
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            place, key, node = (t.column(c).to_numpy() for c in ("place", "key", "node"))
            sig = np.stack([t.column("s0").to_numpy(), t.column("s1").to_numpy()], axis=1).view(U64)
            cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            out_a, out_b = [], []
            for lo, hi in zip(cut, np.append(cut[1:], len(place)), strict=True):
                if hi - lo > 1:
                    a, b = near_pairs(key[lo:hi], sig[lo:hi], top, depth, max_distance)
                    out_a.append(node[lo:hi][a])
                    out_b.append(node[lo:hi][b])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            place = t.column("place").to_numpy()
            cut = int(np.searchsorted(place, place[-1], side="left"))
            if cut or (held and held[-1].column("place")[-1].as_py() != place[-1]):
                held.append(t.slice(0, cut))
                yield from flush()
            held.append(t.slice(cut))
        yield from flush()

    return run


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = RECALL) -> DataFrame:
    """(u, v) with u > v: links that span the near-duplicate groups of ``distinct`` (node, s0, s1)."""
    depth, tries = shape(distinct.count(), recall, max_distance)
    top = max(0, depth - CLIMB)
    planted = distinct.select("node", "s0", "s1").mapInArrow(_plant(tries, top), "place bigint, key bigint, node bigint, s0 bigint, s1 bigint")
    return planted.repartition("place").sortWithinPartitions("place").mapInArrow(_search(top, depth, max_distance), "u bigint, v bigint").distinct()


# ---------------------------------------------------------------- groups
def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the graph with the smallest node of its component, itself left out."""
    state, before = materialise(edges.select("u", "v").distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest one
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        state = materialise(moved)
        now = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            return state
        before = tuple(now)


def _grouped(docs: DataFrame, rid: str, max_distance: int, recall: float) -> DataFrame:
    """(rid, group, size): rows that belong to a group of two or more."""
    sigs = materialise(signatures(docs, rid))
    distinct = materialise(sigs.groupBy("s0", "s1").agg(F.min("rid").alias("node"), F.count("*").alias("n")))
    merged = components(links(distinct, max_distance, recall))
    top = distinct.join(merged, distinct["node"] == merged["u"], "left").select("s0", "s1", "n", F.coalesce("v", "node").alias("group"))
    size = top.groupBy("group").agg(F.sum("n").alias("size")).where("size > 1")
    return sigs.join(top.join(size, "group").select("s0", "s1", "group", "size"), ["s0", "s1"]).select("rid", "group", "size")


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = RECALL) -> DataFrame:
    """(doc_id, group_id, n_docs, keep) of the documents with near duplicates; group_id is the id of the one that stays."""
    rid = fresh(docs, "_rid")
    ids = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"))
    member = _grouped(docs.select("text", F.monotonically_increasing_id().alias(rid)), rid, max_distance, recall)
    member = materialise(member.join(ids, "rid"))
    first = member.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    return member.join(first, "group").select("doc_id", F.col("best.doc_id").alias("group_id"), F.col("size").alias("n_docs"), (F.col("rid") == F.col("best.rid")).alias("keep"))


def keep_documents(docs: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each group; all columns as they were. ``docs`` must be a stable table: rows are told apart by their place in it."""
    rid = fresh(docs, "_rid")
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    member = _grouped(docs.select("text", F.monotonically_increasing_id().alias(rid)), rid, max_distance, recall)
    member = materialise(member.join(docs.select("doc_id", F.monotonically_increasing_id().alias("rid")), "rid"))
    first = member.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).getField("rid").alias("best"))
    gone = materialise(member.join(first, "group").where("rid <> best").select(F.col("rid").alias(rid)))
    return numbered.join(gone, rid, "left_anti").drop(rid)
