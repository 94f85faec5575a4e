"""Operator 2: quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words
are compared with those of its language by Jensen-Shannon distance (the square
root of the divergence, base 2). The references come from all documents of the
language: for words their summed histogram, for character classes the median
share of each class, which a minority of junk can't shift. Shares are counted
in ten-thousandths, so an exact median needs at most 10,001 counters. Each text is
read once, in one Arrow kernel that counts all classes and words; everything else
is built-in expressions over the counters, and only small rows a language are shuffled.

Divergence of a small sample is biased upwards by about
``(bins - 1) / (8 n ln 2)``, which is taken off before the root, and each distance
has its minimum length: characters are judged from ``min_chars`` characters on, words
from ``min_words`` words on.

Defined cases
-------------
* Null, empty and blank texts hold no word: reason ``empty``, rejected.
* Fewer than ``min_chars`` characters and ``min_words`` words: neither distance speaks; reason ``short``, kept.
* A null language is the language ``''``. A language without a word list is
  judged by character classes alone (its word distance is null).
* Repeated rows are judged alike, each on its own. An empty table gives an empty result.
* Extra columns, of whatever names, are carried through by ``keep_documents``.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import U64, chunks, fresh, materialise, raw_text, text_of, words

#: The commonest function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for it as with was on be by are this from at or an not have has but which you he they his her we were been will would can there their if".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux d l mais comme on nous vous ses cette été".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split(),
}
#: Character classes as patterns of runs; whatever else there is counts as one more class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[ \\t\\r\\n]+", "[.,;:?''\"()-]+", "[^\\x00-\\x7F]+")

MIN_CHARS = 200
MIN_WORDS = 40
MAX_CHAR_DISTANCE = 0.19
MAX_WORD_DISTANCE = 0.18
_ROUND = 6
BROADCAST_LANGUAGES = 10_000
_SHARES = 10_000


def _classes() -> np.ndarray:
    """Class of each byte: as in CLASSES, one more for other characters, and one for bytes that go on a character."""
    out = np.full(256, len(CLASSES), np.uint8)
    for k, some in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\n", b".,;:?'\"()-", range(192, 256))):
        out[[*some]] = k
    out[128:192] = len(CLASSES) + 1
    return out


_CLASS = _classes()
_LANGS = {k: i for i, k in enumerate(COMMON_WORDS)}
_WIDTH = np.array([*map(len, COMMON_WORDS.values()), 0])
_WORD_HASH = np.zeros((len(_LANGS) + 1, max(_WIDTH) + 1), U64)
#: Place of a word in the list of its language, by the leading bits of its hash; the last place holds no word.
_PLACE = np.full((len(_LANGS) + 1, 1 << 16), max(_WIDTH), np.int16)
for _i, _list in enumerate(COMMON_WORDS.values()):
    _WORD_HASH[_i, : len(_list)] = words(*raw_text(pa.array(_list)), lower=False)[3]
    _PLACE[_i, (_WORD_HASH[_i, : len(_list)] >> U64(48)).astype(np.int64)] = np.arange(len(_list))
    assert len(set(_PLACE[_i].tolist())) == len(_list) + 1, "two common words share their leading bits"

_COUNTS = "struct<n_chars: bigint, n_words: bigint, chars: array<bigint>, words: array<bigint>>"
_MEASURES = "struct<n_chars: bigint, n_words: bigint, char_distance: double, word_distance: double>"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters."""
    out = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        size = 2 + (buf[lead] >= 0xE0).astype(np.int64) + (buf[lead] >= 0xF0)
        point = buf[lead].astype(np.int64) & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            point[more] = (point[more] << 6) | (buf[lead[more] + k] & 63)
        yes = _letter_table()[point]
        for k in range(4):
            more = size > k
            out[lead[more] + k] = yes[more]
    return out


def _counts(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Counters of (text, language)."""
    for raw, lang in columns:
        n, width = len(raw), max(_WIDTH) + 1
        chars, seen = np.zeros((n, len(CLASSES) + 1), np.int64), np.zeros((n, width), np.int64)
        of = np.array([_LANGS.get(x, len(_LANGS)) for x in lang.to_pylist()], np.int64)
        buf, offs = raw_text(raw)
        for lo, hi in chunks(offs):
            part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            kind = _CLASS[part]
            for k in range(len(CLASSES) + 1):
                chars[lo:hi, k] = np.diff(np.append(0, np.cumsum(kind == k, dtype=np.int64))[at])
            _, _, row, h = words(part, at, inside=_letters(part))
            which = of[lo + row]
            place = _PLACE[which, (h >> U64(48)).astype(np.int64)].astype(np.int64)
            place[_WORD_HASH[which, place] != h] = width - 1
            seen[lo:hi] = np.bincount(row * width + place, minlength=(hi - lo) * width).reshape(hi - lo, width)
        total = seen.sum(axis=1)
        # the others come last, right behind the list of the language
        size = _WIDTH[of] + 1
        seen[np.arange(n), size - 1] = seen[:, width - 1]
        flat = seen[np.arange(width) < size[:, None]]
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)).astype(np.int32)), pa.array(x)) for k, x in ((np.full(n, chars.shape[1]), chars.ravel()), (size, flat))]
        yield pa.StructArray.from_arrays([pa.array(chars.sum(axis=1)), pa.array(total), *lists], ["n_chars", "n_words", "chars", "words"])


def histograms(docs: DataFrame) -> DataFrame:
    """``docs`` plus _lang, _chars (counts by class), _words (counts by common word, others last), _n_chars, _n_words."""
    lang = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    run = F.arrow_udf(_counts, _COUNTS, functionType=F.ArrowUDFType.SCALAR_ITER)
    out = docs.withColumns({"_lang": lang, "_counts": run(text_of(docs), lang)})
    return out.withColumns({f"_{k}": F.col(f"_counts.{k}") for k in ("n_chars", "n_words", "chars", "words")}).drop("_counts")


def references(hist: DataFrame) -> DataFrame:
    """(_lang, _ref_chars, _ref_words) over all documents of each language."""
    width = max(map(len, COMMON_WORDS.values())) + 1
    share = [F.when(F.col("_n_chars") > 0, F.floor(F.get("_chars", F.lit(i)) * _SHARES / F.col("_n_chars")).cast("int")) for i in range(len(CLASSES) + 1)]
    sums = [F.percentile(c, F.lit(0.5)).alias(f"c{i}") for i, c in enumerate(share)]
    sums += [F.sum(F.get("_words", F.lit(i))).alias(f"w{i}") for i in range(width)]
    wide = hist.select("_lang", "_n_chars", "_chars", "_words").groupBy("_lang").agg(*sums)
    out = materialise(
        wide.select(
            "_lang",
            F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("_ref_chars"),
            F.filter(F.array(*[f"w{i}" for i in range(width)]), lambda x: x.isNotNull()).alias("_ref_words"),
        )
    )
    # one row a language; only a table with a language a document would be too large to send around
    return F.broadcast(out) if out.count() <= BROADCAST_LANGUAGES else out


def _distance_of(p: pa.Array, q: pa.Array) -> pa.Array:
    """Distance of each histogram from its reference, as far as one speaks; null where either is empty or of one bin."""
    x, offs = _flat(p)
    y, _ = _flat(q)
    rows = len(offs) - 1
    of, bins = np.repeat(np.arange(rows), np.diff(offs)), np.diff(offs)
    n, m = (np.bincount(of, weights=v, minlength=rows) for v in (x, y))
    good = (n > 0) & (m > 0) & (bins > 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = x / n[of], y / m[of]
        mid = (a + b) / 2
        term = np.where(a > 0, a * np.log2(a / mid), 0.0) + np.where(b > 0, b * np.log2(b / mid), 0.0)
        raw = np.bincount(of, weights=term, minlength=rows) / 2 - (bins - 1) / (n * 8 * math.log(2))
        out = np.round(np.sqrt(np.maximum(raw, 0.0)), _ROUND)
    return pa.array(out, mask=~good)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(float), offs - offs[0]


def _distances(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for chars, ref_chars, seen, ref_seen in columns:
        yield pa.StructArray.from_arrays([_distance_of(chars, ref_chars), _distance_of(seen, ref_seen)], ["chars", "words"])


def _measures(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Lengths and distances of (text, language, its reference by class, by word)."""
    for text, lang, ref_chars, ref_seen in columns:
        n_chars, n_words, chars, seen = next(_counts(iter([(text, lang)]))).flatten()
        yield pa.StructArray.from_arrays([n_chars, n_words, _distance_of(chars, ref_chars), _distance_of(seen, ref_seen)], ["n_chars", "n_words", "char_distance", "word_distance"])


def judged(hist: DataFrame, ref: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``hist`` plus _char_distance, _word_distance, _reason (null where nothing speaks against it), _keep."""
    run = F.arrow_udf(_distances, "struct<chars: double, words: double>", functionType=F.ArrowUDFType.SCALAR_ITER)
    out = hist.join(ref, "_lang").withColumn("_far", run("_chars", "_ref_chars", "_words", "_ref_words"))
    out = out.withColumns({"_char_distance": F.col("_far.chars"), "_word_distance": F.col("_far.words")})
    return _reasoned(out, min_chars, min_words, max_char, max_word).drop("_chars", "_words", "_ref_chars", "_ref_words", "_far")


def _reasoned(measured: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``measured`` (with lengths and distances) plus _reason, _keep."""
    reason = (
        F.when(F.col("_n_words") == 0, "empty")
        .when((F.col("_n_chars") >= min_chars) & (F.col("_char_distance") > max_char), "characters")
        .when((F.col("_n_words") >= min_words) & (F.col("_word_distance") > max_word), "words")
        .when((F.col("_n_chars") < min_chars) & (F.col("_n_words") < min_words), "short")
    )
    return measured.withColumn("_reason", reason).withColumn("_keep", F.coalesce(F.col("_reason") == "short", F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, n_chars, n_words, char_distance, word_distance, reason, keep."""
    # a few dozen counters a document are written once, so each text is read once
    hist = materialise(histograms(docs.select("doc_id", "text", "lang")).drop("text", "lang"))
    out = judged(hist, references(hist))
    return out.select("doc_id", F.col("_lang").alias("lang"), *[F.col(f"_{c}").alias(c) for c in ("n_chars", "n_words", "char_distance", "word_distance", "reason", "keep")])


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    whole = fresh(docs, "whole")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(whole), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("_lang"))
    # two narrow passes over the texts: rows written with their counters would take the table's size again, and joined to them a shuffle of it.
    # Counters and distances come from one kernel: with two, a task holds two Python workers, which an executor keeps while Python is in use
    run = F.arrow_udf(_measures, _MEASURES, functionType=F.ArrowUDFType.SCALAR_ITER)
    far = packed.join(references(histograms(docs.select("text", "lang"))), "_lang").withColumn("_far", run(F.coalesce(F.col(whole).getField("text").cast("string"), F.lit("")), "_lang", "_ref_chars", "_ref_words"))
    return _reasoned(far.select(whole, *[F.col(f"_far.{k}").alias(f"_{k}") for k in ("n_chars", "n_words", "char_distance", "word_distance")])).where("_keep").select(f"{whole}.*")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_distance(p: str, q: str) -> str:
    n, m = f"list_sum({p})::DOUBLE", f"list_sum({q})::DOUBLE"
    term = f"(CASE WHEN x[1] > 0 THEN x[1] / {n} * log2(x[1] / {n} / ((x[1] / {n} + x[2] / {m}) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] / {m} * log2(x[2] / {m} / ((x[1] / {n} + x[2] / {m}) / 2)) ELSE 0 END)"
    raw = f"list_sum(list_transform(list_zip({p}, {q}), lambda x: {term})) / 2"
    return f"CASE WHEN {n} > 0 AND {m} > 0 AND len({p}) > 1 THEN round(sqrt(greatest({raw} - (len({p}) - 1) / ({n} * 8 * ln(2::DOUBLE)), 0)), {_ROUND}) END"


def oracle_sql(source: str = "documents") -> str:
    """The same rows in DuckDB SQL."""
    lists = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON_WORDS.items()) + " ELSE [] END"
    classes = ", ".join("length(text) - length(regexp_replace(text, '{}', '', 'g'))".format(p.replace("''", "'").replace("'", "''").replace("\\x00", "\\x{00}").replace("\\x7F", "\\x{7F}")) for p in CLASSES)
    width = max(map(len, COMMON_WORDS.values())) + 1
    k = len(CLASSES) + 1
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM {source}
), s AS (SELECT *, {lists} AS list, '  ' || regexp_replace(lower(text), '[^\\p{{L}}]+', '  ', 'g') || '  ' AS spaced, CAST(length(text) AS BIGINT) AS n_chars, [{classes}] AS part FROM d
), h AS (SELECT doc_id, lang, n_chars, list_append(part, n_chars - list_sum(part)) AS chars,
  CAST(len(regexp_extract_all(spaced, ' [^ ]')) AS BIGINT) AS n_words,
  list_transform(list, lambda w: (strlen(spaced) - strlen(replace(spaced, ' ' || w || ' ', ''))) // strlen(' ' || w || ' ')) AS seen FROM s
), e AS (SELECT doc_id, lang, n_chars, n_words, list_transform(chars, lambda x: x::DOUBLE) AS chars,
  list_transform(list_append(seen, n_words - coalesce(list_sum(seen), 0)), lambda x: x::DOUBLE) AS words FROM h
), r AS (SELECT lang, [{', '.join(f'quantile_cont(CASE WHEN n_chars > 0 THEN floor(chars[{i}] * {_SHARES} / n_chars) END, 0.5)' for i in range(1, k + 1))}] AS rc,
  list_filter([{', '.join(f'sum(words[{i}])' for i in range(1, width + 1))}], lambda x: x IS NOT NULL) AS rw FROM e GROUP BY lang
), x AS (SELECT e.doc_id, e.lang, n_chars, n_words, {_sql_distance('chars', 'rc')} AS char_distance, {_sql_distance('words', 'rw')} AS word_distance FROM e JOIN r ON e.lang = r.lang
), y AS (SELECT *, CASE WHEN n_words = 0 THEN 'empty' WHEN n_chars >= {MIN_CHARS} AND char_distance > {MAX_CHAR_DISTANCE} THEN 'characters'
  WHEN n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE} THEN 'words' WHEN n_chars < {MIN_CHARS} AND n_words < {MIN_WORDS} THEN 'short' END AS reason FROM x)
SELECT *, coalesce(reason = 'short', true) AS keep FROM y
"""
