"""Evaluation texts inside training texts.

1. Items become a table of n-grams (hashes of SEED words) and a table of word sequences. Nothing of them is in a task's closure but two
   Bloom filters, of their n-grams and of their words, whose size is bounded.
2. The corpus is rendered and cut into words once, whatever the number of items. A document's n-grams that the filter lets
   through are its hits; they are stored, with the words around them.
3. Document counts of the n-grams over the whole corpus say which are rare. From each window of RUN words of an item the
   rarest n-gram becomes a seed: a document that shows the window shows its seed, so nothing is lost.
4. Seeds join documents to items. Smith-Waterman alignment scores each pair. What scores less than RUN equal words in a row would is no
   leak; the others are checked for such a run, word by word.

Edited copies need other seeds: an edit breaks the n-grams around it, and the broken ones are the rarest. For them every
n-gram of an item is a seed, and the score decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.render import plain_words, words
from rillflow.runtime import cut_lineage, spread

#: Words of a seed, words that must stand together.
SEED, RUN = 6, 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a filter for each value, and the most it may have: beyond, more hits are stored and then dropped by the join.
FILTER_BITS, MOST_BITS, PROBES = 16, 1 << 28, 4
#: Words whose hashes a worker remembers; only saves time.
REMEMBERED = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_words(found: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word, never 0."""
    if len(known) > REMEMBERED:
        known.clear()
    out = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w) or 1
        out[i] = h
    return out


def grams_of(u: np.ndarray, n: int = SEED) -> np.ndarray:
    """Hash of each n-gram of word hashes."""
    if len(u) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(u) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ u[k : len(u) - n + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Filter:
    """Bloom filter of 64-bit hashes over a bit array made elsewhere."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        size, on = np.uint64(len(self.bits) * 8 - 1), np.ones(len(h), bool)
        a, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            p = ((a + step * np.uint64(i)) & size).astype(np.int64)
            on &= ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
        return on


def make_filter(hashes: DataFrame, column: str) -> Filter:
    """Filter of a column of hashes, built on the executors. At most MOST_BITS come to the driver."""
    n = hashes.count()
    bits = 1 << min(int(math.log2(MOST_BITS)), max(15, math.ceil(math.log2(max(1, n * FILTER_BITS)))))
    array = np.zeros(bits // 8, np.uint8)
    at = [F.expr(f"((({column} & 4294967295) + (shiftrightunsigned({column}, 32) | 1L) * {i}L) & {bits - 1}L) + 1L") for i in range(PROBES)]
    chunks = hashes.select(F.explode(F.array(*at)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("c")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    for r in chunks.toLocalIterator():
        array[(r.c - 1) * 4096 : r.c * 4096] = np.frombuffer(r.b, np.uint8)
    return Filter(array)


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Smith-Waterman score of two word sequences (local alignment, linear gaps). Rows of the table are vectors; gaps along
    a row come out of a running maximum."""
    row = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1) * GAP
    best = 0
    for i in range(len(a)):
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(b == a[i], MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - steps) + steps
        best = max(best, int(row.max()))
    return best


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Most equal words in a row that two sequences share."""
    run, longest = np.zeros(len(b) + 1, np.int64), 0
    for w in a:
        fresh = np.zeros_like(run)
        fresh[1:] = np.where(b == w, run[:-1] + 1, 0)
        run = fresh
        longest = max(longest, int(run.max()))
    return longest


_FIELDS = T.StructType([T.StructField("field", T.StringType()), T.StructField("item_id", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("n_words", T.LongType())])


def item_fields(items: DataFrame, shortest: int) -> DataFrame:
    """A row for each passage and question of at least `shortest` words: its n-grams in their order, and its word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for item, *texts in zip(*(c.to_pylist() for c in b.columns)):
                for name, text in zip("pq", texts):
                    u = hash_words(plain_words(text), known)
                    if len(u) >= shortest:
                        out.append((f"{item}{name}{xxhash.xxh3_64_hexdigest(u.tobytes())}", item, grams_of(u).view(np.int64), u.tobytes(), len(u)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()))], names=_FIELDS.names)

    wanted = items.select(F.col("item_id").cast("bigint"), "passage", "question").where("item_id is not null")
    return cut_lineage(wanted.mapInArrow(run, _FIELDS).dropDuplicates(["field"]))


_HITS = T.StructType([T.StructField("doc", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.BinaryType()))])


def _find_hits(filters, around: int | None):
    """(doc_id, text) -> a row for each document with hits: their hashes, distinct, and the words around them, as hashes, 0 where
    no item has the word. Hits further apart than twice `around` are parts of their own; with None the document is one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_gram, is_word = filters.value
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u = hash_words(words(text), known)
                h = grams_of(u)
                at = np.flatnonzero(is_gram(h))
                if not len(at):
                    continue
                kept = np.where(is_word(u), u, np.uint64(0))
                if around is None:
                    parts = [kept.tobytes()]
                else:
                    cuts = np.flatnonzero(np.diff(at) > 2 * around + SEED) + 1
                    parts = [kept[max(0, p[0] - around) : p[-1] + SEED + around].tobytes() for p in np.split(at, cuts)]
                # Repeated ids are documents of their own.
                out.append((f"{doc}:{xxhash.xxh3_64_hexdigest(text)}", doc, np.unique(h[at]).view(np.int64), parts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())))], names=_HITS.names)

    return run


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, [(place, gram, documents)]) -> (field, gram): of each window of RUN words the n-gram that fewest documents have."""
    per = RUN - SEED + 1
    for b in batches:
        fields, grams = [], []
        for field, held in zip(*(c.to_pylist() for c in b.columns)):
            held = sorted((g["place"], g["gram"], g["n"]) for g in held)
            h, df = np.array([g[1] for g in held], np.int64), np.array([g[2] for g in held], np.int64)
            if len(h) >= per:
                window = np.lib.stride_tricks.sliding_window_view(df, per)
                chosen = np.unique(h[window.argmin(1) + np.arange(len(window))])
                fields += [field] * len(chosen)
                grams += chosen.tolist()
        if fields:
            yield pa.RecordBatch.from_arrays([pa.array(fields), pa.array(grams, pa.int64())], names=["field", "gram"])


_PAIRS = "doc_id bigint, item_id bigint, score bigint, item_words bigint, longest_run bigint"


def _scored(least: int, with_run: bool):
    """(doc_id, parts, item_id, words) -> scores of at least `least`, the best part of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, parts, item, wanted in zip(*(c.to_pylist() for c in b.columns)):
                a = np.frombuffer(wanted, np.uint64)
                best = longest = 0
                for p in parts:
                    u = np.frombuffer(p, np.uint64)
                    score = align(a, u)
                    best = max(best, score)
                    if with_run and score >= least:
                        longest = max(longest, longest_run(a, u))
                if best >= least:
                    out.append((doc, item, best, len(a), longest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "score", "item_words", "longest_run"])

    return run


def _hits(documents: DataFrame, fields: DataFrame, around: int | None) -> DataFrame:
    """The one pass over the corpus, stored."""
    is_gram = make_filter(fields.select(F.explode("grams").alias("g")).distinct(), "g")
    is_word = make_filter(fields.select("words").mapInArrow(_each_word, "w bigint").distinct(), "w")
    filters = documents.sparkSession.sparkContext.broadcast((is_gram, is_word))
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), "text")).where("doc_id is not null and text is not null")
    return cut_lineage(docs.mapInArrow(_find_hits(filters, around), _HITS))


def _each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [np.unique(np.frombuffer(w, np.int64)) for w in b.column(0).to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], names=["w"])


def _pairs(hits: DataFrame, fields: DataFrame, seeds: DataFrame, least: int, with_run: bool) -> DataFrame:
    """Documents and items that share a seed, aligned (a text stored twice, twice). Joined by seed, then by document and by item; texts travel only
    in the last two."""
    near = hits.select("doc", F.explode("grams").alias("gram")).join(seeds, "gram").select("doc", "field").distinct()
    both = near.join(hits.select("doc", "doc_id", "parts"), "doc").join(fields.select("field", "item_id", "words"), "field")
    return both.select("doc_id", "parts", "item_id", "words").mapInArrow(_scored(least, with_run), _PAIRS)


def aligned_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, item_words, longest_run) of every document and item field that share a seed and score at least
    what RUN equal words in a row do.

    documents: (doc_id, text) in wiki markup; items: (item_id, passage, question). A pair may have a row for each of the item's
    fields. Null texts have no words. Passages and questions shorter than RUN words have no window of that length and find
    nothing. Documents without an id are left out; of repeated ids each text counts. Empty tables give an empty result.

    The words around a hit reach as far as the hits of a run can; the run itself lies inside its hits. Counts, seeds and pairs are
    joins on hashes; nothing is collected but the filters.
    """
    fields = item_fields(items, RUN)
    hits = _hits(documents, fields, RUN)
    counts = hits.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))  # a document has each once
    placed = fields.select("field", F.posexplode("grams").alias("place", "gram")).join(counts, "gram", "left")
    held = placed.groupBy("field").agg(F.collect_list(F.struct("place", "gram", F.coalesce("n", F.lit(0)).alias("n"))).alias("held"))  # as long as the item
    seeds = held.mapInArrow(_rarest, "field string, gram bigint")
    return _pairs(hits, fields, seeds, MATCH * RUN, True)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct: the document shows at least RUN consecutive words of the item's passage or question."""
    return aligned_pairs(documents, items).where(F.col("longest_run") >= RUN).select("doc_id", "item_id").distinct()


def share_of(score: str, item_words: str) -> Column:
    return F.col(score) / (F.lit(MATCH) * F.col(item_words))


def edited_copies(documents: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share): pairs whose alignment has at least `share` of the score of an exact copy, the best of each pair.

    Every document and item field with SEED words in a row in common are aligned, however common those words are and whether
    or not RUN words stand together; the score is that of the whole document. A copy in which no SEED words in a row are left
    as they were isn't aligned, whatever its score would be. One pass over the corpus, whatever the number of items.
    """
    fields = item_fields(items, SEED)
    hits = _hits(documents, fields, None)
    seeds = fields.select("field", F.explode("grams").alias("gram")).distinct()
    scored = _pairs(hits, fields, seeds, 1, False).withColumn("share", share_of("score", "item_words"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("share").alias("share")).where(F.col("share") >= share)
