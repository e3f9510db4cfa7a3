"""Texts into containers of fixed token capacity, with certified repacking.

Texts are counted in tokens of a public tokenizer, spread over partitions and packed by best-fit decreasing. A lower bound
from dual feasible functions certifies a partition that can't be packed into fewer containers. Partitions with a gap
keep their full containers and give the texts of the others into an exchange, where they are packed again together
with those of other partitions, until no gap is left to close or an exchange no longer helps.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.runtime import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts of a partition, rounds of exchange at most, and how full a container must be to stay out of one (in a certified partition: less,
#: as only its left-over containers are worth an exchange).
PER_PARTITION, ROUNDS, KEEP_FILL, KEEP_CERTIFIED = 40_000, 4, 0.995, 0.9

# Fixed value: the published splitting pattern of the byte-level vocabularies.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """Function from texts to token counts, for the file's kind: .tiktoken, .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer library for {path}")


def token_counts(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each text that isn't null; empty texts have 0. Whole texts are counted."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(count(b.column(1).to_pylist()), pa.int64())], names=out.names)

    return spread(df.select("doc_id", "text")).where("text is not null and doc_id is not null").mapInArrow(run, out)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs, by the best of three families of dual feasible functions.

    Each function maps sizes so that what fits into one container still sums to at most one; so the mapped total, rounded
    up, is a bound. The two families with a threshold are evaluated at each distinct one: the sizes up to half the capacity,
    and what the larger ones leave. All arithmetic is on whole numbers. sizes: distinct, from 1 to the capacity.
    """
    if not len(sizes):
        return 0
    x, n = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 25):  # floor((k + 1) x) / k, kept where (k + 1) x is whole
        up = (k + 1) * x
        whole = up % capacity == 0
        value = int((np.where(whole, k * x, (up // capacity) * capacity) * n).sum())
        best = max(best, -(-value // (k * capacity)))
    edges = np.unique(np.concatenate([x[2 * x <= capacity], capacity - x[2 * x > capacity]]))
    edges = edges[(edges > 0) & (2 * edges <= capacity)]
    if not len(edges):
        return int(best)
    order = np.argsort(x)
    x, n = x[order], n[order]
    number, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(x * n))
    low, high = np.searchsorted(x, edges), np.searchsorted(x, capacity - edges, "right")
    rounded = capacity * (number[-1] - number[high]) + total[high] - total[low]  # small ones to nothing, large ones to a container
    best = max(best, -(-int(rounded.max()) // capacity))
    half = np.searchsorted(x, capacity // 2, "right")
    left, n_left = capacity - x[half:], n[half:]
    slots = capacity // edges  # how often the threshold fits
    value = slots * n_left.sum() + number[half] - number[low]
    step = max(1, (1 << 20) // max(1, len(left)))
    for k in range(0, len(edges), step):
        value[k : k + step] -= (left[None, :] // edges[k : k + step, None]) @ n_left
    best = max(best, int((-(-value // slots)).max()))
    return int(best)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item and fill of each container. The tightest container is found by the lowest set bit of the free spaces."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = bits >> s
        if fits:
            gap = s + ((fits & -fits).bit_length() - 1)
            c = free[gap].pop()
            if not free[gap]:
                bits &= ~(1 << gap)
        else:
            c, gap = len(fill), capacity
            fill.append(0)
        where[i] = c
        fill[c] += s
        gap -= s
        if gap:
            free[gap].append(c)
            bits |= 1 << gap
    return where, np.array(fill, np.int64)


_ITEMS = "capacity_id int, capacity int, separator int, doc_id bigint, piece int, tokens bigint, lot bigint"
_PACKED = f"{_ITEMS}, container string, kept boolean, gap bigint"


def _pieces(capacities: list[tuple[int, int, int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f.tokens > 0]
            for cid, cap, sep in capacities:
                n = -(-f.tokens.to_numpy() // cap)
                at = np.repeat(np.arange(len(f)), n)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                tokens = np.minimum(f.tokens.to_numpy()[at] - piece * cap, cap)
                yield pd.DataFrame({"capacity_id": np.int32(cid), "capacity": np.int32(cap), "separator": np.int32(sep), "doc_id": f.doc_id.to_numpy()[at], "piece": piece.astype(np.int32), "tokens": tokens, "lot": np.int64(0)})

    return run


def _pack(round_no: int, last: bool):
    def run(key: tuple[Any, ...], f: pd.DataFrame) -> pd.DataFrame:
        cap, sep = int(f.capacity.iloc[0]), int(f.separator.iloc[0])
        f = f.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = f.tokens.to_numpy() + sep
        room = cap + sep  # a separator stands between two texts: one fewer than texts
        where, fill = best_fit_decreasing(sizes, room)
        distinct, counts = np.unique(sizes, return_counts=True)
        gap = len(fill) - lower_bound(distinct, counts, room)
        keep = np.ones(len(fill), bool) if last else fill >= (KEEP_CERTIFIED if gap <= 0 else KEEP_FILL) * room
        name = np.array([f"{key[0]}-{round_no}-{key[1]}-{i}" for i in range(len(fill))], object)
        return f.assign(container=name[where], kept=keep[where], gap=np.int64(max(gap, 0)))

    return run


def pack(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """The containers of `pack_and_report`."""
    return pack_and_report(documents, capacities, tokenizer, per_partition, rounds)[0]


_REPORT = "capacity_id int, round int, lot bigint, containers bigint, gap bigint, kept bigint"


def pack_and_report(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(capacity_id, container, doc_id, piece, first_token, tokens): each text once for each capacity.

    documents: (doc_id, text); capacities: (capacity_id, capacity_tokens, separator_tokens); between two texts of a container its
    separator is spent. A text is split only if it alone exceeds the capacity: into full pieces and a rest, which is packed
    like a text; piece counts from 0 and first_token says where it begins. Null texts and texts without tokens are in no
    container. Rows of capacities with a null or without room are passed over, a null separator spends nothing. Every other row
    counts, whatever repeats (ids should be unique). Empty tables give an empty result.

    Texts are spread by a hash of their id over partitions of about `per_partition` texts, so no source or page fills one of
    them. Each exchange moves only the texts of containers that aren't full.

    The report has a row for each partition of each round: containers, how many lie above its lower bound (`gap`; 0 is certified), and
    how many are kept. After `rounds` rounds, or where all that is open fits one partition, what is open is kept as it is: a
    gap in such a row is one that exchanges haven't closed, which doesn't say that it can be.
    """
    spark = documents.sparkSession
    caps = [(r.capacity_id, r.capacity_tokens, r.separator_tokens or 0) for r in capacities.where("capacity_id is not null and capacity_tokens > 0").limit(10_001).collect()]
    if len(caps) > 10_000:
        raise ValueError("more than 10000 capacities")
    counted = cut_lineage(token_counts(documents, tokenizer))
    n = counted.count()
    done: DataFrame | None = None
    report = spark.createDataFrame([], _REPORT)
    todo = counted.mapInPandas(_pieces(caps), _ITEMS)
    lots = max(1, math.ceil(n / per_partition))
    for r in range(rounds):
        last = r == rounds - 1
        placed = todo.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(lots)))
        packed = cut_lineage(placed.groupBy("capacity_id", "lot").applyInPandas(_pack(r, last), _PACKED))
        partitions = packed.groupBy("capacity_id", "lot", "container").agg(F.max("gap").alias("gap"), F.max(F.col("kept").cast("int")).alias("kept"))
        report = report.unionByName(partitions.groupBy("capacity_id", "lot").agg(F.count(F.lit(1)).alias("containers"), F.max("gap").alias("gap"), F.sum("kept").alias("kept")).withColumn("round", F.lit(r)))
        kept = packed.where("kept")
        done = kept if done is None else done.unionByName(kept)
        released = packed.where("not kept")
        n_open = released.count()
        if last or n_open == 0:
            break
        # In one lot of a capacity an exchange has no partner; what is open there is as good as it was.
        if lots == 1:
            done = done.unionByName(released)
            break
        todo = released.select("capacity_id", "capacity", "separator", "doc_id", "piece", "tokens", "lot")
        lots = max(1, math.ceil(n_open / max(1, len(caps)) / per_partition))
    if done is None:
        done = spark.createDataFrame([], _PACKED)
    return done.select("capacity_id", "container", "doc_id", "piece", (F.col("piece").cast("bigint") * F.col("capacity")).alias("first_token"), "tokens"), report


def certificate(documents: DataFrame, capacities: DataFrame, packed: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per capacity: containers used, the lower bound over all texts together, unused tokens. The bound needs one row a distinct size."""
    used = packed.groupBy("capacity_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    sizes = packed.groupBy("capacity_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    caps = capacities.select("capacity_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens"))

    def bound(key: tuple[Any, ...], f: pd.DataFrame) -> pd.DataFrame:
        sep, cap = int(f.separator_tokens.iloc[0]), int(f.capacity_tokens.iloc[0])
        f = f.sort_values("tokens")
        return pd.DataFrame({"capacity_id": [key[0]], "lower_bound": [lower_bound(f.tokens.to_numpy() + sep, f.n.to_numpy(), cap + sep)]})

    bounds = sizes.join(caps, "capacity_id").groupBy("capacity_id").applyInPandas(bound, "capacity_id int, lower_bound bigint")
    return used.join(bounds, "capacity_id").join(caps, "capacity_id").select(
        "capacity_id", "containers", "lower_bound", (F.col("containers") * F.col("capacity_tokens") - F.col("tokens") - F.col("separator_tokens") * (F.col("pieces") - F.col("containers"))).alias("unused_tokens")
    )
