"""Best-fit packing of documents into fixed-length training sequences, with certified bin counts.

A document becomes pieces of at most `length` tokens. Pieces are dealt at random among groups; each
group packs its pieces by best-fit decreasing and proves a lower bound on the number of bins with
dual feasible functions. A group whose count equals its bound is done but for its emptiest bin. A
group with a gap gives up every bin that is not full. What was given up is dealt anew among fewer
groups and packed again, until one group is left, a round saves nothing, or as few bins are made as the
bound for all pieces together allows.

Defined results: null text is empty and gives one piece of the end id alone; repeated rows are
packed once each; an empty table gives no rows; columns that clash with those added are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.tokens import encoder

#: Pieces that one group packs: they fit in a worker's memory many times over.
GROUP = 65_536


def split_lengths(n: int, length: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than `length`."""
    first = n % length
    return [first] * bool(first) + [length] * (n // length)


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = common.schema_with(docs, "doc_id", piece="int", start="long", length="long", ids_crc32="long", **({"ids": "array<int>"} if with_ids else {}))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, tokens, bounds in enc.encode_all(batch.column(1)):
                out: list[list] = [[] for _ in schema.fields]
                for doc, a, b in zip(docs[first:], bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = np.concatenate([tokens[a:b], end])
                    start = 0
                    for k, n in enumerate(split_lengths(len(ids), length)):
                        own = ids[start : start + n]
                        row = (doc, k, start, n, zlib.crc32(own), *([own.astype("i4")] if with_ids else []))
                        for column, x in zip(out, row):
                            column.append(x)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, arrow)], names=schema.names)
        common.tidy()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    return common.text_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by best fit in decreasing order (ties in given order).

    Open bins stand in stacks by free space; `free` finds the tightest one that fits.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask = 0  # bit f is set while a bin with f free places is open
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_mask &= ~(1 << free)
        else:
            free, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - n:
            stacks[left].append(b)
            open_mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins from two families of dual feasible functions.

    Rounding: u_k(x) = x if (k+1)x is an integer, else floor((k+1)x)/k, for x = length/capacity.
    Threshold: items over 1-e count whole, those under e count nothing, the rest as they are.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """lower_bound() of counts[n] items of each length n."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ size) // capacity)
    for k in range(1, 41):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    from_top = np.cumsum(counts[::-1])[::-1]
    weight = np.cumsum(counts * size)
    for e in range(1, capacity // 2 + 1):
        whole = int(from_top[capacity - e + 1])
        between = int(weight[capacity - e] - weight[e - 1])
        best = max(best, whole + -(-between // capacity))
    return best


def histogram(items: DataFrame, length: int) -> np.ndarray:
    """Pieces of each length from 0 to `length`: all that a bound needs."""
    counts = np.zeros(length + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return counts


def certificate(packed: DataFrame, length: int = 2048) -> dict[str, int]:
    """Of packed pieces: the sequences used, the bound that no packing can go below, and the gap between them."""
    used = packed.agg(F.countDistinct("sequence_id")).first()[0]
    bound = bound_of(histogram(packed, length), length)
    return {"sequences": used, "bound": bound, "gap": used - bound}


def pack(items: DataFrame, length: int = 2048, group: int = GROUP) -> DataFrame:
    """items (a table from cut() with column `length`) with sequence_id, offset and, per row, whether
    its group's bin count was certified in the round that placed it (`certified`).

    A sequence_id is round << 52 | group << 24 | bin.
    """
    keep = [c for c in items.columns if c not in ("sequence_id", "offset", "certified", "_row", "_group", "_free")]
    items = items.select(*keep)
    full = items.where(F.col("length") == length).withColumn("sequence_id", (F.lit(1 << 62) + F.monotonically_increasing_id()).cast("long"))
    done = [full.select(*keep, "sequence_id", F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    open_items, before, r = items.where(F.col("length") < length), None, 0
    counts = histogram(open_items, length)
    n, bound, settled = int(counts.sum()), bound_of(counts, length), 0
    while n:
        groups = -(-n // group)
        packed = common.cut(_round(open_items, keep, length, r, groups), f"packed{r}")
        n, now, kept = packed.agg(F.count(F.when(F.col("_free"), 1)), F.countDistinct(F.when(F.col("_free"), F.col("sequence_id"))), F.countDistinct(F.when(~F.col("_free"), F.col("sequence_id")))).first()
        # What a round gave up may not fit better: then the bins of the round before stay.
        if before is not None and now + kept >= was:
            break
        before, was, r, settled = packed, now, r + 1, settled + kept
        done.append(packed.where(~F.col("_free")))
        if groups == 1 or settled + now <= bound:
            break
        open_items = packed.where("_free").select(*keep)
    if before is not None:
        done.append(before.where("_free"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x.select(*keep, "sequence_id", "offset", "certified"))
    return out


def _round(items: DataFrame, keep: list[str], length: int, r: int, groups: int) -> DataFrame:
    dealt = items.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(r)), F.lit(groups)).cast("long")).drop("_row")
    schema = common.schema_with(items, *keep, sequence_id="long", offset="long", certified="boolean", _free="boolean")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *[c for c in ("ids_crc32", "piece") if c in pdf]], ascending=False, kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, length)
        fill = np.bincount(bins, weights=lengths)
        certified = len(fill) == lower_bound(lengths, length)
        free = np.zeros(len(fill), bool)
        if groups > 1:
            if certified:
                free[np.argmin(fill)] = True
            else:
                free = fill < length
        return pdf[keep].assign(sequence_id=(r << 52) | (int(key[0]) << 24) | bins, offset=offsets, certified=certified, _free=free[bins])

    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """docs packed: one row per piece with sequence_id and offset."""
    return pack(common.cut(pieces(docs, tokenizer, length, end_id, with_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """From pack_documents(with_ids=True): one row per sequence with its token ids in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
