"""Token files: frequency-ranked ids in a byte-aligned variable-length coding.

File format. A shard is a Parquet file whose rows are blocks in order. A block holds whole documents:
    doc_ids  per document its id                    n_tokens  per document its number of ids
    control  two bits per token, four tokens a byte from the low bits up: bytes of its rank, less 1
    data     the ranks, little-endian, in as many bytes as control says
Rank 0 is the most frequent id; `ranks` (one row: the ids by rank, as little-endian unsigned 32-bit
integers) stands beside the shards. So nine tokens in ten take one byte, and a block is decoded by
looking lengths up in a table of 256 rows with numpy, without a loop over tokens.

Defined results: null text is empty and has the end id alone; repeated rows are written once each;
documents with one id stand side by side, null ids first; an empty table gives an empty file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.tokens import encoder

#: Tokens after which a block is closed; a longer document is a block of its own.
BLOCK = 1 << 20
#: _LENGTHS[c] are the bytes of the four tokens of control byte c.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    n = len(ranks)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    wide = int(code.max(initial=0)) + 1
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]
    return control.tobytes(), each[np.arange(wide, dtype=np.uint8) <= code[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > k)
        out[has] |= raw[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, width and ids (little-endian unsigned integers of width bytes, the end id last) of whole texts."""
    schema = common.schema_with(docs, "doc_id", width="int", ids="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, narrow=True)
        end = end_id.to_bytes(enc.width, "little")
        for batch in batches:
            for first, tokens, bounds in enc.encode_all(batch.column(1)):
                ids = [tokens[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array([enc.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=schema.names)
        common.tidy()

    return common.text_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over the whole table, ties by id. At most one entry per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.bincount(_ids(b"".join(batch.column(0).to_pylist()), batch.column(1)[0].as_py()))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy().astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK) -> None:
    """Encode docs and write shards in ascending doc_id order under path/shards, ranks under path/ranks."""
    spark = docs.sparkSession
    tokens = common.cut(tokenize(docs, tokenizer, end_id), "tokens")
    by_rank = frequency_ranks(tokens)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    doc_type = common.schema_with(tokens, "doc_id").fields[0].dataType.simpleString()
    schema = f"shard int, block long, doc_ids array<{doc_type}>, n_tokens array<long>, control binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, made = shared.value, 0
        ids: list = []
        each: list[bytes] = []
        held = 0

        def block_of(shard: int) -> pa.RecordBatch:
            control, data = encode_block(ranks[_ids(b"".join(each), width)])
            row = [[shard], [made], [ids], [[len(x) // width for x in each]], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=names)

        shard, width = 0, 4
        for batch in batches:
            for doc, x, s, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                x, shard, width = x.as_py(), s.as_py(), w.as_py()
                if each and held + len(x) > width * block:
                    yield block_of(shard)
                    ids, each, held, made = [], [], 0, made + 1
                ids.append(doc)
                each.append(x)
                held += len(x)
        if each:
            yield block_of(shard)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types
    ordered = common.in_order(tokens, "doc_id")
    ordered.select("doc_id", "ids", "shard", "width").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/shards")
    common.drop(tokens)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: per document doc_id, start, n_tokens, ids_crc32 (and its ids)."""
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    shards = spark.read.parquet(f"{path}/shards")
    sums = shards.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # Starts within a shard come from its own blocks; one row per shard is added up in one task.
    bases = common.before(sums.groupBy("shard").agg(F.sum("n").alias("n")), "n")
    from pyspark.sql.window import Window

    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("first", F.coalesce(F.sum("n").over(own), F.lit(0))).join(bases, "shard").select("shard", "block", (F.col("first") + F.col("base")).alias("base"))
    doc_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {doc_type}, within long, n_tokens long, ids_crc32 long, shard int, block long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                tokens = ids[decode_block(row["control"], row["data"], int(n.sum()))].astype("<u4")
                starts = np.cumsum(n) - n
                crc = [zlib.crc32(tokens[a : a + k]) for a, k in zip(starts.tolist(), n.tolist())]
                out = [row["doc_ids"], starts, n, crc, [row["shard"]] * len(n), [row["block"]] * len(n)]
                out += [[tokens[a : a + k].astype("i4") for a, k in zip(starts.tolist(), n.tolist())]] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types
    docs = shards.mapInArrow(run, schema).join(blocks, ["shard", "block"])
    more = ["ids"] if with_ids else []
    return docs.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *more)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """write() under the shared folder, then read()."""
    path = f"{common.shared_dir(docs.sparkSession)}/tokenfile-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    common._WRITTEN.append(path)
    return read(docs.sparkSession, path)
