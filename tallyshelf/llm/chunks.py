"""Documents packed into chunks of a few MB, and arrays sent between tasks as compressed rows.

Operators that compare every place of every text with all others work on arrays, many places at a
time. A chunk is a row that holds the texts of neighbouring rows; what a chunk has to say to the rest
goes out as one row for each bucket of hashes, already made distinct within the chunk.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import new_path

CHUNK_BYTES = 4 << 20
#: Input bytes for which there is one bucket.
BUCKET_BYTES = 8 << 20
#: Distinct segments under one anchor above which they are dealt out window by window.
CROWD = 2048

SCHEMA = "chunk bigint, ids array<bigint>, sizes array<bigint>, data binary, rest binary"
MESSAGE = "bucket bigint, chunk bigint, payload binary"


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def write_chunks(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Chunks of the documents, written to the shared folder and read back.

    ``sizes`` are bytes of UTF-8, -1 for a null text. With ``keep`` all columns ride along in ``rest``.
    A text longer than ``chunk_bytes`` makes a chunk of its own with what came before it.
    """
    id_field, text_field = f"`{id_col}`", f"`{text_col}`"
    narrow = documents.select(
        F.col(id_field).cast("bigint").alias("_id"), F.col(text_field).alias("_text"),
        *([F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("_rest")] if keep else []),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        ids, sizes, texts, held, rest = [], [], [], 0, []

        def row():
            nonlocal serial, held
            kept = b""
            if keep:
                table = pa.Table.from_batches([pa.RecordBatch.from_arrays([r], names=["rest"]) for r in rest])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                kept = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
            out = pa.RecordBatch.from_pydict({
                "chunk": pa.array([serial], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "data": pa.array([pack(b"".join(texts))], pa.binary()), "rest": pa.array([kept], pa.binary()),
            })
            serial += 1
            ids.clear(), sizes.clear(), texts.clear(), rest.clear()
            held = 0
            return out

        for batch in batches:
            begin = 0
            for i, (ident, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(ident)
                sizes.append(len(data) if text.is_valid else -1)
                texts.append(data)
                held += len(data) + 32
                if held >= chunk_bytes:
                    if keep:
                        rest.append(batch.column(2).slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield row()
            if keep and begin < batch.num_rows:
                rest.append(batch.column(2).slice(begin))
        if ids:
            yield row()

    path = new_path(documents.sparkSession, "chunks")
    (narrow.mapInArrow(run, SCHEMA).write.option("compression", "none")
     .option("parquet.block.size", 16 << 20).parquet(path))
    return documents.sparkSession.read.schema(SCHEMA).parquet(path)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every field allowed to be null."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(_nullable(kind.key_type), _nullable(kind.item_type))
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    return kind


def rest_of(blob: bytes) -> pa.ChunkedArray:
    """The other columns of a chunk's rows, as structs whose fields may all be null."""
    rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().column("rest")
    return rest.cast(_nullable(rest.type))


def buckets_for(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets the chunks' total size asks for."""
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + F.greatest(b, F.lit(0)))
    total = chunks.agg(F.sum(size)).first()[0]
    return max(1, -(-(total or 0) // bucket_bytes))


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Buckets of 64-bit hashes: ranges of their leading bits, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def cuts(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) of sorted bucket numbers."""
    if len(buckets):
        edge = np.flatnonzero(np.diff(buckets)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(buckets)]):
            yield int(buckets[lo]), slice(lo, hi)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, chunk, payload = zip(*rows) if rows else ((), (), ())
    return pa.table({
        "bucket": pa.array(bucket, pa.int64()), "chunk": pa.array(chunk, pa.int64()),
        "payload": pa.array(payload, pa.binary()),
    })


def per_chunk(
    chunks: DataFrame, mailbox: DataFrame, run: Callable[[dict, list[bytes]], pa.Table], schema: str
) -> DataFrame:
    """``run(chunk, payloads sent to it)`` for every chunk; without messages the list is empty."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        sent = right.column("payload").to_pylist()
        return pa.concat_tables([run(row, sent) for row in left.to_pylist()])

    letters = mailbox.select("chunk", "payload").groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(letters).applyInArrow(both, schema)


def each_chunk(
    chunks: DataFrame, run: Callable[[dict], pa.Table], schema: str
) -> DataFrame:
    """``run(chunk)`` for every chunk."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(batch.slice(i, 1).to_pylist()[0]).to_batches()

    return chunks.mapInArrow(all_of, schema)


def per_bucket(mailbox: DataFrame, run: Callable[[int, list[tuple[int, bytes]]], list]) -> DataFrame:
    """``run(bucket, [(chunk, payload)])`` for every bucket gives the messages that go back."""

    def bucket(table: pa.Table) -> pa.Table:
        sent = list(zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist()))
        return messages(run(table.column("bucket")[0].as_py(), sent))

    return mailbox.groupBy("bucket").applyInArrow(bucket, MESSAGE)


def is_in(values: np.ndarray, sorted_names: np.ndarray) -> np.ndarray:
    if not len(sorted_names):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_names, values), len(sorted_names) - 1)
    return sorted_names[at] == values


def codes_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Bucket and last 32 bits of 64-bit keys. Few keys of a bucket share a code, however many buckets."""
    return (bucket_of(keys, count).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _counted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a message of ``keys_elsewhere`` and the number of segments of each."""
    many = int(np.frombuffer(blob[:4], np.uint32)[0])
    parts = np.frombuffer(blob[4:], np.uint32)
    codes = parts[2 * many:]
    counts = np.ones(len(codes), np.int64)
    counts[parts[:many]] = parts[many:2 * many]
    return codes, counts


def _shared(bucket: int, sent: list[tuple[int, bytes]], crowd: int) -> list[tuple[int, int, bytes]]:
    keys = [_counted(blob) for _, blob in sent]
    names, inverse, chunks = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True, return_counts=True)
    total = np.bincount(inverse, np.concatenate([n for _, n in keys]), len(names))
    crowded = names[(chunks > 1) & (total > crowd)]
    names = names[chunks > 1]
    found = [(sender, own[is_in(own, names)]) for (sender, _), (own, _) in zip(sent, keys)]
    return [
        (0, sender, np.concatenate([np.array([bucket, len(full)], np.uint32), full, own]).tobytes())
        for sender, own in found if len(own) for full in [own[is_in(own, crowded)]]
    ]


def keys_elsewhere(
    chunks: DataFrame, segments_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], count: int, crowd: int
) -> DataFrame:
    """Messages to each chunk: which codes of its keys other chunks have too, for ``sent_codes``.

    ``segments_of`` gives (key, content) of the chunk's segments. Codes that have more than ``crowd``
    distinct segments, chunk by chunk, are crowded; every chunk that has one is told so.
    """

    def keys(chunk: dict) -> pa.Table:
        key, content = segments_of(chunk)
        key = key[np.unique(content, return_index=True)[1]]
        names, counts = np.unique(codes_of(key, count), return_counts=True)
        buckets, short = (names >> np.uint64(32)).astype(np.int64), names.astype(np.uint32)
        rows = []
        for b, s in cuts(buckets):
            many = np.flatnonzero(counts[s] > 1).astype(np.uint32)
            sizes = counts[s][many].astype(np.uint32)
            head = np.array([len(many)], np.uint32)
            rows.append((b, chunk["chunk"], np.concatenate([head, many, sizes, short[s]]).tobytes()))
        return messages(rows)

    return per_bucket(each_chunk(chunks, keys, MESSAGE), lambda bucket, sent: _shared(bucket, sent, crowd))


def sent_codes(sent: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes from the messages of ``keys_elsewhere``: all of them, and the crowded ones."""
    every, full = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for blob in sent:
        part = np.frombuffer(blob, np.uint32).astype(np.uint64)
        codes = (part[0] << np.uint64(32)) | part[2:]
        every.append(codes[int(part[1]):])
        full.append(codes[:int(part[1])])
    return np.sort(np.concatenate(every)), np.sort(np.concatenate(full))


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first to its last, one run after the other."""
    width = last - first + 1
    return np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width - first, width)


def runs_of(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the spans that windows with these starts cover, windows in a row taken together."""
    starts = np.unique(starts)
    border = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, border + 1)[:len(starts)]], starts[np.append(border, len(starts) - 1)[:len(starts)]] + window


def _widths(bucket: int, sent: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    keys = [np.frombuffer(blob, np.uint32) for _, blob in sent]
    names, counts = np.unique(np.concatenate(keys), return_counts=True)
    names, width = names[counts > 1], bits_of(counts[counts > 1])
    head = np.uint32(bucket).tobytes()
    out = []
    for (sender, _), own in zip(sent, keys):
        shared = is_in(own, names)
        spread = width[np.searchsorted(names, own[shared])]
        out.append((0, sender, head + np.packbits(shared).tobytes() + spread.tobytes()))
    return out


def bits_of(counts: np.ndarray) -> np.ndarray:
    """The number of bits of each positive count."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def widths_elsewhere(chunks: DataFrame, codes: Callable[[dict], np.ndarray]) -> DataFrame:
    """Messages to each chunk, for ``sent_widths``: how many chunks have each of its sorted distinct codes."""

    def keys(chunk: dict) -> pa.Table:
        names = codes(chunk)
        buckets, short = (names >> np.uint64(32)).astype(np.int64), names.astype(np.uint32)
        return messages([(b, chunk["chunk"], short[s].tobytes()) for b, s in cuts(buckets)])

    return per_bucket(each_chunk(chunks, keys, MESSAGE), _widths)


def sent_widths(names: np.ndarray, sent: list[bytes]) -> np.ndarray:
    """Bits of the number of chunks that have each of the chunk's sorted distinct codes, 0 if no other has it.

    All chunks get the same answer for a code.
    """
    out = np.zeros(len(names), np.uint8)
    slices = dict(cuts((names >> np.uint64(32)).astype(np.int64)))
    for blob in sent:
        own = slices[int(np.frombuffer(blob[:4], np.uint32)[0])]
        many = own.stop - own.start
        flags = np.frombuffer(blob[4:4 + -(-many // 8)], np.uint8)
        shared = np.flatnonzero(np.unpackbits(flags, count=many)) + own.start
        out[shared] = np.frombuffer(blob[4 + len(flags):], np.uint8)
    return out


NO_ID = np.int64(-(2**63))  # a null id comes before all others


def chunk_ids(chunk: dict) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in chunk["ids"]], np.int64)


def chunk_bytes_of(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their sizes); null texts have none."""
    return np.frombuffer(unpack(chunk["data"])[0], np.uint8), np.maximum(np.array(chunk["sizes"], np.int64), 0)


def rows_table(rows: list[tuple], ddl: str) -> pa.Table:
    """Rows as a table of the named types."""
    kinds = {
        "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary(),
        "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(),
    }
    columns = [c.split() for c in ddl.split(", ")]
    data = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table({name: pa.array(list(d), kinds[kind]) for (name, kind), d in zip(columns, data)})
