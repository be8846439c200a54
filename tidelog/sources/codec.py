"""The binary formats of log segments and sorted tables."""

from __future__ import annotations

import bisect
import io
import struct
from collections.abc import Collection, Iterable, Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.functions import hashing
from tidelog.schema import DEL, PUT, Corruption, InvalidArgument
from tidelog.sources import files

# Segment header, record layout and limits of the formats.
MAGIC, VERSION = 0x4C534D57, 1
SEGMENT_HEADER = struct.Struct("<IB3x")
RECORD = struct.Struct("<BQIII")
#: A record's head by its fields, the lengths of key and value in it, and how much of it the checksum covers.
HEAD = np.dtype([("first", "u1"), ("seq", "<u8"), ("key", "<u4"), ("value", "<u4"), ("crc", "<u4")])
KEY_VALUE, COVERED = struct.Struct("<II"), 17
INDEX_ENTRY, OFFSET, FOOTER = struct.Struct("<I"), struct.Struct("<Q"), struct.Struct("<QQ")
MAX_PAYLOAD = 64 << 20

#: So much of a file is held in memory when its records are streamed.
CHUNK = 4 << 20


def check_record(op: int, seq_no: int, key: bytes | None, value: bytes | None) -> None:
    """Raise InvalidArgument for a record that may not be written."""
    if op not in (PUT, DEL) or not key or (op == DEL and value) or not 0 <= seq_no < 1 << 63:
        raise InvalidArgument(f"record op {op}, seq_no {seq_no}")
    if len(key) + len(value or b"") > MAX_PAYLOAD:
        raise InvalidArgument("payload over 64 MiB would not be readable again")


def encode(rows: Iterable[tuple[int, int, bytes, bytes | None]]) -> list[bytes]:
    """Records (first byte, seq_no, key, value) with their CRC-32C, which covers all but itself."""
    rows = list(rows)
    data, start, lengths = encode_columns(*_arrays(rows))
    raw = data.tobytes()
    return [raw[at : at + n] for at, n in zip(start.tolist(), lengths.tolist())]


def _arrays(rows: list[tuple[int, int, bytes, bytes | None]]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    first, seq, key, value = zip(*rows) if rows else ((),) * 4
    return np.array(first, np.uint8), np.array(seq, np.uint64), pa.array(key, pa.large_binary()), pa.array(value, pa.large_binary())


def encode_columns(first: np.ndarray, seq: np.ndarray, key: pa.Array, value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bytes of all records, where each starts, their lengths); key and value are of type large_binary, a null value has no bytes."""
    if key.null_count:
        raise InvalidArgument("a record without a key")
    value = value.fill_null(b"")
    head = np.zeros(len(first), HEAD)
    head["first"], head["seq"] = first, seq
    head["key"], head["value"] = (pc.binary_length(c).to_numpy(zero_copy_only=False) for c in (key, value))
    lengths = RECORD.size + head["key"].astype(np.int64) + head["value"]
    raw = head.view(np.uint8).reshape(-1)
    heads = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(np.arange(len(head) + 1) * RECORD.size), pa.py_buffer(raw)])
    records = pc.binary_join_element_wise(heads, key, value, pa.scalar(b"", pa.large_binary()))
    start = np.cumsum(lengths) - lengths
    data = np.frombuffer(records.buffers()[2] or b"", np.uint8, lengths.sum()).copy()
    crc = np.ascontiguousarray(checksums(data, start, lengths)).view(np.uint8).reshape(-1, 4)
    data[start[:, None] + np.arange(COVERED, RECORD.size)] = crc
    return data, start, lengths


def checksums(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32C that each of those records should have."""
    c = hashing.crc32c_more(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, np.full(len(start), COVERED))
    return ~hashing.crc32c_more(c, data, start + RECORD.size, lengths - RECORD.size)


def record_columns(data: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(where the whole records start that begin at ``at``, their heads, which are checked, and where they end)."""
    start, unpack, last = [], KEY_VALUE.unpack_from, len(data) - RECORD.size
    while at <= last:
        k, v = unpack(data, at + 9)
        if k + v > MAX_PAYLOAD:
            raise Corruption(f"payload of {k + v} bytes")
        end = at + RECORD.size + k + v
        if end > len(data):
            break
        start.append(at)
        at = end
    raw, start = np.frombuffer(data, np.uint8), np.array(start, np.int64)
    head = raw[start[:, None] + np.arange(RECORD.size)].view(HEAD).reshape(-1)
    wrong = checksums(raw, start, RECORD.size + head["key"].astype(np.int64) + head["value"]) != head["crc"]
    if wrong.any():
        raise Corruption(f"checksum of the record with seq_no {head['seq'][wrong][0]}")
    if (beyond := head["seq"] >= 1 << 63).any():
        raise Corruption(f"seq_no {head['seq'][beyond][0]} is beyond a signed 64-bit number")
    return start, head, at


def _rows(data: bytes, start: np.ndarray, head: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    key = start + RECORD.size
    value = key + head["key"]
    places = zip(key.tolist(), value.tolist(), (value + head["value"]).tolist())
    return [(first, seq, data[k:v], data[v:e]) for first, seq, (k, v, e) in zip(head["first"].tolist(), head["seq"].tolist(), places)]


def stream_columns(file, length: int, torn_tail: bool = False, chunk: int = CHUNK) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, where records start in them, their heads) of the next ``length`` bytes of an open file, a chunk of it in memory at a time.

    A torn last record ends it if ``torn_tail``, and is Corruption otherwise.
    """
    held = b""
    while length > 0:
        data = file.read(min(chunk, length))
        if not data:
            raise Corruption("the file is shorter than it was")
        length -= len(data)
        held += data
        start, head, used = record_columns(held)
        yield held, start, head
        held = held[used:]
    if held and not torn_tail:
        raise Corruption(f"record cut off, {len(held)} bytes left")


def decode_stream(file, length: int, torn_tail: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The records as of ``stream_columns``."""
    for data, start, head in stream_columns(file, length, torn_tail, chunk):
        yield from _rows(data, start, head)


def decode(data: bytes, torn_tail: bool = False) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The records in ``data``, as decode_stream."""
    return decode_stream(io.BytesIO(data), len(data), torn_tail)


def segment_ids(folder: str) -> list[int]:
    """The numbers of the log segments in ``folder``, ascending; other files are ignored."""
    stems = [n.removesuffix(".wal") for n in files.names(folder) if n.endswith(".wal")]
    return sorted(int(s) for s in stems if s.isascii() and s.isdigit() and int(s) > 0)


def segment_path(folder: str, number: int) -> str:
    return f"{str(folder).rstrip('/')}/{number:06d}.wal"


def stream_segment(path: str, torn_tail: bool = False) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(op, seq_no, key, value) of one segment; the file is never changed."""
    size = files.size(path)
    with files.open_read(path) as f:
        head = f.read(SEGMENT_HEADER.size)
        if len(head) < SEGMENT_HEADER.size:
            raise Corruption(f"{path}: smaller than a header")
        magic, version = SEGMENT_HEADER.unpack(head)
        if magic != MAGIC or version != VERSION:
            raise Corruption(f"{path}: magic {magic:x}, version {version}")
        for op, seq, key, value in decode_stream(f, size - SEGMENT_HEADER.size, torn_tail):
            if op not in (PUT, DEL) or not key or (op == DEL and value):
                raise Corruption(f"{path}: invalid record with seq_no {seq}")
            yield op, seq, key, None if op == DEL else value


def read_segment(path: str, torn_tail: bool = False) -> list[tuple[int, int, bytes, bytes | None]]:
    return list(stream_segment(path, torn_tail))


class SegmentWriter:
    """Appends records as new segments of ``folder``, a new one whenever the next record would pass ``roll_bytes``."""

    def __init__(self, folder: str, roll_bytes: int = 64 << 20, first: int | None = None):
        self.folder, self.roll_bytes, self.made = folder, roll_bytes, []
        self.number = max(segment_ids(folder), default=0) if first is None else first - 1
        self.out, self.size = None, 0

    def write(self, rows: Sequence[tuple[int, int, bytes, bytes | None]]) -> None:
        for r in rows:
            check_record(*r)
        for record in encode(rows):
            if self.out is None or (self.size > SEGMENT_HEADER.size and self.size + len(record) > self.roll_bytes):
                self.close()
                self.number += 1
                self.made.append(self.number)
                self.out = files.open_write(segment_path(self.folder, self.number))
                self.size = self.out.write(SEGMENT_HEADER.pack(MAGIC, VERSION))
            self.size += self.out.write(record)

    def close(self) -> None:
        if self.out:
            self.out.close()
        self.out = None


def batched(rows: Iterable, n: int = 1024) -> Iterator[list]:
    it = iter(rows)
    while part := list(islice(it, n)):
        yield part


def write_segments(folder: str, rows: Iterable[tuple[int, int, bytes, bytes | None]], roll_bytes: int = 64 << 20) -> list[int]:
    """Append records as new segments; their numbers."""
    files.make_folder(folder)
    w = SegmentWriter(folder, roll_bytes)
    try:
        for part in batched(rows):
            w.write(part)
    finally:
        w.close()
    return w.made


def bloom_bytes(keys: list[bytes], fp_rate: float) -> bytes:
    """The Bloom filter of a table's keys as stored in its file."""
    return bloom_of_hashes(*hashing.bloom_hashes(keys), fp_rate)


def bloom_of_hashes(h1: np.ndarray, h2: np.ndarray, fp_rate: float) -> bytes:
    n = max(1, len(h1))
    m = max(64, int(np.ceil(-n * np.log(fp_rate) / (np.log(2) * np.log(2)))))
    m = -(-m // 8) * 8
    k = max(1, int(np.floor(m / n * np.log(2) + 0.5)))
    cells = np.zeros(m, np.uint8)
    with np.errstate(over="ignore"):
        for i in range(k):
            cells[(h1 + np.uint64(i) * h2) % np.uint64(m)] = 1
    return struct.pack("<QQ", m, k) + np.packbits(cells, bitorder="little").tobytes()


def write_table(path: str, entries: Iterable[tuple[bytes, bytes | None, int, bool]], block_size: int = 8192, fp_rate: float = 0.01) -> int:
    """One sorted table from (key, value, seq_no, tombstone); written aside and renamed. Returns its size."""
    rows = sorted(entries, key=lambda e: e[0])
    return write_records(path, [encode_columns(*_arrays([(int(t), s, k, None if t else v) for k, v, s, t in rows]))], block_size, fp_rate)


def write_records(path: str, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block_size: int = 8192, fp_rate: float = 0.01) -> int:
    """One table of records in key order, as of ``encode_columns``; written aside and renamed. Returns its size."""
    ends = np.cumsum(np.concatenate([lengths for _, _, lengths in parts])).tolist()
    keys = [(start + RECORD.size, data[start[:, None] + np.arange(9, 13)].view("<u4").reshape(-1).astype(np.int64)) for data, start, _ in parts]
    h1, h2 = (np.concatenate(h) for h in zip(*(hashing.bloom_hashes_at(data, at, n) for (data, _, _), (at, n) in zip(parts, keys))))
    firsts = np.cumsum([0, *(len(n) for _, n in keys)]).tolist()
    index, i = [], 0
    while i < len(ends):
        part = bisect.bisect_right(firsts, i) - 1
        at, n = (int(c[i - firsts[part]]) for c in keys[part])
        offset = ends[i - 1] if i else 0
        index.append(INDEX_ENTRY.pack(n) + parts[part][0][at : at + n].tobytes() + OFFSET.pack(offset))
        i = bisect.bisect_left(ends, offset + block_size, i) + 1
    blocks, data_end = b"".join(index), ends[-1] if ends else 0
    tail = blocks + bloom_of_hashes(h1, h2, fp_rate) + FOOTER.pack(data_end, data_end + len(blocks))
    with files.open_write(str(path) + ".tmp") as f:
        for data, start, lengths in parts:
            if len(start):
                f.write(data[start[0] : start[-1] + lengths[-1]])
        f.write(tail)
    files.move(str(path) + ".tmp", path)
    return data_end + len(tail)


class TableFile:
    """One table file, opened: its footer, block index and Bloom filter are read and checked; entries stay where they are.

    ``counters`` counts filter checks, filter skips and block reads of the lookups.
    """

    def __init__(self, path: str):
        self.path, self.file = str(path), files.open_read(path)
        self.counters = {"bloom_checks": 0, "bloom_skips": 0, "block_reads": 0}
        end = self.file.size() - FOOTER.size
        if end < 0:
            raise Corruption(f"{path}: too small")
        self.data_end, bloom_at = FOOTER.unpack(files.read_range(self.file, end, FOOTER.size))
        if not self.data_end <= bloom_at <= end:
            raise Corruption(f"{path}: footer offsets")
        self.bloom = files.read_range(self.file, bloom_at, end - bloom_at)
        self.m, self.k = struct.unpack_from("<QQ", self.bloom) if len(self.bloom) >= 16 else (0, 0)
        if self.m == 0 or self.m % 8 or self.k == 0 or len(self.bloom) - 16 != self.m // 8:
            raise Corruption(f"{path}: Bloom filter")
        self.index = self._index(files.read_range(self.file, self.data_end, bloom_at - self.data_end))

    def _index(self, raw: bytes) -> list[tuple[bytes, int]]:
        index, i = [], 0
        while i < len(raw):
            n = INDEX_ENTRY.unpack_from(raw, i)[0] if i + 4 <= len(raw) else len(raw)
            if i + 12 + n > len(raw):
                raise Corruption(f"{self.path}: index cut off")
            index.append((raw[i + 4 : i + 4 + n], OFFSET.unpack_from(raw, i + 4 + n)[0]))
            i += 12 + n
        if index and index[0][1] != 0:
            raise Corruption(f"{self.path}: index does not start at 0")
        for (k0, o0), (k1, o1) in zip(index, index[1:]):
            if k1 <= k0 or o1 <= o0:
                raise Corruption(f"{self.path}: index is not increasing")
        if index and index[-1][1] >= self.data_end:
            raise Corruption(f"{self.path}: index beyond the data")
        return index

    def scan(self) -> Iterator[tuple[bytes, bytes | None, int, bool]]:
        """Every (key, value, seq_no, tombstone) in key order, a chunk of the file in memory at a time."""
        self.file.seek(0)
        for flags, seq, key, value in decode_stream(self.file, self.data_end):
            yield key, None if flags & 1 else value, seq, bool(flags & 1)

    def maybe(self, key: bytes) -> bool:
        """Whether the filter lets the key pass."""
        h1, h2 = (int(h[0]) for h in hashing.bloom_hashes([key]))
        at = ((h1 + i * h2) % (1 << 64) % self.m for i in range(self.k))
        return all(self.bloom[16 + (p >> 3)] >> (p & 7) & 1 for p in at)

    def passing(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The places of the keys, given by their hashes as of ``bloom_hashes``, that the filter lets pass."""
        cells = np.unpackbits(np.frombuffer(self.bloom, np.uint8, offset=16), bitorder="little").view(bool)
        m, at = np.uint64(self.m), np.arange(len(h1))
        with np.errstate(over="ignore"):
            for i in range(self.k):
                if i:
                    h1 = h1 + h2
                kept = np.flatnonzero(cells[(h1 - h1 // m * m).view(np.int64)])  # 2.6 ns a key, 7.1 by %
                at, h1, h2 = at[kept], h1[kept], h2[kept]
        return at

    def find(self, keys: Collection[bytes]) -> dict[bytes, tuple[bytes, bytes | None, int, bool]]:
        """The entries of those ascending, distinct keys that the table holds: each block that may hold one is read once, adjoining ones together."""
        firsts, ends = [k for k, _ in self.index], [*(o for _, o in self.index), self.data_end]
        found, order = {}, list(keys)
        if len(order) < len(firsts):
            blocks = sorted({bisect.bisect_right(firsts, k) - 1 for k in order} - {-1})
        else:
            below = [*(bisect.bisect_left(order, k) for k in firsts), len(order)]
            blocks = [b for b in range(len(firsts)) if below[b] < below[b + 1]]
        for _, run in groupby(enumerate(blocks), lambda b: b[1] - b[0]):
            run = [b for _, b in run]
            self.file.seek(ends[run[0]])
            self._matching(ends[run[-1] + 1] - ends[run[0]], keys, found)
        return found

    def columns(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """(bytes, where records start in them, their heads) of every entry in key order, a chunk of the file in memory at a time."""
        self.file.seek(0)
        return stream_columns(self.file, self.data_end)

    def _matching(self, length: int, keys: Collection[bytes], found: dict) -> None:
        """Puts the first entry of each of those keys in the next ``length`` bytes into ``found``."""
        for data, start, head in stream_columns(self.file, length):
            at = start + RECORD.size
            for i, (k, v) in enumerate(zip(at.tolist(), (at + head["key"]).tolist())):
                if (key := data[k:v]) in keys and key not in found:
                    h = head[i]
                    tombstone = bool(h["first"] & 1)
                    found[key] = (key, None if tombstone else data[v : v + int(h["value"])], int(h["seq"]), tombstone)

    def get(self, key: bytes) -> tuple[bytes, bytes | None, int, bool] | None:
        """The entry of ``key``, read by the filter, the index and the one block that may hold it."""
        self.counters["bloom_checks"] += 1
        if not self.maybe(key):
            self.counters["bloom_skips"] += 1
            return None
        self.counters["block_reads"] += 1
        block = bisect.bisect_right(self.index, key, key=lambda e: e[0]) - 1
        if block < 0:
            return None
        start = self.index[block][1]
        end = self.index[block + 1][1] if block + 1 < len(self.index) else self.data_end
        for flags, seq, k, value in decode(files.read_range(self.file, start, end - start)):
            if k == key:
                return k, None if flags & 1 else value, seq, bool(flags & 1)
        return None

    def close(self) -> None:
        self.file.close()


def read_table(path: str) -> tuple[list[tuple[bytes, bytes | None, int, bool]], list[tuple[bytes, int]], bytes]:
    """(entries in key order, block index, Bloom bytes) of a table file; any inconsistency is Corruption."""
    t = TableFile(path)
    try:
        return list(t.scan()), t.index, t.bloom
    finally:
        t.close()
