"""Encoding a corpus with a public byte-level BPE by content-defined chunk reuse (problem 7).

Texts are cut into chunks where the content says so: before line breaks, and inside lines where a
rolling hash of the last bytes hits. Equal chunks, wherever they occur, are encoded once per Python
worker (a dictionary of bounded size is kept over all batches of the worker) and reused. A cut is
exact where the tokenizer's splitting pattern must break in any context: between a non-space
character and an ASCII space character, since no alternative of the pattern runs from a non-space
into a space, and none looks behind. A hash hit elsewhere moves to the exact points on both sides of it,
unless these lie more than LONG bytes apart; then the cut stays, and its join is repaired: a window from the last sure
split before it is encoded again, and grows until it splits where the chunk behind the join does, from where on
that chunk's tokens hold. The result equals encoding each text whole.

Nothing is shuffled: the corpus is read, encoded and written where it lies.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import ship

TOKENIZER = "byte_bpe_50k"
#: Length in bytes of the rolling window, and bits of the hash that must be zero at a cut.
WINDOW, CUT_BITS = 8, 6
#: A stretch without exact points is cut within if it is longer.
LONG = 64
#: A split is sure if so many characters follow it: the pattern looks no farther.
LOOK = 4
#: When the dictionary holds so many chunks or tokens, the most used chunks stay, up to half of that; this bounds memory, never results.
MAX_CHUNKS, MAX_TOKENS = 1 << 18, 1 << 22

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EDGE = _SPACE.tolist()
_LOADED: dict[str, Encoder] = {}


def rank_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def strings(texts: pa.Array) -> list[str | None]:
    """The texts as Python strings; bytes that are no UTF-8 become replacement characters."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


def _after_nonspace(b: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is not white space, non-ASCII spaces included."""
    one = np.concatenate(([0], b[:-1]))
    two = np.concatenate(([0, 0], b[:-2]))[: len(b)]
    space = _SPACE[b] | ((b >= 0x1C) & (b <= 0x1F))
    space |= (one == 0xC2) & ((b == 0x85) | (b == 0xA0))
    space |= (two == 0xE1) & (one == 0x9A) & (b == 0x80)
    space |= (two == 0xE2) & (one == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF))
    space |= ((two == 0xE2) & (one == 0x81) & (b == 0x9F)) | ((two == 0xE3) & (one == 0x80) & (b == 0x80))
    return ~space


def segments(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions at which the bytes ``b`` of texts beginning at ``starts`` are cut, whether each is exact)."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    exact = np.zeros(len(b), bool)
    exact[1:] = _after_nonspace(b)[:-1] & _SPACE[b[1:]]
    exact[starts[starts < len(b)]] = True
    gear = _GEAR[b]
    rolling = gear.copy()
    for k in range(1, WINDOW):
        rolling[k:] += gear[:-k] << np.uint32(k)
    hit = np.zeros(len(b), bool)
    hit[1:] = (rolling[:-1] >> np.uint32(32 - CUT_BITS)) == 0  # a cut after the byte that completes the hash
    line = exact & ((b == 10) | (b == 13))
    points = np.append(np.flatnonzero(exact), len(b))
    joins = np.flatnonzero(hit & ~exact)
    around = np.searchsorted(points, joins)
    before, after = points[around - 1], points[around]
    cut = line | (hit & exact)
    cut[before] = True
    cut[after[after < len(b)]] = True
    cut[starts[starts < len(b)]] = True
    cut[joins[(after - before > LONG) & ((b[joins] & 0xC0) != 0x80)]] = True
    at = np.flatnonzero(cut)
    return at, exact[at]


def _stretches(exact: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of an exact cut and the inexact ones after it."""
    inexact = np.flatnonzero(~exact)
    if not len(inexact):
        return []
    firsts = inexact[np.concatenate(([True], np.diff(inexact) > 1))] - 1
    lasts = inexact[np.concatenate((np.diff(inexact) > 1, [True]))] + 1
    return list(zip(firsts.tolist(), lasts.tolist()))


@dataclass
class Encoder:
    """A worker's tokenizer with its dictionary of encoded chunks."""

    path: str
    chunks: dict[bytes, int] = field(default_factory=dict)
    seen: int = 0
    encoded: int = 0
    repaired: int = 0

    def __post_init__(self) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(self.path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            self.width[n] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.chunks.clear()
        self.pool, self.at = [np.zeros(0, np.int32)], 0
        self.begin, self.count, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Keep the most used chunks, up to half of the limits; uses count less from now on."""
        order = np.argsort(-self.uses, kind="stable")[: MAX_CHUNKS // 2]
        order = order[np.cumsum(self.count[order]) <= MAX_TOKENS // 2]
        order = order[self.uses[order] > 1]
        texts = dict(zip(self.chunks.values(), self.chunks))
        count, begin = self.count[order], self.begin[order]
        total = np.cumsum(count)
        pool = np.concatenate(self.pool)[np.repeat(begin - total + count, count) + np.arange(total[-1] if len(total) else 0)]
        kept = [texts[i] for i in order.tolist()]
        uses = self.uses[order] // 2
        self._clear()
        self.chunks.update(zip(kept, range(len(kept))))
        self.pool, self.at = [pool], len(pool)
        self.begin, self.count, self.uses = total - count, count, uses

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode the chunks ``fresh``; those that begin and end at exact points are encoded in one go."""
        inner, apart = [], []
        for c in fresh:
            (inner if _EDGE[c[0]] and (32 < c[-1] < 128 or c[-1] > 127 and not c[-4:].decode(errors="ignore")[-1:].isspace()) else apart).append(c)
        counts: list[int] = []
        tokens = []
        for at in range(0, len(inner), 1 << 14):
            part = inner[at : at + (1 << 14)]
            ids = self.bpe.encode_to_numpy(b"".join(part).decode(), disallowed_special=()).astype(np.int32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(c) for c in part])) + 1
            counts += np.diff(ends, prepend=0).tolist()
            tokens.append(ids)
        for ids in self.bpe.encode_ordinary_batch([c.decode() for c in apart], num_threads=1) if apart else []:
            counts.append(len(ids))
            tokens.append(np.array(ids, np.int32))
        first, sizes = len(self.begin), np.array(counts, np.int64)
        self.begin = np.concatenate((self.begin, self.at + np.cumsum(sizes) - sizes))
        self.count = np.concatenate((self.count, sizes))
        self.uses = np.concatenate((self.uses, np.zeros(len(sizes), np.int64)))
        self.at += int(sizes.sum())
        self.chunks.update(zip((*inner, *apart), range(first, first + len(fresh))))
        self.pool += tokens
        self.encoded += len(fresh)

    def _tokens(self, piece: bytes) -> np.ndarray:
        k = self.chunks[piece]
        return self.pool[0][self.begin[k] : self.begin[k] + self.count[k]]

    def _splits(self, data: bytes) -> list[int]:
        """The ends in bytes of what the pattern splits ``data`` into."""
        return np.cumsum([len(m.encode()) for m in self.pattern.findall(data.decode())], dtype=np.int64).tolist()

    def _sure(self, data: bytes, splits: list[int]) -> list[int]:
        """Those of ``splits`` that stay whatever follows ``data``."""
        return [e for e in splits if len(data[e : e + 4 * LOOK].decode(errors="ignore")) >= LOOK]

    def _split_tokens(self, data: bytes, splits: list[int]) -> list[int]:
        return [t for s, e in zip([0, *splits], splits) for t in self.bpe.encode_ordinary(data[s:e].decode())]

    def joined(self, pieces: list[bytes]) -> np.ndarray:
        """The tokens of neighbouring pieces as one text that begins and ends at exact points, from the tokens of each.

        At a join a window is encoded again: it begins at the last sure split of what is done, and takes in as much of
        the next piece as it needs to split at a sure split of that piece; from there on both would go on alike.
        """
        done, ids = pieces[0], self._tokens(pieces[0]).tolist()
        splits = self._splits(done)
        for at, piece in enumerate(pieces[1:], 2):
            self.repaired += 1
            start = max((e for e in self._sure(done, splits)), default=0)
            tail = done[start:]
            own = self._splits(piece)
            reliable = {0, *(own if at == len(pieces) else self._sure(piece, own))}
            width, agreed, ends = LONG // 4, None, []
            while agreed is None:
                width *= 2
                end = min(width, len(piece))
                while end < len(piece) and piece[end] & 0xC0 == 0x80:
                    end += 1
                window = tail + piece[:end]
                ends = self._splits(window)
                sure = ends if at == len(pieces) and end == len(piece) else self._sure(window, ends)
                agreed = next((e for e in sure if e >= len(tail) and e - len(tail) in reliable), None)
                if agreed is None and end == len(piece):  # nothing of the piece's tokens holds
                    agreed = len(window)
            inner = [e for e in ends if e <= agreed]
            taken = np.cumsum(self.width[ids])
            rest = self._tokens(piece)
            skip = int(np.searchsorted(np.cumsum(self.width[rest]), agreed - len(tail), side="right"))
            ids = ids[: int(np.searchsorted(taken, start, side="right"))] + self._split_tokens(window, inner) + rest[skip:].tolist()
            splits = [e for e in splits if e <= start] + [start + e for e in inner] + [len(done) + e for e in own if len(tail) + e > agreed]
            done += piece
        return np.array(ids, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per text, all tokens in order) of a string array; null and empty texts have none."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        data = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        raw = bytes(data)
        try:
            raw.decode()
        except UnicodeDecodeError:  # a string column may hold any bytes
            return self.encode(pa.array(strings(texts), pa.large_string()))
        cuts, exact = segments(np.frombuffer(data, np.uint8), offsets[:-1])
        cuts, exact = self._safe(raw, cuts, exact)
        ends = np.append(cuts[1:], len(raw))
        pieces = [raw[s:e] for s, e in zip(cuts.tolist(), ends.tolist())]
        if len(self.chunks) > MAX_CHUNKS or self.at > MAX_TOKENS:
            self._shrink()
        known = self.chunks
        if fresh := list(dict.fromkeys(p for p in pieces if p not in known)):
            self._learn(fresh)
        self.seen += len(pieces)
        no = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        self.uses += np.bincount(no, minlength=len(self.uses))
        begin, count = self.begin[no], self.count[no]
        self.pool = [np.concatenate(self.pool)]
        pool, extra, at = self.pool[0], [], len(self.pool[0])
        for first, last in _stretches(exact):  # the tokens of the whole stretch stand in the place of its first piece
            ids = self.joined(pieces[first:last])
            begin[first], count[first] = at, len(ids)
            count[first + 1 : last] = 0
            at += len(ids)
            extra.append(ids)
        total = np.concatenate(([0], np.cumsum(count)))
        ids = np.concatenate((pool, *extra))[np.repeat(begin - total[:-1], count) + np.arange(total[-1])] if extra else pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return np.diff(total[np.searchsorted(cuts, offsets)]), ids

    def _safe(self, raw: bytes, cuts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop inexact cuts from stretches with characters younger than Unicode 3.2, whose class libraries may not agree on."""
        if exact.all():
            return cuts, exact
        keep = np.ones(len(cuts), bool)
        bounds = np.append(cuts, len(raw))
        for first, last in _stretches(exact):
            if any(c > "\x7f" and unicodedata.ucd_3_2_0.category(c) == "Cn" for c in raw[bounds[first] : bounds[last]].decode()):
                keep[first + 1 : last] = False
        return cuts[keep], exact[keep]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file, with the chunks it has met so far."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def token_ids(documents: DataFrame, text: str = "text", id_: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens; one row per input row.

    Bytes that are no UTF-8 count as replacement characters. Null and empty texts give an empty list; blank texts are encoded as they are; repeated rows and
    null ids stay as they are. ``path`` is the rank file of a byte-level BPE with the public pattern.
    """
    ship(documents.sparkSession)
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.llm.tokenize import encoder  # the worker's own copy keeps its dictionary

        for batch in batches:
            counts, ids = encoder(path).encode(batch.column(1))
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[id_, "ids"])

    kind = documents.schema[id_].dataType.simpleString()
    return documents.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``tokens``, the number of token ids of the text."""
    ship(documents.sparkSession)
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.llm.tokenize import encoder

        for batch in batches:
            counts, _ = encoder(path).encode(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, text).mapInArrow(run, f"{kinds}, tokens long")


def reuse(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row: texts, chunks met, chunks encoded and joins repaired when encoding the table; it depends on how workers share it."""
    ship(documents.sparkSession)
    path = path or rank_file()
    names = ["texts", "chunks", "encoded", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.llm.tokenize import encoder

        e = encoder(path)
        for batch in batches:
            before = e.seen, e.encoded, e.repaired
            e.encode(batch.column(0))
            made = (batch.num_rows, *(n - b for n, b in zip((e.seen, e.encoded, e.repaired), before)))
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in made], names=names)

    each = documents.select(text).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in names])
