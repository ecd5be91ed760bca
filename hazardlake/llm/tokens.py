"""Token ids of documents in files of patched frame-of-reference blocks.

Layout. A token file set is a Parquet folder; a row is a segment: consecutive documents in
ascending id, at least ``SEGMENT`` ids unless it ends a part. Columns: ``part`` and ``segment``
(order of the segment), ``before`` (ids of the part before the segment), ``doc_ids``, ``lengths``
(ids of each document, end id included) and ``payload``. A payload is, little-endian:

    u32 values, u32 blocks, u32 start of each block (bytes from the first block)
    per block of 128 values (the last is filled up with its minimum):
        u32 minimum, u8 width, u8 exceptions
        128 * width bits: value - minimum, lowest bit first; 0 for an exception
        per exception u8 position, then per exception u32 value - minimum

The width of a block is the smallest that holds the given percentile of its differences; what
needs more bits goes to the exception list. The block starts give access to any value without
reading what stands before it (``value_at``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlake.llm.words import hashes, slices

BLOCK = 128
SEGMENT = 1 << 15
#: Bytes of pieces and their ids that an encoder remembers before it forgets the rare ones.
REMEMBERED_BYTES = 32 << 20
#: Bytes that a piece takes besides its text and its ids, and of the longest that is remembered.
PIECE_BYTES, LONGEST = 48, 256
#: Bytes of text that are cut into pieces at once; a byte takes some 20 bytes meanwhile.
PIECES_BYTES = 1 << 20
#: Texts the tokenizer encodes at once; what it returns takes some hundred bytes an id.
TOGETHER = 16
#: How a byte-level BPE writes a space and a line end.
SPACE_MARK, LINE_MARK = "\u0120", "\u010a"

#: Kinds of bytes: 0 any other, 1 ASCII white space, 2 part of another character that some hold for white space.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[0x1C:0x20] = 2
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace() or c == "\u180e"]
_LEADS = np.zeros(256, bool)
_LEADS[[c[0] for c in _WIDE]] = True
#: Bytes that end a letter if ASCII, second bytes of a letter behind ``_LATIN`` (U+00C0 to U+027F), and ASCII signs.
_LETTER, _LATIN, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN[0xC3:0xCA] = True
_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        for c in _WIDE:
            at = lead[data[lead] == c[0]]
            for k in range(1, len(c)):
                at = at[at + k < len(data)]
                at = at[data[at + k] == c[k]]
            for k in range(len(c)):
                kind[at + k] = 2
    return kind


def _pick(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` values from each ``start`` on, one behind the other."""
    return values[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


class Encoder:
    """Ids of whole texts, with a memory of pieces.

    A byte-level BPE without normaliser first cuts a text: white space before a character
    other than white space is cut before its last character; a last character that is a space
    starts the next piece, any other stands alone. Nothing else joins white space to what
    stands before it, nor a letter to a sign behind it. So a text is cut there, and each
    distinct piece is encoded once. White space beside a character that tokenizers may or may
    not hold for white space is left uncut, and so are signs where a special token occurs.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that start with a space
        self.spaced[[i for w, i in self.tokenizer.get_vocab().items() if w.startswith(SPACE_MARK)]] = True
        self.line = np.arange(len(self.spaced)) == self.tokenizer.token_to_id(LINE_MARK)
        # Row 0 is the end of a document; ids of a row are flat[start: start + size], its piece is text[piece: next piece].
        self.flat, self.start, self.size = np.array([end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.text, self.piece = np.zeros(0, np.uint8), np.zeros(2, np.int64)
        self.seen = np.array([2])
        # Hashes of the pieces in order, and the row of each: arrays, since a dict of bytes takes three times the memory.
        self.rows, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _held(self) -> int:
        return len(self.text) + self.flat.nbytes + PIECE_BYTES * len(self.size)

    def _forget(self) -> None:
        """Keep the pieces that came more than once, of too many those that came most often."""
        named = np.zeros(len(self.size), bool)
        named[self.row] = True
        often = np.flatnonzero(named & (self.seen > 1))
        often = often[np.argsort(-self.seen[often], kind="stable")]
        cost = PIECE_BYTES + np.diff(self.piece)[often] + self.flat.itemsize * self.size[often]
        keep = np.append(0, np.sort(often[np.cumsum(cost) <= REMEMBERED_BYTES // 2]))
        row = np.zeros(len(named), np.int64)
        row[keep] = np.arange(len(keep))
        length = np.diff(self.piece)[keep]
        self.text, self.piece = _pick(self.text, self.piece[keep], length), np.append(0, np.cumsum(length))
        self.flat, self.size = _pick(self.flat, self.start[keep], self.size[keep]), self.size[keep]
        self.start = np.cumsum(self.size) - self.size
        kept = row[self.row] > 0
        self.rows, self.row = self.rows[kept], row[self.row[kept]]
        self.seen = np.where(np.arange(len(keep)) > 0, 0, 2)

    def _find(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rows of the pieces that start at ``at``, 0 for unknown ones. Of equal hashes the bytes are compared."""
        if not len(self.rows):
            return np.zeros(len(key), np.int64)
        place = np.minimum(np.searchsorted(self.rows, key), len(self.rows) - 1)
        row = np.where(self.rows[place] == key, self.row[place], 0)
        row[self.piece[row + 1] - self.piece[row] != size] = 0
        some = np.flatnonzero(row)
        if len(some):
            same = _pick(data, at[some], size[some]) == _pick(self.text, self.piece[row[some]], size[some])
            row[some[~np.logical_and.reduceat(same, np.cumsum(size[some]) - size[some])]] = 0
        return row

    def _learn(self, new: list[bytes]) -> None:
        """Rows for new pieces, and their ids.

        Pieces with no white space but a space in front are encoded many at a time, one behind
        the other: an id that starts with a space starts a piece. So are those with no white
        space at all, with a line end between each two. Others are encoded alone.
        """
        n, base = len(new), len(self.size)
        length = np.fromiter(map(len, new), np.int64, n)
        at = np.cumsum(length) - length
        data = np.frombuffer(b"".join(new), np.uint8)
        white = np.add.reduceat(_kinds(data) > 0, at, dtype=np.int64)
        spaced, bare = (white == 1) & (data[at] == 0x20) & (length > 1), white == 0
        self.start, self.size = np.append(self.start, np.zeros(n, np.int64)), np.append(self.size, np.zeros(n, np.int64))
        held, end, rest = [self.flat], len(self.flat), np.flatnonzero(~spaced & ~bare).tolist()
        for joint, marks, which in ((b"", self.spaced, spaced), (b"\n", self.line, bare)):
            which = np.flatnonzero(which).tolist()
            runs, texts = [], []
            for i in range(0, len(which), 1000):
                text = joint.join([new[j] for j in which[i: i + 1000]])
                if any(x in text for x in self.special):
                    rest += which[i: i + 1000]
                else:
                    runs.append(which[i: i + 1000])
                    texts.append(text.decode())
            for run, e in zip(runs, self._ids(texts)):
                cut = np.flatnonzero(marks[e])
                first = np.append(0, cut + 1) if joint else cut
                if len(first) != len(run):
                    raise ValueError("the tokenizer joins pieces across white space")
                row = np.array(run) + base
                self.start[row], self.size[row] = end + first, np.diff(first, append=len(e) + len(joint)) - len(joint)
                held.append(e)
                end += len(e)
        for i, e in zip(rest, self._ids([new[i].decode() for i in rest])):
            self.start[base + i], self.size[base + i] = end, len(e)
            held.append(e)
            end += len(e)
        self.flat = np.concatenate(held)
        self.seen = np.append(self.seen, np.zeros(n, np.int64))
        self.text, self.piece = np.append(self.text, data), np.append(self.piece, self.piece[-1] + at + length)

    def _name(self, row: np.ndarray, key: np.ndarray) -> None:
        """Let new rows be found by their hashes; of those with one hash only the first is."""
        key, one = np.unique(key, return_index=True)
        place = np.searchsorted(self.rows, key)
        free = place == len(self.rows)
        free[~free] = self.rows[place[~free]] != key[~free]
        self.rows = np.insert(self.rows, place[free], key[free])
        self.row = np.insert(self.row, place[free], row[one[free]])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for i in range(0, len(texts), TOGETHER)
                for e in self.tokenizer.encode_batch_fast(texts[i: i + TOGETHER], add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start, and the end of the last."""
        kind = _kinds(data)
        border = np.zeros(len(data) + 1, bool)
        border[at] = True
        white = np.flatnonzero(kind == 1)
        kind = np.append(kind, 0)  # at the end, and as what stands before the first
        first = white[border[white] | (kind[white - 1] != 1)]
        last = white[border[white + 1] | (kind[white + 1] != 1)]
        inner = ~border[last + 1]
        text = data.tobytes()
        special = any(x in text for x in self.special)
        if special:  # white space before a special token is the end of a text to the tokenizer
            inner &= ~np.isin(data[np.minimum(last + 1, len(data) - 1)], [x[0] for x in self.special])
        sure = (border[first] | (kind[first - 1] == 0)) & (~inner | (kind[last + 1] == 0))
        first, last = first[sure], last[sure & inner]
        cut = border
        if not special:
            sign = np.flatnonzero(_SIGN[data[1:]]) + 1
            before = data[sign - 1]
            # Of U+00C0 to U+027F only the signs of multiplication and division are no letters.
            wide = (before >= 0x80) & _LATIN[data[sign - 2]] & (sign > 1) & ~((data[sign - 2] == 0xC3) & ((before == 0x97) | (before == 0xB7)))
            cut[sign[_LETTER[before] | wide]] = True
        cut[first] = True
        cut[last] = True
        cut[last[data[last] != 0x20] + 1] = True
        return np.flatnonzero(cut)

    def _rows(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """Row of each of distinct pieces; what is not known is learned."""
        row = np.zeros(len(pieces), np.int64)
        if not len(row):
            return row
        at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset: pieces.offset + len(pieces) + 1]
        data, size = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(at)
        short = np.flatnonzero(size <= LONGEST)
        key = hashes(data, at[short], at[short + 1])
        row[short] = self._find(data, at[short], size[short], key)
        new = np.flatnonzero(row == 0)
        if len(new):
            row[new] = len(self.size) + np.arange(len(new))
            unnamed = row[short] >= len(self.size)
            self._learn(pieces.take(pa.array(new)).to_pylist())
            self._name(row[short[unnamed]], key[unnamed])
        return row

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids per text."""
        raw = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), at)

    def encode_bytes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts in UTF-8, the i-th being ``data[at[i]: at[i + 1]]``."""
        if self._held() > REMEMBERED_BYTES:
            self._forget()
        n = len(at) - 1
        cut = self._cuts(data, at) if len(data) else np.zeros(1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)]).dictionary_encode()
        known = self._rows(pieces.dictionary)
        which = pieces.indices.to_numpy()
        self.seen[known] += np.bincount(which, minlength=len(known))
        row = np.zeros(len(which) + n, np.int64)
        behind = np.searchsorted(cut, at[1:]) + np.arange(n)  # places of the end ids
        inside = np.ones(len(row), bool)
        inside[behind] = False
        row[inside] = known[which]
        size = self.size[row]
        total = np.cumsum(size)[behind]
        return _pick(self.flat, self.start[row], size), np.diff(total, prepend=0)


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker process: a task goes on with the words that earlier tasks learned."""
    return Encoder(path, end_id)


def pack(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Payload of a segment."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(2, "<u4").tobytes()
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = np.minimum(full.min(axis=1), np.uint32(ids[-1]))
    tail = n - (blocks - 1) * BLOCK
    low[-1] = full[-1, :tail].min()
    full[-1, tail:] = low[-1]
    diff = full - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    bound = np.partition(diff, at, axis=1)[:, at]
    width = np.zeros(blocks, np.uint8)
    for bit in range(32):
        width[bound >> np.uint32(bit) > 0] = bit + 1
    over = np.where(width[:, None] < 32, diff >> np.minimum(width, 31)[:, None].astype(np.uint32), 0) > 0
    patches = over.sum(axis=1)
    kept = np.where(over, 0, diff).astype(np.uint32)
    size = 6 + BLOCK // 8 * width.astype(np.int64) + 5 * patches
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start + 4], out[start + 5] = width, patches
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        word = "<u2" if w <= 16 else "<u4"
        bits = np.unpackbits(kept[rows].astype(word).view(np.uint8), axis=1, bitorder="little")
        bits = bits.reshape(len(rows), BLOCK, -1)[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        out[(start[rows] + 6)[:, None] + np.arange(BLOCK // 8 * w)] = packed
    row, spot = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    after = (start + 6 + BLOCK // 8 * width.astype(np.int64))[row]
    out[after + nth] = spot
    out[(after + patches[row] + 4 * nth)[:, None] + np.arange(4)] = diff[row, spot].astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.concatenate([[n, blocks], start]).astype("<u4").tobytes() + out.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks from ``first`` to before ``last``; all by default."""
    n, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(payload, np.uint8)
    at = 8 + 4 * blocks + np.frombuffer(payload, "<u4", blocks, 8).astype(np.int64)[first:last]
    low = data[at[:, None] + np.arange(4)].copy().view("<u4")
    width, patches = data[at + 4], data[at + 5].astype(np.int64)
    out = np.empty((last - first, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = np.zeros((len(rows), BLOCK, 16 if w <= 16 else 32), np.uint8)
        if w:
            raw = data[at[rows][:, None] + 6 + np.arange(BLOCK * int(w) // 8)]
            bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u2" if w <= 16 else "<u4")
    row = np.repeat(np.arange(last - first), patches)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
    after = (at + 6 + BLOCK // 8 * width.astype(np.int64))[row]
    out[row, data[after + nth]] = data[(after + patches[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    out += low
    return out.ravel()[: n - first * BLOCK]


def value_at(payload: bytes, i: int) -> int:
    """One value, reading one block."""
    return int(unpack(payload, i // BLOCK, i // BLOCK + 1)[i % BLOCK])


SCHEMA = "part int, segment long, before long, doc_ids array<long>, lengths array<int>, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, percentile: float = 90.0) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) below ``path``.

    ``tokenizer`` is the path of a tokenizer file on every executor. Rows are dealt by ranges
    of the id and sorted, rows that share an id by text; a null id comes first. A null or
    empty text is the end id alone. An empty table writes an empty file set. Other columns
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer, end_id)
        doc_ids: list = []
        held, sizes, total, before = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, lengths = pa.concat_arrays(doc_ids), pa.array(np.concatenate(sizes), pa.int32())
            row = [[part], [segment], [before], pa.ListArray.from_arrays([0, len(ids)], ids),
                   pa.ListArray.from_arrays([0, len(ids)], lengths), [pack(np.concatenate(held), percentile)]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in batches:
            for top, end, data, at in slices(batch, size=PIECES_BYTES):
                ids = batch.column("doc_id").slice(top, end - top)
                tokens, size = encoder.encode_bytes(data, at)
                done = np.cumsum(size)
                lo = 0
                while lo < len(ids):  # fill the segment up to SEGMENT ids, whole documents
                    base = done[lo - 1] if lo else 0
                    hi = min(len(ids), int(np.searchsorted(done, base + SEGMENT - total, "left")) + 1)
                    doc_ids.append(ids.slice(lo, hi - lo))
                    held.append(tokens[base: done[hi - 1]])
                    sizes.append(size[lo:hi])
                    total += int(done[hi - 1] - base)
                    lo = hi
                    if total >= SEGMENT:
                        yield flush()
                        segment, before = segment + 1, before + total
                        doc_ids, held, sizes, total = [], [], [], 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, SCHEMA).write.parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a file set.

    ``ids`` is binary: unsigned 32-bit integers, little-endian. ``start`` counts the ids of all
    documents before. Segments are decoded one by one, where they are read; only the totals of
    the parts, one row a part, are summed up and sent to the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, doc_ids = batch.column("lengths"), batch.column("doc_ids")
            for i, (part, before, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "before", "payload")))):
                size = lengths[i].values.to_numpy().astype(np.int64)
                ends = np.cumsum(size)
                raw = unpack(payload).astype("<u4", copy=False)
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                n = len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), doc_ids[i].values, pa.array(before + ends - size), pa.array(size),
                     pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])],
                    ["part", "doc_id", "within", "n_tokens", "ids"])

    files = spark.read.schema(SCHEMA).parquet(path)
    docs = files.mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids binary")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = files.groupBy("part").agg(F.max(F.col("before") + size).alias("n"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
