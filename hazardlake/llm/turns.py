"""Repair of conversations by a Viterbi search over edits that converges in rank.

A repaired conversation has the role initials ``(s?(ua)+)?``: four states, at the start, after
``s``, after ``u`` and after ``a``. Every message is kept, given another role or deleted, empty
messages can be inserted anywhere, and each edit has a cost. The cost to go from each state is
found from the end backwards, then the edits are read forwards: among the cheapest ones always
the least letter that still reaches the cost, which gives the least audit of all.

Conversations are cut into chunks of messages. All chunks run at once, each from a speculative
vector of costs behind its last message (that of a conversation's end). Costs to go forget
where they come from: after some messages two vectors differ by a constant only. So a chunk
is run again only if the vector that its follower found differs from the one it started from
by more than a constant, until none does; costs are kept less their minimum. The forward
reading runs alike, from a speculated state before the first message, and chunks whose
predecessor ended in another state run again. Chunks hold codes of roles and faults, no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import cut_lineage
from hazardlake.skew import rank_in_segments

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the next message that the grammar lets insert; after a kept message by its initial.
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 20
#: Costs to go behind the last message.
DONE = np.array([0, 2 * INSERT, INSERT, 0])
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Messages of a chunk, and of all the chunks that are searched in step.
CHUNK = 512
STEP = 1 << 18


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs when messages may be inserted first; never more than two in a row."""
    return np.minimum(v, np.minimum(INSERT + v[:, NEXT], 2 * INSERT + v[:, NEXT[NEXT]]))


def _steps(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost to go of deleting, keeping and giving another role, by chunk and state."""
    fault, initial = code >> 2, code & 3
    gone = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    cut = CUT * (fault == TRUNCATED)[:, None]
    to = KEPT[initial]
    keep = np.where(gone | (to < 0), FAR, cut + np.take_along_axis(after, np.maximum(to, 0), 1))
    return DELETE + after, keep, np.where(gone, FAR, REROLE + cut + after[:, NEXT])


def backward(codes: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go in front of every message and behind the last, (messages + 1, chunks, states).

    ``codes`` is padded, a row per chunk; in front of the padding the costs are those behind it.
    """
    width = codes.shape[1]
    out = np.empty((width + 1, len(codes), 4), np.int32)
    out[width] = end
    for t in range(width - 1, -1, -1):
        best = _closed(np.minimum.reduce(_steps(codes[:, t], out[t + 1])))
        out[t] = np.where((t < size)[:, None], best, out[t + 1])
    return out


def forward(codes: np.ndarray, size: np.ndarray, costs: np.ndarray, entry: np.ndarray, last: np.ndarray):
    """The least audit of every chunk: state behind it, and (chunk, order, letter, message, state
    after it) of all edits; an insertion has message -1."""
    state, edits = entry.astype(np.int64), []
    every = np.arange(len(codes))

    def note(which, order, letter, message):
        edits.append((which, np.full(len(which), order), np.full(len(which), ord(letter), np.uint8),
                      np.full(len(which), message), state[which]))

    for t in range(codes.shape[1]):
        left = every[t < size]
        for turn in range(3):
            now = costs[t, left, state[left]]
            drop = DELETE + costs[t + 1, left, state[left]] == now
            note(left[drop], 4 * t + 3, "D", t)
            left, now = left[~drop], now[~drop]
            put = INSERT + costs[t, left, NEXT[state[left]]] == now
            state[left[put]] = NEXT[state[left[put]]]
            note(left[put], 4 * t + turn, "I", -1)
            rest, now = left[~put], now[~put]
            _, keep, _ = _steps(codes[rest, t], costs[t + 1, rest])
            same = keep[np.arange(len(rest)), state[rest]] == now
            a, b = rest[same], rest[~same]
            state[a] = KEPT[codes[a, t] & 3, state[a]]
            state[b] = NEXT[state[b]]
            note(a, 4 * t + 3, "K", t)
            note(b, 4 * t + 3, "R", t)
            left = left[put]
    for turn in range(2):
        open_ = every[last & ((state == SYSTEM) | (state == USER))]
        state[open_] = NEXT[state[open_]]
        note(open_, 4 * codes.shape[1] + turn, "I", -1)
    chunk, order, letter, message, after = (np.concatenate(x) for x in zip(*edits))
    at = np.lexsort((order, chunk))
    return state, chunk[at], letter[at], message[at], after[at]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, padded codes, sizes) of pieces of a batch of chunks."""
    lists = batch.column("codes")
    size = np.diff(lists.offsets.to_numpy())
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi, width = lo, 0
        while hi < len(size) and (hi == lo or max(width, int(size[hi])) * (hi - lo + 1) <= STEP):
            width = max(width, int(size[hi]))
            hi += 1
        codes = np.zeros((hi - lo, width), np.int64)
        codes[np.arange(width) < size[lo:hi, None]] = flat[at[lo]: at[hi]]
        yield lo, hi, codes, size[lo:hi]
        lo = hi


def _vectors(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    return batch.column("ends").flatten().to_numpy().reshape(-1, 4)[lo:hi].astype(np.int32)


def _run_backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, codes, size in _groups(batch):
            found = backward(codes, size, _vectors(batch, lo, hi))[0]
            found = (found - found.min(axis=1, keepdims=True)).astype(np.int32)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv"), part.column("chunk"), part.column("ends"),
                 pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), 4).cast(pa.list_(pa.int32()))],
                ["conv", "chunk", "ends", "starts"])


def _traced(batch: pa.RecordBatch):
    for lo, hi, codes, size in _groups(batch):
        part = batch.slice(lo, hi - lo)
        entry, last = part.column("entry").to_numpy(), part.column("last").to_numpy(zero_copy_only=False)
        costs = backward(codes, size, _vectors(batch, lo, hi))
        yield part, forward(codes, size, costs, entry, last)


def _run_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, (state, *_) in _traced(batch):
            yield pa.RecordBatch.from_arrays(
                [part.column("conv"), part.column("chunk"), part.column("entry"), pa.array(state.astype(np.int32))],
                ["conv", "chunk", "entry", "exit"])


def _run_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, (_, chunk, letter, message, after) in _traced(batch):
            offsets = pa.py_buffer(np.arange(len(letter) + 1, dtype=np.int32))
            letters = pa.StringArray.from_buffers(len(letter), offsets, pa.py_buffer(np.ascontiguousarray(letter)))
            head = np.flatnonzero(np.diff(chunk, prepend=-1))
            order = np.arange(len(chunk)) - np.repeat(head, np.diff(head, append=len(chunk)))
            first = part.column("first").to_numpy()[chunk]
            yield pa.RecordBatch.from_arrays(
                [part.column("conv").take(pa.array(chunk)), part.column("chunk").take(pa.array(chunk)), pa.array(order), letters,
                 pa.array(np.where(message < 0, 0, first + message), mask=message < 0), pa.array(after.astype(np.int32))],
                ["conv", "chunk", "nth", "edit", "rank", "state"])


def messages(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows (conv_id, turn, role, text), ordered and judged: ``conv`` (the id as text, null
    apart), ``rank`` in the conversation, ``chunk``, ``initial`` of the role and ``fault``.

    Order: turn, nulls first, then role and text. A null role or text is one space. ``fault`` is
    the first that holds: 1 blank, 2 a role and text seen earlier, 3 no full stop at the end.
    Rows are numbered in pieces of 1,024 turns, duplicates come by a minimum per text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turn = F.col("turn")
    flat = rows.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        turn.cast("long").alias("turn"), text("role"), text("text"),
        F.coalesce(F.floor(turn / 1024), F.lit(-(1 << 62))).alias("piece"))
    ranked = cut_lineage(rank_in_segments(flat, ["conv"], ["piece"], ["turn", "role", "text"]).drop("piece"), "messages")
    firsts = (ranked.groupBy("conv", "role", F.sha2("text", 256).alias("sha")).agg(F.min("rank").alias("rank"))
              .select("conv", "rank", F.lit(True).alias("new")))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.position(F.left("role", F.lit(1)), F.lit("sua"))
    fault = (F.when(body == "", BLANK).when(F.col("new").isNull(), DUPLICATE)
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0))
    return ranked.join(firsts, ["conv", "rank"], "left").select(
        "conv_id", "conv", "rank", F.floor((F.col("rank") - 1) / chunk).alias("chunk"), "turn", "role", "text",
        F.when((F.col("role") != "") & (initial > 0), initial - 1).otherwise(3).alias("initial"), fault.alias("fault"))


def _chunks(found: DataFrame) -> DataFrame:
    """(conv, chunk, first, codes, last) of every chunk."""
    pair = F.struct("rank", (4 * F.col("fault") + F.col("initial")).alias("code"))
    out = found.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(pair)).alias("rows")).select(
        "conv", "chunk", F.get("rows", F.lit(0))["rank"].alias("first"), F.col("rows.code").alias("codes"))
    end = out.groupBy("conv").agg(F.max("chunk").alias("end"))
    return out.join(end, "conv").select("conv", "chunk", "first", "codes", (F.col("chunk") == F.col("end")).alias("last"))


def _passes(state: DataFrame, many: DataFrame, step: int, found: str, used: str, run, schema: str) -> DataFrame:
    """Run chunks again until each started from what its neighbour found."""
    while True:
        near = state.select("conv", (F.col("chunk") + step).alias("chunk"), F.col(found).alias("wanted"))
        stale = cut_lineage(state.join(near, ["conv", "chunk"]).filter(F.col("wanted") != F.col(used)).select("conv", "chunk", "wanted"), "stale")
        if stale.isEmpty():
            return state
        again = many.drop(used).join(stale, ["conv", "chunk"]).withColumnRenamed("wanted", used)
        state = cut_lineage(state.join(stale, ["conv", "chunk"], "left_anti").unionByName(again.mapInArrow(run, schema)), "passes")


def search(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, nth, edit, rank, state) of the cheapest edits with the least letters.

    ``nth`` is the place in the chunk, ``rank`` the message (null for an insertion), ``state``
    the one after the edit: 1 ``s``, 2 ``u``, 3 ``a``.
    """
    ends = F.array(*[F.lit(int(x)) for x in DONE])
    guess = F.when(F.col("chunk") == 0, START).otherwise(ASSISTANT)
    plain = chunks.withColumn("ends", ends).withColumn("entry", guess)
    many = plain.join(chunks.filter("chunk = 1").select("conv"), "conv", "left_semi")
    if not many.isEmpty():
        back = "conv string, chunk long, ends array<int>, starts array<int>"
        state = cut_lineage(many.mapInArrow(_run_backward, back), "passes")
        state = _passes(state, many, -1, "starts", "ends", _run_backward, back)
        many = cut_lineage(many.drop("ends").join(state.drop("starts"), ["conv", "chunk"]), "stitched")
        ahead = "conv string, chunk long, entry int, exit int"
        state = cut_lineage(many.mapInArrow(_run_forward, ahead), "passes")
        state = _passes(state, many, 1, "exit", "entry", _run_forward, ahead)
        many = many.drop("entry").join(state.drop("exit"), ["conv", "chunk"])
        plain = plain.join(chunks.filter("chunk = 1").select("conv"), "conv", "left_anti").unionByName(many)
    return plain.mapInArrow(_run_edits, "conv string, chunk long, nth long, edit string, rank long, state int")


def _digests(lines: DataFrame) -> DataFrame:
    """(conv, sha) of the lines of each conversation, one by one; a task holds one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
                if c != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_buffer())
            yield pa.RecordBatch.from_pydict({"conv": [d[0] for d in done], "sha": [d[1] for d in done]},
                                             schema=pa.schema([("conv", pa.string()), ("sha", pa.string())]))
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"conv": [conv], "sha": [sha.hexdigest()]})

    order = ["conv", "chunk", "nth"]
    return lines.repartition("conv").sortWithinPartitions(*order).select("conv", "line").mapInArrow(run, "conv string, sha string")


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The judged messages of ``rows`` (conv_id, turn, role, text) and the edits that repair them.

    Edits: conv, chunk and nth (their order), edit (``K`` keep, ``R`` other role, ``D`` delete,
    ``I`` insert), rank, cost, role (that of the repaired message; null if deleted) and text
    (empty if inserted). Blank and duplicate messages are always deleted; keeping a truncated
    one costs. Nulls: see ``messages``; rows without an id are one conversation. Repeated rows
    are duplicates. An empty table gives empty ones. Other columns are not looked at. However
    long a conversation is, no task holds more than one chunk of it; ranking sorts its pieces.
    """
    found = cut_lineage(messages(rows, chunk), "judged")
    edits = cut_lineage(search(cut_lineage(_chunks(found), "chunks")), "edits")
    role = (F.when(F.col("edit") == "D", F.lit(None)).when(F.col("edit") == "K", F.col("role"))
            .when(F.col("state") == USER, "user").otherwise("assistant"))
    cut = F.when((F.col("fault") == TRUNCATED) & (F.col("edit") != "D"), CUT).otherwise(0)
    cost = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", REROLE).otherwise(0) + cut
    out = edits.join(found.select("conv", "rank", "role", "text", "fault"), ["conv", "rank"], "left").select(
        "conv", "chunk", "nth", "edit", "rank", cost.cast("long").alias("cost"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return found, out


def report(ids: DataFrame, found: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for every id of ``ids``: gaps, faults, steps that break the order of roles, and
    cost, letters and digest of the repair."""
    turns = (found.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv")
             .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")))
    of = lambda k, name: F.sum((F.col("fault") == k).cast("long")).alias(name)
    faults = found.groupBy("conv").agg(of(BLANK, "blank"), of(DUPLICATE, "duplicate"), of(TRUNCATED, "truncated"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("rank", "initial"))), lambda x: x["initial"])
    legal = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    pieces = found.groupBy("conv", "chunk").agg(row.alias("i"))
    inner = F.size(F.filter(F.sequence(F.lit(1), F.size("i") - 1), lambda k: ~legal(F.get("i", k - 1), F.get("i", k))))
    before = F.lag(F.element_at("i", -1)).over(Window.partitionBy("conv").orderBy("chunk"))
    pieces = pieces.select("conv", F.when(F.size("i") > 1, inner).otherwise(0).alias("inner"), F.get("i", F.lit(0)).alias("head"), before.alias("tail"))
    illegal = pieces.groupBy("conv").agg(F.sum(
        F.col("inner") + F.when(F.col("tail").isNotNull() & ~legal(F.col("tail"), F.col("head")), 1).otherwise(0)).alias("illegal"))
    letters = edits.groupBy("conv", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("nth", "edit"))).alias("e"), F.sum("cost").alias("cost"))
    audit = letters.select("conv", "cost", F.struct("chunk", F.array_join("e.edit", "").alias("a")).alias("piece")).groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list("piece"))["a"], "").alias("audit"))
    shas = _digests(edits.filter("role is not null").select("conv", "chunk", "nth", F.concat_ws(":", "role", "text").alias("line")))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = ids.select("conv_id").distinct().withColumn("conv", key)
    for part in (turns, faults, illegal, audit, shas):
        out = out.join(part, "conv", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by a rule of id and turn: the test data of the
    registered query. Null roles and texts become one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    role, text = word("role"), word("text")
    return (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), h.alias("h"))
            .filter("h <> 0").select(
                "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


def conversations_report(rows: DataFrame) -> DataFrame:
    """Damage, repair and report of the given conversations."""
    found, edits = repair(damaged(rows))
    return report(rows, found, cut_lineage(edits, "repaired"))
