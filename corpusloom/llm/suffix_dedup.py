"""Repeated passages of a corpus by a logarithmic family of suffix arrays.

Every byte that a `length`-byte string covers which also starts anywhere else is removed.
A suffix array over every byte would be many times the text, so suffixes are sampled and
known by fingerprints of their first bytes; only equality of these first bytes matters
here, so arrays are sorted by fingerprint, and equal beginnings lie side by side as in a
lexicographic array:

* Documents are packed, as they come, into compressed blocks that never move again
  (one bucketed table, by block). All that is shuffled are coded fingerprints and answers.
* A window is `length` bytes. Its anchor is the one of its first 32 places whose 32 bytes
  hash lowest, so equal windows have equal anchors; windows in a row that share an anchor
  form a run. One suffix per run instead of one per byte enters the arrays.
* The fingerprints of a range of values have one owner. Blocks reach it in batches. Each
  batch gets its suffix array and is merge-scanned against every level the owner holds,
  which marks what both have; then levels of equal size merge, so that their number
  stays logarithmic in the number of batches. Once all batches are in, each block
  is told which of its suffixes occur elsewhere.

Matches get longer from round to round:

1. The 32 bytes of each anchor. A window over an anchor that occurs once occurs once.
2. Of what is left, whole runs: all bytes that windows of the run touch. Runs that occur
   elsewhere as a whole are repeated.
3. The anchors of what is left again, with whether a run of theirs occurs once. An anchor of
   such a run that has others is mixed: windows of its runs may agree in part.
4. Each window of the runs of mixed anchors.

Rounds 2 and 4 compare 108 bits (64 of the run or window, 44 of its anchor); two different
strings agree in them with odds of 2^-108 a pair. They are dealt by the former, so that a
passage in very many texts, each time with other neighbours, has many owners; of an anchor
itself, a block sends one value, however often it occurs. Rounds 1 and 3 send 44 bits,
which can only let more windows into the later rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import golomb
from corpusloom.llm.bucketed import bucketed
from corpusloom.llm.words import flat, mixed
from corpusloom.sources.scratch import stored

# Bytes of an anchor, and places of a window that it is chosen from.
ANCHOR, PLACES = 32, 32
# Bits of an anchor's fingerprint that are sent.
_SENT = 44
# Bytes of text of a block, bytes of all blocks per owner, batches an owner takes in.
_BLOCK, _OWNER, BATCHES = 1 << 20, 1 << 24, 8
# Places hashed at once: bounds the memory of one step, however long a text is.
_STEP = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_MESSAGE = "block string, round int, owner int, batch int, coded binary, rest binary, again binary, alone binary"
_ANSWER = "block string, round int, owner int, marks binary"


class _Made(dict):
    """Tables a worker keeps; they never travel with a function that uses them."""

    def __reduce__(self):
        return _Made, ()


_powers = _Made()


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, made once per worker."""
    if len(_powers.get(0, ())) < size:
        size = max(size, _STEP + (1 << 12))
        for key, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table)
    return _powers[0], _powers[1]


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial hash: sums[j] - sums[i] stands for bytes i to j."""
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of `data[start:end]`, starts ascending; length counts too."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + _STEP)))
        s, e = starts[i:j] - low, ends[i:j] - low
        sums = _sums(data[low : low + int(e.max())])
        _, inverse = _power_tables(len(sums))
        h = (sums[e] - sums[s]) * inverse[s]
        out[i:j] = mixed(h + (e - s).astype(np.uint64) * np.uint64(_BASE))
        i = j
    return out


def _lowest(h: np.ndarray) -> np.ndarray:
    """For each place, how far behind it the first lowest of PLACES hashes lies."""
    low, off, step = h, np.zeros(len(h), dtype=np.uint8), 1
    while step < PLACES:
        later = low[step:] < low[:-step]
        off = np.where(later, off[step:] + np.uint8(step), off[:-step])
        low = np.minimum(low[step:], low[:-step])
        step *= 2
    return off


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first, last, end, key) of the runs of all texts in `data`, ascending.

    first and last are places that share the anchor, whose fingerprint is key; end is where
    their text ends. Places reach to the last one with PLACES anchors ahead, so that
    all windows are among them; texts of less than `length` bytes have none.
    """
    reach = ANCHOR + PLACES - 1
    ends = np.where(np.diff(offsets) >= length, offsets[1:], offsets[:-1])
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(data) - reach + 1, _STEP):
        stop = min(low + _STEP, len(data) - reach + 1)
        inside = np.diff(np.clip(offsets, low, stop))
        end = np.repeat(ends, inside)
        valid = np.arange(low, stop) + reach <= end
        sums = _sums(data[low : stop + reach - 1])
        _, inverse = _power_tables(len(sums))
        h = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(sums) - ANCHOR])
        at = np.arange(stop - low) + _lowest(h)
        place, anchor = np.flatnonzero(valid), at[valid]
        if not len(place):
            continue
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = place[np.append(starts[1:], len(place)) - 1]
        key = h[anchor[starts]] >> np.uint64(64 - _SENT)
        found.append((place[starts] + low, last + low, end[place[starts]], key, anchor[starts] + low))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    first, last, end, key, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run that a step cuts in two is one.
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = last[np.append(starts[1:], len(last)) - 1]
    return first[starts], last, end[starts], key[starts]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals, both bounds ascending, with those that overlap or touch made one."""
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(ends))[: len(first)] - 1]


def entry(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The sent bits of a fingerprint and what else tells it apart, as one sortable value."""
    both = np.empty((len(key), 2), dtype=">u8")
    both[:, 0], both[:, 1] = key, rest
    return both.reshape(-1).view("S16") if len(key) else np.zeros(0, "S16")


def split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The sent bits of each value, and the rest where there is one."""
    if values.dtype.kind != "S":
        return values, None
    both = values.view(">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype("<u8")


def longer(prints: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64 bits of a string and 44 of its anchor, sorted and dealt by the former."""
    low = np.uint64(64 - _SENT)
    return entry(prints >> low, prints << np.uint64(_SENT) | key)


class Level:
    """A suffix array: ascending distinct suffixes; which occur again, which were flagged alone."""

    def __init__(self, values: np.ndarray, again: np.ndarray, alone: np.ndarray, batches: int = 1):
        self.values, self.again, self.alone, self.batches = values, again, alone, batches

    @classmethod
    def of(cls, parts: list[np.ndarray], again: list[np.ndarray], alone: list[np.ndarray]) -> Level:
        """The array of one batch, from sorted parts of it."""
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.concatenate(([True], values[1:] != values[:-1]))
        starts = np.flatnonzero(first)
        copies = np.diff(np.append(starts, len(values)))
        marked = [np.logical_or.reduceat(np.concatenate(m)[order], starts) for m in (again, alone)]
        return cls(values[first], marked[0] | (copies > 1), marked[1])

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where `values` would lie, and whether they are there."""
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return at, self.values[at] == values

    def scan(self, other: Level) -> None:
        """Mark the suffixes that both have."""
        at, there = self.find(other.values)
        self.again[at[there]] = True
        other.again |= there

    def merged(self, other: Level) -> Level:
        out = Level.of([self.values, other.values], [self.again, other.again], [self.alone, other.alone])
        out.batches = self.batches + other.batches
        return out


class Family:
    """Levels of falling size; batches go in, and equal levels merge."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, batch: Level) -> None:
        for level in self.levels:
            level.scan(batch)
        self.levels.append(batch)
        while len(self.levels) > 1 and self.levels[-2].batches <= self.levels[-1].batches:
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def whole(self) -> Level:
        """All levels as one."""
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)
        return self.levels[0]


def _decoded(table: pa.Table) -> list[np.ndarray]:
    """The suffixes of each message."""
    out = []
    for coded, rest in zip(table["coded"], table["rest"], strict=True):
        key = golomb.decode(coded.as_py())
        out.append(entry(key, np.frombuffer(rest.as_py(), "<u8")) if rest.is_valid else key)
    return out


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8))[:n].astype(bool)


def answered(table: pa.Table) -> pa.Table:
    """Per message of one owner, a bit for each suffix: whether it occurs elsewhere.

    In round 3 also a run of it must have been flagged as occurring once.
    """
    table = table.sort_by([("batch", "ascending"), ("block", "ascending")])
    held = _decoded(table)
    again, alone = ([_bits(m.as_py(), len(v)) for m, v in zip(table[c], held, strict=True)] for c in ("again", "alone"))
    batches = np.array(table["batch"].to_pylist())
    family = Family()
    for batch in np.unique(batches).tolist():
        rows = np.flatnonzero(batches == batch).tolist()
        family.add(Level.of(*([part[r] for r in rows] for part in (held, again, alone))))
    whole = family.whole()
    bits = whole.again & whole.alone if table["round"][0].as_py() == 3 else whole.again
    replies = [np.packbits(bits[whole.find(values)[0]]).tobytes() for values in held]
    return pa.table(
        {
            "block": table["block"].combine_chunks(),
            "round": table["round"].combine_chunks(),
            "owner": table["owner"].combine_chunks(),
            "marks": pa.array(replies, pa.binary()),
        }
    )


def _owner_bounds(values: np.ndarray, owners: int) -> list[int]:
    """Where each owner's range begins in ascending values, and their end."""
    edges = np.array([(k << _SENT) // owners for k in range(owners)], dtype=np.uint64)
    return [*np.searchsorted(split(values)[0], edges).tolist(), len(values)]


def _messages(block: str, turn: int, owners: int, values: np.ndarray, alone: np.ndarray | None = None) -> pa.Table:
    """A block's distinct suffixes, sorted and dealt to the owners of their ranges."""
    found, back, copies = np.unique(values, return_inverse=True, return_counts=True)
    flagged = np.zeros(len(found), dtype=bool)
    if alone is not None:
        flagged[back[alone]] = True
    bounds = _owner_bounds(found, owners)
    parts = [(o, i, j) for o, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if i < j]
    batch = int(hashlib.blake2b(block.encode(), digest_size=4).hexdigest(), 16) % BATCHES
    key, rest = split(found)
    n = len(parts)
    return pa.table(
        {
            "block": pa.array([block] * n, pa.string()),
            "round": pa.array([turn] * n, pa.int32()),
            "owner": pa.array([o for o, _, _ in parts], pa.int32()),
            "batch": pa.array([batch] * n, pa.int32()),
            "coded": pa.array([golomb.encode(key[i:j]) for _, i, j in parts], pa.binary()),
            "rest": pa.array([None if rest is None else rest[i:j].tobytes() for _, i, j in parts], pa.binary()),
            "again": pa.array([np.packbits(copies[i:j] > 1).tobytes() for _, i, j in parts], pa.binary()),
            "alone": pa.array([np.packbits(flagged[i:j]).tobytes() for _, i, j in parts], pa.binary()),
        }
    )


class _Block:
    """What a block knows: its texts, their runs, and the answers so far."""

    def __init__(self, payload: bytes, length: int, owners: int, answers: pa.Table | None = None):
        self.rows = pa.ipc.open_file(payload).read_all()
        self.data, self.offsets = flat(self.rows["text"])
        self.length, self.owners = length, owners
        self.first, self.last, self.end, self.key = runs(self.data, self.offsets, length)
        self.replies: dict[int, list[bytes]] = {}
        if answers is not None:
            order = answers.sort_by([("round", "ascending"), ("owner", "ascending")])
            for turn, owner, marks in zip(*(order[c].to_pylist() for c in ("round", "owner", "marks")), strict=True):
                self.replies.setdefault(turn, []).append((owner, marks))

    def told(self, turn: int, values: np.ndarray) -> np.ndarray:
        """The bits that owners answered for these suffixes."""
        unique, back = np.unique(values, return_inverse=True)
        out = np.zeros(len(unique), dtype=bool)
        bounds = _owner_bounds(unique, self.owners)
        for owner, marks in self.replies.get(turn, []):
            i, j = bounds[owner], bounds[owner + 1]
            out[i:j] = _bits(marks, j - i)
        return out[back]

    def survivors(self) -> None:
        """Keep the windows of the runs that lie over no anchor that occurs once."""
        again = self.told(1, self.key)
        # A window holds an anchor for sure if it holds all places one of its run was chosen from.
        back = self.length - ANCHOR - PLACES + 1
        begin = self.offsets[np.searchsorted(self.offsets, self.first, side="right") - 1]
        gone, until = joined(np.maximum(self.first - back, begin)[~again], self.last[~again] + 1)
        # What lies between is kept; both lists are ascending and without overlaps.
        keep, stop = np.concatenate(([0], until)), np.append(gone, len(self.data))
        last = np.minimum(self.last, self.end - self.length)
        starts = np.union1d(self.first, keep)
        run = np.searchsorted(self.first, starts, side="right") - 1
        piece = np.searchsorted(keep, starts, side="right") - 1
        stops = np.minimum(last[run], stop[piece] - 1) if len(last) else starts - 1
        held = (run >= 0) & (stops >= starts)
        run = run[held]
        self.first, self.last, self.end, self.key = starts[held], stops[held], self.end[run], self.key[run]
        self.body = longer(hashed(self.data, self.first, self.last + self.length), self.key)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and suffixes of the windows in runs of mixed anchors."""
        chosen = np.flatnonzero(self.told(3, self.key))
        sizes = self.last[chosen] - self.first[chosen] + 1
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[chosen], sizes)
        return place, longer(hashed(self.data, place, place + self.length), np.repeat(self.key[chosen], sizes))

    def send(self, block: str, turn: int) -> pa.Table:
        if turn == 1:
            return _messages(block, turn, self.owners, self.key)
        self.survivors()
        if turn == 2:
            return _messages(block, turn, self.owners, self.body)
        if turn == 3:
            return _messages(block, turn, self.owners, self.key, ~self.told(2, self.body))
        return _messages(block, turn, self.owners, self.windows()[1])

    def removed(self) -> tuple[np.ndarray, np.ndarray]:
        """Half-open intervals of bytes to remove, apart from each other, ascending."""
        self.survivors()
        whole = self.told(2, self.body)
        place, windows = self.windows()
        place = place[self.told(4, windows)]
        starts = np.concatenate((self.first[whole], place))
        ends = np.concatenate((self.last[whole], place)) + self.length
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], np.maximum.accumulate(ends[order])
        # Texts lie side by side: moving each by its number keeps their spans from touching.
        text = np.searchsorted(self.offsets, starts, side="right")
        starts, ends = joined(starts + text, ends + text)
        text = np.searchsorted(self.offsets + np.arange(1, len(self.offsets) + 1), starts, side="right")
        return starts - text, ends - text


def _packed(limit: int):
    """Blocks of at least `limit` bytes of text, or one partition's rest, as Arrow files."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_file(sink, held[0].schema, options=options) as out:
                for rows in held:
                    out.write_batch(rows)
            columns = [pa.array([f"{part}-{count}"]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "n_bytes", "payload"])

        for batch in batches:
            offsets = flat(batch["text"])[1]
            begin = 0
            while begin < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[begin] + max(limit - size, 1)))
                end = min(max(end, begin + 1), batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                size += int(offsets[end] - offsets[begin])
                begin = end
                if size >= limit:
                    yield block()
                    held, size, count = [], 0, count + 1
        if held:
            yield block()

    return pack


def packed_blocks(docs: DataFrame) -> DataFrame:
    """(block, n_bytes, payload): rows as they come, in a bucketed table by block.

    Joins on `block` read it where it lies; a block is one document or `_BLOCK` bytes.
    """
    rows = docs.mapInArrow(_packed(_BLOCK), "block string, n_bytes long, payload binary")
    # The payload is compressed already.
    return bucketed(rows, "blocks", "block", compression="none")


def _first_round(length: int, owners: int):
    def send(blocks: pa.Table) -> pa.Table:
        return _Block(blocks["payload"][0].as_py(), length, owners).send(blocks["block"][0].as_py(), 1)

    return send


def _later_round(length: int, owners: int, turn: int):
    def send(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _messages("", turn, owners, np.zeros(0, np.uint64))
        made = _Block(blocks["payload"][0].as_py(), length, owners, answers)
        return made.send(blocks["block"][0].as_py(), turn)

    return send


def _results(length: int, owners: int, id_type: pa.DataType):
    def finish(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids: pa.Array = pa.array([], id_type)
        if blocks.num_rows:
            made = _Block(blocks["payload"][0].as_py(), length, owners, answers)
            ids = made.rows["doc_id"].combine_chunks().cast(id_type)
            starts, ends = made.removed()
            text = np.searchsorted(made.offsets, starts, side="right") - 1
            bounds = np.searchsorted(text, np.arange(len(ids) + 1))
            offsets = made.offsets.tolist()
            for row in range(len(ids)):
                at, stop, digest, gone = offsets[row], offsets[row + 1], hashlib.sha256(), 0
                own = range(bounds[row], bounds[row + 1])
                for k in own:
                    digest.update(made.data[at : starts[k]])
                    at, gone = int(ends[k]), gone + int(ends[k] - starts[k])
                digest.update(made.data[at:stop])
                out.append((stop - offsets[row], gone, len(own), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table(
            [ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return finish


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of a text, in UTF-8, is removed if a `length`-byte string that covers it also
    starts anywhere else, in the same text or another; strings may overlap each other
    but never cross texts, and are judged on the texts as given. n_spans counts maximal
    removed stretches; kept_sha256 is of the remaining bytes. A null text is empty. Rows
    that repeat a text, with one id or several, each count as a place of their own, so
    texts of at least `length` bytes that occur twice go as a whole; shorter ones stay.
    Ids of any atomic type, null ones too, are passed through. Other columns are not looked
    at. No rows give no rows. `length` must be at least 64.
    """
    if length < ANCHOR + PLACES:
        raise ValueError(f"length must be at least {ANCHOR + PLACES}")
    spark: SparkSession = docs.sparkSession
    blocks = packed_blocks(docs.select("doc_id", "text"))
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    owners = 1 + size // _OWNER
    payloads = blocks.select("block", "payload")
    answers = None
    for turn in (1, 2, 3, 4):
        if answers is None:
            sent = payloads.groupBy("block").applyInArrow(_first_round(length, owners), _MESSAGE)
        else:
            met = payloads.groupBy("block").cogroup(answers.groupBy("block"))
            sent = met.applyInArrow(_later_round(length, owners, turn), _MESSAGE)
        told = stored(sent.groupBy("owner").applyInArrow(answered, _ANSWER), f"answers-{turn}")
        answers = told if answers is None else answers.union(told)
    id_field = docs.schema["doc_id"].dataType
    met = payloads.groupBy("block").cogroup(answers.groupBy("block"))
    kind = f"doc_id {id_field.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return met.applyInArrow(_results(length, owners, to_arrow_type(id_field)), kind)
