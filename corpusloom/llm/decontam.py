"""Benchmark decontamination by pigeonhole edit matching.

A text that holds a test item with at most k edits holds one of any k + 1 pieces of the
item unchanged. So each item is cut into k + 1 pieces, one automaton finds all pieces
in a document in a single pass, and Myers' bit-parallel edit distance decides at the
places that the hits point to.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

# Edits allowed per character of an item; one edit in 16 leaves pieces of 16 characters.
EDIT_RATE = 0.06
# Characters of items that one pass over the documents takes on; more items, more passes.
BLOCK_CHARS = 4 << 20


def folded(text: str | None) -> str:
    """Lower case, with one blank for every run of white space and none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """`item` in edits + 1 parts of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(i, item[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of `pattern` to any part of `text`, and where it first ends.

    Columns of the distance table are two bit vectors of the pattern's length; a
    Python integer holds any length in one word.
    """
    m = len(pattern)
    if m == 0:
        return 0, 0
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
            if score < best:
                best, end = score, j
        right <<= 1
        vertical = same | down
        up = ((left << 1) | ~(vertical | right)) & full
        down = right & vertical & full
    return best, end


@dataclass(frozen=True)
class Items:
    """A block of test items: ids, folded texts and the edits each allows."""

    ids: tuple
    texts: tuple[str, ...]
    edits: tuple[int, ...]

    def automaton(self) -> ahocorasick.Automaton:
        found = defaultdict(list)
        for k, (text, edits) in enumerate(zip(self.texts, self.edits, strict=True)):
            for offset, piece in pieces(text, edits):
                found[piece].append((k, offset))
        machine = ahocorasick.Automaton()
        for piece, owners in found.items():
            machine.add_word(piece, (len(piece), owners))
        machine.make_automaton()
        return machine

    def matches(self, machine: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best place of each item that `text` holds."""
        windows = defaultdict(list)
        for end, (length, owners) in machine.iter(text):
            for k, offset in owners:
                start, edits = end + 1 - length - offset, self.edits[k]
                windows[k].append((max(0, start - edits), start + len(self.texts[k]) + edits))
        out = []
        for k, spans in windows.items():
            found = [self._place(k, text, a, b) for a, b in _merged(spans)]
            best = min((f for f in found if f), default=None)
            if best:
                out.append((k, *best))
        return out

    def _place(self, k: int, text: str, a: int, b: int) -> tuple[int, int, int] | None:
        item, window = self.texts[k], text[a:b]
        at = window.find(item)
        if at >= 0:
            return 0, a + at, a + at + len(item)
        distance, end = myers(item, window)
        if distance > self.edits[k]:
            return None
        # Backwards from the end, the first best place gives the start.
        back = myers(item[::-1], window[:end][::-1])[1]
        return distance, a + end - back, a + end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the words of a span of the folded text lie in the text itself."""
    words = folded(text)
    first, last = words.count(" ", 0, start + 1), words.count(" ", 0, max(start + 1, end))
    if end > 0 and words[end - 1 : end] == " ":
        last -= 1
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    return spans[min(first, len(spans) - 1)][0], spans[min(last, len(spans) - 1)][1]


def item_blocks(items: DataFrame, edit_rate: float) -> Iterator[Items]:
    """Test items (item_id, text) in blocks of bounded size; empty ones match nothing."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        text = folded(row["text"])
        if text:
            block.append((row["item_id"], text))
            held += len(text)
        if held >= BLOCK_CHARS:
            yield _items(block, edit_rate)
            block, held = [], 0
    if block:
        yield _items(block, edit_rate)


def _items(block: list[tuple], edit_rate: float) -> Items:
    ids, texts = zip(*block, strict=True)
    return Items(ids, texts, tuple(int(edit_rate * len(t)) for t in texts))


def leaks(docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """A row per document and test item it holds: doc_id, item_id, edits, start, end.

    Texts are compared in lower case with white space folded. An item allows
    floor(edit_rate * length) edits; one shorter than 1 / edit_rate must match exactly.
    start and end are code points of the whole words in the document's own text around
    the best match (least edits, then first). Null, empty and blank texts match
    nothing; repeated documents and repeated items each give their rows. Other columns
    are not looked at. Documents are read once per block of items, and only ids and
    spans leave a partition.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, item_id {item_type}, edits int, start int, end int"
    rows = docs.select("doc_id", "text")
    spark = docs.sparkSession
    found = [
        rows.mapInArrow(_finder(spark.sparkContext.broadcast(astuple(block)), to_arrow_type(items.schema["item_id"].dataType)), kind)
        for block in item_blocks(items, edit_rate)
    ]
    out = found[0] if found else spark.createDataFrame([], kind)
    for more in found[1:]:
        out = out.union(more)
    return out


def _finder(shared, item_type: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        machine = items.automaton()
        for batch in batches:
            at, rows = [], []
            for n, text in enumerate(batch["text"]):
                text = text.as_py()
                for k, edits, start, end in items.matches(machine, folded(text)):
                    at.append(n)
                    rows.append((items.ids[k], edits, *_original(text, start, end)))
            if rows:
                ids, edits, starts, ends = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(at)), pa.array(ids, item_type), *(pa.array(c, pa.int32()) for c in (edits, starts, ends))],
                    names=["doc_id", "item_id", "edits", "start", "end"],
                )

    return find


def without_leaks(docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of `docs` that hold no test item, as they are, decided where they lie."""
    for block in item_blocks(items, edit_rate):
        docs = docs.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(astuple(block))), docs.schema)
    return docs


def _cleaner(shared):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        machine = items.automaton()
        for batch in batches:
            kept = [not items.matches(machine, folded(t.as_py())) for t in batch["text"]]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return clean
