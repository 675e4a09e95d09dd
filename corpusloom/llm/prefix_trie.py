"""Trie of conversation prefixes, with totals of every subtree rolled up by depth bands.

Turns are known by digests from the first shuffle on; texts never move. A node is named by
its depth and the running sum, over its turns, of digest times a power of a fixed base
modulo the prime 2^127 - 1. Such sums add up in any order, so even a conversation that
holds a third of all turns is cut into pieces that are summed apart.

Depths are cut into bands of fixed height. A node is exploded to its ancestors within its
own band only, in one pass over all bands; then the completed totals of the nodes on top
of each band, from the deepest band up, are added to the ancestors in the band above. So a
node makes at most a band's height of rows, and there are as many rounds, over band tops
only, as bands. The height is given, or the square root of the deepest node's depth.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.scratch import stored

# Modulus and base of the sums that name nodes.
_PRIME = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F
# Least height of a band, bands of a conversation that one step sums in a row, and
# members of a node whose ids are joined into one piece.
MIN_BAND, _BANDS_IN_A_ROW, _PIECE = 16, 64, 1 << 15

_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes) of each turn; pos counts from 1 within a conversation.

    Turns are ordered by `turn`, null first, then role, then digest of the text, so that
    repeated turn numbers have one order. A null role or text is empty. Rows without a
    conv_id belong to no conversation and are left out. A conversation that spans several
    ranges of the sorted rows is numbered range by range.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # The role's length keeps ("ab", "c") and ("a", "bc") apart.
    said = F.concat(F.length(role).cast("string"), F.lit(" "), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    rows = ranged.withColumn("nth", nth).join(offsets, ["conv_id", "part"])
    return rows.select("conv_id", (F.col("nth") + F.col("earlier")).alias("pos"), "digest", "bytes")


def rebuilt_turns(turns: DataFrame, donor: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (conv_id, depth, digest, bytes), (conv_id, total).

    The first `taken` (at most `most`) turns of conversation `donor` come first, all if it has
    fewer, none if there is no such conversation; then the own turns after the first `taken`.
    Both columns are made of conv_id. Every conversation has a row in the second table.
    """
    lengths = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "lengths")
    donors = lengths.toDF("donor", "given")
    plan = lengths.select("conv_id", "own", donor.alias("donor"), taken.cast("long").alias("taken"))
    plan = plan.join(donors, "donor", "left").select(
        "conv_id", "donor", "own", "taken", F.least("taken", F.coalesce("given", F.lit(0))).alias("given")
    )
    plan = stored(plan, "plan")
    own = turns.join(plan.select("conv_id", "taken", "given"), "conv_id").where("pos > taken")
    own = own.select("conv_id", (F.col("pos") - F.col("taken") + F.col("given")).alias("depth"), "digest", "bytes")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "donor")
    heads = plan.select("conv_id", "donor", "taken").join(heads, "donor").where("pos <= taken")
    rows = own.union(heads.select("conv_id", F.col("pos").alias("depth"), "digest", "bytes"))
    totals = plan.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("total"))
    return stored(rows, "rebuilt"), totals


_SUM = "conv_id long, chunk long, sum binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _term(digest: bytes | None, depth: int) -> int:
    return int.from_bytes(digest, "big") * pow(_BASE, depth, _PRIME) if digest else 0


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each piece of a conversation, from rows in any order within it."""
    at, total = None, 0
    for batch in batches:
        out = []
        for conv, chunk, depth, digest in zip(*(batch[c].to_pylist() for c in ("conv_id", "chunk", "depth", "digest")), strict=True):
            if (conv, chunk) != at:
                if at:
                    out.append((*at, total.to_bytes(16, "big")))
                at, total = (conv, chunk), 0
            total = (total + _term(digest, depth)) % _PRIME
        if out:
            yield _batch(out, ["conv_id", "chunk", "sum"], [pa.int64(), pa.int64(), pa.binary()])
    if at:
        yield _batch([(*at, total.to_bytes(16, "big"))], ["conv_id", "chunk", "sum"], [pa.int64(), pa.int64(), pa.binary()])


def _running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all earlier pieces of the conversation add up to, from pieces in order."""
    at, total = None, 0
    for batch in batches:
        out = []
        for conv, chunk, piece in zip(*(batch[c].to_pylist() for c in ("conv_id", "chunk", "sum")), strict=True):
            if conv != at:
                at, total = conv, 0
            out.append((conv, chunk, total.to_bytes(16, "big")))
            total = (total + int.from_bytes(piece, "big")) % _PRIME
        if out:
            yield _batch(out, ["conv_id", "chunk", "sum"], [pa.int64(), pa.int64(), pa.binary()])


def _named(depth: int, total: int) -> bytes:
    return depth.to_bytes(8, "big") + total.to_bytes(16, "big")


def _paths(height: int):
    """One row per conversation and band: the names and last bytes of its nodes there."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = ["conv_id", "band", "above", "keys", "sizes"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_at = band_at = above = None
        total, power, keys, sizes = 0, 1, [], []
        for batch in batches:
            out = []
            columns = ("conv_id", "chunk", "depth", "digest", "bytes", "sum")
            for conv, chunk, depth, digest, size, before in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if (conv, depth // height) != band_at:
                    if band_at:
                        out.append((*band_at, above, keys, sizes))
                    above = keys[-1] if keys and (conv, chunk) == chunk_at else None
                    band_at, keys, sizes = (conv, depth // height), [], []
                if (conv, chunk) != chunk_at:
                    chunk_at, total, power = (conv, chunk), int.from_bytes(before or b"", "big"), pow(_BASE, depth, _PRIME)
                    above = _named(depth - 1, total) if depth else None
                if digest:
                    total = (total + int.from_bytes(digest, "big") * power) % _PRIME
                power = power * _BASE % _PRIME
                keys.append(_named(depth, total))
                sizes.append(size)
            if out:
                yield _batch(out, names, kinds)
        if band_at:
            yield _batch([(*band_at, above, keys, sizes)], names, kinds)

    return walk


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a row as one text; rows come by node and id."""
    at, held = None, []

    def piece() -> pa.RecordBatch:
        return _batch([(at, held[0], ",".join(map(str, held)))], ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])

    for batch in batches:
        for key, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if held and (key != at or len(held) == _PIECE):
                yield piece()
                held = []
            at = key
            held.append(conv)
    if held:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in a row, one piece in memory at a time."""
    at, state, kinds = None, None, [pa.binary(), pa.string()]
    for batch in batches:
        out = []
        for key, ids in zip(batch["key"].to_pylist(), batch["ids"], strict=True):
            if key != at:
                if state:
                    out.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        if out:
            yield _batch(out, ["key", "ends_sha256"], kinds)
    if state:
        yield _batch([(at, state.hexdigest())], ["key", "ends_sha256"], kinds)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end.

    Ids are joined into pieces wherever their range of the sorted rows lies, so that the one
    task that a hash must pass through for a node reads few rows of plain text.
    """
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "key binary, first long, ids string")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "first")
    return pieces.mapInArrow(_hashes, "key binary, ends_sha256 string")


def _pathways(turns: DataFrame, totals: DataFrame, height: int, deepest: int) -> DataFrame:
    """(conv_id, band, above, keys, sizes): each conversation's nodes, band by band."""
    root = totals.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    rows = root.union(turns.select("conv_id", "depth", "digest", "bytes"))
    length = height * _BANDS_IN_A_ROW
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / length))
    dealt = rows.repartition("conv_id", "chunk")
    if deepest < length:
        dealt = dealt.withColumn("sum", F.lit(None).cast("binary"))
    else:
        sums = dealt.sortWithinPartitions("conv_id", "chunk").mapInArrow(_chunk_sums, _SUM)
        before = sums.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_running_sums, _SUM)
        dealt = dealt.join(before, ["conv_id", "chunk"])
    kind = "conv_id long, band long, above binary, keys array<binary>, sizes array<long>"
    return stored(dealt.sortWithinPartitions("conv_id", "chunk", "depth").mapInArrow(_paths(height), kind), "paths")


def _across(tops: DataFrame, bands: int) -> DataFrame | None:
    """What completed band tops add to each node of the band above, path by path."""
    done, carried = [], None
    for band in range(bands, 0, -1):
        rows = tops.where(F.col("band") == band)
        if carried is not None:
            rows = rows.join(carried, "key", "left").select(
                "key", "path",
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            )
        rows = stored(rows.select("key", "path", "n_leaves", "saved_tokens"), "completed")
        above = F.col("path")[0].alias("key")
        carried = rows.groupBy(above).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        done.append(rows)
    if not done:
        return None
    whole = done[0]
    for rows in done[1:]:
        whole = whole.union(rows)
    spread = whole.select(F.explode("path").alias("key"), "n_leaves", "saved_tokens")
    return spread.groupBy("key").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))


def prefix_trie(turns: DataFrame, totals: DataFrame, band: int | None = None) -> DataFrame:
    """One row per distinct sequence of first turns, from the empty one on.

    `turns` (conv_id, depth, digest, bytes) counts depth from 1 without gaps; `totals`
    (conv_id, total) has every conversation, also those without turns. Result, all long but
    the hash: conv_id (least member), depth, parent_conv_id (the parent's conv_id; null for
    the root), n_convs (members), n_children, n_leaves (childless nodes of its subtree, itself
    included), saved_tokens (over its subtree, members beyond the first times the bytes of
    the node's last text), ends_sha256 (SHA-256 of the ascending ids, joined by commas, of
    members that end here). No conversations give no rows, not even a root.
    """
    deepest = totals.agg(F.max("total")).first()[0] or 0
    height = band or max(MIN_BAND, math.isqrt(deepest) + 1)
    bands = deepest // height
    paths = _pathways(turns, totals, height, deepest)
    parents = F.concat(F.array("above"), F.slice("keys", 1, F.size("keys") - 1)).alias("parent")
    met = paths.select("conv_id", "band", F.posexplode(F.arrays_zip("keys", "sizes", parents)).alias("nth", "node"))
    depth = (F.col("band") * height + F.col("nth")).alias("depth")
    members = met.select("conv_id", depth, F.col("node.keys").alias("key"), F.col("node.sizes").alias("bytes"), "node.parent")
    nodes = members.groupBy("key", "parent", "depth", "bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stored(nodes, "nodes")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "key", "left").select(
        "key", "depth", "conv_id",
        F.floor(F.col("depth") / height).alias("band"),
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    counted = stored(counted, "counted")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    up = F.slice("keys", F.lit(1), (F.col("depth") - F.col("band") * height + 1).cast("int"))
    own = counted.join(paths.select("conv_id", "band", "keys"), ["conv_id", "band"])
    within = own.select(F.explode(up).alias("key"), leaf.alias("leaf"), "saved").groupBy("key")
    within = stored(within.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "within")

    tops = counted.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).select("key", "conv_id", "band")
    paths_above = paths.select("conv_id", (F.col("band") + 1).alias("band"), F.col("keys").alias("path"))
    tops = tops.join(paths_above, ["conv_id", "band"]).join(within, "key")
    across = _across(stored(tops.select("key", "band", "path", "n_leaves", "saved_tokens"), "tops"), bands)

    ends = members.join(totals.toDF("conv_id", "depth"), ["conv_id", "depth"]).select("key", "conv_id")
    # Both sides are plain tables, so a parent of very many children is split.
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = stored(nodes.join(parents, "parent", "left").drop("parent", "bytes"), "with-parents")
    rows = rows.join(counted.select("key", "n_children"), "key").join(within, "key")
    rows = rows.join(_end_hashes(ends), "key", "left")
    more = {"n_leaves": F.lit(0), "saved_tokens": F.lit(0)}
    if across is not None:
        rows = rows.join(across, "key", "left")
        more = {"n_leaves": F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.coalesce("more_saved", F.lit(0))}
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *[(F.col(c) + v).cast("long").alias(c) for c, v in more.items()],
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
