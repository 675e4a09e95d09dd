"""Size-aware join on n-gram Jaccard similarity, and the classes that its links form.

Two texts link when their sets of distinct word shingles have a Jaccard similarity of
at least `percent` / 100. Every link is found; none is found twice at the cost of
emitting all pairs of a group of copies:

1. Documents are hashed into buckets once. A bucket sends the shingles it holds, sorted
   and Golomb-coded, to the owners of their hash ranges; owners add up in how many sets
   each occurs and answer with one byte per shingle. Both rounds are plain shuffles.
2. Texts with equal sets become one node, so exact copies cost nothing further. The same
   rounds carry the sets' digests, and owners answer which bucket holds the least doc_id of
   each: only there the set is written, once, and it never moves to be told from its copies.
3. Small sets enumerate the fixed-size subsets that a link forces both sides to share;
   equal subsets are links. Large sets scan inverted lists over the rarest shingles of
   each set (a prefix that every link must meet). The size that parts small from large
   is the one with the least rows to move, by the measured sizes and list lengths.
4. Lists are scanned against one hub each, then against ever more. What hubs already
   connect needs no further pairs, so only pairs between different components are left
   to compare in the end. A sketch of each set bounds the pair's difference from below,
   inside the join, so that of a group of nearly similar texts only likely links leave it.

Sets are kept as 64-bit shingle hashes; overlaps are counted exactly on them. From step 2 on
a node goes by the number of its bucket and row, half of what its digest would take to move.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corpusloom.llm import golomb
from corpusloom.llm.graph import components
from corpusloom.llm.words import distinct, shingle_sets
from corpusloom.sources.scratch import stored

# Bits of a shingle hash that the counting exchange sends; merged values only change
# the order in which a set's shingles are taken, which is free.
_SENT = 44
# Largest set size that may count as small: subsets beyond it are never cheaper.
_SMALL = 40
# A row of an inverted list is shuffled, joined and compared; a subset key is only grouped.
_LIST_COST = 4
# Hubs of a list after the first, and how much their number grows from round to round,
# as long as more pairs than hubs are left per row.
_HUBS = 16
# Words of a sketch: bit k of 512 is the parity of the items that hash to k. Sketches of
# two sets differ in at most as many bits as the sets differ in items.
_SKETCH = 8

# Rows of a list, and pairs of sets, that one task takes on at least.
_ROWS_PER_TASK, _PAIRS_PER_TASK = 50_000, 500

_NODES = "node long, digest binary, doc_id {id}, n_shingles long, tokens array<long>, places array<int>, items binary, sketch array<long>"


def overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    """Sizes that a set linked with one of size n can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_keys(n: int, percent: int) -> int:
    """How many subsets a small set of size n enumerates."""
    return sum(math.comb(n, overlap(n, m, percent)) for m in partner_sizes(n, percent))


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sketch(items: np.ndarray) -> list[int]:
    parity = np.bincount(items & np.uint64(64 * _SKETCH - 1), minlength=64 * _SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()


def _bucket_sets(table: pa.Table, width: int) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """Sets and digests of a bucket's rows, and the sent part of its distinct sets."""
    sets = shingle_sets(table["text"], width)
    digests = [_digest(s) for s in sets]
    unique = dict(zip(digests, sets, strict=True))
    sent = [s >> np.uint64(64 - _SENT) for s in unique.values()]
    return sets, digests, np.concatenate(sent) if sent else np.zeros(0, np.uint64)


def _order(doc_id) -> tuple:
    """Order of ids: a null id comes last."""
    return doc_id is None, doc_id


def _claims(ids: list, digests: list[bytes], sets: list[np.ndarray], owners: int) -> dict[int, dict[bytes, int]]:
    """Per owner the digests of a bucket's sets that hold something, each with the row of its least id."""
    rows: dict[bytes, int] = {}
    for row in sorted(range(len(ids)), key=lambda r: _order(ids[r])):
        if len(sets[row]):
            rows.setdefault(digests[row], row)
    dealt: dict[int, dict[bytes, int]] = {}
    for digest, row in sorted(rows.items()):
        dealt.setdefault(int.from_bytes(digest[:8], "big") % owners, {})[digest] = row
    return dealt


def _counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and the sum of their weights."""
    if not len(values):
        return values, weights
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.add.reduceat(weights, starts)


def _owner_bounds(values: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range begins in ascending values."""
    edges = [(k << _SENT) // owners for k in range(owners + 1)]
    return np.searchsorted(values, np.array(edges, dtype=np.uint64))


def _messages(width: int, owners: int, id_type: pa.DataType):
    def send(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        sets, digests, sent = _bucket_sets(table, width)
        ids = table["doc_id"].to_pylist()
        claims = _claims(ids, digests, sets, owners)
        values, counts = _counted(sent, np.ones(len(sent), dtype=np.uint32))
        bounds = _owner_bounds(values, owners).tolist()
        rows = []
        for owner, (i, j) in enumerate(itertools.pairwise(bounds)):
            claimed = claims.get(owner, {})
            if i < j or claimed:
                held = zlib.compress(counts[i:j].astype("<u4").tobytes(), 1)
                least = [ids[row] for row in claimed.values()]
                rows.append((bucket, owner, golomb.encode(values[i:j]), held, b"".join(claimed), least))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type))
        names = ("bucket", "owner", "hashes", "counts", "digests", "ids")
        return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(names, types, strict=True))})

    return send


def _answers(table: pa.Table) -> pa.Table:
    """Per message of one owner, a byte for each hash: 0 if in one set, else about 4 log2.

    And a byte for each digest: 1 in the message that has its least id.
    """
    lists = [golomb.decode(b.as_py()) for b in table["hashes"]]
    counts = [np.frombuffer(zlib.decompress(b.as_py()), dtype="<u4") for b in table["counts"]]
    values, totals = _counted(np.concatenate(lists), np.concatenate(counts).astype(np.uint64))
    ranks = np.floor(4 * np.log2(totals)).astype(np.uint8)
    replies = [zlib.compress(ranks[np.searchsorted(values, v)].tobytes(), 1) for v in lists]
    claims = []
    for joined, ids in zip(table["digests"].to_pylist(), table["ids"].to_pylist(), strict=True):
        claims.append([(joined[16 * k : 16 * k + 16], _order(doc_id)) for k, doc_id in enumerate(ids)])
    least: dict[bytes, tuple] = {}
    for message, claimed in enumerate(claims):
        for digest, order in claimed:
            if digest not in least or order < least[digest][0]:
                least[digest] = order, message
    won = [bytes(least[digest][1] == message for digest, _ in claimed) for message, claimed in enumerate(claims)]
    return pa.table(
        {
            "bucket": table["bucket"].combine_chunks(),
            "owner": table["owner"].combine_chunks(),
            "ranks": pa.array(replies, pa.binary()),
            "won": pa.array(won, pa.binary()),
        }
    )


def _prefixes(width: int, percent: int, owners: int, id_type: pa.DataType):
    def meet(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("node", "digest", "doc_id", "n_shingles", "tokens", "places", "items", "sketch")}
        if docs.num_rows:
            sets, digests, sent = _bucket_sets(docs, width)
            values = distinct(sent)
            said = answers.select(["owner", "ranks", "won"]).to_pylist()
            said = {r["owner"]: r for r in sorted(said, key=lambda r: r["owner"])}
            ranks = np.frombuffer(b"".join(zlib.decompress(r["ranks"]) for r in said.values()), dtype=np.uint8)
            ids = docs["doc_id"].to_pylist()
            # The least doc_id of equal sets, of all buckets, carries the set.
            carrying = {
                row
                for owner, claimed in _claims(ids, digests, sets, owners).items()
                for row, won in zip(claimed.values(), said[owner]["won"], strict=True)
                if won
            }
            bucket = docs["bucket"][0].as_py()
            for row, (items, digest) in enumerate(zip(sets, digests, strict=True)):
                n, node, tokens, places, kept, sketch = len(items), None, None, None, None, None
                if n == 0:
                    # Empty texts link with nothing; an own digest keeps them apart and spread.
                    digest = hashlib.blake2b(f"empty {ids[row]}".encode(), digest_size=16).digest()
                elif row in carrying:
                    rank = ranks[np.searchsorted(values, items >> np.uint64(64 - _SENT))]
                    # A link takes that share of a set's own shingles to be in other sets too.
                    if 100 * np.count_nonzero(rank) >= percent * n:
                        order = np.argsort(rank.astype(np.uint64) << np.uint64(56) | items >> np.uint64(8), kind="stable")
                        head = order[: n - -(-percent * n // 100) + 1]
                        places = np.flatnonzero(rank[head]).astype(np.int32)
                        tokens = items[head[places]].view(np.int64)
                        kept, sketch = items.tobytes(), _sketch(items)
                        # A bucket's rows are numbered once, as what this writes is read from then on.
                        node = bucket << 32 | row
                for name, value in zip(out, (node, digest, ids[row], n, tokens, places, kept, sketch), strict=True):
                    out[name].append(value)
        types = (pa.int64(), pa.binary(), id_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return meet


def _subsets(percent: int, most: int):
    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple]:
            for batch in batches:
                for node, items in zip(batch["node"].to_pylist(), batch["items"].to_pylist(), strict=True):
                    n = len(items) // 8
                    parts = [items[i : i + 8] for i in range(0, len(items), 8)]
                    for m in partner_sizes(n, percent):
                        if m > most:
                            continue
                        sizes = bytes((min(n, m), max(n, m)))
                        side = int(n > m)
                        for chosen in itertools.combinations(parts, overlap(n, m, percent)):
                            key = hashlib.blake2b(sizes + b"".join(chosen), digest_size=16).digest()
                            yield key, side, side if n == m else 1 - side, node

        rows = keys()
        while chunk := list(itertools.islice(rows, 20_000)):
            columns = list(zip(*chunk, strict=True))
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "side", "peer", "node"])

    return enumerate_


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["items_a"], batch["items_b"]
            linked = []
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                b = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                both = np.sort(np.concatenate((a, b)), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return compare


class _Join:
    """One run of the join; tables it needs more than once are written first."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, percent: int):
        self.spark, self.nodes, self.percent = spark, nodes, percent

    def boundary(self) -> int:
        """Largest size that counts as small: the one with the least rows to move."""
        sizes = (
            self.nodes.groupBy(F.least("n_shingles", F.lit(2 * _SMALL)).alias("n"))
            .agg(F.count("*").alias("sets"), F.sum(F.size("tokens")).alias("listed"))
            .collect()  # at most 2 * _SMALL rows
        )
        sets = {r["n"]: r["sets"] for r in sizes}
        listed = {r["n"]: r["listed"] or 0 for r in sizes}

        def cost(most: int) -> int:
            from_size = -(-self.percent * (most + 1) // 100)
            small = sum(c * subset_keys(n, self.percent) for n, c in sets.items() if n <= most)
            return small + _LIST_COST * sum(c for n, c in listed.items() if n >= from_size)

        return min(range(_SMALL + 1), key=cost)

    def small_links(self, most: int) -> DataFrame:
        """Links between sets of at most `most` shingles, as stars per shared subset."""
        small = self.nodes.where(F.col("n_shingles") <= most).select("node", "items")
        kind = "key binary, side int, peer int, node long"
        keys = stored(small.mapInArrow(_subsets(self.percent, most), kind), "subsets")
        hubs = keys.groupBy("key", "side").agg(F.min("node").alias("hub"))
        hubs = stored(hubs.withColumnRenamed("side", "peer"), "subset-hubs")
        joined = keys.join(hubs, ["key", "peer"]).where("node <> hub")
        return joined.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

    def lists(self, most: int) -> DataFrame:
        """Inverted lists (token, place, node, n) for links with a set above `most`."""
        least = -(-self.percent * (most + 1) // 100)
        large = self.nodes.where(F.col("n_shingles") >= least)
        item = F.explode(F.arrays_zip("tokens", "places")).alias("item")
        rows = large.select("node", F.col("n_shingles").alias("n"), item)
        return stored(rows.select("node", "n", "item.tokens", "item.places"), "lists").toDF(
            "node", "n", "token", "place"
        )

    def fits(self, n: str, m: str):
        """Sizes that a link allows."""
        low, high = F.least(n, m), F.greatest(n, m)
        return low * 100 >= high * self.percent

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        """Every list row against its list's hub, the node that ranks first everywhere."""
        rank = F.xxhash64("node")
        hub = F.min(F.struct(rank.alias("rank"), "node", "n", "root")).alias("hub")
        hubs = lists.groupBy("token").agg(hub, F.count("*").alias("rows")).where("rows > 1")
        hubs = stored(hubs.select("token", "hub"), "list-hubs")
        pairs = lists.join(hubs, "token").where("root <> hub.root").where(self.fits("n", "hub.n"))
        return self.ordered(F.col("node"), F.col("hub.node"), pairs)

    def opened(self, lists: DataFrame) -> DataFrame:
        """Rows of lists that still hold several components, with the nodes' sketches."""
        roots = lists.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        tokens = stored(roots.where("low <> high").select("token"), "open-tokens")
        lists = lists.join(tokens, "token")
        if "s0" not in lists.columns:
            words = [F.col("sketch")[k].alias(f"s{k}") for k in range(_SKETCH)]
            lists = lists.join(self.nodes.select("node", *words), "node")
        return stored(lists, "open-lists")

    def hubs(self, lists: DataFrame, count: int) -> DataFrame:
        """`count` rows of each list, drawn anew for every list."""
        drawn = Window.partitionBy("token").orderBy(F.xxhash64("token", "node"), "node")
        return stored(lists.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= count).drop("nth"), "hubs")

    def open_pairs(self, lists: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of rows of one list that a link allows and no component joins yet."""
        other = others.toDF(*[f"{c}_" for c in others.columns])
        both = F.col("n") + F.col("n_")
        room = F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"))
        apart = sum(F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_"))) for k in range(_SKETCH))
        pairs = (
            lists.join(other, F.col("token") == F.col("token_"))
            .where("root < root_" if others is lists else "root <> root_")
            .where(self.fits("n", "n_"))
            .where(room * (100 + self.percent) >= both * self.percent)
            .where(apart * (100 + self.percent) <= both * (100 - self.percent))
        )
        return self.ordered(F.col("node"), F.col("node_"), pairs)

    @staticmethod
    def ordered(a, b, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose sets are similar enough, compared item by item."""
        pairs = stored(pairs, "pairs")
        tasks = 1 + pairs.count() // _PAIRS_PER_TASK
        # Written, so that its size is known: where it is small, only the sets it names move.
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ends = stored(ends.coalesce(1 + tasks // _PAIRS_PER_TASK), "pair-ends")
        nodes = self.nodes.join(ends, "node", "left_semi")
        for side in ("a", "b"):
            sets = nodes.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}"))
            pairs = pairs.join(sets, side)
        rows = pairs.select("a", "b", "items_a", "items_b").coalesce(tasks)
        return stored(rows.mapInArrow(_compare(self.percent), "a long, b long"), "linked")

    def rooted(self, lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of `links`, and the lists with each node's root."""
        roots = stored(components(links), "roots")
        lists = lists.drop("root").join(roots, "node", "left")
        lists = lists.withColumn("root", F.coalesce("root", "node"))
        return roots, lists

    def run(self) -> DataFrame:
        """(node, root) of every node with a link."""
        most = self.boundary()
        roots, lists = self.rooted(self.lists(most), self.small_links(most))
        tasks = 1 + lists.count() // _ROWS_PER_TASK
        lists = stored(lists.coalesce(tasks), "rooted-lists")
        found = self.linked(self.first_pairs(lists))
        roots, lists = self.rooted(lists, roots.toDF("a", "b").union(found))
        lists, hubs = self.opened(lists), _HUBS
        while self.left(lists) > hubs * lists.count():
            found = self.linked(self.open_pairs(lists, self.hubs(lists, hubs)))
            roots, lists = self.rooted(lists, roots.toDF("a", "b").union(found))
            lists, hubs = self.opened(lists), _HUBS * hubs
        last = self.linked(self.open_pairs(lists, lists))
        return components(roots.toDF("a", "b").union(last)) if last.limit(1).count() else roots

    @staticmethod
    def left(lists: DataFrame) -> int:
        """Pairs of list rows between different components."""
        per_root = lists.groupBy("token", "root").agg(F.count("*").cast("double").alias("c"))
        per_token = per_root.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        return int(per_token.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of other characters than space and tab to carriage return, with
    A to Z lower-cased. A text's set holds its distinct shingles of `width` words; with
    fewer words the whole sequence is one shingle; a null, empty or blank text has an
    empty set and links with nothing. component_id is the least doc_id that links
    reach, the row itself included; a null doc_id only stands where all are null.
    Repeated rows and repeated ids each give a row. Other columns are not looked at.
    No rows give no rows.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Twice as many buckets as tasks evens out what the hash deals to each.
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(2 * owners)).cast("int").alias("bucket")
    dealt = docs.select("doc_id", "text", bucket)
    id_type = docs.schema["doc_id"].dataType
    arrow_id, id_name = to_arrow_type(id_type), id_type.simpleString()
    sent = dealt.groupBy("bucket").applyInArrow(
        _messages(width, owners, arrow_id),
        f"bucket int, owner int, hashes binary, counts binary, digests binary, ids array<{id_name}>",
    )
    answers = sent.groupBy("owner").applyInArrow(_answers, "bucket int, owner int, ranks binary, won binary")
    met = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket"))
    kind = _NODES.format(id=id_name)
    sets = stored(met.applyInArrow(_prefixes(width, percent, owners, arrow_id), kind), "sets")

    carried = sets.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    carried = stored(carried, "carried")
    nodes = sets.where("items IS NOT NULL")
    roots = _Join(spark, nodes.drop("digest", "doc_id"), percent).run()
    classes = stored(roots.join(nodes.select("node", "digest", "doc_id"), "node").drop("node"), "classes")

    # Written first, so that a root with very many nodes meets a plain side and is split.
    reached = stored(classes.groupBy("root").agg(F.min("doc_id").alias("reached")), "reached")
    linked = classes.join(reached, "root").select("digest", "reached")
    labels = carried.join(linked, "digest", "left")
    labels = stored(labels.select("digest", F.coalesce("reached", "least").alias("component_id")), "labels")
    rows = sets.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    return rows.select("doc_id", "n_shingles", own)
