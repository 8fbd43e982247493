"""Near-duplicate documents by a parity-sketch join on word shingles (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, released
from .components import components
from .shingles import Chunk, mix, shingle_chunks

#: documents whose ids are broadcast to fetch their texts; beyond that the texts are shuffled
BROADCAST_IDS = 2_000_000
#: documents of one bucket that one task compares with as many others
BLOCK = 1_000
#: one document in SAMPLE is looked at for hot keys; a key that HOT of them have is spread over SALTS tasks
SAMPLE, HOT, SALTS = 256, 32, 64
#: sketches under other hash functions for documents whose sketch has too many empty blocks
LEVELS = 6
#: hot keys that are spread; any further ones are the least hot and go to one task each
MAX_HOT = 20_000
#: the low bits of a bucket key, naming size band and level
TAG_BITS = 10

SETS = "doc_id long, shingles array<long>"


class Bands:
    """Size bands, and how many sketch blocks each needs.

    Two sets of sizes a <= b with a Jaccard similarity of at least j differ in at most (a + b)(1 - j)/(1 + j) elements, and
    a >= j b. Band k holds sizes from low[k] to high[k] = low[k + 1] - 1, each low about 1/j of the one before, so the smaller
    of two similar sets is in the larger one's band or the one below. They meet in the larger one's band, whose limit
    of differing elements holds for both.
    """

    def __init__(self, percent: int, largest: int = 1 << 31):
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * 100 // percent)))
        self.low = np.array(lows, np.int64)
        high = self.low[1:] - 1
        self.differ = 2 * high * (100 - percent) // (100 + percent)
        #: more blocks than can differ: what is over must agree
        self.blocks = np.where(self.differ > 0, self.differ + 1 + np.maximum(1, self.differ * 3 // 20), 0)
        self.percent = percent

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (index into sizes, band) in which a set of that size can meet others that differ from it."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        upper = (100 * sizes >= self.percent * self.low[own + 1]) & (sizes > 0)
        index = np.concatenate([np.flatnonzero(sizes > 0), np.flatnonzero(upper)])
        band = np.concatenate([own[sizes > 0], own[upper] + 1])
        use = self.blocks[band] > 0
        return index[use], band[use]


def sketch(chunk: Chunk, index: np.ndarray, blocks: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the chosen sets, one row of blocks after the other, and where each starts.

    A shingle flips one bit of one block, the one its hash names. A block has a bit for every hash, so it is kept as the
    exclusive or of the hashes whose bits are set: equal bits give equal words, and two flips of a bit cancel.
    """
    first = np.cumsum(blocks) - blocks
    lengths = chunk.sizes[index]
    words = np.zeros(int(blocks.sum()), np.uint64)
    inside = np.arange(int(lengths.sum())) + np.repeat(chunk.starts[index] - (np.cumsum(lengths) - lengths), lengths)
    values = chunk.values[inside]
    at = mix(values, 11 + level) >> np.uint64(32)
    at = (at * np.repeat(blocks, lengths).astype(np.uint64)) >> np.uint64(32)
    np.bitwise_xor.at(words, np.repeat(first, lengths) + at.astype(np.int64), values)
    return words, first


def sketch_rows(chunk: Chunk, chosen: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: index of the set, tag, agreeing blocks that a similar set must share, bucket keys and their counts.

    Of `blocks` blocks at most `differ` differ between similar sets; both-empty ones say nothing and give no key. If a
    set has so many empty blocks that nothing must agree, it is sketched again at the next level, where the same holds for a
    similar one; the last level gives keys for empty blocks, too.
    """
    index, band = bands.of(chunk.sizes[chosen])
    index = chosen[index]
    for level in range(LEVELS):
        if not len(index):
            return
        blocks = bands.blocks[band]
        words, first = sketch(chunk, index, blocks, level)
        row = np.repeat(np.arange(len(index)), blocks)
        filled = (words != 0) | (level == LEVELS - 1)
        count = np.bincount(row, filled, len(index)).astype(np.int64)
        must = count - bands.differ[band]
        tag = (band * LEVELS + level).astype(np.uint64)
        place = (np.arange(len(words)) - first[row]).astype(np.uint64)
        keys = mix(words ^ mix((place << np.uint64(TAG_BITS)) | tag[row], 211))
        keys = (keys & ~np.uint64((1 << TAG_BITS) - 1)) | tag[row]
        yield index, tag.astype(np.int64), np.maximum(must, 0), keys[filled].view(np.int64), count
        again = must <= 0
        index, band = index[again], band[again]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        yield from shingle_chunks(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()))


def with_count(rows: DataFrame, key: str) -> DataFrame:
    """Adds n, the rows of each key: counted with partial sums and joined, so that no key's rows have to meet in a task."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def hot_keys(rows: DataFrame, bands: Bands) -> list[int]:
    """Keys that about HOT * SAMPLE documents or more have, found in a sample by id; there are at most all keys / HOT of the sample.

    They only decide where rows go, so a key missed or listed in error changes no result.
    """
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = bucket_keys(some, bands, every=True).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
    return [r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(MAX_HOT).collect()]


def describe(rows: DataFrame, bands: Bands) -> DataFrame:
    """Size and fingerprints of each document's set, and per tag how many agreeing blocks a similar set must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            tags: list[list[int]] = [[] for _ in chunk.ids]
            musts: list[list[int]] = [[] for _ in chunk.ids]
            for index, tag, must, _, _ in sketch_rows(chunk, np.arange(len(chunk.ids)), bands):
                for i, t, m in zip(index.tolist(), tag.tolist(), must.tolist()):
                    tags[i].append(t)
                    musts[i].append(m)
            lists = pa.list_(pa.int64())
            columns = [pa.array(chunk.ids, pa.int64()), *map(pa.array, (chunk.sizes, *chunk.prints())), pa.array(tags, lists), pa.array(musts, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print_1", "print_2", "tags", "musts"])

    return rows.mapInArrow(released(run), "doc_id long, n_shingles long, print_1 long, print_2 long, tags array<long>, musts array<long>")


def bucket_keys(rows: DataFrame, bands: Bands, every: bool = False) -> DataFrame:
    """key, doc_id for every block of every sketch; a set that occurs twice in a chunk is sketched once, or `every` time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            least: dict[tuple[int, int], int] = {}
            prints = list(zip(*(p.tolist() for p in chunk.prints())))
            named = [k for k, name in enumerate(chunk.ids) if name is not None]
            for k in sorted(named, key=lambda k: -chunk.ids[k]):
                least[prints[k] if not every else (k, k)] = k
            names = np.array([name or 0 for name in chunk.ids], np.int64)
            for index, _, _, keys, count in sketch_rows(chunk, np.array(sorted(least.values()), np.int64), bands):
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[index]), pa.ListArray.from_arrays(ends, pa.array(keys))], names=["doc_id", "keys"]
                )

    return rows.mapInArrow(released(run), "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key"))


def shingle_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of the documents in ids (node), broadcast where their number is small enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            ends = pa.array(np.append(chunk.starts, len(chunk.values)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(chunk.values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), lists], names=["doc_id", "shingles"])

    return by_ids(rows, ids.selectExpr("node as doc_id"), "left_semi").mapInArrow(released(run), SETS)


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with ids, which are broadcast where their number is small enough."""
    ids = keep(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_sets = pairs.join(sets.selectExpr("doc_id as a", "shingles as set_a"), "a").join(
        sets.selectExpr("doc_id as b", "shingles as set_b"), "b"
    )
    return with_sets.select("a", "b", "set_a", "set_b").mapInArrow(released(run), "a long, b long").distinct()


def buckets_of(keys: DataFrame, described: DataFrame, classes: DataFrame, hot: list[int]) -> DataFrame:
    """bucket, node: the buckets that pairs of similar nodes must meet in, reduced as far as exactness allows.

    Keys that only one document has go first. Keys with the same documents are one bucket, weighted by their number.
    Copies count as one node. A node that shares fewer keys than a similar set must share has no partner. Of the others, all
    but the largest buckets stay: if m agreeing keys are certain, any m - 1 may be left out when all
    nodes leave out those that come last in one common order.
    """
    # a hot key is spread over SALTS windows, and its members are then the bucket of that key
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    salted = keys.withColumns({"hot": is_hot, "salt": F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))})
    by_key = Window.partitionBy("key", "salt")
    members = F.expr("bit_xor(xxhash64(doc_id)) over (partition by key, salt)")
    shared = salted.withColumns({"n": F.count(F.lit(1)).over(by_key), "members": members}).filter("n > 1 or hot")
    tag = F.col("key").bitwiseAND((1 << TAG_BITS) - 1)
    bucket = F.when(F.col("hot"), F.xxhash64("key")).otherwise(F.xxhash64("members", "n", tag))
    met = shared.groupBy(bucket.alias("bucket"), tag.alias("tag"), "doc_id").agg(F.count(F.lit(1)).alias("weight"))
    nodes = met.join(classes, "doc_id", "left").withColumn("node", F.coalesce("class_id", "doc_id"))
    nodes = keep(nodes.groupBy("bucket", "tag", "node").agg(F.max("weight").alias("weight")), "bucket-nodes")
    nodes = keep(with_count(nodes, "bucket").filter("n > 1"), "buckets")

    musts = described.select(F.col("doc_id").alias("node"), F.explode(F.arrays_zip("tags", "musts")).alias("t")).selectExpr(
        "node", "t.tags as tag", "t.musts as must"
    )
    musts = musts.groupBy("node", "tag").agg(F.min("must").alias("must"))
    largest_first = Window.partitionBy("node", "tag").orderBy(F.desc("n"), "bucket")
    sums = {
        "to_here": F.sum("weight").over(largest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "all": F.sum("weight").over(Window.partitionBy("node", "tag")),
    }
    useful = nodes.join(musts, ["node", "tag"]).withColumns(sums).filter("all >= must and to_here > must - 1")
    useful = keep(useful.select("bucket", "node", "weight"), "useful")
    return keep(with_count(useful, "bucket").filter("n > 1"), "useful-buckets")


def bit_sketches(sets: DataFrame) -> DataFrame:
    """node, n_shingles, bits: a plain parity sketch of each set, its bits a power of two and two to four times the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shingles in batch.column("shingles"):
                values = shingles.values.to_numpy().view(np.uint64)
                size = 1 << max(6, int(2 * len(values) - 1).bit_length())
                at = mix(values, 501) & np.uint64(size - 1)
                flips = np.bincount(at.astype(np.int64), minlength=size) & 1
                out.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
            sizes = batch.column("shingles").value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(out, pa.binary())], names=["node", "n_shingles", "bits"])

    return sets.select("doc_id", "shingles").mapInArrow(released(run), "node long, n_shingles long, bits binary")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the size of the smallest, which keeps parities."""
    words = min(map(len, sketches)) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in sketches])


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one bucket that no link joins yet and whose sizes and sketches allow similarity, each once.

    members: bucket, node, root, n_shingles, bits. A bucket is cut into blocks, and a task compares two of them, so neither
    memory nor time of a task grows with the bucket. The Hamming distance of two sketches is at most the symmetric
    difference of the sets, so a pair beyond what similar sets may differ in goes no further.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, size, block = (table.column(c).to_numpy() for c in ("node", "root", "n_shingles", "block"))
        sketches = folded(table.column("bits").to_pylist())
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        found = [np.zeros((0, 2), np.int64)]
        for i in left:
            other = right if first != second else right[node[right] > node[i]]
            fits = (root[other] != root[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))
            other = other[fits]
            apart = np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            other = other[(100 + percent) * apart <= (100 - percent) * (size[other] + size[i])]
            found.append(np.column_stack([np.minimum(node[other], node[i]), np.maximum(node[other], node[i])]))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    numbered = with_count(members, "bucket").withColumn("last", F.expr(f"(n - 1) div {BLOCK}"))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("node"), F.col("last") + 1))
    spread = numbered.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    spread = spread.select(
        "bucket", "node", "root", "n_shingles", "bits", "block", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second")
    )
    return spread.groupBy("bucket", "first", "second").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of percent / 100 or more.

    1. Equal sets are one class, found by fingerprint; its smallest doc_id stands for it.
    2. Every set gets a parity sketch per size band it can meet others in. The Hamming distance of two sketches is at most the
       symmetric difference of the sets, so among more blocks than may differ some agree: similar sets share a bucket.
    3. In each bucket all members are compared with the one that shares most keys with others; verified links make
       components, and pairs that one already holds are not looked at again.
    4. What stays apart in a bucket is compared pair by pair, block against block.
    5. Every pair is verified on the whole sets. Links between all components give the result.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null and empty texts have no shingles, are linked with nothing and stand alone. Texts of any length are used whole. Rows
    that repeat a doc_id count as linked. A row without a doc_id takes no part and has no component_id. An empty table
    gives no rows. Other columns are ignored.
    """
    bands = Bands(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = keep(describe(rows, bands), "described")
    prints = ["print_1", "print_2", "n_shingles"]
    sized = described.filter("n_shingles > 0 and doc_id is not null")
    groups = sized.groupBy(*prints).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    copies = keep(
        sized.join(groups.filter("n > 1"), prints).filter("doc_id <> class_id").select("doc_id", "class_id").distinct(), "copies"
    )
    sizes = sized.groupBy(F.col("doc_id").alias("node")).agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))

    # a doc_id with several sets stands for itself
    several = sized.groupBy("doc_id").agg((F.min(F.struct(*prints)) != F.max(F.struct(*prints))).alias("several")).filter("several")
    classes = copies.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).join(several, "doc_id", "left_anti")
    members = buckets_of(bucket_keys(rows, bands), sized, classes, hot_keys(rows, bands))
    sets = keep(shingle_sets(rows, members.select("node")), "sets")

    fame = members.groupBy("node").agg(F.sum(F.col("n") * F.col("weight")).alias("fame"))
    famous = members.join(fame, "node")
    centers = famous.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("node")).alias("least"))).alias("top"))
    stars = famous.join(centers.selectExpr("bucket", "-top.least as center"), "bucket").filter("node <> center")
    pairs = stars.groupBy(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"), "node").agg(
        F.sum("weight").alias("weight")
    )
    pairs = (
        pairs.join(sizes.selectExpr("node as a", "low as low_a", "high as high_a"), "a")
        .join(sizes.selectExpr("node as b", "low as low_b", "high as high_b"), "b")
        .filter(f"100 * high_a >= {percent} * low_b and 100 * high_b >= {percent} * low_a")
    )
    pairs = keep(pairs.select("a", "b", "node", "weight"), "star-pairs")
    # first each node's most likely center, then what that leaves apart
    best = pairs.groupBy("node").agg(F.max(F.struct("weight", "a", "b")).alias("top")).selectExpr("top.a", "top.b").distinct()
    copy_links = copies.selectExpr("doc_id as a", "class_id as b")
    links = keep(verify(best, sets, percent), "links").unionByName(copy_links)
    roots = components(links)

    def apart(found: DataFrame, roots: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            named = roots.selectExpr(f"node as {side}", f"root as root_{side}")
            found = found.join(named, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        return found.filter("root_a <> root_b").select("a", "b")

    second = apart(pairs.select("a", "b").distinct().join(best, ["a", "b"], "left_anti"), roots)
    links = links.unionByName(keep(verify(second, sets, percent), "links"))
    roots = components(links)

    rooted = members.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("bucket").agg(
        (F.min("root") != F.max("root")).alias("split"), F.expr("bit_xor(xxhash64(node))").alias("members"), F.count(F.lit(1)).alias("n")
    )
    # buckets with the same members need one look
    split = split.filter("split").groupBy("members", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    open_members = keep(rooted.select("bucket", "node", "root").join(split, "bucket"), "open-members")
    wanted = sets.join(open_members.selectExpr("node as doc_id").distinct(), "doc_id", "left_semi")
    left = block_pairs(open_members.join(bit_sketches(wanted), "node"), percent)
    left = left.join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(keep(verify(left, sets, percent), "links"))
    roots = components(links).selectExpr("node as doc_id", "root")
    return described.join(roots, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without the near duplicates: of each component the document with the smallest id stays.

    Rows that share a doc_id are one document, of which one row stays (the one with the smallest text hash). Rows without a
    doc_id, and texts without words, have no duplicates and stay.
    """
    found = keep(near_duplicates(docs, percent), "components")
    kept = by_ids(docs, found.filter("component_id <> doc_id").select("doc_id"), "left_anti")
    again = keep(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = by_ids(kept, again, "left_semi").withColumn("row_of_id", F.row_number().over(first)).filter("row_of_id = 1")
    return by_ids(kept, again, "left_anti").unionByName(one.drop("row_of_id"))
