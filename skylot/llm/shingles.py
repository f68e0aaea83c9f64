"""N-gram Jaccard join by parity sketches.

A text's set is its distinct word 4-grams, each hashed to 64 bits. For a band of set sizes the hash
space is cut into k blocks; a block's parity sketch has a bit for each value of its elements, and is
kept as the XOR of random words, one a set bit, so that two blocks have one key if (but for 64-bit
chance) the same elements fell into them an odd number of times.

Two sets with 100 * intersection >= 85 * union differ in d = 15/185 * (a + b) elements at most. Each
differing element touches one block, so with k > d blocks at least k - d of them are equal: pairs are
found by an equality join on blocks (pigeonhole). A set looks for partners in its own size band and,
if the band's end is near, in the next; d follows the largest partner of each. Blocks with no or one
element are common in unrelated texts; both kinds, else the empty ones, are left out where k - d exceeds
their number: of the blocks that a linked pair shares, one is then left that neither set leaves out.

Of these equal blocks a pair is sure to share one among the d + 1 that are rarest in each of both sets, by how many classes
have a block over the whole corpus. Only those are keys: what many texts have in common, such as a passage, brings no
pairs unless it is most of a set.

The join never makes all pairs of a group. First every shared block links its members to one pivot,
the member with the most shared blocks; these pairs are verified and the links contracted. Only pairs
that share a block across the components so found are then compared. Before any pair is verified, the
Hamming distance of its parity sketches, which never exceeds the symmetric difference, has to allow a
link. A sketch has 2048 bits or, of larger sets, as many as the set's size, so that it doesn't fill up; the
longer of two folds to the shorter. Verified means: counted on the sets made from the texts.

Spark side: texts with equal sets are one class from the start; block keys are emitted once a class
and partition, and go through one shuffle as arrays, by ranges of the key. A chunk of keys sends its
smallest and largest class of a key there, whatever the number between them, so that a common block
cannot fill a range; only blocks that two classes share are kept. Pairs are narrow rows until they are
distinct; a block with more than CROWD classes is compared where it lies, by sketches alone, in pieces of SPLIT classes
against as many, so that what shares most of a text without being linked makes no rows of pairs. Every stage between joins is
written to the shared folder.

Cases: null, empty and blank texts have no set and link with nothing (component: their own doc_id);
fewer words than four make one shingle; rows that repeat a doc_id are texts of one document, which links
with what any of them links with, so that all its rows have one component; rows with a null doc_id have a
set but no component and link with nothing; texts are read whole; an empty table gives an empty one;
further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.llm.common import LOWER, UPPER, components, staged

N, PERCENT = 4, 85
#: Band borders grow by this factor; blocks beyond the most that can differ, as a share.
GROWTH, SPARE = 1.5, 0.07
SKETCH_BITS = 2048
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Block keys that a task sorts at once; about as many, or fewer, meet in a range.
CHUNK = 1 << 19
#: Ids that are broadcast at most, 8 bytes each, to pick texts where they lie; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Texts, pairs of texts and pairs of sketches in an Arrow batch: texts may be very long.
SET_ROWS, PAIR_ROWS, SKETCH_ROWS = 1000, 100, 500
#: Classes of a block that are compared with as many in one piece; up to CROWD of a block meet in a join.
SPLIT, CROWD = 1000, 40
#: Word hashes that a Python worker keeps at most.
KEPT = 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes are split at SPACE only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out = np.full(max(1, len(words) - n + 1), min(len(words), n), np.uint64)
    for i in range(min(len(words), n)):
        out = mixed_bits(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + len(out)])
    return np.unique(out)


def most_differing(total: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of two linked sets of `total` elements together."""
    return (100 - percent) * total // (100 + percent)


def band(size: int) -> int:
    """The band of a set size: band b holds the sizes from border(b) up to border(b + 1) - 1."""
    b = max(0, int(math.log(size) / math.log(GROWTH)) - 1)
    while border(b + 1) <= size:
        b += 1
    return b


def border(b: int) -> int:
    return math.ceil(GROWTH**b)


@functools.cache
def n_blocks(b: int, percent: int = PERCENT) -> int:
    """Blocks of a band: more than the elements in which a pair with its larger set there can differ."""
    return math.ceil((most_differing(2 * (border(b + 1) - 1), percent) + 1) * (1 + SPARE))


#: A key's low bits: its band modulo 4 (a set looks in two bands at most) and its level, by what the block holds.
LEVELS, LOW_BITS = 3, 4


def blocks(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """(keys of a set's blocks, limits): keys in every band in which it has to meet its partners, and for each band five numbers:
    the band modulo 4, the most blocks that a partner's can differ in, and how many keys each level has. Levels: 0, blocks
    of two elements or more; 1, of one; 2, empty ones."""
    size = len(hashes)
    largest = 100 * size // percent
    differ = most_differing(size + largest, percent)
    if not size or not differ:  # only an equal set can link
        return np.empty(0, np.uint64), []
    keys, limits = [], []
    for b in range(band(size), band(largest) + 1):
        k = n_blocks(b, percent)
        differ = most_differing(size + min(largest, border(b + 1) - 1), percent)
        block = (((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        parity = np.zeros(k, np.uint64)
        np.bitwise_xor.at(parity, block, mixed_bits(hashes ^ np.uint64(0x5851F42D4C957F2D)))
        held = np.bincount(block, minlength=k)
        few = next((few for few in (1, 0) if (held <= few).sum() < k - differ), -1)
        name = mixed_bits(np.arange(k, dtype=np.uint64) + np.uint64(b << 40))
        level = 2 - np.minimum(held, 2)
        low = (level * 4 + b % 4).astype(np.uint64)
        keys.append(((mixed_bits(parity ^ name) >> np.uint64(LOW_BITS) << np.uint64(LOW_BITS)) | low)[held > few])
        limits += [b % 4, differ, *np.bincount(level[held > few], minlength=LEVELS).tolist()]
    return np.concatenate(keys), limits


def block_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return blocks(hashes, percent)[0]


def sketch(hashes: np.ndarray) -> bytes:
    """The parity sketch: SKETCH_BITS, or the power of two that the set's size needs."""
    bits = max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Hamming distances of sketches, each pair folded to the bits of the shorter one."""
    out = np.zeros(len(x), np.int64)
    lengths = np.array([[len(v) for v in x], [len(v) for v in y]]).T
    for pair in {tuple(v) for v in lengths.tolist()}:
        own = np.flatnonzero((lengths == pair).all(1))
        words = [np.frombuffer(b"".join(side[i] for i in own), np.uint64).reshape(len(own), -1, min(pair) // 8) for side in (x, y)]
        folded = [np.bitwise_xor.reduce(w, axis=1) for w in words]
        out[own] = np.bitwise_count(folded[0] ^ folded[1]).sum(1)
    return out


SET = "doc_id long, text_key long, n_shingles long, class long, proof long, keys array<long>, limits array<int>, sketch binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> SET. text_key tells texts of one doc_id apart; class and proof are two digests of
    the set; keys, limits and sketch are given with the first row of a class in a partition, else null."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                h = shingles(text.as_py(), n)
                own = int(xxhash.xxh64_intdigest(h.tobytes())) >> 1
                proof = int(xxhash.xxh64_intdigest(h.tobytes(), seed=1)) >> 1
                new = own not in seen and len(h) > 0
                seen.add(own)
                keys, limits = blocks(h, percent) if new else (None, None)
                rows.append((len(h), own, proof, keys.view(np.int64) if new else None, limits, sketch(h) if new else None))
            size, own, proof, keys, limits, sketches = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(size, pa.int64()), pa.array(own, pa.int64()),
                 pa.array(proof, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(limits, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "class", "proof", "keys", "limits", "sketch"])

    return keyed(docs).mapInArrow(digest, SET)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and their classes, CHUNK at most at a time."""
    kept, size = [], 0
    for batch in batches:
        lists = batch.column("keys")
        keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        classes = np.repeat(batch.column("class").to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(keys):
            taken = min(len(keys) - at, CHUNK - size)
            kept.append((keys[at:at + taken], classes[at:at + taken]))
            at, size = at + taken, size + taken
            if size == CHUNK:
                yield np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept])
                kept, size = [], 0
    if kept:
        yield np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept])


def _by_key(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and where a key's first and last pair is."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    other = keys[1:] != keys[:-1]
    fresh = np.concatenate([[True], other | (classes[1:] != classes[:-1])])[:len(keys)]
    keys, classes = keys[fresh], classes[fresh]
    other = keys[1:] != keys[:-1]
    return keys, classes, np.concatenate([[True], other])[:len(keys)], np.concatenate([other, [True]])[:len(keys)]


def shared_blocks(found: DataFrame) -> DataFrame:
    """SET -> (key, class) for keys that two classes or more have, each once.

    A chunk's smallest and largest class of a key go to the key's range. Those between them, if any, are
    shared whatever is elsewhere: they go through in a group of their own, whose number is negative."""
    spark = found.sparkSession
    total = found.agg(F.sum("n_shingles")).first()[0] or 0  # a set has fewer keys than shingles
    ranges = max(total // CHUNK + 1, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, classes in _chunks(batches):
            keys, classes, first, last = _by_key(keys, classes)
            ends = first | last
            at = (((keys[ends] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            numbers, offsets = at[starts], np.append(starts, len(at))
            sent_keys, sent_classes = keys[ends], classes[ends]
            if not ends.all():
                own = int(xxhash.xxh64_intdigest(keys.tobytes(), seed=2)) >> 1
                numbers, offsets = np.append(numbers, -1 - own), np.append(offsets, len(keys))
                sent_keys, sent_classes = np.append(sent_keys, keys[~ends]), np.append(sent_classes, classes[~ends])
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sent_keys.view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(sent_classes))], ["range", "keys", "classes"])

    def meet(dealt: pa.Table) -> pa.Table:
        keys, classes = (pc.list_flatten(dealt[c]).to_numpy() for c in ("keys", "classes"))
        if dealt["range"][0].as_py() >= 0:
            keys, classes, first, last = _by_key(keys, classes)
            shared = ~(first & last)
            keys, classes = keys[shared], classes[shared]
        return pa.table({"key": pa.array(keys, pa.int64()), "class": pa.array(classes, pa.int64())})

    dealt = found.filter("keys IS NOT NULL").select("class", "keys").mapInArrow(deal, "range long, keys array<long>, classes array<long>")
    return dealt.groupBy("range").applyInArrow(meet, "key long, class long").distinct()


def rarest(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, class) of shared_blocks(), written -> those among the d + 1 first blocks of a set in one order of all blocks: by level,
    then by how many classes have them, then by key. A linked pair differs in d of a set's blocks at most, so the first
    block in that order that both have is among the d + 1 first of each (prefix filter). Blocks that no other class has come
    first in their level and are known by their number alone; sets with more than d of them meet nobody."""
    counts = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    low = F.col("key").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    rows = shared.join(counts, "key").withColumns({"band": (low % 4).cast("int"), "level": F.floor(low / 4).cast("int")})
    own = Window.partitionBy("class", "band", "level")
    rows = rows.withColumns({"nth": F.row_number().over(own.orderBy("n", "key")), "shared": F.count(F.lit(1)).over(own)})
    each = F.sequence(F.lit(0), F.floor(F.size("limits") / 5).cast("int") - 1)
    limits = found.filter("size(limits) > 0").select("class", F.explode(F.transform(each, lambda i: F.slice("limits", i * 5 + 1, 5))).alias("l"))
    limits = limits.groupBy("class", F.get("l", 0).alias("band")).agg(F.first("l").alias("l"))
    before = sum((F.when(F.col("level") > i, F.get("l", i + 2)).otherwise(0) for i in range(LEVELS)), F.lit(0))
    place = before + F.get("l", F.col("level") + 2) - F.col("shared") + F.col("nth")
    return rows.join(limits, ["class", "band"]).filter(place <= F.get("l", 1) + 1).select("key", "class")


def verified(pairs: DataFrame, texts: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among pairs (a, text_a, b, text_b) of doc_ids and text_keys, counted on the sets of
    texts (doc_id, text, text_key). pairs: written."""
    ids = staged(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("text_a").alias("text_key")),
                                                F.struct(F.col("b").alias("doc_id"), F.col("text_b").alias("text_key")))).alias("s")).select("s.*").distinct(), "ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # of repeated rows one is enough
    texts = staged(texts.join(chosen, ["doc_id", "text_key"], "left_semi"), "texts")
    repeated = texts.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        texts = texts.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    one = texts.select(F.col("doc_id").alias("b"), F.col("text_key").alias("text_b"), F.col("text").alias("right"))
    other = texts.select(F.col("doc_id").alias("a"), F.col("text_key").alias("text_a"), F.col("text").alias("left"))
    both = pairs.join(one, ["b", "text_b"]).join(other, ["a", "text_a"]).select("a", "text_a", "b", "left", "right")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            linked = []
            for a, key, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a")), batch.column("left"), batch.column("right"), strict=True):
                if (a, key) != last:
                    last, left = (a, key), shingles(text_a.as_py(), n)
                right = shingles(text_b.as_py(), n)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(common > 0 and 100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(count, "a long, b long")


def _near(percent: int):
    """Of a crowded block's classes, left and right ones of a piece, the pairs across components whose sizes and sketches allow
    a link. What only shares a passage is told apart here, where it lies, and isn't sent on as pairs."""

    def near(piece: pa.Table) -> pa.Table:
        left = piece["left"].to_numpy()
        own, size, part = (piece[c].to_numpy() for c in ("class", "size", "component"))
        sketches = piece["sketch"].to_pylist()
        by_length: dict[tuple[bool, int], list[int]] = {}
        for i, (is_left, value) in enumerate(zip(left.tolist(), sketches, strict=True)):
            by_length.setdefault((is_left, len(value)), []).append(i)
        words = {k: np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1) for k, at in by_length.items()}
        found = []
        for (is_left, a), ours in by_length.items():
            for (is_right, b), theirs in by_length.items():
                if not is_left or is_right:
                    continue
                n, theirs = min(a, b) // 8, np.array(theirs)
                mine, other = (np.bitwise_xor.reduce(words[k].reshape(len(words[k]), -1, n), axis=1) for k in ((True, a), (False, b)))
                for row, i in enumerate(ours):
                    fit = (part[theirs] > part[i]) & (100 * np.minimum(size[theirs], size[i]) >= percent * np.maximum(size[theirs], size[i]))
                    far = np.bitwise_count(mine[row] ^ other[fit]).sum(1)
                    some = theirs[fit][far * (100 + percent) <= (100 - percent) * (size[i] + size[theirs[fit]])]
                    found.append(np.stack([np.minimum(own[i], own[some]), np.maximum(own[i], own[some])]))
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"x": pa.array(pairs[0], pa.int64()), "y": pa.array(pairs[1], pa.int64())})

    return near


def links(docs: DataFrame, found: DataFrame, classes: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Enough links (a, b) between representatives of classes to connect all that is connected.
    found: SET, written; classes: as classes_of() gives them, written."""
    texts = keyed(docs)
    members = staged(rarest(staged(shared_blocks(found), "shared", SET_ROWS), found), "members")
    sketches = found.filter("sketch IS NOT NULL").select("class", "sketch").groupBy("class").agg(F.first("sketch").alias("sketch"))
    fit = F.expr(f"100 * least(size_x, size_y) >= {percent} * greatest(size_x, size_y)")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = apart(batch.column("sketch_x").to_pylist(), batch.column("sketch_y").to_pylist())
            fine = far * (100 + percent) <= (100 - percent) * batch.column("sizes").to_numpy()
            yield batch.select(["a", "text_a", "b", "text_b"]).filter(pa.array(fine))

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) of classes as pairs of representatives whose sizes and sketches allow a link."""
        for c, name in (("x", "a"), ("y", "b")):
            pairs = pairs.join(classes.select(F.col("class").alias(c), F.col("rep").alias(name), F.col("text_key").alias(f"text_{name}"),
                                              F.col("size").alias(f"size_{c}")), c)
        pairs = pairs.filter(fit).withColumn("sizes", F.expr("size_x + size_y"))
        for c in "yx":
            pairs = pairs.join(sketches.withColumnsRenamed({"class": c, "sketch": f"sketch_{c}"}), c)
        return pairs.select("a", "text_a", "b", "text_b", "sizes", "sketch_x", "sketch_y").mapInArrow(
            near, "a long, text_a long, b long, text_b long")

    def connected(pairs: DataFrame) -> DataFrame:
        return staged(verified(staged(alike(pairs), "pairs", SKETCH_ROWS), texts, n, percent), "links", PAIR_ROWS)

    # 1. each shared block's members to its pivot, the one with the most shared blocks
    central = members.groupBy("class").agg(F.count(F.lit(1)).alias("weight"))
    weighed = members.join(central, "class")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", "class")).alias("top")).select("key", F.col("top.class").alias("pivot"))
    star = staged(members.join(pivots, "key").filter("class <> pivot").select(
        F.least("class", "pivot").alias("x"), F.greatest("class", "pivot").alias("y")).distinct(), "star")
    first = connected(star)

    # 2. across the components of these links, what shares a block; narrow rows until pairs are distinct
    joined = components(first)
    of_class = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "class", "size", F.coalesce("component", "rep").alias("component"))
    placed = members.join(of_class, "class")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    rest = staged(placed.join(mixed.select("key", "n", parts.alias("parts")), "key").select(
        "key", "class", "size", "component", "n", "parts", F.pmod(F.hash("class"), "parts").alias("part")), "rest")
    few, many = rest.filter(F.col("n") <= CROWD), rest.filter(F.col("n") > CROWD)
    side = lambda c: few.select("key", *(F.col(k).alias(f"{k}_{c}") for k in ("class", "size", "component")))
    meet = side("x").join(side("y"), "key").filter((F.col("component_x") < F.col("component_y")) & fit)
    pairs = meet.select(F.least("class_x", "class_y").alias("x"), F.greatest("class_x", "class_y").alias("y"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    crowd = many.join(sketches, "class")
    x = crowd.withColumns({"p": F.col("part"), "q": every, "left": F.lit(True)})
    y = crowd.withColumns({"p": every, "q": F.col("part"), "left": F.lit(False)})
    near_pairs = x.unionByName(y).select("key", "p", "q", "left", "class", "size", "component", "sketch").groupBy("key", "p", "q").applyInArrow(_near(percent), "x long, y long")
    pairs = pairs.unionByName(near_pairs).distinct()
    return first.union(connected(staged(pairs.join(star, ["x", "y"], "left_anti"), "candidates")))


def classes_of(found: DataFrame) -> DataFrame:
    """SET -> (class, proof, size, rep, text_key): its text of the smallest doc_id stands for a class."""
    rows = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class", "proof").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("n_shingles").alias("size"))
    return rows.select("class", "proof", "size", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"))


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), one row a document."""
    found = staged(sets(docs, n, percent), "sets", SET_ROWS)
    classes = staged(classes_of(found), "classes")
    rows = found.select("doc_id", "n_shingles", "class", "proof").join(classes.select("class", "proof", "rep"), ["class", "proof"], "left")
    rows = staged(rows.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "rows")
    # a document of several texts connects their classes
    bridges = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).filter(
        "size(reps) > 1").select(F.col("doc_id").alias("a"), F.explode("reps").alias("b"))
    connected = components(links(docs, found, classes, n, percent).union(bridges)).withColumnRenamed("id", "rep")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return rows.join(connected, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def deduplicated(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the component's doc_id. Texts without
    words and rows without doc_id stay."""
    others = staged(joined(docs, n, percent).filter("doc_id <> component_id").select("doc_id").distinct(), "others")
    chosen = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
    return docs.join(chosen, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
