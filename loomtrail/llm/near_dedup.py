"""Near duplicates by HyperMinHash sketches, banding and verification on full shingle sets.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes. The hash's first bits name
   one of ``REGISTERS`` registers; of the smallest rest in each, the register keeps the number of leading
   zeros and ``MANTISSA`` further bits: 16 bits a register.
2. Equal sets form a class, found by a digest of the set; from here on a class is one node.
3. Registers are cut into bands of four. Nodes that agree in a band lie in one bucket. Two sets of
   similarity 0.8 miss all 32 bands once in 20 million cases. A small set leaves registers empty, and a band of one or
   two registers would let unrelated sets meet by chance, ever more often the more there are; where a band has an empty register,
   each empty one takes the smallest hash of the next filled register, and the four whole hashes are the band's key.
4. Buckets propose pairs. First every member of a bucket is compared with one member, the pivot: the one
   that shares most buckets. What becomes connected needs no further comparison. In buckets that still
   hold nodes of different components, all pairs of different components follow: one by one in small
   buckets; in blocks in large ones, where a task counts the overlaps of two blocks of full sets at
   once and gives out only links that join components. So a bucket of thousands of copies yields about
   as many pairs as members, and no pair is left out.
5. A proposed pair's similarity is estimated from its registers, corrected for chance collisions; pairs
   more than six standard deviations below the threshold are dropped. All others are verified on the
   full sets.
6. Connected components of the verified links; a component is named by its smallest ``doc_id``.

Results on edge cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle form one shingle; rows that share a ``doc_id`` count as one document;
a row without ``doc_id`` has no component of its own, is kept and may only join one through an equal set;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrail.llm.components import connected, spread
from loomtrail.scale import stage

SHINGLE_WORDS = 5
#: Similarity as a fraction: links have ``100 * intersection >= 80 * union``.
THRESHOLD = (80, 100)
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
BAND = 4
PIVOT_ROUNDS = 1
#: Open buckets up to this size propose their pairs one by one; larger ones are compared in blocks.
SMALL_BUCKET = 32
BLOCK, BLOCK_SHINGLES = 512, 500_000
MATRIX_COLUMNS = 4096
DEVIATIONS = 6

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_REST = 64 - REGISTER_BITS
_SLICE = 256


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Distinct shingles of a text as ascending 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    length = min(size, len(words))
    n = len(words) - length + 1
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = out * _P + hashes[k : k + n]
    out ^= out >> np.uint64(30)
    out *= _M1
    out ^= out >> np.uint64(27)
    out *= _M2
    out ^= out >> np.uint64(31)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set, 0 where empty; ``hashes`` ascend, so a register's smallest comes first."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        at, first = np.unique(hashes >> np.uint64(_REST), return_index=True)
        rest = hashes[first] & np.uint64((1 << _REST) - 1)
        part, exponent = np.frexp(np.maximum(rest, 1).astype(np.float64))
        zeros = np.maximum(_REST - exponent, 0)
        mantissa = ((part - 0.5) * (2 << MANTISSA)).astype(np.int64)
        out[at.astype(np.int64)] = (zeros << MANTISSA) + np.minimum(mantissa, (1 << MANTISSA) - 1) + 1
    return out


def band_keys(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A key per band: its four registers, or a hash of four whole hashes where a register is empty."""
    keys = own.view(np.int64).copy()
    if len(hashes) and not own.all():
        at, first = np.unique(hashes >> np.uint64(_REST), return_index=True)
        following = np.searchsorted(at, np.arange(REGISTERS)) % len(at)
        whole = hashes[first][following].reshape(-1, BAND)
        mixed = np.full(len(whole), BAND, np.uint64)
        for k in range(BAND):
            mixed = (mixed ^ whole[:, k]) * _P
            mixed ^= mixed >> np.uint64(29)
        sparse = ~own.reshape(-1, BAND).all(1)
        keys[sparse] = (mixed * _M1).view(np.int64)[sparse]
    return keys


def chance_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of unrelated sets of these sizes that are expected to agree."""
    a, b = n / REGISTERS, m / REGISTERS
    s = np.maximum(a + b, 1e-12)
    # Cells of a register are about x / 2^MANTISSA wide at x; the factor is their mean width within an octave.
    width = 1 / (2 * math.log(2)) / (1 << MANTISSA)
    return REGISTERS * width * a * b * (1 - np.exp(-s) * (1 + s)) / s**2


def could_link(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose corrected estimate does not rule the threshold out."""
    either = ((left != 0) | (right != 0)).sum(1)
    agree = ((left == right) & (left != 0)).sum(1) - chance_collisions(n, m)
    slack = DEVIATIONS * np.sqrt(threshold * (1 - threshold) * either)
    return agree >= threshold * either - slack


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: set size, digest of the set (null if empty), the registers, four to a long, and the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_hashes(t or "", size) for t in batch.column(1).to_pylist()]
            own = [registers(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _long_lists([r.view(np.int64) for r in own]),
                    _long_lists([band_keys(s, r) for s, r in zip(sets, own)]),
                ],
                names=["doc_id", "n_shingles", "digest", "registers", "bands"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers array<long>, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Shingle sets of the documents that stand for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_hashes(t or "", size) for t in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), _long_lists(sets)],
                names=["node", "digest", "shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    wanted = texts.join(nodes.select("node").distinct(), "node", "left_semi")
    return wanted.mapInArrow(run, "node long, digest binary, shingles array<long>").dropDuplicates(["node", "digest"])


class _Linker:
    """Verifies pairs of nodes: first on registers, then on full sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, threshold: tuple[int, int]):
        self.classes, self.threshold = classes, threshold
        self.sets = sets.select("node", "shingles")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        value = self.threshold[0] / self.threshold[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue

                def lists(k: int) -> np.ndarray:
                    values = batch.column(k).flatten().to_numpy(zero_copy_only=False)
                    return np.ascontiguousarray(values).view(np.uint16).reshape(-1, REGISTERS)

                n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5))
                keep = could_link(lists(2), lists(3), n, m, value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"]
                )

        own = self.classes.select("node", "registers", "n_shingles")
        left = own.toDF("a", "ra", "na")
        right = own.toDF("b", "rb", "nb")
        least, most = F.least("na", "nb"), F.greatest("na", "nb")
        both = pairs.join(left, "a").join(right, "b").where(least * self.threshold[1] >= most * self.threshold[0])
        return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        left, right = self.sets.toDF("a", "sa"), self.sets.toDF("b", "sb")
        both = self.estimated(pairs).join(right, "b").join(left, "a")
        common = F.size(F.array_intersect("sa", "sb"))
        measured = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))
        linked = F.col("common") * self.threshold[1] >= F.col("either") * self.threshold[0]
        return measured.where(linked).select("a", "b").distinct()


def _pivots(members: DataFrame, round_: int) -> DataFrame:
    """One member of each bucket: of those that share most buckets first, then at random."""
    if round_ == 0:
        merit = F.struct(F.col("shared"), -F.col("node"))
    else:
        # Among the members of the bucket's most central component.
        merit = F.struct(F.col("merit"), F.xxhash64("bucket", "node", F.lit(round_)), -F.col("node"))
    return members.groupBy("bucket").agg(F.max_by("node", merit).alias("pivot"))


def find_links(docs: DataFrame, classes: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between nodes that connect all nodes whose sets are similar enough."""
    bands = classes.where(F.col("node").isNotNull()).select("node", F.posexplode("bands").alias("band", "key"))
    buckets = bands.select(F.xxhash64("band", "key").alias("bucket"), "node")
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(buckets.join(counts, "bucket").dropDuplicates(["bucket", "node"]), "near-members")
    shared = members.groupBy("node").agg(F.sum("n").alias("shared"))
    sizes = classes.groupBy("node").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    members = stage(
        members.select("bucket", "node").join(shared, "node").join(sizes, "node"), "near-members"
    )
    sets = stage(full_sets(docs, members, size), "near-sets")
    linker = _Linker(classes, sets, threshold)
    labelled = members.withColumn("component", F.col("node")).withColumn("merit", F.lit(0))
    links: DataFrame | None = None
    for n_round in range(PIVOT_ROUNDS):
        pivots = _pivots(labelled, n_round).join(labelled.toDF(*[f"p_{c}" for c in labelled.columns]),
            (F.col("bucket") == F.col("p_bucket")) & (F.col("pivot") == F.col("p_node")))
        pairs = labelled.join(pivots.select("bucket", "pivot", "p_component"), "bucket").where(
            (F.col("node") != F.col("pivot")) & (F.col("component") != F.col("p_component"))
        )
        pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        found = linker.links(pairs)
        links = stage(found if links is None else links.unionByName(found).distinct(), "near-links")
        labelled = stage(_open_buckets(members, spread(links)), "near-open")
    sizes = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("weight"))
    sized = labelled.join(sizes, "bucket")
    rest = linker.links(_small_bucket_pairs(sized.where(F.col("n") <= SMALL_BUCKET), threshold))
    rest = rest.unionByName(_large_bucket_links(sized.where(F.col("n") > SMALL_BUCKET), sets, threshold))
    return stage(links.unionByName(rest).distinct(), "near-links")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that still hold more than one component; ``merit`` marks the component of the most central member."""
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.max_by("component", F.struct(F.col("shared"), -F.col("node"))).alias("central"),
    ).where("low < high")
    return labelled.join(mixed, "bucket").select(
        *members.columns, "component", (F.col("component") == F.col("central")).cast("int").alias("merit")
    )


def _small_bucket_pairs(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs in different components whose sizes allow a link; at most ``SMALL_BUCKET`` a member and bucket."""
    left = members.select("bucket", "node", "component", "least", "most").toDF("bucket", "a", "ca", "la", "ma")
    right = left.toDF("bucket", "b", "cb", "lb", "mb")
    top, base = threshold
    fit = (F.col("ma") * base >= F.col("lb") * top) & (F.col("mb") * base >= F.col("la") * top)
    pairs = left.join(right, "bucket").where((F.col("ca") < F.col("cb")) & fit)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(key: tuple, table: pa.Table, threshold: tuple[int, int]) -> pa.Table:
    """Links within one block of a bucket, or between two, by exact overlaps; only those that join components."""
    top, base = threshold
    nodes, component = table["node"].to_numpy(), table["component"].to_numpy()
    lists = table["shingles"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(nodes)), sizes)
    found, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # Shingles of one set only are in no overlap.
    place = np.cumsum(times > 1) - 1
    used = times[column] > 1
    row, column = row[used], place[column[used]]
    overlap = np.zeros((len(nodes), len(nodes)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + MATRIX_COLUMNS])
        part = np.zeros((len(nodes), MATRIX_COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        overlap += part @ part.T
    linked = overlap * (top + base) >= top * (sizes[:, None] + sizes[None, :])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in np.argwhere(np.triu(linked & (component[:, None] != component[None, :]), 1)).tolist():
        x, y = root(int(component[i])), root(int(component[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _large_bucket_links(members: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Large buckets in blocks: every block meets every other in a task of its own, so that each task holds
    at most two blocks of ``BLOCK`` nodes or about ``BLOCK_SHINGLES`` shingles, and pairs are never written."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = met.select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component"
    )
    return (
        keyed.join(sets.select("node", "shingles"), "node")
        .groupBy("bucket", "low", "high")
        .applyInArrow(lambda key, table: _block_links(key, table, threshold), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (the smallest id of its component)."""
    own = stage(sketches(docs, size), "near-sketches")
    filled = own.where(F.col("digest").isNotNull())
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("node"), F.col("registers"), F.col("bands")))
    classes = stage(
        filled.groupBy("digest").agg(best.alias("best"), F.min("n_shingles").alias("n_shingles")).select(
            "digest", "best.node", "best.registers", "best.bands", "n_shingles"), "near-classes")
    groups = connected(find_links(docs, classes, size, threshold))
    named = classes.select("digest", "node").join(groups, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("class_component"))
    rows = own.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("class_component", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
