"""Token-id files under a Re-Pair grammar, with random access.

A table of shards, stored as Parquet. A shard holds consecutive documents, up to about
``SHARD_TOKENS`` ids (a longer document has a shard of its own), and its own grammar: frequent pairs
of neighbouring symbols are replaced by nonterminals, again and again. A round counts all pairs and
replaces the most frequent ones together, from the left, never across the end of a document.
Symbols below ``first_rule`` are token ids; symbol ``first_rule + k`` is rule ``k``, a pair of earlier
symbols. ``rule_lengths`` gives the ids each rule stands for, so a reader finds a token position by
adding lengths and expands only what it wants.

==============  ================================================================
doc_ids         documents in order
n_tokens        ids of each document, with its end id
symbol_starts   where each document begins in ``symbols``
first_rule      symbols below it are token ids
rules           pairs, little-endian unsigned 32-bit
rule_lengths    expanded lengths, little-endian unsigned 32-bit
symbol_bytes    2 or 4: width of a symbol
symbols         the documents, little-endian unsigned integers
==============  ================================================================

``part`` and ``shard`` order the shards. Documents are in ascending order of ``doc_id`` (missing ids
first, equal ids by a hash of their text). A null or empty text is stored as its end id; equal rows
are all stored; an empty table gives an empty shard table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtrail.llm import tokens

SHARD_TOKENS = 1 << 20
ROUNDS = 3
#: Pairs replaced in a round at most; rarer ones wait for the next round. Keeps symbols within 16 bits.
RULES_A_ROUND = 4096
MIN_COUNT = 16
#: Token ids are below this bound; rules are numbered from it.
VOCABULARY = 50_257

_SHARDS = (
    "part int, shard int, doc_ids array<long>, n_tokens array<long>, symbol_starts array<long>, first_rule long, "
    "rules binary, rule_lengths binary, symbol_bytes int, symbols binary"
)


def _frequent_pairs(keys: np.ndarray, inside: np.ndarray, limit: int, least: int) -> tuple[np.ndarray, ...]:
    """The most frequent keys, ascending, each found ``least`` times or more; where they are, and which.

    Counts of hashed keys show which keys can be among them; only those are sorted.
    """
    wide = keys.dtype.itemsize * 8
    mix = keys.dtype.type(0x9E3779B1 if wide == 32 else 0x9E3779B97F4A7C15)
    bins = (keys * mix) >> keys.dtype.type(wide - 16)
    counts = np.bincount(bins, minlength=1 << 16)
    floor = max(least, int(np.partition(counts, -limit)[-limit]))
    at = np.flatnonzero((counts >= floor)[bins] & inside)
    found, which, n = np.unique(keys[at], return_inverse=True, return_counts=True)
    good = np.flatnonzero(n >= least)
    if len(good) > limit:
        good = np.sort(good[np.argsort(-n[good], kind="stable")[:limit]])
    rank = np.full(len(found), -1)
    rank[good] = np.arange(len(good))
    which = rank[which]
    return found[good], at[which >= 0], which[which >= 0]


def compress(
    ids: np.ndarray, lengths: np.ndarray, first_rule: int = VOCABULARY, rounds: int = ROUNDS,
    limit: int = RULES_A_ROUND, least: int = MIN_COUNT,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the start of each document among them, and the rules as pairs.

    ``ids`` are the documents one after the other, ``lengths`` their lengths, each 1 or more.
    """
    half = 16 if first_rule + rounds * limit <= 1 << 16 else 32
    kind = np.uint32 if half == 16 else np.uint64
    symbols = ids.astype(kind)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        keys = (symbols[:-1] << kind(half)) | symbols[1:]
        chosen, hit, rank = _frequent_pairs(keys, ~last[:-1], limit, least)
        if not len(chosen):
            break
        # Of pairs that overlap, every other one from the left.
        begins = np.r_[True, np.diff(hit) > 1]
        run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        turn = (np.arange(len(hit)) - run) % 2 == 0
        hit = hit[turn]
        symbols[hit] = (first_rule + n_rules + rank[turn]).astype(kind)
        last[hit] = last[hit + 1]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, last = symbols[keep], last[keep]
        rules.append(np.stack([chosen >> kind(half), chosen & kind((1 << half) - 1)], 1).astype(np.uint64))
        n_rules += len(chosen)
    starts = np.r_[0, np.flatnonzero(last) + 1][:-1]
    return symbols, starts, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint64)


def lengths_of(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):
        # Rules of one round refer to earlier rounds only.
        later = np.flatnonzero((rules[done:] >= first_rule + done).any(1))
        end = done + (int(later[0]) if len(later) else len(rules) - done)
        sides = rules[done:end].astype(np.int64)
        known = np.r_[out[:done], 0]
        out[done:end] = np.where(sides < first_rule, 1, known[np.clip(sides - first_rule, 0, done)]).sum(1)
        done = end
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for."""
    out = symbols.astype(np.int64)
    while len(at := np.flatnonzero(out >= first_rule)):
        width = np.ones(len(out), np.int64)
        width[at] = 2
        place = np.cumsum(width) - width
        wider = np.empty(int(width.sum()), np.int64)
        wider[place] = out
        pairs = rules[out[at] - first_rule].astype(np.int64)
        wider[place[at]] = pairs[:, 0]
        wider[place[at] + 1] = pairs[:, 1]
        out = wider
    return out.astype(np.uint32)


def _shard(part: int, shard: int, doc_ids: list, found: list[bytes], first_rule: int, rounds: int) -> dict:
    lengths = np.array([len(x) // 4 for x in found], np.int64)
    ids = np.frombuffer(b"".join(found), "<u4")
    if len(ids) and int(ids.max()) >= first_rule:
        raise ValueError("a token id lies above the vocabulary's bound")
    symbols, starts, rules = compress(ids, lengths, first_rule, rounds)
    width = 2 if first_rule + len(rules) <= 1 << 16 else 4
    return {
        "part": part, "shard": shard, "doc_ids": doc_ids, "n_tokens": lengths.tolist(),
        "symbol_starts": starts.tolist(), "first_rule": first_rule, "rules": rules.astype("<u4").tobytes(),
        "rule_lengths": lengths_of(rules, first_rule).astype("<u4").tobytes(), "symbol_bytes": width,
        "symbols": symbols.astype(f"<u{width}").tobytes(),
    }


_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
     ("symbol_starts", pa.list_(pa.int64())), ("first_rule", pa.int64()), ("rules", pa.binary()),
     ("rule_lengths", pa.binary()), ("symbol_bytes", pa.int32()), ("symbols", pa.binary())]
)


def write_shards(
    docs: DataFrame, folder: str, path: str | None = None, vocabulary: int = VOCABULARY, rounds: int = ROUNDS,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every text and write the shard table, in ascending order of ``doc_id``."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        waiting: list[bytes] = []
        for piece, found in tokens.encoded(batches, path, 1):
            for doc, ids in zip(piece.column(0).to_pylist(), found):
                if waiting and size + len(ids) // 4 > shard_tokens:
                    yield pa.RecordBatch.from_pylist([_shard(part, shard, doc_ids, waiting, vocabulary, rounds)], _ARROW)
                    doc_ids, waiting, size, shard = [], [], 0, shard + 1
                doc_ids.append(doc)
                waiting.append(ids)
                size += len(ids) // 4
        if waiting:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, doc_ids, waiting, vocabulary, rounds)], _ARROW)

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    in_order = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    in_order.mapInArrow(run, _SHARDS).write.option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SHARDS).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """The ids of all documents before each shard."""
    sizes = shards.select(
        "part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("size")
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per written file.
    parts = sizes.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "shard", (F.col("part_start") + F.col("inside")).alias("shard_start")
    )


def read_documents(shards: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents of a shard table: place (part, shard, ``start_in_shard``), length and ids.

    With ``wanted``, only the shards that hold these documents are read, and of them only the symbols
    of these documents are expanded.
    """
    if wanted is not None:
        shards = shards.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(w).cast("long") for w in wanted])))
    only = None if wanted is None else set(wanted)
    schema = "part int, shard int, doc_id long, start_in_shard long, n_tokens long, ids binary"
    arrow = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("start_in_shard", pa.int64()),
         ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                symbols = np.frombuffer(row["symbols"], f"<u{row['symbol_bytes']}")
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                lengths = np.array(row["n_tokens"], np.int64)
                starts = np.cumsum(lengths) - lengths
                docs = range(len(lengths))
                if only is None:
                    raw = expand(symbols, rules, row["first_rule"]).astype("<u4").tobytes()
                    ids = [raw[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), row["n_tokens"])]
                else:
                    docs = [d for d in docs if row["doc_ids"][d] in only]
                    ends = [*row["symbol_starts"][1:], len(symbols)]
                    ids = [
                        expand(symbols[row["symbol_starts"][d] : ends[d]], rules, row["first_rule"]).tobytes()
                        for d in docs
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ids), pa.int32()), pa.array([row["shard"]] * len(ids), pa.int32()),
                     pa.array([row["doc_ids"][d] for d in docs], pa.int64()), pa.array(starts[list(docs)], pa.int64()),
                     pa.array(lengths[list(docs)], pa.int64()), pa.array(ids, pa.binary())], schema=arrow
                )

    return shards.mapInArrow(run, schema)
