"""Alignment of two tokenizers' tokens over the same text, and how often their ids meet.

Tokenizer A is a byte-level vocabulary of the ``tokenizers`` library, B a SentencePiece model with byte fallback.
Both write a space followed by the text (B puts that space there by itself). Where a token ends is read from the
libraries first: character offsets of A, spans of B's proto (the form that follows the immutable proto in
current releases). These are coarse cuts: an offset tells nothing inside a character of several bytes that tokens share,
nor a span inside a letter written as byte tokens. There the decoded bytes of the tokens supply the missing ends, and at every
coarse cut both must agree.

Offsets where a token of A and one of B both end cut the bytes into groups. Each pair of tokens whose bytes overlap is a
link. No piece of either vocabulary reaches from another character over a following space or line break, so a text is aligned
chunk by chunk, each beginning with one, and workers remember chunks. A pair of ids counts the rows of
the table that hold it linked; ``scored`` adds the counts to every row's links. Counts are joined by a broadcast of at most
``BROADCAST_PAIRS`` pairs: all of them, or those that most rows hold; the others, each with few rows, by a shuffle.

Results on edge cases: a null or empty text, or one whose joined token bytes of A or B are not a space and the text
(it holds the letter that stands for a space, or one without a token), has no tokens: zeros and no groups. Special tokens' names
inside a text are plain text. Every row is a document of its own, equal rows and rows that share or lack a ``doc_id``
too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.llm.subwords import default_model
from loomtrail.llm.tokens import _LETTER, default_path
from loomtrail.scale import stage

SPACE = "▁"
#: Chunks and characters of chunks a worker remembers: they bound its memory, not its results.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
#: Texts aligned before rows are handed on, in characters.
BATCH_CHARS = 500_000
BROADCAST_PAIRS = 1_000_000

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A chunk that any other may follow, and the number of such chunks handed over at once.
_USUAL = re.compile(r"[ \n]\S(?:.*\S)?", re.DOTALL)
_ROW = 64
_BYTE = {letter: byte for byte, letter in _LETTER.items()}


def refine(ends: list[int], sure: list[bool], lengths: list[int]) -> list[int] | None:
    """Ends of tokens in bytes: coarse where ``sure``, by decoded lengths elsewhere; None if the two contradict."""
    at, out = 0, []
    for end, is_sure, length in zip(ends, sure, lengths):
        at += length
        if is_sure and at != end:
            return None
        out.append(at)
    return out


def overlaps(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links as pairs of token places, and groups as places behind their last tokens; both end at the same byte."""
    links, groups = [], []
    i = j = 0
    while i < len(a_ends) and j < len(b_ends):
        links.append((i, j))
        a, b = a_ends[i], b_ends[j]
        if a <= b:
            i += 1
        if b <= a:
            j += 1
        if a == b:
            groups.append((i, j))
    return links, groups


class _Chunks:
    """What is known of chunks, by number: counts, the digest text of the groups, links as codes."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n_a, self.n_b, self.n_groups = (array.array("q") for _ in range(3))
        self.starts, self.codes = array.array("q", [0]), array.array("q")
        self.chars = 0


class Aligner:
    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            letters = map(_BYTE.get, map(ord, name))
            self.a_bytes[i] = name.encode() if None in (known := list(letters)) else bytes(known)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            if SPACE in name.lstrip(SPACE) or "\n" in name:
                raise ValueError("a piece reaches over a space or line break")
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(SPACE, " ").encode())
        self.width = len(self.b_bytes)
        # Ids as the digest text has them: with what follows inside a group, then with what follows at its end.
        self.a_names = np.array([b"%d%b" % (i, end) for end in (b",", b"|") for i in range(len(self.a_bytes))], object)
        self.b_names = np.array([b"%d%b" % (i, end) for end in (b",", b";") for i in range(self.width)], object)
        self.remembered = remembered
        self.known = _Chunks()

    def a_tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids and byte ends of A's tokens; None where their bytes are not the text's."""
        out = []
        for text, found in zip(texts, self.a.encode_batch(texts, add_special_tokens=False)):
            ids, offsets, raw = found.ids, found.offsets, text.encode()
            content = list(map(self.a_bytes.__getitem__, ids))
            if b"".join(content) != raw:
                out.append(None)
                continue
            ends = [o[1] for o in offsets]
            # An end inside a character is one the next token begins before.
            if len(raw) != len(text):
                begins = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
                at = [*np.flatnonzero(begins).tolist(), len(raw)]
                sure = [n[0] >= e for e, n in zip(ends, offsets[1:])] + [True]
                ends = refine([at[e] for e in ends], sure, list(map(len, content)))
            out.append(ends and (ids, ends))
        return out

    def b_tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The same of B; the space it adds is the first of a text, or taken away before a line break."""
        spaced = [t[0] == " " for t in texts]
        bare = [t[1:] if s else t for t, s in zip(texts, spaced)]
        every, spans = self.b.encode(bare), self.b.encode(bare, return_type="proto")
        out = []
        for text, own, ids, span in zip(texts, spaced, every, spans):
            ends = [p.end for p in span.pieces]
            if not own:
                if not ids or self.b_bytes[ids[0]] != b" ":
                    out.append(None)
                    continue
                ids, ends = ids[1:], ends[1:]
            content = list(map(self.b_bytes.__getitem__, ids))
            if b"".join(content) != text.encode():
                out.append(None)
                continue
            if own:
                ends = [e + 1 for e in ends]
            # An empty span is a byte of a letter that ends later, or the added space alone.
            sure = [e > before for before, e in zip([int(own), *ends], ends)]
            ends = refine(ends, sure, list(map(len, content)))
            out.append(ends and (ids, ends))
        return out

    def rows_of(self, chunks: list[str]) -> tuple[list[tuple[list[str], tuple, tuple]], list[str]]:
        """Tokens of A and B of chunks, and the chunks that have none.

        Usual chunks are handed to the libraries in rows of many: a row has an end of both where a chunk ends.
        """
        usual = [c for c in chunks if _USUAL.fullmatch(c)]
        lone = [[c] for c in chunks if not _USUAL.fullmatch(c)]
        out, none = [], []
        for rows in ([usual[at : at + _ROW] for at in range(0, len(usual), _ROW)], lone):
            texts = ["".join(row) for row in rows]
            for row, a, b in zip(rows, self.a_tokens(texts), self.b_tokens(texts)):
                if a and b:
                    out.append((row, a, b))
                elif len(row) == 1:
                    none += row
                else:
                    lone += [[c] for c in row]
        return out, none

    def learn(self, chunks: list[str]) -> None:
        k = self.known
        rows, none = self.rows_of(chunks)
        for chunk in none:
            k.number[chunk] = len(k.groups)
            k.n_a.append(-1), k.n_b.append(-1), k.n_groups.append(0), k.groups.append(b"")
            k.starts.append(len(k.codes))
        if not rows:
            return
        learned = [c for row, _, _ in rows for c in row]
        k.number.update(zip(learned, range(len(k.groups), len(k.groups) + len(learned))))
        k.chars += sum(map(len, learned))
        # All rows as one stream of bytes, in which every chunk ends with a token of both.
        stops = np.cumsum([len(c.encode()) for c in learned])
        last = np.cumsum([len(row) for row, _, _ in rows]) - 1
        base = np.r_[0, stops[last][:-1]]

        def stream(side: int) -> tuple[np.ndarray, np.ndarray]:
            n = [len(row[side][0]) for row in rows]
            ids = np.fromiter((i for row in rows for i in row[side][0]), np.int64, sum(n))
            return ids, np.fromiter((e for row in rows for e in row[side][1]), np.int64, sum(n)) + np.repeat(base, n)

        (ids_a, ends_a), (ids_b, ends_b) = stream(1), stream(2)
        both = np.concatenate([ends_a, ends_b])
        both.sort(kind="stable")
        shared = both[1:] == both[:-1]
        ends, cuts = both[np.r_[True, ~shared]], both[1:][shared]
        codes = ids_a[np.searchsorted(ends_a, ends)] * self.width + ids_b[np.searchsorted(ends_b, ends)]

        def each(values: np.ndarray) -> np.ndarray:
            return np.bincount(np.searchsorted(stops, values), minlength=len(stops))

        n_a, n_b = each(ends_a), each(ends_b)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        names = np.empty(len(ids_a) + len(ids_b), object)
        names[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = self.a_names[
            ids_a + len(self.a_bytes) * (cuts[group_a] == ends_a)
        ]
        names[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = self.b_names[
            ids_b + self.width * (cuts[group_b] == ends_b)
        ]
        written, stop = names.tolist(), np.cumsum(n_a + n_b).tolist()
        k.groups += [b"".join(written[i:j]) for i, j in zip([0, *stop], stop)]
        k.starts.frombytes((len(k.codes) + np.cumsum(each(ends))).astype(np.int64).tobytes())
        k.codes.frombytes(codes.tobytes())
        for kept, n in ((k.n_a, n_a), (k.n_b, n_b), (k.n_groups, each(cuts))):
            kept.frombytes(n.astype(np.int64).tobytes())

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The chunks of each text; none where the bytes of the tokens are not the text's."""
        if len(self.known.groups) > self.remembered or self.known.chars > REMEMBERED_CHARS:
            self.known = _Chunks()
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        missing = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.known.number))
        self.learn(missing)
        number, n_a = self.known.number, self.known.n_a
        out = []
        for text, chunks in zip(texts, cut):
            found = [number[c] for c in chunks]
            if any(n_a[i] < 0 for i in set(found)):
                # Whole texts decide: only the bytes of all tokens together have to be the text's.
                whole = " " + text
                if whole not in number:
                    self.learn([whole])
                found = [number[whole]] if n_a[number[whole]] >= 0 else []
            out.append(found)
        return out

    def rows(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Per text: counts, digest of the groups, and its different links with their numbers."""
        found = self.numbers(texts)
        k = self.known
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for one in found for i in one), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values[flat], len(found)).astype(np.int64)

        starts = np.frombuffer(k.starts, np.int64)
        links = np.diff(starts)
        counts = {n: total(np.frombuffer(getattr(k, n), np.int64)) for n in ("n_a", "n_b", "n_groups")} if len(flat) else {
            n: np.zeros(len(found), np.int64) for n in ("n_a", "n_b", "n_groups")}
        # A chunk that a text repeats is taken once and weighs as often as it stands there.
        pairs, times = np.unique(owner * len(k.groups) + flat, return_counts=True) if len(flat) else (flat, flat)
        owner, chunk = np.divmod(pairs, max(len(k.groups), 1))
        n = links[chunk]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - starts[chunk], n)
        codes = np.frombuffer(k.codes, np.int64)[at] if len(at) else at
        owner, weight = np.repeat(owner, n), np.repeat(times, n)
        order = np.lexsort((codes, owner))
        owner, codes, weight = owner[order], codes[order], weight[order]
        first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(codes) != 0)]) if len(codes) else at
        weight = np.add.reduceat(weight, first) if len(first) else weight
        owner, codes = owner[first], codes[first]
        n_links = np.bincount(owner, weight, len(found)).astype(np.int64)
        text = k.groups.__getitem__
        return counts | {
            "n_links": n_links,
            "groups_sha256": [hashlib.sha256(b"".join(map(text, f))[:-1]).hexdigest() if f else "" for f in found],
            "offsets": np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(found)))]).astype(np.int32),
            "pairs": codes, "times": weight.astype(np.int32),
        }

    def groups(self, text: str) -> list[dict]:
        """The groups of one text, with byte offsets in the space and the text."""
        chunks = [" " + text] if any(self.known.n_a[i] < 0 for i in self._chunk_numbers(text)) else _CUT.split(" " + text)
        out, start = [], 0
        for chunk in chunks if text else []:
            found, _ = self.rows_of([chunk])
            if not found:
                return []
            _, a, b = found[0]
            i = j = 0
            base = start
            for x, y in overlaps(a[1], b[1])[1]:
                end = base + a[1][x - 1]
                out.append({"start": start, "stop": end, "a_ids": a[0][i:x], "b_ids": b[0][j:y]})
                i, j, start = x, y, end
        return out

    def _chunk_numbers(self, text: str) -> list[int]:
        chunks = _CUT.split(" " + text) if text else []
        self.learn([c for c in dict.fromkeys(chunks) if c not in self.known.number])
        return [self.known.number[c] for c in chunks]


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(key: tuple[str, str]) -> Aligner:
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at, chars = 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= BATCH_CHARS or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, chars = i + 1, 0


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its different links as ``pairs`` with ``times``.

    A pair is the id of A times B's vocabulary size plus the id of B.
    """
    key = (a_path or default_path(), b_path or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(key)
        for part, texts in _parts(batches):
            found = aligner.rows(texts)
            offsets = pa.array(found["offsets"])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(found[n])) for n in ("pairs", "times")]
            counts = [pa.array(found[n]) for n in ("n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(found["groups_sha256"], pa.string()), *lists],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return _columns(docs).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<int>",
    )


def token_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per group: doc_id, text_hash, place in the text, byte offsets in the space and the text, ids of A and B."""
    key = (a_path or default_path(), b_path or default_model())
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int64()), ("start", pa.int64()),
                        ("stop", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(key)
        for part, texts in _parts(batches):
            for doc_id, text_hash, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts):
                own = {"doc_id": doc_id, "text_hash": text_hash}
                rows = [own | {"place": i} | g for i, g in enumerate(aligner.groups(text))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    columns = _columns(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return columns.mapInArrow(
        run, "doc_id long, text_hash long, place long, start long, stop long, a_ids array<int>, b_ids array<int>"
    )


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """Per pair of ``linked`` rows: the rows that hold it, and whether it is the highest count of its id of A."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.withColumn("a_id", F.expr(f"pair div {width}")), "pair-counts")
    highest = counts.groupBy("a_id").agg(F.max("n").alias("top"))
    return counts.join(highest, "a_id").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _sums(times: Column, n: Column, best: Column) -> list[Column]:
    return [F.sum(F.when(best, times).otherwise(0)).alias("n_best"), F.sum(times * n).alias("count_sum")]


def scored(rows: DataFrame, width: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to the rows of ``linked``; ``pairs`` and ``times`` are left out."""
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "linked-rows")
    counts = stage(pair_counts(rows, width), "pair-scores")
    n_pairs, n_held = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    # At most held / least pairs are held by ``least`` rows or more.
    least = 0 if n_pairs <= broadcast_pairs else -(-n_held // broadcast_pairs)
    frequent = held.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    known = frequent.where("n is not null").groupBy("row").agg(*_sums(F.col("times"), F.col("n"), F.col("best")))
    if least:
        rare = counts.where(F.col("n") < least)
        others = frequent.where("n is null").select("pair", "row", "times").join(rare.hint("shuffle_merge"), "pair")
        more = others.groupBy("row").agg(*_sums(F.col("times"), F.col("n"), F.col("best")))
        known = known.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(known, "row", "left").select(
        *[c for c in rows.columns if c not in ("row", "pairs", "times")],
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
    )


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path or default_model()).get_piece_size()
    found = scored(linked(docs, a_path, b_path), width)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
