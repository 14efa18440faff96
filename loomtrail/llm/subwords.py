"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary and its scores come from a SentencePiece BPE model file. Merging follows the agenda: of
all neighbouring symbols that join to a piece, the best score goes first, the leftmost of equals. Under
dropout a candidate that reaches the top is skipped if a keyed hash of (seed, document, place of the chunk in
the text, piece, place in the chunk) says so, drawn anew for every occurrence of a chunk; with dropout 0 the ids equal the library's. Skipping changes how a text is cut, never what it says:
decoding gives back the very text. Letters the vocabulary lacks, line breaks among them, are written as
bytes; so is the letter that stands for the space, where a text itself holds it.

Pieces do not reach from another letter over a following space or over a line break, so texts are merged
chunk by chunk. Workers remember the ids and candidates of a chunk without skips, never a draw: the candidates of many
occurrences are drawn at once, and occurrences with a skip are merged once more, each with its own draws.

Results on edge cases: a null or empty text has no ids and decodes to an empty text; equal texts of
different documents may be cut differently, equal rows are cut alike; a null ``doc_id`` stays null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
#: Chunks a worker remembers: bounds its memory, not its results.
REMEMBERED = 600_000
SPACE = "▁"

_CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_MASK = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Chunks of up to so many letters are merged together.
_WIDE = 64
#: Rows of a matrix at most.
_ROWS = 4096
_SLICE = 128
#: Chunks drawn at once.
_SPAN = 100_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * _B) & _MASK
    x = ((x ^ (x >> 27)) * _C) & _MASK
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_C)
    return x ^ (x >> np.uint64(31))


def _below(x: np.ndarray, bound: int) -> np.ndarray:
    return (_mixed_all(x) >> np.uint64(32)) < np.uint64(bound)


class Pieces:
    """A model's vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any("\n" in names[i] or SPACE in names[i].lstrip(SPACE) for i in usual):
            raise ValueError("a piece reaches over a space or line break")
        self.ids = {names[i]: i for i in usual}
        self.rank = {names[i]: -model.get_score(i) for i in usual if len(names[i]) > 1}
        # Symbols are numbered from 1: letters of pieces, and pieces. Every way to put a piece together is a pair of symbols.
        self.symbol = {s: k for k, s in enumerate(sorted({c for p in self.ids for c in p} | set(self.ids)), 1)}
        self.n_symbols = len(self.symbol) + 1
        self.own_id = np.full(self.n_symbols, -1, np.int64)
        for piece, i in self.ids.items():
            self.own_id[self.symbol[piece]] = i
        self.letters = np.zeros(0x110000, np.int64)
        for s, k in self.symbol.items():
            if len(s) == 1:
                self.letters[ord(s)] = k
        self.letters[ord(" ")] = self.letters[ord(SPACE)]
        cuts = [(p[:k], p[k:], p) for p in self.rank for k in range(1, len(p))]
        pairs = sorted(
            (self.symbol[a] * self.n_symbols + self.symbol[b], self.rank[p], self.symbol[p])
            for a, b, p in cuts if a in self.symbol and b in self.symbol
        )
        pairs.append((np.iinfo(np.int64).max, np.inf, 0))
        self.pairs, self.pair_rank, self.pair_symbol = (np.array(c, t) for c, t in zip(zip(*pairs), (np.int64, float, np.int64)))
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.content = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.content[i] = bytes([b])

    def segment(self, chunk: str, skips: tuple[int, ...] = (), key: int = 0, below: int = 0) -> tuple[list[int], list[int]]:
        """Ids of a chunk without the letter for the space, if the candidates of these numbers are skipped.

        And per candidate, in the order they reach the top, a number for its piece and place. Those that ``key`` draws
        ``below`` are skipped, too.
        """
        own = chunk.replace(" ", SPACE)
        symbols: list[str | None] = list(own)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank.get
        agenda = []
        for i in range(n - 1):
            if (r := rank(own[i : i + 2])) is not None:
                agenda.append((r, i, i + 1, 2))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        drawn: list[int] = []
        while agenda:
            r, i, j, size = pop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or len(left) + len(right) != size or after[i] != j:
                continue
            drawn.append(((int(r) * _A) ^ (i * _C)) & _MASK)
            if len(drawn) - 1 in skips or (below and _mixed(key ^ drawn[-1]) >> 32 < below):
                continue
            symbols[i], symbols[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] + symbols[k])) is not None:
                    push(agenda, (r, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + symbols[i])) is not None:
                push(agenda, (r, h, i, len(symbols[h]) + size))
        out = []
        for s in symbols:
            if s is None:
                continue
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out, drawn

    def segment_all(self, chunks: list[str], skips: list[tuple[int, ...]]) -> list[tuple[bytes, bytes]]:
        """``segment`` of many chunks at once, as bytes; of the candidates only those behind the last skip."""
        found: list[tuple[bytes, bytes]] = [(b"", b"")] * len(chunks)
        for places, ids, n_ids, drawn, n_drawn in self.cut_all(chunks, skips):
            ends, stops = np.cumsum(n_ids), np.cumsum(n_drawn)
            for p, a, b, c, d in zip(places.tolist(), ends - n_ids, ends, stops - n_drawn, stops):
                found[p] = ids[a:b].tobytes(), drawn[c + (skips[p][-1] + 1 if skips[p] else 0) : d].tobytes()
        return found

    def cut_all(
        self, chunks: list[str], skips: list[tuple[int, ...]] | None = None, keys: np.ndarray | None = None, below: int = 0
    ) -> Iterator[tuple[np.ndarray, ...]]:
        """``segment`` of many chunks, in parts: places of chunks, their ids and how many each, and so their candidates.

        Chunks of about one length are the rows of a matrix, which holds the score of every symbol with the next; every
        step takes the best candidate of each row. With ``keys`` candidates are drawn, and none are given back.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        wide = sizes[order] > _WIDE
        alone, order = [order[wide]], order[~wide]
        for a in range(0, len(order), _ROWS):
            places = order[a : a + _ROWS]
            letters = np.frombuffer("".join([chunks[p] for p in places.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
            held = np.arange(sizes[places[-1]]) < sizes[places][:, None]
            # A column at either end stands for the edge: it joins nothing.
            symbols = np.zeros((len(places), held.shape[1] + 2), np.int64)
            symbols[:, 1:-1][held] = self.letters[letters]
            named = ((self.own_id[symbols[:, 1:-1]] >= 0) | ~held).all(axis=1)
            alone.append(places[~named])
            places = places[named]
            own = [skips[p] for p in places.tolist()] if skips else None
            yield places, *self._merged(symbols[named], own, None if keys is None else keys[places], below)
        places = np.concatenate(alone)
        cuts = [self.segment(chunks[p], skips[p] if skips else (), 0 if keys is None else int(keys[p]), below) for p in places.tolist()]
        yield places, *(
            part
            for k, kind in enumerate((np.uint32, np.uint64))
            for part in (
                np.fromiter((x for c in cuts for x in c[k]), kind, sum(len(c[k]) for c in cuts)),
                np.fromiter((len(c[k]) for c in cuts), np.int64, len(cuts)),
            )
        )

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of two symbols as one, infinite if they are no piece, and that piece."""
        key = left * self.n_symbols + right
        at = np.searchsorted(self.pairs, key)
        fits = self.pairs[at] == key
        return np.where(fits, self.pair_rank[at], np.inf), self.pair_symbol[at]

    def _merged(
        self, symbols: np.ndarray, skips: list[tuple[int, ...]] | None, keys: np.ndarray | None, below: int
    ) -> tuple[np.ndarray, ...]:
        count, width = symbols.shape
        symbols = np.ascontiguousarray(symbols).ravel()
        live = symbols > 0
        places = np.arange(count * width)
        after, before = places + 1, places - 1
        score, joined = np.full(count * width, np.inf), np.zeros(count * width, np.int64)
        first = np.flatnonzero(live)
        score[first], joined[first] = self._joins(symbols[first], symbols[first + 1])
        table = score.reshape(count, width)
        if skips is not None:
            last = max((own[-1] + 1 for own in skips if own), default=0)
            wanted = np.zeros((count, last + 1), bool)
            for row, own in enumerate(skips):
                wanted[row, list(own)] = True
        owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        rows, step = np.arange(count), 0
        while True:
            best = table[rows].argmin(axis=1)
            at = rows * width + best
            top = score[at]
            going = top < np.inf
            if not going.all():
                rows, best, at, top = rows[going], best[going], at[going], top[going]
            if not len(rows):
                break
            value = (top.astype(np.int64).astype(np.uint64) * np.uint64(_A)) ^ ((best - 1).astype(np.uint64) * np.uint64(_C))
            if keys is None:
                owners.append(rows)
                values.append(value)
            i = at
            if keys is not None or skips is not None:
                # A row has met as many candidates as there were steps.
                skip = _below(value ^ keys[rows], below) if keys is not None else wanted[rows, min(step, last)]
                score[at[skip]] = np.inf
                i = at[~skip]
            step += 1
            j = after[i]
            symbols[i] = joined[i]
            live[j] = False
            score[j] = np.inf
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            left = np.concatenate([i, h])
            score[left], joined[left] = self._joins(symbols[left], symbols[np.concatenate([k, i])])
        ids = self.own_id[symbols[live]].astype(np.uint32)
        owner = np.concatenate(owners)
        drawn = np.concatenate(values)[np.argsort(owner, kind="stable")]
        return ids, live.reshape(count, width).sum(axis=1), drawn, np.bincount(owner, minlength=count)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.content.__getitem__, ids)).decode()[1:]


class _Runs:
    """Arrays one behind the other; room for more is kept."""

    def __init__(self, kind: type):
        self.values, self.filled = np.zeros(1024, kind), 0
        self.starts, self.lengths, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        end, n = self.filled + len(values), self.n + len(lengths)
        if end > len(self.values):
            self.values = np.concatenate([self.values[: self.filled], np.zeros(end, self.values.dtype)])
        if n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x[: self.n], np.zeros(n, np.int64)]) for x in (self.starts, self.lengths))
        self.values[self.filled : end] = values
        self.starts[self.n : n] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[self.n : n] = lengths
        self.filled, self.n = end, n


def _picked(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.arange(lengths.sum()) + np.repeat(shift, lengths)]


class Encoder:
    def __init__(self, path: str, seed: int, dropout: float, remembered: int = REMEMBERED):
        if not 0 <= dropout < 1 or remembered < 1:
            raise ValueError("dropout lies in [0, 1), and one chunk or more is remembered")
        self.pieces, self.seed, self.remembered = Pieces(path), seed, remembered
        self.below = int(dropout * (1 << 32))
        self.clear()

    def clear(self) -> None:
        # The letter for the space in a text comes first: it is written as bytes.
        self.known: dict[str, int] = {SPACE: 0}
        self.ids, self.drawn = _Runs(np.uint32), _Runs(np.uint64)
        letter = np.array([self.pieces.byte_ids[b] for b in SPACE.encode()], np.uint32)
        self.ids.add(letter, np.array([len(letter)]))
        self.drawn.add(np.zeros(0, np.uint64), np.zeros(1, np.int64))

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        new = list({c for c in chunks if c not in known})
        for places, ids, n_ids, drawn, n_drawn in self.pieces.cut_all(new):
            known.update(zip([new[p] for p in places.tolist()], range(self.ids.n, self.ids.n + len(places))))
            self.ids.add(ids, n_ids)
            self.drawn.add(drawn, n_drawn)

    def _cut(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has."""
        self._learn(chunks)
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        starts, lengths = self.ids.starts[number], self.ids.lengths[number]
        n = self.drawn.lengths[number]
        x = _picked(self.drawn.values, self.drawn.starts[number], n) ^ np.repeat(keys, n)
        skipped = np.zeros(len(chunks), bool)
        skipped[np.repeat(np.arange(len(chunks)), n)[_below(x, self.below)]] = True
        others = np.flatnonzero(skipped)
        values = [self.ids.values[: self.ids.filled]]
        end = self.ids.filled
        for places, ids, n_ids, _, _ in self.pieces.cut_all([chunks[p] for p in others.tolist()], None, keys[others], self.below):
            values.append(ids)
            lengths[others[places]] = n_ids
            starts[others[places]] = end + np.cumsum(n_ids) - n_ids
            end += len(ids)
        return _picked(np.concatenate(values), starts, lengths), lengths

    def _span(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        ids, n = self._cut(chunks, keys)
        ends = np.cumsum(n)
        return [ids[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())]

    def encode_all(self, rows: list[tuple[int | None, str]]) -> list[bytes]:
        chunks: list[str] = []
        keys, ends = [], [0]
        for doc_id, text in rows:
            if text:
                found = _CHUNK.findall(" " + text)
                if SPACE in text:
                    found = [p for c in found for p in (re.split(f"({SPACE})", c) if SPACE in c else [c]) if p]
                start = np.uint64(_mixed((self.seed * _B + (doc_id or 0) * _A + (doc_id is None)) & _MASK))
                keys.append(_mixed_all(np.arange(len(found), dtype=np.uint64) * np.uint64(_A) + start))
                chunks += found
            ends.append(len(chunks))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        out, counts = [], [np.zeros(1, np.int64)]
        for at in range(0, len(chunks), _SPAN):
            ids, n = self._cut(chunks[at : at + _SPAN], key[at : at + _SPAN])
            out.append(ids.astype("<u4").tobytes())
            counts.append(n)
            self.forget()
        ids = b"".join(out)
        stops = (4 * np.cumsum(np.concatenate(counts)))[ends].tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:])]

    def encode(self, doc_id: int | None, text: str) -> bytes:
        return self.encode_all([(doc_id, text)])[0]

    def forget(self) -> None:
        if len(self.known) > self.remembered:
            self.clear()


_encoders: dict[tuple, Encoder] = {}
_pieces: dict[str, Pieces] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        gc.disable()  # Remembered strings hold no cycles; walking them takes longer than encoding.
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode_documents(
    docs: DataFrame, seed: int = 0, dropout: float = DROPOUT, path: str | None = None
) -> DataFrame:
    """doc_id, text_hash and ids (little-endian unsigned 32-bit)."""
    key = (path or default_model(), seed, dropout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*key)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = encoder.encode_all(list(zip(part.column(0).to_pylist(), texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(found, pa.binary())], names=["doc_id", "text_hash", "ids"]
                )

    text = F.col("text").cast("string")
    columns = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    return columns.mapInArrow(run, "doc_id long, text_hash long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text_hash, ids and the text they spell."""
    model = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _pieces:
            _pieces[model] = Pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                ids = [np.frombuffer(b, "<u4").tolist() for b in part.column(2).to_pylist()]
                texts = pa.array([_pieces[model].decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "text_hash", "ids", "text"])

    return encoded.select("doc_id", "text_hash", "ids").mapInArrow(
        run, "doc_id long, text_hash long, ids binary, text string"
    )
