"""Token ids of whole texts by the ``tokenizers`` library, inside Spark tasks.

Byte-level BPE cuts a text before it merges: no piece reaches from a non-space character over a
following space. A text is therefore encoded chunk by chunk, cutting before every space and line
break, and the ids of a chunk are remembered. Runs of three or more spaces, and of two or more at the
end or before a special token, form pieces of their own across chunks; such texts are handed to the
library whole.
"""

from __future__ import annotations

import array
import gc
import os
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

END_ID = 2
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Chunks a worker remembers: bounds its memory, not its results.
REMEMBERED = 1_000_000
#: Texts encoded before rows are handed on, in characters.
BATCH_CHARS = 2_000_000

_ACROSS_CHUNKS = re.compile(r"\s{3}|\s{2}(?:\Z|<)")
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_OTHER_ASCII_SPACES = [c for c in _OTHER_SPACES if c.isascii()]
_MARKS = string.punctuation.replace("'", "")
#: Byte-level vocabularies write each byte as one letter: visible Latin-1 as itself, others from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: b for b in _VISIBLE} | {
    b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(_VISIBLE))
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class TextEncoder(dict):
    """Texts to ids, as little-endian unsigned 32-bit integers; a dictionary of the chunks met so far.

    A chunk's key leaves its leading space out; chunks behind a line break keep it.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces = self.library.model.tokenize
        self.marks: dict[str, bytes] = {}
        self.line_break = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def word(self, text: str) -> bytes:
        """A run of letters, with or without a leading space: one piece, so the library's model alone decides."""
        mapped = text.encode().decode("latin-1").translate(_LETTER)
        return array.array("I", [t.id for t in self.pieces(mapped)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """A word and the marks behind it are pieces of their own; anything else goes to the library whole."""
        line = chunk[:1] == "\n"
        body = chunk[1:] if line else chunk
        core = body.rstrip(_MARKS)
        if not core.isalpha():
            ids = self.whole([chunk if line else " " + chunk])[0]
        else:
            marks = body[len(core) :]
            if marks not in self.marks:
                self.marks[marks] = self.whole([marks])[0]
            if line:
                ids = self.line_break + self.word(core) + self.marks[marks]
            elif marks:
                ids = self[core] + self.marks[marks]
            else:
                ids = self.word(" " + core)
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        if len(self) > REMEMBERED:
            self.clear()
            self.marks.clear()
        out: list[bytes] = [b""] * len(texts)
        across, firsts = [], []
        for i, t in enumerate(texts):
            first, *chunks = t.replace("\n", " \n").split(" ")
            spaces = _OTHER_ASCII_SPACES if t.isascii() else _OTHER_SPACES
            if "" in chunks or "\n" in chunks or any(c in t for c in spaces):
                if _ACROSS_CHUNKS.search(t):
                    across.append(i)
                    continue
            firsts.append((i, first))
            out[i] = b"".join(map(self.__getitem__, chunks))
        for (i, _), ids in zip(firsts, self.whole([f for _, f in firsts])):
            out[i] = ids + out[i]
        for i, ids in zip(across, self.whole([texts[i] for i in across])):
            out[i] = ids
        return out


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process, kept over tasks."""
    if path not in _encoders:
        gc.disable()  # Millions of remembered strings hold no cycles; walking them takes longer than encoding.
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of their texts, each with the end id; a null text is empty."""
    enc = encoder(path)
    end = array.array("I", [END_ID]).tobytes()
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        at, chars = 0, 0
        for i, n in enumerate(lengths):
            chars += n
            if chars >= BATCH_CHARS or i == len(lengths) - 1:
                part = batch.slice(at, i + 1 - at)
                texts = [t or "" for t in part.column(column).to_pylist()]
                yield part, [ids + end for ids in enc.encode(texts)]
                at, chars = i + 1, 0
