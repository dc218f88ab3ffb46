"""Bulk encoding with a public tokenizer.

Where the steps before merging are those of `word_bpe_49k.json`, which drop white space and join nothing across it, texts are cut
at spaces and line feeds, each distinct piece is encoded once, and the ids of a text are gathered with numpy, which equals encoding
the whole text. With any other tokenizer whole texts go to the tokenizers library.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The steps before merging of `word_bpe_49k.json`, which plain pieces can skip.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Printable ASCII, and Latin-1 letters whose lower case is Latin-1 and which no normal form changes.
PLAIN = re.compile(r"(?!.*<\|)[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
CHUNKS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-`{-~]+").findall
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the other bytes, in order, for 256 and on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SELF)}

#: A piece table above this many entries is started anew.
MAX_PIECES = 700_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Pieces(dict):
    def __init__(self):
        super().__init__({"": 0})
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.pending.append(piece)
        return number


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        told = json.loads(self.tokenizer.to_str())
        self.direct = (told["normalizer"], told["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and all("<|" in t["content"] and not re.search(r"\s", t["content"]) for t in told["added_tokens"])
        self._reset()

    def _reset(self) -> None:
        self.pieces = _Pieces()
        self.flat = np.zeros(0, "<u4")
        self.start = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int64)

    def _encode_pending(self) -> None:
        pending = self.pieces.pending
        if not pending:
            return
        ids: list[int] = []
        lengths = np.empty(len(pending), np.int64)
        others = []
        for i, piece in enumerate(pending):
            before = len(ids)
            if PLAIN(piece):
                for chunk in CHUNKS(piece.lower()):
                    ids += [t.id for t in self.tokenize(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(BYTES))]
            else:
                others.append(i)
            lengths[i] = len(ids) - before
        starts = self.flat.size + np.cumsum(lengths) - lengths
        flat = [self.flat, np.array(ids, "<u4")]
        end = self.flat.size + len(ids)
        for i, e in zip(others, self.tokenizer.encode_batch([pending[i] for i in others], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, "<u4"))
            starts[i], lengths[i] = end, len(e.ids)
            end += len(e.ids)
        self.flat = np.concatenate(flat)
        self.start, self.length = np.concatenate([self.start, starts]), np.concatenate([self.length, lengths])
        self.pieces.pending = []

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (little-endian uint32) of each text; null encodes as the empty text."""
        if not self.direct:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self.pieces) > MAX_PIECES:
            self._reset()
        look = self.pieces.__getitem__
        numbers = []
        for text in texts:
            cut = (text or "").replace("\n", " ").split(" ")
            numbers.append(np.fromiter(map(look, cut), np.int64, len(cut)))
        self._encode_pending()
        return [self._gather(n) for n in numbers]

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        if not ends[-1]:
            return self.flat[:0]
        at = np.repeat(self.start[numbers] - (ends - lengths), lengths)
        at += np.arange(at.size)
        return self.flat[at]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Forgets this process's encoders; operators with large tables of their own call it as a task begins."""
    _ENCODERS.clear()


def text_slices(batches, rows: int = 1024):
    """Batches cut to a thousand rows, so that few texts are Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_blocks(texts, limit: int = 4_000_000):
    """(first, last) row numbers of runs of texts of about limit characters at most, or of one text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
