"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at white space, which the tokenizer drops and no token crosses (for a tokenizer that joins a space to
the next word: at single spaces between other characters, the space going with what follows).  So each text's count
is the sum of its pieces' counts, however long it is.  The distinct pieces that are not yet known are encoded in
batches of about the same number of bytes; known ones come from a table of bounded size.

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; repeated rows are each counted; null doc_id is
kept; a long text is one piece of its task's work, with some 30 bytes of memory for each of its own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.llm._shared import SPACE, chunks, runs

BATCH_BYTES = 256 << 10
KNOWN = 500_000
#: pieces() splits longer texts.
PIECE_BYTES = 64 << 10
# Fixed value: the pattern that splits text before the merges of a .tiktoken file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_NOT_SINGLE = re.compile(r"\s\s|\A\s|\s\Z")  # where it is absent every space is a single one


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batches_by_bytes(pieces: Iterable[bytes], size: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Longest first, so that a batch's pieces are alike and each batch has about `size` bytes."""
    batch, total = [], 0
    for p in sorted(pieces, key=len, reverse=True):
        batch.append(p)
        total += len(p) + 16
        if total >= size:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


class Encoder:
    """A vocabulary file with its library: tokenizers for .json, tiktoken for .tiktoken, sentencepiece for .model."""

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.vocab: int
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = plain_specials
            self.vocab = t.get_vocab_size()
            self._ids = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            self._len = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            # a tokenizer with word ends drops white space; a byte-level one joins a space to the next word
            model = getattr(t.model, "end_of_word_suffix", None)
            self.split = bytes.split if model else split_before_spaces
            self.cuts = after_white_space if model else before_spaces
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.vocab = len(ranks) + 1  # the id after the last rank is free for an end of text
            self._ids = lambda texts: list(map(e.encode_ordinary, texts))
            self._len = lambda texts: [len(x) for x in self._ids(texts)]
            self.split, self.cuts = split_before_spaces, before_spaces
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab = p.vocab_size()
            self._ids = lambda texts: p.encode(texts, num_threads=1)
            self._len = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
            self.split, self.cuts = whole, None  # its treatment of spaces depends on the text's edges

    def lengths(self, pieces: list[bytes] | list[str]) -> list[int]:
        return self._len([p if isinstance(p, str) else p.decode() for p in pieces])

    def ids(self, pieces: list[bytes] | list[str]) -> list[list[int]]:
        return self._ids([p if isinstance(p, str) else p.decode() for p in pieces])


def whole(text: bytes) -> list[bytes]:
    return [text] if text else []


def split_before_spaces(text: bytes) -> list[str]:
    """Pieces that a byte-level pattern with ` ?letters` treats alike alone and in the text."""
    if not text:
        return []
    s = text.decode()
    first, *rest = _SINGLE.split(s) if _NOT_SINGLE.search(s) else s.split(" ")
    return [first, *map(" ".__add__, rest)]


def known_pieces(make: Callable[[list[bytes]], list], split: Callable[[bytes], list[bytes]]) -> Callable[[list[bytes]], Iterator[tuple[list[bytes], dict]]]:
    """A function from texts to (pieces, table of what make() gives for each of them)."""
    table: dict[bytes, object] = {}

    def run(texts: list[bytes]) -> Iterator[tuple[list[bytes], dict]]:
        if len(table) > KNOWN:
            table.clear()
        parts = [split(t) for t in texts]
        new: set[bytes] = set()
        for p in parts:
            new.update(set(p).difference(table))
        for batch in batches_by_bytes(new):
            table.update(zip(batch, make(batch), strict=True))
        for p in parts:
            yield p, table

    return run


#: Bytes that white space beyond ASCII may start or end with; next to them no text is cut.
_WIDE_START, _WIDE_END = np.zeros(256, bool), np.zeros(256, bool)
_WIDE_START[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_END[[*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def after_white_space(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut for a tokenizer that drops ASCII white space: at the runs outside it."""
    return runs(data, np.array([0, len(data)]))[0]


def before_spaces(data: np.ndarray) -> np.ndarray:
    """Before single spaces: a byte-level pattern with ` ?letters` treats what follows alike alone and in the text."""
    solid = ~SPACE[data]
    cut = (data[1:-1] == 32) & solid[:-2] & solid[2:] & ~_WIDE_END[data[:-2]] & ~_WIDE_START[data[2:]]
    return np.flatnonzero(cut) + 1


def pieces(data: np.ndarray, off: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray] | None, size: int) -> tuple[list[str], np.ndarray]:
    """The texts, those of over `size` bytes in parts of about that size, and which text each piece is of."""
    whole, at = data.tobytes(), off.tolist()
    out, owner = [], []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        bounds = [a, b]
        if b - a > size and cuts:
            safe = cuts(data[a:b])
            near = np.searchsorted(safe, np.arange(size, b - a, size))
            bounds = [a, *(np.unique(safe[near[near < len(safe)]]) + a).tolist(), b]
        out += [whole[x:y].decode() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        owner += [i] * (len(bounds) - 1)
    return out, np.array(owner, np.int64)


def slices(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    whole_data, at = data.tobytes(), off.tolist()
    return [whole_data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        counted = known_pieces(encoder.lengths, encoder.split)
        for rows, data, off in chunks(batches, size=1 << 20):
            n = [sum(map(table.__getitem__, pieces)) for pieces, table in counted(slices(data, off))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off)), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text); tokenizer: path of a vocabulary file."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_count(tokenizer or default_path("word_bpe_49k.json"), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
