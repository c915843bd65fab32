"""Encoding of whole texts with the tokenizers library, in bulk.

A byte-level BPE file splits a text before any merge, and always before a
single space that a visible character follows.  Texts are therefore cut there,
and a text's ids are its chunks' ids in order.  Chunks are told apart by 64-bit
hashes; a worker keeps the ids of those it has met in flat arrays.  A new chunk is
split into the pieces that the file's pattern makes, and each new piece is encoded
by the library.  Texts with other white space after a space or with the string of
an added token, and files of any other kind, go to the library whole.  Strings of
special tokens in a text become those tokens, as the library has it by default;
``plain_specials`` makes them ordinary text.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .common import kept_in_worker, span_hash

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are encoded together.
SLICE = 1 << 21
#: Chunks and pieces that a worker remembers, about 25 bytes and 150 bytes each.
#: What it has forgotten it encodes again, so they trade memory for time only.
CHUNKS, PIECES = 2_500_000, 500_000
#: Ids of chunks that a worker remembers (2 or 4 bytes each).
IDS = 1 << 24
#: How byte-level BPE files split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(spark: SparkSession, path: str | None = None):
    """The tokenizer file, read once on the driver and broadcast (its size is
    that of a vocabulary, not of the data)."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Encoder:
    def __init__(self, text: str, chunks: int = CHUNKS, pieces: int = PIECES, plain_specials: bool = False):
        self.most_chunks, self.most_pieces = chunks, pieces
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # an executor has its own cores busy
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = plain_specials
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and all(t.get("special") and not t.get("lstrip") and not any(map(str.isspace, t["content"])) for t in spec.get("added_tokens") or ())
        )
        self.added = [] if plain_specials else [t["content"] for t in spec.get("added_tokens") or ()]
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes, and for each its ids' place and number (-1: not by chunks).
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.width)

    @classmethod
    def of(cls, shared, chunks: int = CHUNKS, pieces: int = PIECES, plain_specials: bool = False) -> Encoder:
        return kept_in_worker(f"encoder-{hash(shared.value)}-{chunks}-{pieces}-{plain_specials}", lambda: cls(shared.value, chunks, pieces, plain_specials))

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = {2: "H", 4: "I"}[self.width.itemsize]
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str], second: np.ndarray) -> None:
        """Remembers the chunks, which begin with a space unless a text does.
        ``second``: their second bytes."""
        import regex

        pattern = kept_in_worker("bpe-pattern", lambda: regex.compile(PATTERN))
        parts = [pattern.findall(x) for x in texts]
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        known = self.pieces
        new = [x for x in set(chain.from_iterable(parts)) if x not in known]
        known.update(zip(new, self._ids(new)))
        ids = [b"".join(map(known.__getitem__, p)) for p in parts]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        at = len(self.ids) + np.cumsum(n) - n
        odd = [i for i in np.flatnonzero((second <= 32) | (second >= 127)) if (x := texts[i])[0] == " " and (len(x) == 1 or x[1].isspace() or not x[1].isprintable())]
        n[odd] = -1
        if self.added:
            n[[i for i, x in enumerate(texts) if any(t in x for t in self.added)]] = -1
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.width)])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at.astype(np.int32)), np.insert(self.n, place, n.astype(np.int32))

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of UTF-8 bytes, one after the other, and each row's
        number of ids."""
        rows = len(offsets) - 1
        if not self.chunked:
            whole = [np.frombuffer(x, self.width) for x in self._ids([data[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(offsets[:-1], offsets[1:])])]
            return np.concatenate([np.zeros(0, self.width), *whole]), np.array([len(x) for x in whole], np.int64)
        flag = data == 32
        flag[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(flag)
        ends = np.concatenate([starts[1:], [len(data)]])[: len(starts)]
        first = np.searchsorted(starts, offsets)
        h = span_hash(data, starts, ends)
        kinds, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(kinds) > self.most_chunks or len(self.ids) + len(data) > IDS:
            self._forget()
        near = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[near] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(new):
            raw = data.tobytes()
            a, z = starts[sample[new]], ends[sample[new]]
            gc.disable()  # many small objects, none in a cycle
            self._learn(kinds[new], [raw[i:j].decode("utf-8", "replace") for i, j in zip(a.tolist(), z.tolist())], np.where(z - a > 1, data[np.minimum(a + 1, len(data) - 1)], 0))
            gc.enable()
            near = np.searchsorted(self.keys, kinds)
        n, at = self.n[near][inverse].astype(np.int64), self.at[near][inverse].astype(np.int64)
        odd = np.unique(np.searchsorted(first, np.flatnonzero(n < 0), "right") - 1) if (n < 0).any() else ()
        n = np.maximum(n, 0)
        done = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(at - done[:-1], n) + np.arange(done[-1])]
        count = np.diff(done[first])
        if len(odd):
            parts = np.split(flat, np.cumsum(count)[:-1])
            whole = self._ids([data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in odd])
            for i, x in zip(odd, whole):
                parts[i] = np.frombuffer(x, self.width)
            flat, count = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, count if rows else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        data = [x.encode() for x in texts]
        flat, n = self.encode_rows(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        return np.split(flat, np.cumsum(n)[:-1]) if texts else []
