"""Byte-pair encoding of whole texts with reuse of content-defined chunks."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KNOWN = 400_000        # distinct words a task remembers at most
CHUNKS = 20_000        # chunks, of about a kilobyte
LONG = 64              # longer words are not remembered
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s | \s|\A | \Z")


class _Words(dict):
    """Ids by word; a word not yet known is encoded, and remembered while there is room."""

    def __init__(self, fresh):
        self.fresh = fresh

    def __missing__(self, word: str) -> bytes:
        if len(word) > 2 and word[-1] in ",." and word[-2].isalpha():
            # after a letter these always begin a new piece
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = self.fresh(word)
        if len(self) < KNOWN and len(word) <= LONG:
            self[word] = ids
        return ids


class Coder:
    """Ids of a tokenizer file, as little-endian 32-bit bytes.

    A space between two other visible characters always begins a new piece of the byte-level
    pattern, so a text may be cut there without any change; the words between are looked up
    before they are encoded. The memory is bounded and only saves time. Words of plain Latin
    letters go to a faster library with the same vocabulary, where ids follow merge order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, "rb") as file:
            model = json.load(file)
        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.special = [t["content"] for t in model["added_tokens"]]
        table = self._byte_table()
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(table[c] for c in t)
        for t in model["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.fast = self._fast(model, vocab)
        self.words = _Words(self._fresh)
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _byte_table() -> dict[str, int]:
        """The fixed letters that byte-level tokenizer files write for the 256 bytes."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _fast(self, model, vocab):
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        own = (model["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not model["normalizer"]
        if not own or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken
        pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        ranks = {self.bytes_of[i]: i for i in vocab.values()}
        return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _fresh(self, word: str) -> bytes:
        if self.fast and max(word, default="") < "\u0250":
            return array("I", self.fast.encode_ordinary(word)).tobytes()
        return self.raw(word)

    def forget(self) -> None:
        """Empties the memories of words and chunks."""
        self.words.clear()
        self.chunks.clear()

    def raw(self, text: str) -> bytes:
        return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text, from the ids of its words."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.raw(text)
        if _UNSAFE.search(text):
            words = _SAFE.split(text)
        else:
            words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: np.ndarray) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])


def cuts(text: str, mask: int = 0x3FF, window: int = 16) -> list[int]:
    """Character positions where a rolling hash of the last `window` bytes ends a chunk.

    Positions depend on nearby bytes alone, so a passage is cut alike in every text.
    A cut never parts a character.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < 4 * window:
        return []
    x = raw.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    h = np.zeros(len(raw) - window + 1, np.uint32)
    for j in range(window):
        h = h * np.uint32(31) + x[j:len(raw) - window + 1 + j]
    h ^= h >> np.uint32(13)
    at = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(16) & np.uint32(mask) == 0) + window
    at = at[at < len(raw)]
    at = at[(raw[at] & 0xC0) != 0x80]
    if len(at) == 0:
        return []
    if len(raw) == len(text):
        return at.tolist()
    return np.cumsum((raw & 0xC0) != 0x80)[at - 1].tolist()


def encode_in_chunks(coder: Coder, text: str) -> bytes:
    """Ids of a text: chunks are encoded once, then the joins are put right.

    At a join the characters from the last sure word start before it to the first one after
    it are encoded again, and replace the ids of both sides there. Where the ids of a side do
    not end exactly at that place the span grows by a word, until they agree or the chunk ends.
    """
    if any(s in text for s in coder.special):
        return coder.raw(text)
    at = cuts(text)
    if not at:
        return coder.encode(text)
    ends = [0, *at, len(text)]
    parts = []
    for a, b in zip(ends[:-1], ends[1:]):
        chunk = text[a:b]
        ids = coder.chunks.get(chunk)
        if ids is None:
            ids = coder.encode(chunk)
            if len(coder.chunks) >= CHUNKS:
                coder.chunks.clear()
            coder.chunks[chunk] = ids
        parts.append((chunk, ids))
    out, held, ids = [], *parts[0]
    for chunk, more in parts[1:]:
        left = _agree(coder, held, ids, False)
        right = _agree(coder, chunk, more, True)
        if left is None or right is None:
            held, ids = held + chunk, coder.encode(held + chunk)
            continue
        (i, a), (j, b) = left, right
        out.append(ids[:4 * a])
        out.append(coder.encode(held[i:] + chunk[:j]))
        held, ids = chunk[j:], more[4 * b:]
    return b"".join(out) + ids


def _agree(coder: Coder, chunk: str, ids: bytes, ahead: bool) -> tuple[int, int] | None:
    """The nearest sure word start to the join where an id starts too: character and id number."""
    size = None
    i = 0 if ahead else len(chunk)
    while True:
        i = chunk.find(" ", i + 1) if ahead else chunk.rfind(" ", 0, i)
        if i < 0 or (not ahead and i == 0):
            return None
        if i + 1 >= len(chunk) or i == 0 or chunk[i - 1].isspace() or chunk[i + 1].isspace():
            continue
        if size is None:
            n = np.frombuffer(ids, "<u4")
            near = n[:256] if ahead else n[-256:]
            size = np.cumsum(coder.length_of[near if ahead else near[::-1]])
        want = len((chunk[:i] if ahead else chunk[i:]).encode())
        k = int(np.searchsorted(size, want))
        if k < len(size) and size[k] == want:
            return (i, k + 1) if ahead else (i, len(ids) // 4 - k - 1)
        if k >= len(size):
            return None


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                  ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    `path` is a byte-level tokenizer file that every worker can read. Null text is empty.
    One row per row of `docs`; doc_id may be null or repeated; other columns are ignored.
    Texts that hold a special token's string are encoded by the library as a whole.
    Each task works on its own rows, one text at a time, with bounded memories of words and
    chunks; nothing is shuffled.
    """
    def run(batches):
        tool = coder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = np.frombuffer(encode_in_chunks(tool, text.as_py() or ""), "<u4")
                n.append(len(ids))
                of = tool.text_of
                listed = ids.tolist()
                ids_sha.append(hashlib.sha256(",".join([of[i] for i in listed]).encode()).hexdigest())
                raw = b"".join([tool.bytes_of[i] for i in listed])
                raw = raw.decode(errors="replace").encode()
                text_sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()),
                                   pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
