"""Token encoding, decoding and counting over whole texts.

``encode`` and ``decode`` run the byte-level BPE transducer of ``bpe``;
``count_tokens`` counts by a proven table of whole tokens and merges only the
pre-tokens outside it. The vocabulary file is a parameter: its bytes are
broadcast (at most ``MAX_VOCABULARY_BYTES``, refused beyond), so executors
need no file. Null texts count as empty: no ids, no tokens. Texts of any
length are encoded about a million characters at a time, and decoded in pieces;
the row itself, with its ids, is held whole. Rows that repeat are encoded
alike, each by itself; an empty table gives no rows. Columns of other names are
kept as they are; one with the name of a new column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import bpe
from quarry.llm.common import add_by_text, lists_of, once

MAX_VOCABULARY_BYTES = 64 << 20


def _read(path: str) -> tuple[bytes, str]:
    """A vocabulary file's bytes and their digest."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes isn't broadcast")
    return data, hashlib.sha256(data).hexdigest()


def _vocabulary(df: DataFrame, path: str):
    data, digest = _read(path)
    return df.sparkSession.sparkContext.broadcast(data), digest


def _lists(packed: Iterable[bytes]) -> pa.Array:
    rows = list(packed)
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(rows), np.int32))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids array<int>``: the tokens of the whole text, each match of ``pattern`` encoded by itself."""
    data, digest = _vocabulary(df, ranks_path)

    def make():
        encoder = once(("encode", digest, pattern), lambda: bpe.Encoder(bpe.load_ranks(data.value), pattern))
        return lambda texts: [_lists(encoder.encode_all(texts))]

    return add_by_text(df, make, "ids array<int>", text, keep, keeps=True)


def _tokens(data: bytes) -> list[bytes]:
    ranks = bpe.load_ranks(data)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, r in ranks.items():
        out[r] = b
    return out


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded string``: the text of the ids (null ids: empty), decoded in pieces by the incremental UTF-8 machine."""
    data, digest = _vocabulary(df, ranks_path)

    def make():
        table = once(("decode", digest), lambda: _tokens(data.value))
        return lambda rows: [[bpe.StreamDecoder(table).decode(r) for r in rows]]

    return add_by_text(df, make, "decoded string", ids, keep, keeps=True)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, states: int = bpe.MAX_STATES, words: int = bpe.MAX_WORDS) -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass: what ``decode`` makes of what ``encode`` makes of the text. ``states`` and ``words`` bound a worker's caches."""
    data, digest = _vocabulary(df, ranks_path)

    def make():
        encoder, table = once(("both", digest, pattern, states, words), lambda: (bpe.Encoder(bpe.load_ranks(data.value), pattern, states=states, words=words), _tokens(data.value)))

        def of(texts: list[str]) -> list:
            ids = _lists(encoder.encode_all(texts))
            return [ids, [bpe.StreamDecoder(table).decode(r) for r in lists_of(ids)]]

        return of

    return add_by_text(df, make, "ids array<int>, decoded string", text, keep, keeps=True)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a vocabulary file in the json format, byte-level, its added tokens, and the strings proven to be one token."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        of = byte_characters()
        raw = lambda token: bytes(of[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        names: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            to = names.setdefault(a + b, len(names))
            self.pairs.setdefault(names.setdefault(a, len(names)) << 32 | names.setdefault(b, len(names)), (rank, to))
        self.added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        # The proof: a string counts as one token only if merging its bytes really ends in one.
        self.whole = [data.decode("utf-8") for data in names if self.merged(data) == 1 and self._is_text(data)]

    @staticmethod
    def _is_text(data: bytes) -> bool:
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
        if len(data) > 48:
            return self._merged_long(data)
        ids, pairs = list(data), self.pairs.get
        while len(ids) > 1:
            best = None
            for i in range(len(ids) - 1):
                got = pairs(ids[i] << 32 | ids[i + 1])
                if got is not None and (best is None or got[0] < best[0]):
                    best, at = got, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return len(ids)

    def _merged_long(self, data: bytes) -> int:
        """The same with a heap over a linked list, for long pre-tokens."""
        ids, n = list(data), len(data)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (got := self.pairs.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            offer(i)
        count = n
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], count = to, -1, count - 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return count


class Counter(dict):
    """Numbers of tokens of pre-tokens: proven whole tokens are there from the start, others are merged once and remembered (within a bound)."""

    def __init__(self, merges: Merges, pattern: str):
        import regex

        super().__init__(dict.fromkeys(merges.whole, 1))
        self.merges = merges
        self.find = regex.compile(pattern).findall
        self.special = re.compile("|".join(map(re.escape, merges.added))) if merges.added else None
        self.most = len(self) + bpe.MAX_WORDS

    def __missing__(self, word: str) -> int:
        n = self.merges.merged(word.encode("utf-8"))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.merges.whole, 1))
            self[word] = n
        return n

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            total = len(parts) - 1
        return total + sum(sum(map(self.__getitem__, self.find(part))) for part in parts)


def count_tokens(df: DataFrame, json_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens bigint``. Added tokens of the file found inside a text count as one each, as the library's default has it.

    Which strings are one token is proved here, once; executors get the table.
    """
    data, digest = _read(json_path)
    sent = df.sparkSession.sparkContext.broadcast(Merges(data))

    def make():
        counter = once(("count", digest, pattern), lambda: Counter(sent.value, pattern))
        return lambda texts: [[counter.count(t) for t in texts]]

    return add_by_text(df, make, "n_tokens bigint", text, keep, keeps=True)
