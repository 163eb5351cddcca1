"""Byte-level BPE as a lazily determinised finite-state transducer.

A merge list encodes a byte string into the one token sequence whose tokens
each encode to themselves and whose neighbouring pairs stay apart when their
bytes are encoded together. That makes the encoder a transducer: a
configuration is (place in the trie of token bytes, last whole token, tokens
not yet emitted), and reading a byte either walks down the trie or closes a
token that may follow the last one. ``Transducer`` determinises it by subset
construction as inputs ask for it; the longest common prefix of the pending
outputs of all live configurations is emitted at once, so tokens leave after a
bounded lookahead (no configuration outlives the longest token). Every
pre-token that isn't a token itself runs on determinised states. These are a
cache of bounded size, like the other tables: when it is full it is emptied,
and determinising goes on from the state at hand.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from struct import pack, unpack

MAX_STATES = 250_000
MAX_PAIRS = 200_000
MAX_WORDS = 250_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64-token rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_parts(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging: always the pair of lowest rank, the leftmost of equals; only ranks under ``below``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best) and (below is None or r < below):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def self_encoding(ranks: dict[bytes, int]) -> list[bytes]:
    """The vocabulary strings whose own bytes encode to them alone (each is proved by merging it)."""
    return [data for data in ranks if len(merge_parts(data, ranks)) == 1]


class Pairs:
    """Which token may follow which: the merges of both, replayed by rank, must never join across the boundary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.known: dict[int, bool] = {}

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """Parts that stand at one edge of a token while it is merged, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self.edges:
            out, data, ends = [], self.tokens[token], 1 << 60
            while True:
                out.append((data, ends))
                if len(data) == 1:
                    break
                ends = self.ranks[data]
                parts = merge_parts(data, self.ranks, below=ends)
                data = parts[-1] if right else parts[0]
            self.edges[key] = out[::-1]
        return self.edges[key]

    def apart(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            got = self.known[key] = self._apart(self.edge(left, True), self.edge(right, False))
        return got

    def _apart(self, lefts: list[tuple[bytes, int]], rights: list[tuple[bytes, int]]) -> bool:
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            r = self.ranks.get(a + b)
            # A merge within the left token is further left, so it wins a tie; one within the right token loses it.
            if r is not None and r < a_ends and r <= b_ends:
                return False
            if i + 1 == len(lefts) and j + 1 == len(rights):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """bytes -> token ids, for one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int], proven: Iterable[bytes] | None = None, most: int | None = None):
        self.ranks = ranks
        self.most = MAX_STATES if most is None else most
        self.pairs = Pairs(ranks)
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for data in self_encoding(ranks) if proven is None else proven:
            node, rank = 0, ranks[data]
            for b in data:
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = rank
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}
        self.clear()

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one more transition: the state after ``byte`` (its complement, if tokens are emitted) and the tokens that all its configurations agree on."""
        child, token, known = self.child.get, self.token, self.pairs.known.get
        last, nodes, outs = self.states[state]
        nodes_on, outs_on, closed = [], [], None
        for node, out in zip(nodes, outs, strict=True):
            node = child(node << 8 | byte)
            if node:
                nodes_on.append(node)
                outs_on.append(out)
                # At most one way to cut before this byte is right, so the first that fits is the only one.
                if closed is None and (t := token[node]) >= 0:
                    before = out[-1] if out else last
                    if before < 0:
                        closed = (t,)
                    else:
                        fits = known(before << 20 | t)
                        if fits or fits is None and self.pairs.apart(before, t):
                            closed = (*out, t)
        if closed is not None:
            nodes_on.append(0)
            outs_on.append(closed)
        emitted = outs_on[0]
        if emitted:
            for out in outs_on:
                while out[: len(emitted)] != emitted:
                    emitted = emitted[:-1]
                if not emitted:
                    break
            else:
                last, n = emitted[-1], len(emitted)
                outs_on = [out[n:] for out in outs_on]
        # Where all have tokens pending, what was emitted before doesn't matter any more.
        key = (last if () in outs_on else -2, tuple(nodes_on), tuple(outs_on))
        if len(self.states) >= self.most and key not in self.ids:
            self.clear()  # the state that asked is gone: its number may come again, so this transition isn't kept
            state = -1
        to = self.ids.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        if emitted:
            to = ~to
        if state >= 0:
            self.steps[state << 8 | byte] = to
            if emitted:
                self.emits[state << 8 | byte] = emitted
        return to, emitted

    def clear(self) -> None:
        """Drop all determinised states but the first.

        A state: the last token emitted, and of each configuration the place in
        the trie and the tokens not yet emitted. ``steps`` has the next state by
        state and byte; where tokens are emitted, its complement, with the tokens in ``emits``.
        """
        start = (-1, (0,), ((),))
        self.states[:] = [start]
        for d in (self.ids, self.steps, self.emits):
            d.clear()
        self.ids[start] = 0

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one pre-token, each emitted as soon as no byte to come can change it; as the library does, bytes that are a token need no merging."""
        got = self.ranks.get(data)
        if got is not None:
            return (got,)
        out, state, steps, emits = (), 0, self.steps.get, self.emits
        for byte in data:
            to = steps(state << 8 | byte)
            if to is None:
                to, emitted = self.step(state, byte)
                if to < 0:
                    out += emitted
                    to = ~to
            elif to < 0:
                out += emits[state << 8 | byte]
                to = ~to
            state = to
        _, nodes, pending = self.states[state]
        return out + pending[nodes.index(0)]


class Encoder:
    """Texts -> token ids: pre-tokens by a pattern, each through the transducer; recent pre-tokens are remembered.

    The ids of a pre-token are kept as packed 32-bit numbers, so those of a
    text are joined bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, proven: Iterable[bytes] | None = None, states: int | None = None, words: int | None = None):
        import regex

        self.find = regex.compile(pattern).findall
        self.machine = Transducer(ranks, proven, states)
        self.most = MAX_WORDS if words is None else words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, found: list[list[str]]) -> None:
        """Make sure that ``words`` holds every pre-token of ``found``."""
        distinct = set().union(*found)
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        gc.disable()  # states hold no cycles, and there are many of them to look through
        try:
            for w in sorted(distinct - self.words.keys()):  # in order, for words that begin alike share states
                packed = self.older.get(w)
                if packed is None:
                    ids = self.machine.encode(w.encode("utf-8"))
                    packed = pack(f"{len(ids)}i", *ids)
                self.words[w] = packed
        finally:
            gc.enable()

    def encode_all(self, texts: list[str], most: int = 1 << 20) -> Iterator[bytes]:
        """Packed ids of each text; pre-tokens of about ``most`` characters of text are held at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= most):
                size += len(texts[end])
                end += 1
            found = [self.find(t) for t in texts[at:end]]
            self.learn(found)
            for words in found:
                yield b"".join(map(self.words.__getitem__, words))
            at = end

    def encode(self, text: str) -> list[int]:
        data = next(self.encode_all([text]))
        return list(unpack(f"{len(data) // 4}i", data))


#: UTF-8: bytes that must follow a lead byte, by its class (first byte of the class, bytes that follow).
LEADS = ((0xF0, 3), (0xE0, 2), (0xC0, 1))


class StreamDecoder:
    """Token ids -> text in pieces of any size: an incremental UTF-8 machine keeps the bytes of an unfinished character."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end belong to a character that still lacks bytes."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = next(n for lead, n in LEADS if b >= lead)
                return back if need >= back else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        n = self.unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", errors="replace")

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", errors="replace"), b""
        return rest

    def decode(self, ids: list[int], chunk: int = 8192) -> str:
        return "".join(self.pieces(ids, chunk))

    def pieces(self, ids: list[int], chunk: int) -> Iterator[str]:
        for i in range(0, len(ids), chunk):
            yield self.feed(ids[i : i + chunk])
        yield self.close()
