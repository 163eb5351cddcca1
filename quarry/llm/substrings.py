"""Removal of repeated runs of words by suffix trees, partitioned by prefixes.

A window is ``length`` consecutive words. Suffixes are sampled: of each window
the ``GRAM`` words of least hash are its anchor, which equal windows have at
equal places, and neighbouring windows with one anchor make a segment. The
words that a suffix starts with decide which group it belongs to, and those
prefixes are as long as it takes for a group to fit in memory:

* the anchor's ``GRAM`` words, where at most ``GROUP`` different segments have
  them;
* else ``GRAM + SIDE`` words, from the anchor on for windows that reach that
  far, from ``SIDE`` words before it for the others;
* where even these are shared by more than ``GROUP`` segments, all ``length``
  words: then a group is one class of equal windows, of which the least
  document is all that is held.

Within groups of the first two kinds a subtree is built of the windows'
suffixes, in sorted form: the leaves in order, and the depth of the branching
between neighbours. Its internal nodes at ``length`` words or deeper are the
repeats; of their leaves all but those of the least document are marked.
Subtrees compare words by their bytes, those of over ``LONG`` bytes by SHA-256.

Before any group is made, what is plain goes its own way: segments equal as a
whole (64 bits of their words' hashes and of the anchor's; their bytes are not
moved) are settled by the least document, within a batch of texts first, so
that copies and boilerplate are one row a batch in the exchange. Repeats
within a text are found where the text is.

Null and empty texts have no words. Rows with a null key remove nothing
elsewhere and lose only what repeats within them; so do, among themselves,
rows that share a key. Rows that repeat whole get the same result. Very long
texts are read in pieces of ``PIECE`` words, their hashes of windows are held
together. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import map_batches, pick
from quarry.llm.repeats import Prefixes, _powers, beside, covered, mix

GRAM, SIDE = 4, 8
#: Words of a piece of a long text and of the pieces worked on at a time; different segments that are one group at most, and that are put into subtrees at a time.
PIECE, CHUNK, GROUP, SETTLE = 1 << 15, 1 << 16, 20_000, 20_000
#: Bytes of a word beyond which its SHA-256 stands for it.
LONG = 256
#: Low bits of an anchor's hash that hold hashes of the words beside it.
SIDES = 16
#: Kinds of marks and rows: a whole segment is repeated; a segment goes on by its anchor, or by a longer prefix.
FULL, COLD, HOT = 0, 1, 2
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


class Sums(Prefixes):
    """Prefix polynomial hashes of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray):
        if len(self.up) <= len(values):
            n = 2 * len(values) + 2
            Prefixes.up, Prefixes.down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])


def word_hashes(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by spaces, where each starts and ends, and their hashes."""
    data = b" ".join(words) + b" "
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw == 32)
    start = np.concatenate(([0], end[:-1] + 1))
    return data, start, end, mix(Prefixes(raw).of(start, end) + (end - start).astype(np.uint64) * _BASE)


class Segments:
    """The segments of some pieces of texts, each (row, place of its first word, words) with at least ``length`` words."""

    def __init__(self, pieces: list[tuple[int, int, list[bytes]]], length: int):
        self.data, self.word_start, self.word_end, h = word_hashes([w for p in pieces for w in p[2]])
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        first = np.cumsum(sizes) - sizes
        n = len(h) - GRAM + 1
        grams = h[:n]
        for i in range(1, GRAM):
            grams = grams * _BASE + h[i : n + i]
        grams = mix(grams)
        least = grams & _U(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
        width, step = length - GRAM + 1, 1
        while step * 2 <= width:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
        starts = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, first)
        piece = np.searchsorted(first, starts, "right") - 1
        stop = np.minimum(np.concatenate((starts[1:], [len(anchor)])), (first + sizes)[piece] - length + 1)
        ok = stop > starts
        self.start, self.windows, piece = starts[ok], (stop - starts)[ok], piece[ok]
        self.end = self.start + self.windows + length - 1
        at = anchor[self.start]
        self.left = at - self.start
        self.sums = Sums(h)
        # Beside the anchor a window holds SIDE words on one side at least.
        sides = []
        for inside, a, b in ((self.left >= SIDE, at - SIDE, at), (self.end - at >= GRAM + SIDE, at + GRAM, at + GRAM + SIDE)):
            sides.append(np.where(inside, mix(self.sums.of(np.where(inside, a, at), np.where(inside, b, at))) % _U(255) + _U(1), _U(0)))
        self.key = (grams[at] & ~_U((1 << SIDES) - 1) | sides[0] << _U(8) | sides[1]).view(np.int64)
        self.hash = mix(self.sums.of(self.start, self.end) + self.windows.astype(np.uint64)).view(np.int64)
        self.row = np.array([p[0] for p in pieces], np.int64)[piece]
        self.at = self.start - first[piece] + np.array([p[1] for p in pieces], np.int64)[piece]

    def once_a_row(self, which: np.ndarray) -> np.ndarray:
        """Of the segments ``which``, the first of equal ones of a row."""
        _, one = np.unique(self.hash[which].view(np.uint64) + self.row[which].astype(np.uint64) * _BASE, return_index=True)
        one.sort()  # rows of a document stay together, which shuffle compression rewards
        return which[one]

    def text(self, a: int, b: int) -> bytes:
        return self.data[self.word_start[a] : self.word_end[b - 1]]


def chunks(texts: list[list[bytes]], length: int):
    """``Segments`` of the texts' words, a chunk at a time; where a text is cut doesn't depend on its neighbours."""
    pieces, size = [], 0
    for row, words in enumerate(texts):
        for at in range(0, max(0, len(words) - length + 1), PIECE):
            part = words[at : at + PIECE + length - 1]
            if pieces and size + len(part) > CHUNK:
                yield Segments(pieces, length)
                pieces, size = [], 0
            pieces.append((row, at, part))
            size += len(part)
    if pieces:
        yield Segments(pieces, length)


def _words(column: pa.Array) -> list[list[bytes]]:
    """The words of each text: ``bytes.split`` cuts at exactly the white space of ASCII."""
    return [(x or b"").split() for x in column.cast(pa.binary()).to_pylist()]


def short(texts: list[list[bytes]]) -> list[list[bytes]]:
    """The texts with digests (that no UTF-8 text holds) for words of over ``LONG`` bytes."""
    return [[w if len(w) <= LONG else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in t] if max(map(len, t), default=0) > LONG else t for t in texts]


def _rows(s: Segments):
    """Where the segments of each row begin and end."""
    edge = np.flatnonzero(np.concatenate(([True], s.row[1:] != s.row[:-1]))).tolist()
    return zip(edge, [*edge[1:], len(s.row)], strict=True) if len(s.row) else ()


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


ENTRY = ["m", "s", "d", "u", "settled"]


def _entries(length: int):
    """(key, identity, text) -> (anchor, segment, key, identity, settled): each segment once a row; settled if a row of smaller key in the batch has it."""

    def fn(batches):
        for b in batches:
            d, u = (b.column(i).to_numpy() for i in (0, 1))
            found = []
            for s in chunks(short(_words(b.column(2))), length):
                one = s.once_a_row(np.arange(len(s.row)))
                found.append((s.key[one], s.hash[one], s.row[one]))
            if not found:
                continue
            m, h, row = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((d[row], h, m))
            new = np.concatenate(([True], (m[order][1:] != m[order][:-1]) | (h[order][1:] != h[order][:-1])))
            first = np.repeat(order[new], np.diff(np.concatenate((np.flatnonzero(new), [len(order)]))))
            settled = np.zeros(len(m), bool)
            settled[order] = d[row[order]] > d[row[first]]
            # Rows that share the least key are one entry too: they are no repeats of each other.
            kept = settled.copy()
            kept[order] |= new | (u[row[order]] != u[row[first]])
            yield _batch(ENTRY, m[kept], h[kept], d[row[kept]], u[row[kept]], settled[kept])

    return fn


MARK = ["u", "d", "s", "kind"]


def _decide(group: int):
    """Entries, those not settled sorted by (m, s, d) -> marks (identity, key, segment, kind)."""

    def marks(u, d, s, kind):
        return _batch(MARK, u, d, s, pa.array(np.broadcast_to(np.int8(kind), len(u)), pa.int8()))

    def fn(batches):
        held = [np.zeros(0, np.int64)] * 4  # different segments of the group that may go on: m, s, d, u
        going, hot, last = None, False, None  # its anchor; whether it has been found to be large; (m, s, least key) of the row before
        for b in batches:
            m, s, d, u = (b.column(i).to_numpy() for i in range(4))
            settled = b.column(4).to_numpy(zero_copy_only=False)
            if settled.any():
                yield marks(u[settled], d[settled], s[settled], FULL)
                m, s, d, u = (x[~settled] for x in (m, s, d, u))
            if not len(m):
                continue
            new = np.concatenate(([last is None or (m[0], s[0]) != last[:2]], (m[1:] != m[:-1]) | (s[1:] != s[:-1])))
            least = np.concatenate((d[new], [last[2] if last else 0]))[np.cumsum(new) - 1]  # -1 is the run of the row before
            full = d > least
            if full.any():
                yield marks(u[full], d[full], s[full], FULL)
            last = (m[-1], s[-1], least[-1])
            m, s, d, u = (np.concatenate((x, y[new])) for x, y in zip(held, (m, s, d, u), strict=True))
            if not len(m):
                continue
            edge = np.flatnonzero(np.concatenate(([True], m[1:] >> SIDES != m[:-1] >> SIDES))).tolist()
            for a, z in zip(edge, [*edge[1:], len(m)], strict=True):
                anchor, open_ = m[a] >> SIDES, z == len(m)
                large = (hot and anchor == going) or z - a > group
                if large:
                    yield marks(u[a:z], d[a:z], s[a:z], HOT)
                elif not open_ and z - a > 1:
                    yield from cold(m[a:z], s[a:z], d[a:z], u[a:z])
            going, hot = anchor, large
            held = [x[len(x) if hot else a :] for x in (m, s, d, u)]
        if len(held[0]) > 1:
            yield from cold(*held)

    def cold(m, s, d, u):
        """Segments of one anchor that agree with one of another document on a side."""
        if d.min() == d.max():
            return
        out = beside(np.zeros(len(m), np.int64), m, d)
        if out.any():
            yield marks(u[out], d[out], s[out], COLD)

    return fn


CANDIDATE = ["p", "d", "u", "s", "shift", "windows", "words", "kind"]


def _candidates(length: int):
    """(..., key, identity, text, cold, hot, full) -> the marked segments' words by their prefix: (prefix, key, identity, segment, its first window, windows, words, kind)."""

    def fn(batches):
        for b in batches:
            b = b.filter(b.column(b.num_columns - 6).is_valid())
            key, identity, text, *marks = b.columns[-6:-1]
            d, u = key.to_numpy(), identity.to_numpy()
            wanted = [[np.array(x or [], np.int64) for x in c.to_pylist()] for c in marks]
            for s in chunks(short(_words(text)), length):
                take = np.zeros(len(s.row), np.int8)
                for a, z in _rows(s):
                    for kind, lists in ((COLD, wanted[0]), (HOT, wanted[1])):
                        if len(x := lists[s.row[a]]):
                            take[a:z][np.isin(s.hash[a:z], x)] = kind
                i = s.once_a_row(np.flatnonzero(take == COLD))
                j = s.once_a_row(np.flatnonzero(take == HOT))
                none = np.zeros(len(i), np.int64)
                # Windows that start more than SIDE words before the anchor reach back far enough, the others far enough on.
                early = np.clip(s.left[j] - SIDE, 0, s.windows[j])
                at = s.start[j] + s.left[j]
                parts = [(i, none, s.windows[i], s.key[i] >> SIDES, COLD)]
                for which, shift, windows, back in ((early > 0, np.zeros(len(j), np.int64), early, SIDE), (early < s.windows[j], early, s.windows[j] - early, 0)):
                    x = (at - back)[which]
                    prefix = mix(s.sums.of(x, x + GRAM + SIDE) + _U(back)).view(np.int64)
                    parts.append((j[which], shift[which], windows[which], prefix, HOT))
                for k, shift, windows, prefix, kind in parts:
                    if len(k):
                        a = s.start[k] + shift
                        text = [s.text(x, y) for x, y in zip(a.tolist(), (a + windows + length - 1).tolist(), strict=True)]
                        r = s.row[k]
                        yield _batch(CANDIDATE, prefix, d[r], u[r], s.hash[k], pa.array(shift, pa.int32()), pa.array(windows, pa.int32()), pa.array(text, pa.binary()), pa.array(np.full(len(k), kind), pa.int8()))

    return fn


def subtree(words: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``words`` at ``start`` in order, and at what depth each branches from the one before it (``depth`` at most; -1 for the first).

    Names of stretches of 1, 2, 4, ... words in sorted order give the order of
    the first ``depth`` words; neighbours are compared by the same names, from
    the longest down. Each suffix has ``depth`` words at least.
    """
    levels, size = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while size * 2 <= depth:
        one = levels[-1]
        pair = one * (len(words) + 1)
        pair[:-size] += one[size:] + 1
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        size *= 2
    # The first ``depth`` words are the stretch of the longest named size and the one that ends with them.
    longest = levels[-1]
    order = np.lexsort((longest[start + depth - size], longest[start]))
    a, b = start[order][:-1], start[order][1:]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        for _ in range(depth // size if level == len(levels) - 1 else 1):
            at = np.flatnonzero(common + step <= depth)
            same = at[levels[level][a[at] + common[at]] == levels[level][b[at] + common[at]]]
            common[same] += step
    return order, np.concatenate(([-1], common))


def deep_nodes(branch: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf the number of its topmost internal node at ``depth`` or deeper (a leaf alone has its own)."""
    return np.cumsum(branch < depth) - 1


def repeated_windows(texts: list[bytes], doc: np.ndarray, windows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch of words, which of its first ``windows`` windows a smaller document has among all of them."""
    split = [t.split(b" ") for t in texts]
    names: dict[bytes, int] = {}
    words = np.fromiter((names.setdefault(w, len(names)) for t in split for w in t), np.int64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    owner = np.repeat(np.arange(len(split)), windows)
    first = np.cumsum(windows) - windows
    within = np.arange(len(owner)) - first[owner]
    order, branch = subtree(words, (np.cumsum(sizes) - sizes)[owner] + within, length)
    node = deep_nodes(branch, length)
    d = doc[owner[order]]
    least = np.full(node[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, d)
    hit = np.zeros(len(owner), bool)
    hit[order] = d > least[node]
    return np.split(hit, first[1:])


PART = ["q", "d", "u", "s", "mask", "window"]


def _subtrees(length: int, group: int):
    """Candidates sorted by (kind, prefix, key) -> parts: (null, key, identity, segment, repeated windows), or a window's own row where a group is too large."""

    def settle(held):
        t = pa.Table.from_batches(held).combine_chunks()
        d, u, s, shift, windows = (t.column(n).to_numpy() for n in ("d", "u", "s", "shift", "windows"))
        hits = repeated_windows(t.column("words").to_pylist(), d, windows.astype(np.int64), length)
        mask = np.array([(np.int64(1) << (np.flatnonzero(x) + k)).sum() for x, k in zip(hits, shift.tolist(), strict=True)], np.int64)
        i = np.flatnonzero(mask)
        none = pa.nulls(len(i), pa.int64())
        return _batch(PART, none, d[i], u[i], s[i], mask[i], pa.nulls(len(i), pa.binary()))

    def dealt(b):
        """Each window of the rows by all its words."""
        d, u, s, shift = (b.column(n).to_pylist() for n in ("d", "u", "s", "shift"))
        for i, (text, n) in enumerate(zip(b.column("words").to_pylist(), b.column("windows").to_pylist(), strict=True)):
            w = text.split(b" ")
            parts = [b" ".join(w[x : x + length]) for x in range(n)]
            hashes = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in parts]
            yield _batch(PART, hashes, [d[i]] * n, [u[i]] * n, [s[i]] * n, [1 << x + shift[i] for x in range(n)], pa.array(parts, pa.binary()))

    def fn(batches):
        held, n = [], 0  # whole groups, not settled yet
        tail, size, large, going = [], 0, False, None  # the group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("p").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))).tolist()
            for a, z in zip(edge, [*edge[1:], len(p)], strict=True):
                if p[a] != going:
                    held, n = held + tail, n + size
                    if n >= SETTLE:
                        yield settle(held)
                        held, n = [], 0
                    tail, size, large, going = [], 0, False, p[a]
                rows = b.slice(a, z - a)
                if large or size + z - a > group:
                    for x in (*tail, rows):
                        yield from dealt(x)
                    tail, size, large = [], 0, True
                else:
                    tail.append(rows)
                    size += z - a
        if held or tail:
            yield settle(held + tail)

    return fn


def _equal_windows(batches):
    """Parts, rows of windows sorted by (q, key) -> (identity, segment, mask) of repeated windows; of each class of equal windows only the least key is held."""
    going, least = None, {}
    for b in batches:
        q = b.column("q")
        plain = b.filter(q.is_null())
        if plain.num_rows:
            yield plain.select(["u", "s", "mask"])
        rows = b.filter(q.is_valid())
        if not rows.num_rows:
            continue
        us, ss, masks = [], [], []
        for h, d, u, s, mask, window in zip(*(rows.column(c).to_pylist() for c in PART), strict=True):
            if h != going:
                going, least = h, {}
            if d > least.setdefault(window, d):
                us.append(u), ss.append(s), masks.append(mask)
        yield _batch(["u", "s", "mask"], *(pa.array(x, pa.int64()) for x in (us, ss, masks)))


def _groups(texts: list[list[bytes]]):
    """Runs (from, to) of texts with at most ``CHUNK`` words together; a longer text is alone."""
    a, size = 0, 0
    for z, words in enumerate(texts):
        if z > a and size + len(words) > CHUNK:
            yield a, z
            a, size = z, 0
        size += len(words)
    if texts:
        yield a, len(texts)


def again(texts: list[list[bytes]], length: int) -> list[list[int]]:
    """For each text, the windows whose words also start earlier in it."""
    out: list[list[int]] = [[] for _ in texts]
    for a, z in _groups(texts):
        flat = [w for t in texts[a:z] for w in t]
        if len(flat) <= length:
            continue
        h = np.concatenate([word_hashes(flat[i : i + CHUNK])[3] for i in range(0, len(flat), CHUNK)])
        sizes = np.fromiter(map(len, texts[a:z]), np.int64, z - a)
        row = np.repeat(np.arange(z - a), sizes)
        n = len(h) - length + 1
        g = np.zeros(n, np.uint64)
        for i in range(length):
            g = g * _BASE + h[i : n + i]
        inside = np.flatnonzero(row[:n] == row[length - 1 :])
        g = mix(g[inside] + row[inside].astype(np.uint64) * _BASE)
        order = np.argsort(g, kind="stable")
        same = np.concatenate(([False], g[order][1:] == g[order][:-1]))
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))]
        begin = (np.cumsum(sizes) - sizes)[row]
        for i, f in zip(order[same].tolist(), first[same].tolist(), strict=True):
            x, y = int(inside[i]), int(inside[f])
            # Compared by words; should different windows ever have one hash, with all before it.
            if flat[x : x + length] == flat[y : y + length] or any(flat[j : j + length] == flat[x : x + length] for j in inside[:i][g[:i] == g[i]].tolist()):
                out[a + int(row[x])].append(x - int(begin[x]))
    return out


def _remove(kept_columns: int, length: int, names: list[str]):
    """Rows with their marks -> rows with the words that are left."""

    def fn(batches):
        for b in batches:
            texts = _words(b.column(kept_columns + 1))
            full, part, masks = (b.column(kept_columns + i).to_pylist() for i in (2, 5, 6))
            hashed = short(texts)
            starts = [[np.array(x, np.int64)] for x in again(hashed, length)]
            for s in chunks([t if full[i] or part[i] else [] for i, t in enumerate(hashed)], length):
                for a, z in _rows(s):
                    r, mine = int(s.row[a]), s.hash[a:z]
                    if full[r]:
                        for i in (a + np.flatnonzero(np.isin(mine, np.array(full[r], np.int64)))).tolist():
                            starts[r].append(s.at[i] + np.arange(s.windows[i]))
                    if part[r]:
                        bits: dict[int, int] = {}
                        for x, y in zip(part[r], masks[r], strict=True):
                            bits[x] = bits.get(x, 0) | y
                        for i in (a + np.flatnonzero(np.isin(mine, np.array(part[r], np.int64)))).tolist():
                            y = bits[int(s.hash[i])]
                            starts[r].append(s.at[i] + np.array([w for w in range(int(s.windows[i])) if y >> w & 1], np.int64))
            spans, kept, removed = [], [], []
            for words, found in zip(texts, starts, strict=True):
                stretches = covered(len(words), np.concatenate(found), length)
                at, left = 0, []
                for x, y in stretches:
                    left += words[at:x]
                    at = y
                left += words[at:]
                kept.append(b" ".join(left).decode())
                removed.append(len(words) - len(left))
                spans.append([[x, y] for x, y in stretches])
            new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())]
            yield _batch(names, *[b.column(i) for i in range(kept_columns)], *new)

    return fn


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 20, keep: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """``keep`` columns (default: all), then n_words, n_removed, spans (word positions [from, to) removed) and kept (the words left, joined by spaces).

    Removed is each word in a window of ``length`` words that also starts in a
    row of a smaller integer ``key``, or earlier in the same row, judged on the
    input. Kept columns with the names of new ones are replaced.
    """
    if not GRAM + 2 * SIDE <= length < GRAM + 60:
        raise ValueError(f"length: {GRAM + 2 * SIDE} to {GRAM + 59}")
    new = ["n_words", "n_removed", "spans", "kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    names = [f"k{i}" for i in range(len(keep))]
    taken = pick(df, [*keep, key, text]).toDF(*names, "id", "t").withColumn("id", F.col("id").cast("long"))
    # Rows are told apart by key and text, so that marks of a key that many rows share are not one list.
    rows = taken.withColumn("u", F.xxhash64("id", "t"))
    entries = map_batches(rows.filter("id is not null").select("id", "u", "t"), _entries(length), "m long, s long, d long, u long, settled boolean")
    # Settled entries only pass through: they are spread by their rows.
    dealt = entries.repartition(F.when(F.col("settled"), F.col("u")).otherwise(F.shiftright("m", SIDES))).sortWithinPartitions("settled", "m", "s", "d")
    marks = map_batches(dealt, _decide(group), "u long, d long, s long, kind tinyint")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("s")))
    marked = marks.groupBy(F.col("u").alias("mu")).agg(of(FULL).alias("full"), of(COLD).alias("cold"), of(HOT).alias("hot"))
    known = rows.join(marked, F.col("u") == F.col("mu"), "left").drop("mu")
    # Both joins take the same columns of the rows and of the marks, so that they read the same two exchanges.
    asked = known.filter("size(cold) > 0 or size(hot) > 0").select(*names, "id", "u", "t", "cold", "hot", "full")
    candidates = map_batches(asked, _candidates(length), "p long, d long, u long, s long, shift int, windows int, words binary, kind tinyint")
    parts = map_batches(candidates.repartition("kind", "p").sortWithinPartitions("kind", "p", "d"), _subtrees(length, group), "q long, d long, u long, s long, mask long, window binary")
    found = map_batches(parts.repartition(F.coalesce("q", "u")).sortWithinPartitions("q", "d"), _equal_windows, "u long, s long, mask long")
    listed = found.groupBy(F.col("u").alias("pu")).agg(F.collect_set(F.struct("s", "mask")).alias("p"))
    ready = known.join(listed, F.col("u") == F.col("pu"), "left").select(*names, "id", "t", "full", "cold", "hot", F.col("p.s").alias("ps"), F.col("p.mask").alias("pm"))
    schema = StructType([ready.schema[n] for n in names] + list(StructType.fromDDL("n_words long, n_removed long, spans array<array<long>>, kept string").fields))
    return map_batches(ready, _remove(len(names), length, schema.names), schema).toDF(*keep, *new)
