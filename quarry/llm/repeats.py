"""Removal of repeated passages with a sparse, hash-compared suffix sort.

Every window of ``length`` bytes is anchored at its minimiser: the place of the
k-gram of least hash in it. Equal windows have equal minimisers at equal
distances, so only suffixes that start at anchors need sorting. Neighbouring
windows with one anchor make a segment. Segments are dealt by the anchor's
hash; there segments equal as a whole are settled by the least document,
without any text: equal are those that agree in 128 bits of hashes (64 of all
bytes, 48 of the anchor, 8 of the bytes on either side of it), which are not
compared byte by byte, for that would move the bytes of every copy once more.
Segments that share an anchor, and a hash of the bytes on one side of it, but
differ go on with their bytes: their suffixes at the anchor, and the reversed
ones before it, are sorted by a mergesort whose comparisons find common
extensions by binary search over prefix polynomial hashes; neighbours' common
extensions are then verified byte by byte. Two windows at a distance
``a`` before the anchor are equal if they agree ``a`` bytes to the left and
``length - a`` to the right, so the sorted orders give all classes of equal
windows, and of each class all but those of the least document are removed.

No group is gathered beyond ``GROUP`` segments: an anchor with more of them is
dealt again, window by window, by the window's own hash, and those rows are
compared with the first of their hash as they stream by. Long texts are read
in pieces of ``PIECE`` windows.

Null texts count as empty. Rows with a null key keep their text and remove
nothing. Rows that repeat a key don't remove each other's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, pick

K = 16
#: Bytes of text that are hashed at a time, windows of a piece of a long text, segments of an anchor that are compared at once, and segments that are settled at a time.
CHUNK, PIECE, GROUP, SETTLE = 1 << 18, 1 << 18, 20_000, 20_000
#: Low bits of an anchor's key that hold hashes of the bytes beside it, 8 bits a side.
SIDES = 16
FULL, COLD, HOT = 0, 1, 2
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(31)) * _U(0x7FB5D329728EA185)
    h = (h ^ h >> _U(27)) * _U(0x81DADEF4BC2DD44D)
    return h ^ h >> _U(33)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefixes:
    """Prefix polynomial hashes (modulo 2**64, odd base) of a byte array: the hash of any stretch in a few steps."""

    up, down = _powers(int(_BASE), 2), _powers(pow(int(_BASE), -1, 1 << 64), 2)

    def __init__(self, data: np.ndarray):
        if len(self.up) <= len(data):
            n = 2 * len(data) + 2
            Prefixes.up, Prefixes.down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class Segments:
    """The segments of some texts (at least ``length`` bytes each, as (row, offset, bytes) pieces) side by side in one array."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int):
        data = self.data = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(K), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        ends = first + sizes - length + 1
        eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
        n = len(data) - K
        grams = mix(eight[:n] * _BASE + mix(eight[8 : 8 + n]))
        least = grams & _U(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
        width, step = length - K + 1, 1
        while step * 2 <= width:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
        starts = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, first[first < len(anchor)])
        piece = np.searchsorted(first, starts, "right") - 1
        stop = np.minimum(np.concatenate((starts[1:], [len(anchor)])), ends[piece])
        ok = stop > starts
        self.start, self.windows, piece = starts[ok], (stop - starts)[ok], piece[ok]
        self.end = self.start + self.windows + length - 1
        self.left = anchor[self.start] - self.start
        self.prefixes = Prefixes(data)
        # Of the bytes beside the anchor a window holds half on one side at least: their hashes, one byte each, end the anchor's.
        half = (length - K + 1) // 2
        at = self.start + self.left
        before, after = np.where(self.left >= half, at - half, at), np.where(self.end - at >= K + half, at + K + half, at + K)
        sides = [np.where(ok, mix(self.prefixes.of(x, y)) % _U(255) + _U(1), _U(0)) for ok, x, y in ((self.left >= half, before, at), (self.end - at >= K + half, at + K, after))]
        self.key = (grams[anchor[self.start]] & ~_U((1 << SIDES) - 1) | sides[0] << _U(8) | sides[1]).view(np.int64)
        self.hash = mix(self.prefixes.of(self.start, self.end) + self.windows.astype(np.uint64)).view(np.int64)
        self.row = np.array([p[0] for p in pieces], np.int64)[piece]
        self.at = self.start - first[piece] + np.array([p[1] for p in pieces], np.int64)[piece]


def chunks(texts: list[bytes], length: int):
    """``Segments`` of the texts, a chunk at a time; a text's pieces don't depend on its neighbours."""
    pieces, size = [], 0
    for row, data in enumerate(texts):
        for at in range(0, max(0, len(data) - length + 1), PIECE):
            part = data[at : at + PIECE + length - 1]
            if pieces and size + len(part) > CHUNK:
                yield Segments(pieces, length)
                pieces, size = [], 0
            pieces.append((row, at, part))
            size += len(part)
    if pieces:
        yield Segments(pieces, length)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _entries(length: int):
    """(key, text) -> (anchor hash, segment hash, key), each once a document."""

    def fn(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for s in chunks(_texts(b.column(1)), length):
                _, one = np.unique(s.hash.view(np.uint64) + s.row.astype(np.uint64) * _BASE, return_index=True)
                one.sort()  # rows of a document stay together, which shuffle compression rewards
                yield pa.RecordBatch.from_arrays([pa.array(s.key[one]), pa.array(s.hash[one]), pa.array(keys[s.row[one]].astype(np.int64))], names=["m", "s", "d"])

    return fn


def beside(group: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which segments agree with one of another document in their group on a hash of the bytes before or after the anchor."""
    out = np.zeros(len(m), bool)
    for shift in (8, 0):
        side = m >> shift & 255
        key = group * 256 + side
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(m) else np.zeros(0, np.int64)
        if len(edge):
            mixed = np.minimum.reduceat(d[order], edge) < np.maximum.reduceat(d[order], edge)
            out[order] |= np.repeat(mixed, np.diff(np.concatenate((edge, [len(m)])))) & (side[order] > 0)
    return out


def _decide(group: int):
    """Entries sorted by (m, s, d) -> marks (d, s, kind): FULL if a smaller document has the segment; COLD or HOT if others share its anchor."""

    def marks(d, s, kind):
        kind = np.broadcast_to(np.int8(kind), len(d)) if np.isscalar(kind) else kind
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(kind, pa.int8())], names=["d", "s", "kind"])

    def fn(batches):
        # Of the group that may go on: its segments so far (first documents), and whether it has been found to be large.
        held_m, held_s, held_d, hot = (np.zeros(0, np.int64),) * 3 + (False,)
        going = None  # the anchor of that group
        last = None  # (m, s, first document) of the row before
        for b in batches:
            if not b.num_rows:
                continue
            m, s, d = (b.column(i).to_numpy() for i in range(3))
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
            if last is not None and (m[0], s[0]) == last[:2]:
                new[0] = False
            run = np.cumsum(new) - 1
            firsts = d[new]
            first = np.concatenate((firsts, [last[2] if last else 0]))[run]  # -1 is the run of the row before
            full = d > first
            if full.any():
                yield marks(d[full], s[full], FULL)
            last = (m[-1], s[-1], first[-1])
            rm, rs, rd = (np.concatenate(x) for x in ((held_m, m[new]), (held_s, s[new]), (held_d, firsts)))
            if not len(rm):
                continue
            anchor = rm >> SIDES
            edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            sizes = np.diff(np.concatenate((edge, [len(rm)])))
            several = (np.minimum.reduceat(rd, edge) < np.maximum.reduceat(rd, edge)) & (sizes > 1)
            kind = np.where(sizes > group, HOT, COLD)
            if hot and anchor[0] == going:
                several[0], kind[0] = True, HOT
            going = m[-1] >> SIDES
            open_ = anchor[-1] == going
            done = several.copy()
            hot = bool(open_ and kind[-1] == HOT)
            if open_:
                done[-1] = hot  # segments of one document too: another document may follow
            out = np.repeat(done, sizes)
            out &= (np.repeat(kind, sizes) == HOT) | beside(np.repeat(np.arange(len(sizes)), sizes), rm, rd)
            if out.any():
                yield marks(rd[out], rs[out], np.repeat(kind, sizes)[out].astype(np.int8))
            held_m, held_s, held_d = (x[:0] if hot else x[edge[-1] :] for x in (rm, rs, rd))
        if len(held_s) > 1:
            out = beside(np.zeros(len(held_s), np.int64), held_m, held_d)
            yield marks(held_d[out], held_s[out], COLD)

    return fn


def _candidates(length: int):
    """(..., key, text, cold, hot) -> the marked segments with their bytes, dealt by anchor or, if hot, window by window."""
    names = ["m", "d", "s", "left", "at", "seg"]

    def fn(batches):
        for b in batches:
            b = b.filter(b.column(b.num_columns - 4).is_valid())
            key, text, *marks = b.columns[-4:]
            keys = key.to_numpy()
            wanted = [[np.array(x or [], np.int64) for x in c.to_pylist()] for c in marks]
            for s in chunks(_texts(text), length):
                rows = np.flatnonzero(np.concatenate(([True], s.row[1:] != s.row[:-1])))
                take = np.zeros(len(s.row), np.int8)
                for a, z in zip(rows.tolist(), [*rows[1:].tolist(), len(s.row)], strict=True):
                    for kind, lists in ((COLD, wanted[0]), (HOT, wanted[1])):
                        if len(x := lists[s.row[a]]):
                            take[a:z][np.isin(s.hash[a:z], x)] = kind
                i = np.flatnonzero(take == COLD)
                _, one = np.unique(s.hash[i].view(np.uint64) + s.row[i].astype(np.uint64) * _BASE, return_index=True)
                i = i[one]
                raw = s.data.tobytes()
                segs = [raw[x:y] for x, y in zip(s.start[i].tolist(), s.end[i].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.key[i] >> SIDES), pa.array(keys[s.row[i]]), pa.array(s.hash[i]), pa.array(s.left[i], pa.int32()), pa.array(np.full(len(i), -1), pa.int32()), pa.array(segs, pa.binary())], names=names)
                for j in np.flatnonzero(take == HOT).tolist():
                    n, x = int(s.windows[j]), int(s.start[j])
                    begin = np.arange(x, x + n)
                    key = mix(s.prefixes.of(begin, begin + length)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(n, keys[s.row[j]])), pa.array(np.full(n, s.hash[j])), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([raw[y : y + length] for y in range(x, x + n)], pa.binary())], names=names)

    return fn


def common_extension(p: Prefixes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from ``a`` and from ``b`` on agree, up to ``most``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = p.of(a, a + mid) == p.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def suffix_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``data[start : start + size]`` within each group (groups ascend), and each one's common extension with the one before it (-1 for a group's first).

    A bottom-up mergesort of all groups side by side: each suffix finds its
    place in the neighbouring run by binary search, comparing by common
    extensions. These are verified at the end; should two different stretches
    ever have had one hash, the suffixes are sorted by their bytes instead.
    """
    p = Prefixes(data)
    n = len(start)

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        most = np.minimum(size[x], size[y])
        ext = common_extension(p, start[x], start[y], most)
        whole = ext == most
        at = np.where(whole, 0, ext)
        a, b = data[np.minimum(start[x] + at, len(data) - 1)], data[np.minimum(start[y] + at, len(data) - 1)]
        shorter = (size[x] < size[y]) | (ties & (size[x] == size[y]))
        return np.where(whole, shorter, a < b)

    order = np.arange(n)
    edge = np.concatenate(([True], group[1:] != group[:-1]))
    g0 = np.flatnonzero(edge)
    gsize = np.diff(np.concatenate((g0, [n])))
    base, total = np.repeat(g0, gsize), np.repeat(gsize, gsize)
    width = 1
    while width < gsize.max(initial=0):
        at = np.flatnonzero(total > width)
        within = at - base[at]
        run = within // width
        other = (run ^ 1) * width
        count = np.clip(total[at] - other, 0, width)
        low, high = np.zeros(len(at), np.int64), count.copy()
        right = (run & 1) == 1
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            mine, theirs = order[at[live]], order[base[at[live]] + other[live] + mid]
            # Equal ones keep their order: those of the left run come first.
            before = less(theirs, mine, right[live])
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
        to = base[at] + (run & ~1) * width + within % width + low
        moved = order[at]
        order[to] = moved
        width *= 2
    x, y = order[:-1], order[1:]
    most = np.minimum(size[x], size[y])
    ext = common_extension(p, start[x], start[y], most)
    if not _verified(data, start[x], start[y], ext):
        raw = data.tobytes()
        parts = [raw[a : a + z] for a, z in zip(start.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(n), key=lambda i: (group[i], parts[i])), np.int64)
        ext = np.array([next((i for i, (u, v) in enumerate(zip(parts[a], parts[b], strict=False)) if u != v), min(len(parts[a]), len(parts[b]))) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)], np.int64)
    return order, np.where(edge, -1, np.concatenate(([-1], ext)))


def _verified(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether each pair of stretches really agrees for ``n`` bytes."""
    step = 1 << 12
    for i in range(0, len(a), step):
        m = n[i : i + step]
        wide = np.arange(m.max(initial=0))
        inside = wide < m[:, None]
        u, v = (data[np.minimum(z[i : i + step, None] + wide, len(data) - 1)] for z in (a, b))
        if ((u != v) & inside).any():
            return False
    return True


def repeated_windows(key: np.ndarray, doc: np.ndarray, left: np.ndarray, segs: list[bytes], length: int) -> np.ndarray:
    """For segments sorted by key: a bit for each window that a smaller document has among the segments of the key."""
    n = len(segs)
    size = np.fromiter(map(len, segs), np.int64, n)
    data = np.frombuffer(b"".join(segs), np.uint8)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    right, ext_right = suffix_order(data, begin + left, size - left, group)
    back, ext_left = suffix_order(data[::-1], len(data) - begin - left, left, group)
    mask = np.zeros(n, np.int64)
    for a in range(length - K + 1):
        ok = np.flatnonzero((left >= a) & (size - left >= length - a))
        if len(ok) < 2:
            continue
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        one[right] = np.cumsum(ext_right < length - a)
        two[back] = np.cumsum(ext_left < a)
        both = one[ok] * (n + 1) + two[ok]
        order = np.lexsort((doc[ok], both))
        both, d = both[order], doc[ok][order]
        edge = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        least = np.repeat(d[edge], np.diff(np.concatenate((edge, [len(d)]))))
        hit = ok[order[d > least]]
        mask[hit] |= np.int64(1) << (left[hit] - a)
    return mask


def _compare(length: int):
    """Candidates sorted by (m, d) -> (d, s, mask) of segments with repeated windows."""

    def out(d, s, mask):
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(mask, pa.int64())], names=["d", "s", "mask"])

    def settle(tables):
        t = pa.Table.from_batches(tables)
        m, d, s, left = (t.column(n).to_numpy() for n in ("m", "d", "s", "left"))
        mask = repeated_windows(m, d, left.astype(np.int64), t.column("seg").to_pylist(), length)
        hit = np.flatnonzero(mask)
        return out(d[hit], s[hit], mask[hit])

    def fn(batches):
        held, n = [], 0
        first: tuple = (None, [])  # of window rows: the hash, and (bytes, least document) of the different windows with it
        for b in batches:
            at = b.column("at").to_numpy()
            cold, hot = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
            if len(hot):
                ds, ss, bits = [], [], []
                h = b.take(pa.array(hot))
                for m, d, s, i, seg in zip(*(h.column(c).to_pylist() for c in ("m", "d", "s", "at", "seg")), strict=True):
                    if first[0] != m:
                        first = (m, [])
                    least = next((x for data, x in first[1] if data == seg), None)
                    if least is None:
                        first[1].append((seg, d))
                    elif d > least:
                        ds.append(d), ss.append(s), bits.append(1 << i)
                yield out(ds, ss, bits)
            if not len(cold):
                continue
            b = b.take(pa.array(cold)) if len(hot) else b
            m = b.column("m").to_numpy()
            cut = len(m) - int((m[::-1] != m[-1]).argmax()) if m[0] != m[-1] else 0
            # Whole groups are settled once there are enough; the last one may go on.
            if held and held[-1].column("m")[-1].as_py() != m[0] and n >= SETTLE:
                yield settle(held)
                held, n = [], 0
            if cut and n + cut >= SETTLE:
                yield settle([*held, b.slice(0, cut)])
                held, n = [b.slice(cut)], len(m) - cut
            else:
                held.append(b)
                n += len(m)
        if held:
            yield settle(held)

    return fn


def covered(size: int, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The stretches [from, to) that windows starting at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    begin = np.concatenate((starts[:1], starts[gap + 1]))
    end = np.concatenate((starts[gap], starts[-1:])) + length
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _remove(kept_columns: int, length: int, as_text: bool, names: list[str]):
    """Rows with their marks -> rows with what is left."""

    def fn(batches):
        for b in batches:
            base = b.num_columns - 5
            key = b.column(base).to_pylist()
            texts = _texts(b.column(base + 1))
            full, part, masks = (b.column(base + i).to_pylist() for i in (2, 3, 4))
            starts: list[list[np.ndarray]] = [[] for _ in texts]
            marked = [t if k is not None and (full[i] or part[i]) else b"" for i, (k, t) in enumerate(zip(key, texts, strict=True))]
            for s in chunks(marked, length):
                rows = np.flatnonzero(np.concatenate(([True], s.row[1:] != s.row[:-1])))
                for a, z in zip(rows.tolist(), [*rows[1:].tolist(), len(s.row)], strict=True):
                    r = int(s.row[a])
                    mine = s.hash[a:z]
                    if full[r]:
                        i = a + np.flatnonzero(np.isin(mine, np.array(full[r], np.int64)))
                        starts[r].append(np.repeat(s.at[i], s.windows[i]) + np.concatenate([np.arange(w) for w in s.windows[i].tolist()] or [np.zeros(0, np.int64)]))
                    if part[r]:
                        bits: dict[int, int] = {}
                        for x, y in zip(part[r], masks[r], strict=True):
                            bits[x] = bits.get(x, 0) | y
                        for i in (a + np.flatnonzero(np.isin(mine, np.array(part[r], np.int64)))).tolist():
                            y = bits[int(s.hash[i])]
                            starts[r].append(s.at[i] + np.array([w for w in range(int(s.windows[i])) if y >> w & 1], np.int64))
            kept, removed, spans = [], [], []
            for t, found in zip(texts, starts, strict=True):
                stretches = covered(len(t), np.concatenate(found), length) if found else []
                at, left = 0, []
                for x, y in stretches:
                    left.append(t[at:x])
                    at = y
                rest = b"".join([*left, t[at:]])
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                removed.append(len(t) - len(rest))
                spans.append([[x, y] for x, y in stretches])
            new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(kept_columns)] + new, names=names)

    return fn


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, keep: list[str] | None = None, as_text: bool = False, group: int = GROUP) -> DataFrame:
    """``keep`` columns, then n_bytes, n_removed, spans (byte positions [from, to) removed) and kept.

    Removed is each byte in a ``length``-byte string that also starts in a row
    of a smaller integer ``key``, judged on the input. ``kept`` holds the bytes
    that are left, or with ``as_text`` the text, without characters cut in two.
    """
    if not K <= length < K + 63:
        raise ValueError(f"length: {K} to {K + 62}")
    new = ["n_bytes", "n_removed", "spans", "kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    names = [f"k{i}" for i in range(len(keep))]
    taken = pick(df, [*keep, key, text]).toDF(*names, "id", "t").withColumn("id", F.col("id").cast("long"))
    # Never null, so that both joins below read one and the same exchange.
    rows = taken.withColumn("j", F.coalesce("id", F.lit(-1).cast("long")))
    entries = map_batches(taken.filter("id is not null").select("id", "t"), _entries(length), "m long, s long, d long")
    marks = map_batches(entries.repartition(F.shiftright("m", SIDES)).sortWithinPartitions("m", "s", "d"), _decide(group), "d long, s long, kind tinyint").repartition("d")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("s")))
    marked = marks.groupBy("d").agg(of(FULL).alias("full"), of(COLD).alias("cold"), of(HOT).alias("hot"))
    known = rows.join(marked, rows.j == marked.d, "left").drop("d")
    asked = known.filter((F.size("cold") > 0) | (F.size("hot") > 0)).select(*names, "id", "t", "cold", "hot")
    candidates = map_batches(asked, _candidates(length), "m long, d long, s long, left int, at int, seg binary")
    parts = map_batches(candidates.repartition("m").sortWithinPartitions("m", "d"), _compare(length), "d long, s long, mask long").repartition("d")
    listed = parts.groupBy("d").agg(F.collect_list(F.struct("s", "mask")).alias("p")).select(F.col("d").alias("e"), "p")
    ready = known.join(listed, F.col("j") == F.col("e"), "left").select(*names, "id", "t", "full", F.col("p.s").alias("ps"), F.col("p.mask").alias("pm"))
    from pyspark.sql.types import StructType

    schema = StructType([ready.schema[n] for n in names] + list(StructType.fromDDL(f"n_bytes long, n_removed long, spans array<array<long>>, kept {'string' if as_text else 'binary'}").fields))
    done = map_batches(ready, _remove(len(names), length, as_text, schema.names), schema)
    return done.toDF(*keep, *new)
