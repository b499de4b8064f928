"""External induced suffix sorting with common-prefix values.

A text (bytes; 0 ends it and occurs once) is sorted in four steps, none of which holds all suffixes in memory:

1. Left-most S suffixes are found by one scan from right to left. Their substrings are sorted by induction: L suffixes from
   smaller to larger symbols, then S suffixes back.
2. Neighbours' substrings are compared and named. If names repeat, the string of names is sorted: a string of at most
   ``BASE`` names in memory by doubling, a longer one by a recursion of these steps.
3. Neighbouring left-most S suffixes get their common-prefix value, up to ``depth``, by comparison eight bytes at a time.
4. The final induction carries tuples (position, common-prefix value with the neighbour) through priority queues: a tuple
   pushed for the symbol before its suffix gets one more than the least value among all tuples popped since the last push to
   that symbol, which is the range minimum over the inducing order.

A priority queue is a heap of symbols, each with a first-in-first-out run of tuples, since what is induced into a symbol's
bucket arrives in order. Text blocks, runs of queues, sorted buckets and names all live in a ``Store``: what exceeds its
budget goes to files of the given folder, least recently used first, and comes back when read.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow.fs as pafs

#: Symbols of a block of text or names.
BLOCK = 1 << 23
#: Tuples handed on at once.
BATCH = 1 << 20
#: A string of at most so many names is sorted in memory.
BASE = 1 << 24
_FAR = np.int32(1 << 30)


class Store:
    """Arrays by number; at most ``budget`` bytes stay in memory, the rest in files below ``folder``."""

    def __init__(self, folder: str | None, budget: int):
        self.folder, self.budget, self.bytes, self.spilled = folder, budget, 0, 0
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.files: dict[int, tuple[str, np.dtype]] = {}
        self.next = 0

    def _fs(self):
        return pafs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (pafs.LocalFileSystem(), self.folder)

    def put(self, array: np.ndarray) -> int:
        self.next += 1
        self._hold(self.next, array)
        return self.next

    def _hold(self, key: int, array: np.ndarray) -> None:
        self.held[key] = array
        self.bytes += array.nbytes
        while self.bytes > self.budget and len(self.held) > 1 and self.folder is not None:
            old, gone = self.held.popitem(last=False)
            self.bytes -= gone.nbytes
            if old not in self.files:
                fs, base = self._fs()
                path = f"{base}/run-{uuid.uuid4().hex}"
                with fs.open_output_stream(path, compression=None) as sink:
                    sink.write(np.ascontiguousarray(gone).data)
                self.files[old] = (path, gone.dtype)
                self.spilled += gone.nbytes

    def get(self, key: int) -> np.ndarray:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        path, kind = self.files[key]
        with self._fs()[0].open_input_stream(path, compression=None) as source:
            array = np.frombuffer(source.read(), kind)
        self._hold(key, array)
        return array

    def drop(self, key: int) -> np.ndarray:
        """The array, which the store forgets."""
        array = self.get(key)
        del self.held[key]
        self.bytes -= array.nbytes
        if key in self.files:
            self._fs()[0].delete_file(self.files.pop(key)[0])
        return array

    def close(self) -> None:
        for path, _ in self.files.values():
            self._fs()[0].delete_file(path)
        self.files, self.held = {}, OrderedDict()


class Pages:
    """A long array in blocks of a store. Blocks of bytes overlap by eight, so that eight bytes can be read from any place."""

    def __init__(self, store: Store, kind, block: int = BLOCK):
        self.store, self.kind, self.block, self.size = store, np.dtype(kind), block, 0
        self.keys: list[int] = []
        self.firsts: list[int] = []
        self.wait: list[np.ndarray] = []

    def append(self, array: np.ndarray) -> None:
        self.wait.append(np.asarray(array, self.kind))
        self.size += len(array)
        if self.size - len(self.keys) * self.block >= 2 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        rest = np.concatenate(self.wait) if self.wait else np.empty(0, self.kind)
        while len(rest) >= self.block + 8 or (last and len(rest)):
            part = rest[: self.block + 8]
            self.firsts.append(int(part[0]))
            self.keys.append(self.store.put(part.copy() if len(part) == self.block + 8 else np.concatenate((part, np.zeros(8, self.kind)))))
            rest = rest[self.block :]
        self.wait = [] if last else [rest]

    def done(self) -> Pages:
        self._flush(True)
        return self

    def __len__(self) -> int:
        return self.size

    def chunk(self, i: int) -> np.ndarray:
        """Block i without what it shares with the next."""
        return self.store.get(self.keys[i])[: min(self.block, self.size - i * self.block)]

    def _each(self, at: np.ndarray):
        if len(self.keys) == 1:
            yield self.store.get(self.keys[0]), slice(None), at
            return
        if not len(at):
            return
        of = (at // self.block).astype(np.int16 if len(self.keys) < 1 << 15 else np.int64)
        for b in range(int(of.min()), int(of.max()) + 1):
            own = np.flatnonzero(of == b)
            if len(own):
                yield self.store.get(self.keys[b]), own, at[own] - b * self.block

    def gather(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), self.kind)
        for array, own, inside in self._each(at):
            out[own] = array[inside]
        return out

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place, the first the lowest."""
        out = np.empty(len(at), np.uint64)
        for array, own, inside in self._each(at):
            out[own] = np.ndarray(len(array) - 7, "<u8", array, 0, (1,))[inside]
        return out

    def search(self, values: np.ndarray) -> np.ndarray:
        """Index of the first entry of sorted pages that isn't below each value; it may be their length."""
        of = np.maximum(np.searchsorted(self.firsts, values, side="right") - 1, 0)
        if len(self.keys) == 1:
            return np.searchsorted(self.chunk(0), values)
        out = np.empty(len(values), np.int64)
        for b in np.unique(of).tolist():
            own = np.flatnonzero(of == b)
            out[own] = b * self.block + np.searchsorted(self.chunk(b), values[own])
        return out

    def close(self) -> None:
        for k in self.keys:
            self.store.drop(k)
        self.keys = []


class Queues:
    """For each symbol a run of tuples (position, common-prefix value), and a heap of the symbols that have any."""

    def __init__(self, store: Store, sign: int):
        self.store, self.sign, self.heap, self.waiting = store, sign, [], 0
        self.buffers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def push(self, symbols: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Sorted by symbol."""
        if not len(at):
            return
        cuts = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [len(at)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c = int(symbols[a])
            if c not in self.buffers:
                self.buffers[c] = []
                heapq.heappush(self.heap, self.sign * c)
            self.buffers[c].append((at[a:b], lcp[a:b]))
        self.waiting += at.nbytes + lcp.nbytes
        if self.waiting > self.store.budget // 4:
            for c, parts in self.buffers.items():
                if parts:
                    self.runs.setdefault(c, []).append(tuple(self.store.put(np.concatenate(x)) for x in zip(*parts, strict=True)))
                    self.buffers[c] = []
            self.waiting = 0

    def least(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, c: int):
        """Batches of a symbol's queue, also of what is pushed to it meanwhile."""
        while self.runs.get(c) or self.buffers.get(c):
            if self.runs.get(c):
                a, b = self.runs[c].pop(0)
                at, lcp = self.store.drop(a), self.store.drop(b)
            else:
                parts, self.buffers[c] = self.buffers[c], []
                at, lcp = (np.concatenate(x) for x in zip(*parts, strict=True))
                self.waiting -= at.nbytes + lcp.nbytes
            for i in range(0, len(at), BATCH):
                yield at[i : i + BATCH], lcp[i : i + BATCH]
        if c in self.buffers:
            del self.buffers[c]
            self.heap.remove(self.sign * c)  # nearly always its head
            heapq.heapify(self.heap)


class Minima:
    """Carries the least common-prefix value since the last push to each symbol across batches."""

    def __init__(self, carried: bool, depth: int):
        self.carried, self.depth, self.since, self.ever = carried, depth, {}, np.int32(_FAR)

    def values(self, symbols: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """Values of the tuples pushed from ``place`` in a batch, sorted by (symbol, place); lcp are the batch's."""
        if not self.carried:
            return np.zeros(len(place), np.int32)
        out = np.empty(len(place), np.int32)
        table = [lcp]
        while (1 << len(table)) <= len(lcp):
            s = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-s], table[-1][s:]))

        def least(a, b):
            """min of lcp[a:b] for arrays a < b."""
            n = b - a
            k = (np.frexp(n.astype(np.float64))[1] - 1).astype(np.int8)
            found = np.empty(len(a), np.int32)
            for j in range(int(k.max(initial=-1)) + 1):
                own = np.flatnonzero(k == j)
                found[own] = np.minimum(table[j][a[own]], table[j][b[own] - (1 << j)])
            return found

        all_of = np.int32(table[-1].min()) if len(lcp) else _FAR
        if len(place):
            first = np.concatenate(([True], symbols[1:] != symbols[:-1]))
            inner = np.flatnonzero(~first)
            out[inner] = least(place[inner - 1] + 1, place[inner] + 1)
            heads = np.flatnonzero(first)
            to_head = least(np.zeros(len(heads), np.int64), place[heads] + 1)
            lasts = np.concatenate((heads[1:], [len(place)])) - 1
            rest = place[lasts] + 1
            inside = rest < len(lcp)
            tail = np.full(len(heads), _FAR)
            if inside.any():
                tail[inside] = least(rest[inside], np.full(int(inside.sum()), len(lcp), np.int64))
            names = symbols[heads].tolist()
            for i, c in enumerate(names):
                # never pushed to: the neighbour is in another bucket, and nothing is common
                out[heads[i]] = min(self.since[c], to_head[i]) if c in self.since else -1
            pushed = set(names)
        else:
            pushed = set()
        for c in self.since:
            if c not in pushed and self.since[c] > all_of:
                self.since[c] = all_of
        if pushed:
            self.since |= dict(zip(names, tail.tolist(), strict=True))
        return np.minimum(out + 1, self.depth).astype(np.int32)


def common(text: Pages, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Common-prefix values of suffixes of a byte text, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    live, k = np.arange(len(a)), 0
    most = np.broadcast_to(most, len(a))
    while len(live):
        # the end occurs once, so no two suffixes agree beyond it
        x = text.eight(a[live] + k) ^ text.eight(b[live] + k)
        same = x == 0
        out[live] = k + np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        k += 8
        live = live[same & (most[live] > k)]
    return np.minimum(out, most)


def run_length(text: Pages, at: int, depth: int) -> int:
    """How often the symbol at a place is repeated from there."""
    c, n = text.gather(np.array([at]))[0], 1
    while n < depth and at + n < len(text) and text.gather(np.array([at + n]))[0] == c:
        n += 1
    return n


def _induce(text: Pages, seeds, store: Store, depth: int | None):
    """Suffixes in falling order, as batches (positions, common-prefix values with the suffix before in that order).
    ``seeds`` yields batches (positions, values) of the left-most S suffixes in rising order."""
    carried = depth is not None
    position = np.int32 if len(text) < 1 << 31 else np.int64
    planted: dict[int, list[tuple[int, int]]] = {}
    for at, lcp in seeds:
        c = text.gather(at)
        cuts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(at)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            planted.setdefault(int(c[a]), []).append((store.put(at[a:b].astype(position)), store.put(lcp[a:b].astype(np.int32))))
    sorted_l: dict[int, list[tuple[int, int]]] = {}

    def feed(queues, minima, c, at, lcp, wanted):
        """Push what the batch induces: the symbols before it that are wanted."""
        place = np.flatnonzero(at > 0)
        x = text.gather(at[place] - 1)
        keep = wanted(x)
        place, x = place[keep], x[keep]
        order = np.argsort(x, kind="stable")
        place, x = place[order], x[order]
        queues.push(x, at[place] - position(1), minima.values(x, place, lcp))

    queues, minima, left = Queues(store, 1), Minima(carried, depth or 1), sorted(planted, reverse=True)
    while left or queues.heap:
        c = min(x for x in (queues.least(), left[-1] if left else None) if x is not None)
        last = None
        for at, lcp in queues.pop(c):
            sorted_l.setdefault(c, []).append((store.put(at), store.put(lcp)))
            last = int(at[-1])
            feed(queues, minima, c, at, lcp, lambda x, c=c: x >= c)
        if left and left[-1] == c:
            left.pop()
            for i, (a, b) in enumerate(planted.pop(c)):
                at, lcp = store.drop(a), store.drop(b).copy()
                if carried and i == 0:
                    lcp[0] = 0 if last is None else min(run_length(text, last, depth), run_length(text, int(at[0]), depth))
                feed(queues, minima, c, at, lcp, lambda x, c=c: x >= c)

    queues, minima = Queues(store, -1), Minima(carried, depth or 1)
    left = sorted(sorted_l)
    while left or queues.heap:
        c = max(x for x in (queues.least(), left[-1] if left else None) if x is not None)
        last = None
        for at, lcp in queues.pop(c):
            yield at, lcp
            last = int(at[-1])
            feed(queues, minima, c, at, lcp, lambda x, c=c: x <= c)
        if left and left[-1] == c:
            left.pop()
            ahead = None  # the value of the run that comes next in rising order
            for a, b in reversed(sorted_l.pop(c)):
                at, up = store.drop(a)[::-1], store.drop(b)
                if ahead is None:
                    ahead = 0 if last is None or not carried else min(run_length(text, last, depth), run_length(text, int(at[0]), depth))
                lcp = np.concatenate((up[1:], [ahead])).astype(np.int32)[::-1]
                ahead = up[0]
                yield at, lcp
                feed(queues, minima, c, at, lcp, lambda x, c=c: x < c)


def _stars(text: Pages, store: Store) -> Pages:
    """Positions of left-most S suffixes, rising; the end is one."""
    position = np.int32 if len(text) < 1 << 31 else np.int64
    runs, s_next, symbol_next = [], True, None
    n = len(text)
    for i in range(len(text.keys) - 1, -1, -1):
        t = text.chunk(i)
        base = i * text.block
        s = np.empty(len(t) + 1, bool)  # one more: the first of the next block
        s[-1] = s_next
        ahead = np.concatenate((t, t[-1:] if symbol_next is None else np.array([symbol_next], t.dtype)))
        differs = np.where(ahead[:-1] != ahead[1:], np.arange(len(t)), len(t))
        after = np.minimum.accumulate(differs[::-1])[::-1]
        inside = after < len(t)
        s[:-1] = np.where(inside, ahead[np.minimum(after, len(t) - 1)] < ahead[np.minimum(after, len(t) - 1) + 1], s_next)
        if base + len(t) == n:
            s[len(t) - 1] = True
        # a star of the next block may begin it
        found = np.flatnonzero(s[1:] & ~s[:-1]) + 1 + base
        runs.append(store.put(found[found < n].astype(position)))
        s_next, symbol_next = bool(s[0]), t[0]
    out = Pages(store, position, max(1, text.block // 4))
    for key in reversed(runs):
        out.append(store.drop(key))
    return out.done()


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory, as far as ``depth`` names tell them apart."""
    n = len(names)
    counts = np.bincount(names)
    rank, span = np.concatenate(([0], np.cumsum(counts)[:-1]))[names], 1
    while span < depth:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        second = np.where(tied + span < n, rank[np.minimum(tied + span, n - 1)] + 1, 0)
        own = np.argsort(rank[tied] * (n + 1) + second)
        r, q = rank[tied][own], second[own]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        step = np.concatenate(([True], (r[1:] != r[:-1]) | (q[1:] != q[:-1])))
        # ranks are numbers of smaller suffixes, so a group's members move up by their place in it
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(group, np.arange(len(r)), 0))
        lead = np.maximum.accumulate(np.where(step, np.arange(len(r)), 0))
        rank[tied[own]] = r + place[lead]
        span *= 2
    return np.argsort(rank, kind="stable")


def _in_order(text: Pages, stars: Pages, store: Store, depth: int, base: int):
    """Batches of the stars' positions, rising, as far as ``depth`` symbols tell them apart."""
    n, end = len(stars), len(text) - 1

    def unsorted():
        # by symbol only: within a symbol any order serves
        by: dict[int, list[int]] = {}
        for i in range(len(stars.keys)):
            at = stars.chunk(i)
            c = text.gather(at)
            order = np.argsort(c, kind="stable")
            at, c = at[order], c[order]
            cuts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(at)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                by.setdefault(int(c[a]), []).append(store.put(at[a:b]))
        for c in sorted(by):
            for key in by[c]:
                at = store.drop(key)
                yield at, np.zeros(len(at), np.int32)

    # falling order of the substrings; names count from the largest down, turned round at the end
    dealt: list[list[tuple[int, int]]] = [[] for _ in stars.keys]
    name, before = 0, None

    def deal(index, names):
        of = index // stars.block
        for b in np.unique(of).tolist():
            own = of == b
            dealt[b].append((store.put(index[own]), store.put(names[own])))

    for at, _ in _induce(text, unsorted(), store, None):
        x = text.gather(np.maximum(at - 1, 0))
        own = text.gather(at)
        maybe = np.flatnonzero((at > 0) & (x > own))  # a larger symbol before: the only S suffixes here that can be stars
        at = at[maybe]
        if not len(at):
            continue
        index = stars.search(at)
        hit = stars.gather(np.minimum(index, n - 1)) == at
        at, index = at[hit], index[hit]
        if not len(at):
            continue
        length = stars.gather(np.minimum(index + 1, n - 1)) - at + 1
        joined_at, joined_length = (at, length) if before is None else (np.concatenate(([y], x)) for x, y in zip((at, length), before, strict=True))
        a, b = joined_at[:-1], joined_at[1:]
        alike = np.flatnonzero(joined_length[:-1] == joined_length[1:])
        equal = np.zeros(len(a), bool)
        if text.kind == np.uint8:
            equal[alike] = common(text, a[alike], b[alike], joined_length[alike]) >= joined_length[alike]
        else:
            live, k = alike, 0
            while len(live):
                live = live[text.gather(a[live] + k) == text.gather(b[live] + k)]
                k += 1
                equal[live[joined_length[live] <= k]] = True
                live = live[joined_length[live] > k]
        steps = (~equal).astype(np.int64)
        names = (np.cumsum(steps) if before is not None else np.concatenate(([0], np.cumsum(steps)))) + name
        name, before = int(names[-1]), (at[-1], length[-1])
        deal(index, names)
    distinct = name + 1 + (before is None)
    deal(np.array([n - 1]), np.array([distinct if before is not None else 0]))  # the end, the least of all
    top = distinct if before is not None else 0
    reduced = Pages(store, np.int32 if n < 1 << 31 else np.int64, stars.block)
    for i, runs in enumerate(dealt):
        index, names = (np.concatenate(x) for x in zip(*((store.drop(a), store.drop(b)) for a, b in runs), strict=True))
        block = np.empty(len(index), reduced.kind)
        block[index - i * stars.block] = top - names
        reduced.append(block)
    reduced.done()
    if top + 1 == n or n <= base:
        names = np.concatenate([reduced.chunk(i) for i in range(len(reduced.keys))])
        reduced.close()
        order = np.argsort(names, kind="stable") if top + 1 == n else _doubled(names, depth)
        for i in range(0, n, BATCH):
            yield stars.gather(order[i : i + BATCH])
        return
    deeper = _stars(reduced, store)
    held = [store.put(stars.gather(at)) for at, _ in _induce(reduced, ((at, np.zeros(len(at), np.int32)) for at in _in_order(reduced, deeper, store, depth, base)), store, None)]
    deeper.close()
    reduced.close()
    yield np.array([end])
    for key in reversed(held):
        yield store.drop(key)[::-1]


def suffixes(text: Pages, store: Store, depth: int, base: int = BASE):
    """All suffixes of a byte text but the end, falling, as batches (positions, common-prefix values with the one before, up to
    ``depth``). Suffixes that agree on ``depth`` symbols come in any order."""
    stars = _stars(text, store)

    def seeds():
        last = None
        for at in _in_order(text, stars, store, depth, base):
            joined = at if last is None else np.concatenate(([last], at))
            lcp = common(text, joined[:-1], joined[1:], depth)
            last = at[-1]
            yield at, (lcp if len(lcp) == len(at) else np.concatenate(([0], lcp))).astype(np.int32)

    yield from _induce(text, seeds(), store, depth)
    stars.close()
