"""Fuzzy line deduplication: SimHash, pigeonhole blocks, verified edit similarity, one occurrence a group.

Lines are normalised (ASCII lower case, every digit as 0, everything that is neither a
letter nor a digit as a space, spaces collapsed).  A line of at least ``min_words`` words
takes part.  Equal normalised lines are one node.  A node has a 128-bit SimHash over its
words (over its byte pairs where it has few words or no spaces), in four 32-bit blocks.
Two lines are linked when their edit similarity (1 - distance / longer length, in
characters) is at least ``similarity``; of every connected group of lines one occurrence
stays, the first by (doc_id, position, row).

Candidates.  Lines whose SimHashes differ in three bits or fewer agree in a block, so the
join on blocks misses none of them.  But one changed word of a line of 34 moves 10 of the
128 bits, two words 14, and blocks alone would find few such pairs; wider reach by blocks
costs about 22 keys a line.  So a node also has four keys that are minima over its runs of
three words (of five bytes in short lines), and nodes that agree in any of the eight keys
are compared: SimHashes up to ``BITS`` bits apart and with lengths that allow the similarity go
on to the edit check, which alone decides.

Work in a bucket.  A bucket's nodes are compared block against block inside tasks; each
node offers its ``partners`` nearest, and only buckets in which a pair of different
components is farther down the ranks come again, with the next ranks, until none is left,
so a crowd of similar lines costs a few verified pairs a line and every pair is compared or
known to be connected.  Ranks do not change from round to round and a pair belongs to the
first key that its nodes share, so none is offered twice.  Buckets of more than ``HOT``
nodes are split by size first: lines of similar sizes share a part, so no pair is lost.

Scale: keys are made in one vectorised Arrow pass, without an object a word; occurrences
are tables in the shared folder; nodes meet in map-side combined minima and in joins that
adaptive execution splits; the distinct lines, not their occurrences, are joined.

Edge cases: null text has no lines; lines under ``min_words`` words, and lines without a
letter or digit, always stay; ties of doc_id are resolved by position and then by row; a
null doc_id comes last; repeated rows are documents of their own; result columns win over
carried columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, Stored, grows, hash_bytes, ids_field, mix64, others, quoted, recorded, run_hashes, slices, store, utf8, window_hashes
from .components import connected_components

RESULT = ("n_lines", "n_dropped", "text_clean")
#: Bits in which the SimHashes of compared lines may differ (where one is shorter than SHORT characters, and else), and
#: the keys that they may meet in.  Similarity 0.9 by changed words is 18 bits, with a standard deviation of 4.
BITS, SHORT = (28, 22), 100
KEYS = ("high", "low", "least", "next")
SEEDS = GOLDEN * np.arange(3, 7, dtype=np.uint64)
#: Lines of fewer words, or with longer words on average, are taken as runs of bytes.
FEW, LONG, RUN = 8, 20, 5
#: Nodes of a bucket in a block, sizes up to which all pairs are looked at in one vector step, and from which buckets are split.
BLOCK, SMALL, HOT = 512, 8, 8192
#: Partners a node of a large bucket offers in the first round, and how many times more in each later one.
PARTNERS, MORE = 1, 8
#: Pairs whose edit tables are filled together, characters of a line up to which they are, and characters in all of the longest sides.
TABLES, WIDE, ROOM = 1024, 8192, 1 << 20
#: 64-bit numbers in the places of letters of such a step.
CELLS = 1 << 22
#: Pairs under which each is compared alone, and characters up to which no bound is tried before.
CROWD, BRIEF = 25, 2000
#: Pairs of bucket and node in a task's share, and nodes that a task packs, or pairs that it hands on, at a time.
SHARE, HELD = 1 << 20, 1 << 16
#: Bytes of text whose lines are read at a time (a longer line is read alone).
PIECE = 1 << 20
_FOLD = bytes(b if b >= 0x80 or b == 10 else 48 if chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(_FOLD).split())


class Lines:
    """The lines of some texts, as arrays: words and characters of each, and the hash of its normalised form."""

    def __init__(self, texts: list[bytes]):
        self.folded = b"\n".join(texts).translate(_FOLD)
        data = np.frombuffer(self.folded, np.uint8)
        solid = np.zeros(len(data) + 2, np.int8)
        solid[1:-1] = data > 32
        edges = np.diff(solid)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        breaks = np.flatnonzero(data == 10)
        self.begin, self.end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
        self.first = np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]])
        self.n_words = np.diff(self.first)
        self.words = hash_bytes(data, starts, ends)
        self.node = run_hashes(self.words, self.first[:-1], self.first[1:])
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data > 32) & ((data & 0xC0) != 0x80), out=letters[1:])
        self.letters = letters[self.end] - letters[self.begin]
        self.size = self.letters + np.maximum(self.n_words - 1, 0)

    def keys(self, which: np.ndarray) -> np.ndarray:
        """SimHash and minima (n x 4 words) of some lines, each with a word at least."""
        out = np.empty((len(which), len(KEYS)), np.uint64)
        bare = (self.n_words[which] < FEW) | (self.letters[which] > LONG * self.n_words[which])
        if not bare.all():
            at = which[~bare]
            sizes = self.n_words[at]
            flat = self.words[np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            runs = mix64((flat * GOLDEN + np.roll(flat, -1)) * GOLDEN + np.roll(flat, -2))
            inside = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) > 2
            out[~bare, :2], out[~bare, 2:] = _voted(flat, sizes), _minima(runs[inside], sizes - 2)
        if bare.any():
            bodies = [b" ".join(self.folded[a:b].split()) for a, b in zip(self.begin[which[bare]].tolist(), self.end[which[bare]].tolist(), strict=True)]
            out[bare, :2], out[bare, 2:] = _voted(*_grams(bodies, 2)), _minima(*_grams(bodies, RUN))
        return out


def sim_hashes(lines: list[bytes]) -> np.ndarray:
    """128-bit SimHashes (n x 2 words) of normalised lines."""
    return Lines(lines).keys(np.arange(len(lines)))[:, :2]


def _grams(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` bytes of each line, and their number; a shorter line is filled up to one run."""
    bodies = [b.ljust(width, b"\0") for b in bodies]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    marks = window_hashes(mix64(np.frombuffer(b"".join(bodies) + bytes(width - 1), np.uint8).astype(np.uint64)), width)
    return marks[np.repeat(np.cumsum(sizes), sizes) - np.arange(len(marks)) >= width], sizes - width + 1


def _voted(marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHashes of runs of feature hashes, weight one each.

    Every eighth bit of the hashes makes eight byte-wide counters in one 64-bit number, so
    sums over up to 255 features are plain additions; longer runs are summed in parts."""
    begin = np.cumsum(sizes) - sizes
    cuts = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(cuts)[:-1]])
    starts = np.repeat(begin, cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(first, cuts))
    sums = np.empty((16, len(starts)), np.uint64)
    for half, hashed in enumerate((marks, mix64(marks ^ GOLDEN))):
        for k in range(8):
            sums[8 * half + k] = np.add.reduceat((hashed >> np.uint64(k)) & _LANES, starts)
    counts = np.ascontiguousarray(sums.T).view(np.uint8)
    ones = np.add.reduceat(counts, first, axis=0, dtype=np.int32) if (cuts > 1).any() else counts.astype(np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1).view(np.uint64).reshape(len(sizes), 2)


def _minima(marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Four 32-bit minima (n x 2 words) of runs of feature hashes, each under another hash."""
    begin = np.cumsum(sizes) - sizes
    least = [np.minimum.reduceat(mix64(marks ^ seed), begin) >> np.uint64(32) for seed in SEEDS]
    return np.column_stack([(least[0] << np.uint64(32)) | least[1], (least[2] << np.uint64(32)) | least[3]])


def _distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, a column of the table at a time as bits of whole numbers; any number above ``most`` as soon as it is surely larger.

    What remains after column j costs at least its distance from the table's diagonal, so
    the distance is at least the entry (j, j) less the difference of lengths."""
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | (1 << i)
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    apart = abs(len(a) - len(b))
    for j, c in enumerate(b):
        if j & 31 == 31 and j < len(a):
            seen = (1 << j) - 1
            if j + (up & seen).bit_count() - (down & seen).bit_count() - apart > most:
                return most + 1
        same = rows.get(c, 0)
        kept = same | down
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(flat | up)), up & flat
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(kept | rise)) & every, rise & kept & every
    return score


def edit_similarity(a: str, b: str, least: float) -> bool:
    """Whether 1 - Levenshtein(a, b) / max length is at least ``least``."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    head = _shared(a, b)
    a, b = a[head:], b[head:]
    tail = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if max(len(a), len(b)) <= most:
        return True
    p, q = a.split(" "), b.split(" ")
    if len(p) == len(q) and sum(max(len(x), len(y)) for x, y in zip(p, q, strict=True) if x != y) <= most:
        return True
    if len(b) > 24:  # each edit mends one character too many and one too few at most
        x, y = Counter(a), Counter(b)
        if max((x - y).total(), (y - x).total()) > most:
            return False
    return _distance(a, b, most) <= most


def similar_lines(left: list[bytes], right: list[bytes], least: float) -> np.ndarray:
    """``edit_similarity`` of many pairs of lines in UTF-8: the tables of up to ``TABLES`` pairs are filled together, a column at a time.

    Before that, aligned words tell many that are similar, and runs of two and three characters many that are not; both without error."""
    out = np.zeros(len(left), bool)
    for plain in (True, False):
        mine = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if (x.isascii() and y.isascii()) == plain]
        if not mine:
            continue
        texts = [(x, y) if plain else (x.decode("utf-8", "replace"), y.decode("utf-8", "replace")) for x, y in ((left[k], right[k]) for k in mine)]
        sizes = np.array([(len(x), len(y)) for x, y in texts])
        most = ((1 - least) * sizes.max(1) + 1e-9).astype(np.int64)
        apart = np.abs(sizes[:, 0] - sizes[:, 1])
        open_ = apart <= most
        for k in np.flatnonzero(open_).tolist():
            x, y = texts[k]
            p, q = x.split(), y.split()
            if len(p) == len(q) and sum([max(len(a), len(b)) for a, b in zip(p, q, strict=True) if a != b]) <= most[k] and len(x) + len(y) == sum(map(len, p)) + sum(map(len, q)) + 2 * max(len(p) - 1, 0):
                out[mine[k]], open_[k] = True, False
                continue
            head = _shared(x, y)
            x, y = x[head:], y[head:]
            tail = _shared(x[::-1], y[::-1])
            texts[k] = x, y = x[: len(x) - tail], y[: len(y) - tail]
            sizes[k] = len(x), len(y)
            if max(len(x), len(y)) <= most[k] or (max(len(x), len(y)) > BRIEF and _aligned(x, y) <= most[k]):
                out[mine[k]], open_[k] = True, False
        order = np.flatnonzero(open_)
        order = order[np.lexsort((-sizes[order].sum(1), -(most[order] // 64)))]
        brief = sizes[order].max(1) <= BRIEF
        for at in _steps(order[~brief], sizes, most):
            open_[at] = _few_runs(*zip(*[texts[k] for k in at], strict=True), most[at])
        for at in _steps(order[open_[order]], sizes, most):
            if len(at) < CROWD or sizes[at].max() > WIDE:
                for k in at.tolist():
                    out[mine[k]] = _distance(*texts[k], int(most[k])) <= most[k]
            else:
                pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in (texts[k] for k in at)]
                out[np.asarray(mine)[at]] = _tables(*zip(*pairs, strict=True), most[at])
    return out


def _steps(order: np.ndarray, sizes: np.ndarray, most: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs in the given order in groups of up to ``TABLES``, of about ``ROOM`` characters with each side filled up to the longest, and of similar ``most``."""
    words = most // 64 + 1
    lo = 0
    while lo < len(order):
        at = order[lo : lo + TABLES]
        full = np.maximum.accumulate(sizes[at].sum(1)) * np.arange(1, len(at) + 1) > 2 * ROOM
        stop = np.flatnonzero(full | (words[at] < 0.7 * words[at[0]]))
        at = at[: max(1, stop[0]) if len(stop) else len(at)]
        yield at
        lo += len(at)


def _aligned(x: str | bytes, y: str | bytes) -> int:
    """A number of edits that turn x into y, though not the least: words found once in both stay where their order is the same, and what
    lies between two of them is changed word by word, or as a whole."""
    space = " " if isinstance(x, str) else b" "
    p, q = x.split(space), y.split(space)
    many, place = Counter(p), {}
    for j, w in enumerate(q):
        place[w] = -1 if w in place else j
    ends: list[int] = []  # the longest rising run of places: the smallest last place of each length, and what stands before it
    last: list[int] = []
    found, before = [], []
    for i, w in enumerate(p):
        if many[w] == 1 and (j := place.get(w, -1)) >= 0:
            k = bisect.bisect_left(ends, j)
            before.append(last[k - 1] if k else -1)
            ends[k : k + 1], last[k : k + 1] = [j], [len(found)]
            found.append((i, j))
    stay, k = [(len(p), len(q))], last[-1] if last else -1
    while k >= 0:
        stay.append(found[k])
        k = before[k]
    cost, i, j = 0, 0, 0
    for to_i, to_j in reversed(stay):
        if to_i - i == to_j - j:
            cost += sum([max(len(a), len(b)) for a, b in zip(p[i:to_i], q[j:to_j], strict=True) if a != b])
        else:
            cost += max(sum(map(len, p[i:to_i])) + to_i - i, sum(map(len, q[j:to_j])) + to_j - j)
        i, j = to_i + 1, to_j + 1
    return cost


def _few_runs(a: tuple, b: tuple, most: np.ndarray) -> np.ndarray:
    """False where a[k] and b[k] (all bytes or all text) surely are more than ``most[k]`` edits apart: an edit makes and ends at most q runs of q characters."""

    def units(texts: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts[0], bytes):
            data = np.frombuffer(b"".join(texts), np.uint8)
        else:
            data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return data.astype(np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))

    sides, out = [units(a), units(b)], np.ones(len(a), bool)
    bins = 1 << min(12, max(8, int(max(n.max() for _, n in sides)).bit_length()))
    for q in (2, 3):
        counts = []
        for data, n in sides:
            runs = data
            for k in range(1, q):
                runs = runs[:-1] * np.uint32(0x9E3779B1) + data[k:]
            cells = ((runs * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (bins.bit_length() - 1))).astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            whole = (np.repeat(np.cumsum(n), n) - np.arange(len(data)))[: len(cells)] >= q
            counts.append(np.bincount((own[: len(cells)] * bins + cells)[whole], minlength=len(n) * bins).reshape(len(n), bins))
        more = counts[0] - counts[1]
        total = more.sum(1)
        gone = (np.abs(more).sum(1) + total) // 2
        out &= np.maximum(gone, gone - total) <= q * most
    return out


def _tables(a: tuple, b: tuple, most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distances of a[k], b[k] (a[k] not the shorter; all bytes or all text) are at most ``most[k]``.

    Of a table only the diagonals are kept that a path of at most that cost can touch, most + 1 of them.  A column of
    this band is two rows of bits, where the entries rise and fall (Myers, Hyyro), and takes a few operations on 64-bit
    numbers for all pairs at once.  On the diagonal of the last entry the entries never fall, so they tell when a pair is lost."""
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    order = np.argsort(-n_b, kind="stable")
    joined = b"".join if isinstance(a[0], bytes) else lambda texts: "".join(texts).encode("utf-32-le", "surrogatepass")
    kind = np.uint8 if isinstance(a[0], bytes) else np.uint32
    left, right = (np.frombuffer(joined([texts[k] for k in order]), kind) for texts in (a, b))
    n_a, n_b, most = n_a[order], n_b[order], most[order]
    apart = n_a - n_b
    room = (most - apart) // 2
    words = int((apart + 2 * room).max()) // 64 + 1
    known = np.zeros(int(max(left.max(initial=0), right.max(initial=0))) + 1, bool)
    known[left] = known[right] = True
    code = np.cumsum(known) - 1
    letters, longest = int(known.sum()), int(n_b[0])
    rows = max(int((n_a + room).max()), longest) // 64 + words + 2
    if len(a) > 1 and len(a) * letters * rows > CELLS:
        out, half = np.empty(len(a), bool), len(a) // 2
        for at in (order[:half], order[half:]):
            out[at] = _tables(tuple(a[k] for k in at), tuple(b[k] for k in at), most[np.isin(order, at)])
        return out
    own = np.repeat(np.arange(len(a)), n_a)
    place = np.arange(len(left)) - np.repeat(np.cumsum(n_a) - n_a, n_a) + room[own]
    seen = np.zeros((rows, len(a) * letters), np.uint64)  # where a letter stands in a[k], moved by its room: 64 places a row
    np.add.at(seen.reshape(-1), (place >> 6) * (len(a) * letters) + own * letters + code[left], np.uint64(1) << (place & 63).astype(np.uint64))
    asked = np.zeros((longest, len(a)), np.int64)
    own = np.repeat(np.arange(len(a)), n_b)
    asked[np.arange(len(right)) - np.repeat(np.cumsum(n_b) - n_b, n_b), own] = own * letters + code[right]
    one, every = np.uint64(1), ~np.uint64(0)
    # rows up to 0 of the first column are 0, those below rise by one each
    first = np.clip(room[None, :] - 64 * np.arange(words)[:, None], 0, 64)
    up = np.where(first < 64, every << np.minimum(first, 63).astype(np.uint64), np.uint64(0))
    down = np.zeros_like(up)
    end = apart + room
    end_word, end_bit = end >> 6, (end & 63).astype(np.uint64)
    cost, names, good, live, lanes = apart.copy(), np.arange(len(a)), np.zeros(len(a), bool), len(a), np.arange(len(a))
    for j in range(longest + 1):
        lasting = int(np.searchsorted(-n_b, -j, "left"))  # of those that have more columns
        if lasting < live:
            good[names[lasting:live]] = cost[lasting:live] <= most[lasting:live]
            live = lasting
            if not live:
                break
            cut = slice(0, live)
        elif j % 32 == 0 and len(hope := np.flatnonzero(cost[:live] <= most[:live])) < 0.8 * live:
            cut, live = hope, len(hope)
            if not live:
                break
        else:
            cut = None
        if cut is not None:
            n_b, most, cost, names, end_word, end_bit, asked = n_b[cut], most[cut], cost[cut], names[cut], end_word[cut], end_bit[cut], asked[:, cut]
            up, down, lanes = up[:, cut], down[:, cut], np.arange(live)
        low, shift = j >> 6, np.uint64(j & 63)
        parts = seen[low : low + words + 1].take(asked[j], axis=1)
        equal = parts[:-1]
        if j & 63:
            equal = (equal >> shift) | (parts[1:] << (np.uint64(64) - shift))
        same = equal & up
        if words > 1:
            total = same + up
            over = (total < same).astype(np.uint64)
            for w in range(1, words):
                total[w] += over[w - 1]
                over[w] |= total[w] < over[w - 1]
            same = total
        else:
            same += up
        same ^= up
        same |= equal
        same |= down
        rise = ~(same | up)
        rise |= down
        fall = same & up
        x = same >> one
        if words > 1:
            x[:-1] |= same[1:] << np.uint64(63)
        down = x & rise
        x |= rise
        up = ~x
        up |= fall
        last = same[end_word, lanes] if words > 1 else same[0]
        cost += 1
        cost -= ((last >> end_bit) & one).view(np.int64)
    out = np.empty(len(a), bool)
    out[order] = good
    return out


def _shared(a: str | bytes, b: str | bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 1, similarity: float = 0.9, carry: list[str] | None = None) -> DataFrame:
    """All rows with ``n_lines``, ``n_dropped`` and ``text_clean``, the text without dropped lines.

    ``carry`` names input columns to return besides ``doc_id`` (default none)."""
    kept = [doc_id, *[c for c in (carry or []) if c in others(docs, (*RESULT, doc_id))]]
    plain = docs.select(*[quoted(c).alias(f"__c{k}") for k, c in enumerate(kept)], utf8(quoted(text)).alias("__body"))
    rows = store(plain.withColumn("__row", F.monotonically_increasing_id()), "texts")
    lines = store(_lines(rows, min_words), "lines")
    # the first occurrence of each distinct normalised line, and of each group of lines
    place = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("pos").alias("pos"), F.col("row").alias("row"))
    nodes = store(lines.groupBy("node").agg(F.min(place).alias("first"), *[F.min(c).alias(c) for c in (*KEYS, "size")]), "line-nodes")
    groups = _groups(rows, nodes, similarity)
    linked = store(groups.join(grows(nodes), "node").select("component", "node", "first"), "linked-lines")
    winners = linked.groupBy("component").agg(F.min("first").alias("first"))
    firsts = store(
        nodes.join(grows(linked.select("node", "component").join(grows(winners), "component").select("node", F.col("first").alias("of_group"))), "node", "left")
        .select("node", F.coalesce("of_group", "first").alias("first")),
        "line-firsts",
    )
    dropped = lines.join(grows(firsts), "node").filter((F.col("first.row") != F.col("row")) | (F.col("first.pos") != F.col("pos")))
    cuts = store(dropped.groupBy("row").agg(F.collect_list("pos").alias("__cut")), "dropped-lines")
    met = rows.join(grows(cuts.withColumnRenamed("row", "__row")), "__row", "left").drop("__row")
    types = [ids_field(rows, f"__c{k}") for k in range(len(kept))]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in kept], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text_clean", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body", 2000, 8 << 20):
            counts, gone, texts = [], [], []
            for body, drop in zip(batch.column("__body").to_pylist(), batch.column("__cut").to_pylist(), strict=True):
                counts.append(body.count(b"\n") + 1 if body else 0)
                gone.append(len(drop or ()))
                if drop:
                    away = set(drop)
                    body = b"\n".join(x for k, x in enumerate(body.split(b"\n")) if k not in away)
                texts.append(body.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[batch.column(f"__c{k}").cast(t) for k, t in enumerate(types)], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    return met.mapInArrow(cut, schema)


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """row, doc, pos, node (hash of the normalised line), keys and size in characters of every line that takes part."""
    id_type = ids_field(rows, "__c0")
    names = ("pos", "node", *KEYS, "size")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", rows.schema["__c0"].dataType), *[T.StructField(c, T.LongType()) for c in names]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body", 2000, PIECE):
            for where, before, texts in _pieces(batch.column("__body").to_pylist()):
                found = Lines(texts)
                counts = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
                of = np.repeat(np.arange(len(texts)), counts)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.asarray(before)[of]
                at = np.flatnonzero(found.n_words >= max(1, min_words))
                if not len(at):
                    continue
                _, first, number = np.unique(found.node[at], return_index=True, return_inverse=True)
                columns = [pos[at], found.node[at].view(np.int64), *found.keys(at[first])[number].view(np.int64).T, found.size[at]]
                picked = pa.array(np.asarray(where)[of[at]])
                yield pa.RecordBatch.from_arrays([batch.column("__row").take(picked), batch.column("__c0").cast(id_type).take(picked), *map(pa.array, columns)], names=schema.names)

    return rows.select("__row", "__c0", "__body").mapInArrow(read, schema)


def _pieces(bodies: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about PIECE bytes, long ones cut at line feeds: number of the text, lines before the piece, piece."""
    held: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for k, body in enumerate(bodies):
        at = before = 0
        while True:
            stop = len(body)
            if stop - at > PIECE:
                stop = body.rfind(b"\n", at, at + PIECE)
                stop = stop if stop >= at else body.find(b"\n", at)
                stop = stop if stop >= 0 else len(body)
            piece = body[at:stop]
            for column, x in zip(held, (k, before, piece), strict=True):
                column.append(x)
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = ([], [], []), 0
            if stop >= len(body):
                break
            before += piece.count(b"\n") + 1
            at = stop + 1
    if held[0]:
        yield held


def _groups(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """node, component of all nodes that are linked with another."""
    with recorded() as made:
        members = _members(_met(nodes).join(grows(nodes.select("node", *KEYS, "size")), "node"), similarity)
    links = nodes.sparkSession.createDataFrame([], "a long, b long")
    groups, lines, done, partners, known = None, None, 0, PARTNERS, 0
    while True:
        placed = members if groups is None else members.join(grows(groups.withColumnRenamed("component", "g")), "node", "left").withColumn("g", F.coalesce("g", "node"))
        own = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("own", "o"), "y": F.greatest("own", "o")})
        dealt = dealt.select("bucket", "x", "y", "own", "node", *(["g"] if groups is not None else []), "size", *KEYS, "key", "home").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        near = store(dealt.mapInArrow(partial(_compare, partners, least=similarity, done=done), "a long, b long, more long"), "near")
        fresh = near.filter("a is not null").select("a", "b")
        again = store(near.filter("more is not null").select(F.col("more").alias("bucket")).distinct(), "full-buckets")
        ended = again.isEmpty()
        left = None if ended else Stored(members.join(grows(again), "bucket"), "members")
        for table in made:
            table.drop()
        if not fresh.isEmpty():
            # a node that has any partner offers one in the first round, so its line is read then
            lines = _compared_lines(fresh, rows, nodes) if lines is None else lines
            links = store(links.union(_similar(fresh, lines, similarity)), "links")
        found = links.count()
        if groups is None or found > known:
            groups, known = store(connected_components(links), "line-groups"), found
        if left is None:
            return groups
        members, made, done, partners = left.df, [left], partners, partners * MORE


def _met(nodes: DataFrame) -> DataFrame:
    """node, key, bucket and n, the number of its nodes, of all buckets of several nodes.

    Most buckets have one node.  So only bucket and node are exchanged, 16 bytes each and many in a row, and a task sorts those
    of its share; the number of shares grows with the nodes."""
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * 2 * len(KEYS) // SHARE))
    pair = np.dtype([("bucket", np.int64), ("node", np.int64)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shares(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy().view(np.uint64) for c in KEYS]
            pairs = np.empty(2 * len(KEYS) * table.num_rows, pair)
            pairs["node"] = np.tile(table.column("node").to_numpy(), 2 * len(KEYS))
            cells = [(k >> np.uint64(s)) & np.uint64(0xFFFFFFFF) for k in keys for s in (32, 0)]
            pairs["bucket"] = np.concatenate([(k << 32) + c.astype(np.int64) for k, c in enumerate(cells)])
            share = (mix64(pairs["bucket"].view(np.uint64)) % np.uint64(4 * tasks)).astype(np.uint16 if 4 * tasks < 1 << 16 else np.int32)
            order = np.argsort(share, kind="stable")
            names, sizes = np.unique(share[order], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(pair.itemsize)
            body = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(pairs[order])])
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), body], names=["share", "body"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield shares(held)
                held = []
        if held:
            yield shares(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [np.frombuffer(x, pair) for batch in batches for x in batch.column("body").to_pylist()]
        if not bodies:
            return
        pairs = np.concatenate(bodies)
        bodies.clear()
        order = np.argsort(pairs["bucket"])
        bucket = pairs["bucket"][order]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        sizes = np.diff(np.append(np.flatnonzero(new), len(bucket)))
        n = np.repeat(sizes, sizes)
        at = np.flatnonzero(n > 1)
        for lo in range(0, len(at), HELD):
            k = at[lo : lo + HELD]
            yield pa.RecordBatch.from_arrays([pa.array(pairs["node"][order[k]]), pa.array((bucket[k] >> 32).astype(np.int32)), pa.array(bucket[k]), pa.array(n[k])], names=["node", "key", "bucket", "n"])

    packed = nodes.select("node", *KEYS).mapInArrow(pack, "share int, body binary")
    return packed.repartition(tasks, "share").mapInArrow(meet, "node long, key int, bucket long, n long")


def _members(spread: DataFrame, similarity: float) -> DataFrame:
    """The nodes of buckets of several, with the number of blocks and ``home``; ``n`` is counted where it is not given.

    Hot buckets are split by bands of sizes, as wide as the ratio of sizes that the similarity allows: a node stands in its
    own band's part, at home, and in that of the next longer band, so nodes that may be linked share a part in which one is at home."""

    def crowded(of: DataFrame) -> DataFrame:
        found = of.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("n")).filter("x <> y")
        return store(found.select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")

    counted = spread if "n" in spread.columns else spread.join(grows(crowded(spread).drop("blocks")), "bucket")
    members = store(counted.withColumns({"blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "home": F.lit(True)}), "members")
    if members.filter(F.col("n") > HOT).isEmpty():
        return members.drop("n")
    width = max(-math.log(min(1.0, max(similarity, 1e-9))), 1e-4) * (1 + 1e-6)
    hot = members.filter(F.col("n") > HOT).drop("blocks", "n", "home").withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1))) / width))
    parts = hot.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"home": F.col("up") == 0, "bucket": F.xxhash64("bucket", F.col("band") + F.col("up"))})
    split = store(parts.drop("band", "up"), "split-buckets")
    return store(members.filter(F.col("n") <= HOT).drop("n").unionByName(split.join(grows(crowded(split)), "bucket").drop("n")), "members")


def _compare(partners: int, batches: Iterator[pa.RecordBatch], bits: tuple[int, int] = BITS, least: float = 0.9, done: int = 0) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different components within ``bits`` bits (short lines, others) and of sizes that allow the similarity, in their first common key.

    In large buckets these are the pairs of which a node is at the other's rank ``done`` to ``partners`` (from 0, by bits, in
    its block); ``more`` is the bucket where pairs of later ranks are left, in a row of its own if there is no other."""

    def emit(a: np.ndarray, b: np.ndarray, more: bool = False, bucket: int = 0) -> pa.RecordBatch:
        if more and not len(a):
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([bucket], pa.int64())], names=["a", "b", "more"])
        mark = np.arange(len(a)) == 0 if more else np.zeros(len(a), bool)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), bucket), pa.int64(), mask=~mark)], names=["a", "b", "more"])

    def ranks(far: np.ndarray) -> np.ndarray:
        order = np.argsort(far, axis=1, kind="stable")
        out = np.empty(far.shape, np.int32)
        np.put_along_axis(out, order, np.arange(far.shape[1], dtype=np.int32)[None, :], 1)
        return out

    def alike(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether i and j (shapes that fit) may be linked and meet here first, whatever their components; and their distance in bits."""
        x, y = t["size"][i], t["size"][j]
        far = np.bitwise_count(t["high"][i] ^ t["high"][j]) + np.bitwise_count(t["low"][i] ^ t["low"][j])  # unsigned: of a negative number the bits of its absolute value are counted
        near = (far <= np.where(np.minimum(x, y) < SHORT, *bits)) & (np.abs(x - y) <= (1 - least) * np.maximum(x, y) + 1e-9) & (t["node"][i] != t["node"][j])
        if "key" in t:
            near &= t["home"][i] | t["home"][j]
            at = np.nonzero(near)  # their earlier keys are looked at of these only
            own, other = np.broadcast_to(i, near.shape)[at], np.broadcast_to(j, near.shape)[at]
            before, first = t["key"][own], np.ones(len(own), bool)
            for k in range(int(before.max(initial=0))):
                name, half = KEYS[k // 2], np.uint64(32 * (1 - k % 2))
                first &= (((t[name][own] ^ t[name][other]) >> half).astype(np.uint32) != 0) | (before <= k)
            near[at] = first
        return near, far

    def block(t: dict[str, np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
        at = lo + np.argsort(t["node"][lo:hi], kind="stable")  # ranks of equal distances are the same in all rounds
        same = t["x"][lo] == t["y"][lo]
        left, right = at[t["own"][at] == t["x"][at]], at[t["own"][at] == t["y"][at]]
        if not len(left) or not len(right):
            return emit(left[:0], right[:0])
        near, far = alike(t, left[:, None], right[None, :])
        far[~near] = 255
        rank = ranks(far)
        rank = np.minimum(rank, rank.T if same else ranks(far.T).T)
        open_ = near & (t["g"][left][:, None] != t["g"][right][None, :]) & (rank >= done)
        if same:
            open_ = np.triu(open_)
        i, j = np.nonzero(open_ & (rank < partners))
        return emit(t["node"][left[i]], t["node"][right[j]], bool((open_ & (rank >= partners)).any()), int(t["bucket"][lo]))

    def runs(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(t["bucket"])
        new = np.ones(n, bool)
        new[1:] = (np.diff(t["bucket"]) != 0) | (np.diff(t["x"]) != 0) | (np.diff(t["y"]) != 0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        size, run = np.repeat(sizes, sizes), np.repeat(np.arange(len(starts)), sizes)
        for shift in range(1, SMALL if not done else 0):  # these are whole after the first round
            i = np.flatnonzero((run[:-shift] == run[shift:]) & (size[:-shift] <= SMALL)) if n > shift else np.empty(0, np.int64)
            i = i[alike(t, i, i + shift)[0]]
            i = i[(t["g"][i] != t["g"][i + shift]) & ((t["own"][i] != t["own"][i + shift]) | (t["x"][i] == t["y"][i]))]
            if len(i):
                yield emit(t["node"][i], t["node"][i + shift])
        for lo, size_ in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            yield block(t, lo, lo + size_)

    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "blocks"}
        arrays.setdefault("g", arrays["node"])  # before there are components
        held.append(arrays | {c: arrays[c].view(np.uint64) for c in KEYS if c in arrays})
        t = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        n = len(t["bucket"])
        last = (t["bucket"] == t["bucket"][-1]) & (t["x"] == t["x"][-1]) & (t["y"] == t["y"][-1])
        stop = n - int(last.sum())  # the last bucket may go on in the next batch
        yield from runs({c: v[:stop] for c, v in t.items()})
        held = [{c: v[stop:] for c, v in t.items()}]
    if held:
        yield from runs(held[0])


def _compared_lines(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and normalised line of all nodes in the pairs, read again where they first stand; a text is read once for all of its lines."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body", 2000, 8 << 20):
            places = batch.column("places")
            where = iter(places.flatten().field("pos").to_pylist())
            text = []
            for body, n in zip(batch.column("__body").to_pylist(), pc.list_value_length(places).to_pylist(), strict=True):
                lines = body.split(b"\n")
                text += [normalised(lines[p]) for p in itertools.islice(where, n)]
            yield pa.RecordBatch.from_arrays([places.flatten().field("node"), pa.array(text, pa.binary())], names=["node", "line"])

    first = wanted.join(grows(nodes.select("node", "first")), "node").select(F.col("first.row").alias("__row"), F.struct("node", F.col("first.pos").alias("pos")).alias("place"))
    places = first.groupBy("__row").agg(F.collect_list("place").alias("places"))
    return store(rows.select("__row", "__body").join(grows(places), "__row").select("places", "__body").mapInArrow(pick, "node long, line binary"), "compared-lines")


def _similar(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose normalised lines are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 10_000, 8 << 20):
            same = similar_lines(batch.column("x").to_pylist(), batch.column("y").to_pylist(), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(same))

    met = pairs.join(grows(lines.select(F.col("node").alias("a"), F.col("line").alias("x"))), "a").join(grows(lines.select(F.col("node").alias("b"), F.col("line").alias("y"))), "b")
    return met.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")
