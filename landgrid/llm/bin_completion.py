"""Best-fit packing by bin completion over the histogram of lengths.

Documents are tokenised (an end id after each), cut into pieces of at most ``capacity`` tokens and packed into as few
sequences as possible. Only the count of pieces of each length, at most ``capacity`` numbers whatever the corpus, comes
to the driver. There a branch-and-bound search over whole packings starts from the best of best-fit decreasing (of the
whole, and of equal parts of it) and least-waste completions. It completes bins around the largest length that is left, branches over undominated fillings and
over how many bins take one, and prunes by the lower bound of what is left (Martello and Toth's L2); it ends at the lower
bound of the whole, when all is searched, or after ``WORK``. Pieces find their bins by their rank among the
pieces of their length, counted in salted groups so that one length may hold any share of the rows.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; ties go by doc_id and piece;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.llm._util import arrow_map, materialise, table
from landgrid.llm.bpe_words import WordBpe, loaded

CAPACITY, END_ID, SALTS = 2048, 0, 64
# Bounds of the search, a node counting 20 and its distinct lengths; of the fillings that one node looks at. Beyond them the best packing so far is used.
WORK, LOOKED_AT = 100_000, 200


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def make():
        bpe = loaded(WordBpe, folder)
        end = END_ID.to_bytes(4, "little")

        def batch(rows: pa.RecordBatch) -> dict:
            out = ([], [], [], [], [])
            for doc_id, x in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
                ids = bpe.encode(x.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for to, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        to.append(v)
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), out))

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _reach(count: np.ndarray, room: int) -> tuple[list[int], list[int], list[int]]:
    """Lengths that fit, descending; how many of each can; and by place, the sums that lengths from there on reach, as bits."""
    lengths = (np.flatnonzero(count[1 : room + 1]) + 1)[::-1].tolist()
    copies = [min(int(count[n]), room // n) for n in lengths]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for n, k in zip(reversed(lengths), reversed(copies)):
        bits, step = reach[-1], 1
        while k:  # 1, 2, 4, ... copies at once
            step = min(step, k)
            bits |= bits << (n * step) & mask
            k, step = k - step, step * 2
        reach.append(bits)
    return lengths, copies, reach[::-1]


def complete(count: np.ndarray, room: int) -> list[int]:
    """The lengths, descending, that fill ``room`` with least waste; count[l]: pieces of length l that may be used.

    Of several such fillings the one with the longest pieces, and most of them, first. A length and its number are chosen in
    one step and the sums that the shorter ones reach are known, so no choice is taken back.
    """
    lengths, copies, reach = _reach(count, room)
    goal, filling = reach[0].bit_length() - 1, []
    for n, k, rest in zip(lengths, copies, reach[1:]):
        k = min(k, goal // n)
        while not rest >> (goal - k * n) & 1:
            k -= 1
        filling += [n] * k
        goal -= k * n
    return filling


def lower_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: for each K, pieces above capacity - K stand alone, those of K and more fill the gaps of the rest."""
    n, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * np.arange(len(count))))  # of pieces below a length
    k, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    large, middle = n[-1] - n[half], n[capacity - k + 1] - n[half]
    gaps = middle * capacity - (tokens[capacity - k + 1] - tokens[half])
    small = tokens[half] - tokens[k]
    return int((large + np.maximum(0, -((gaps - small) // capacity))).max())


def best_fit(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-fit decreasing packing, bins of one filling together: a bin that got a piece is the fullest and takes on."""
    open_bins: dict[int, list] = {}  # room left -> [(filling as linked (length, copies), number of bins)]
    for length in (np.flatnonzero(count[1:]) + 1)[::-1].tolist():
        n = int(count[length])

        def put(filling, room, bins, length=length):
            """Pieces of ``length`` into ``bins`` alike ones, as many as fit or are left."""
            nonlocal n
            each = room // length
            full = min(bins, n // each)
            n -= full * each
            for copies, m in ((each, full), (n, 1 if full < bins and n else 0)):
                if m:
                    open_bins.setdefault(room - copies * length, []).append(((filling, length, copies), m))
                    full, n = (full, n) if copies == each else (full + 1, 0)
            return bins - full

        for room in sorted(r for r in open_bins if r >= length):
            alike = open_bins.pop(room)
            while alike and n:
                filling, bins = alike.pop()
                if left := put(filling, room, bins):
                    alike.append((filling, left))
            if alike:
                open_bins.setdefault(room, []).extend(alike)
            if not n:
                break
        if n:
            put(None, capacity, n)
    steps = []
    for alike in open_bins.values():
        for linked, bins in alike:
            filling: list[int] = []
            while linked:
                linked, length, copies = linked
                filling[:0] = [length] * copies
            steps.append((filling, bins))
    return steps


def dive(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Least-waste completions for good, largest piece first."""
    count, steps = count.copy(), []
    while count.any():
        top = int(np.flatnonzero(count)[-1])
        count[top] -= 1
        filling = [top, *complete(count, capacity - top)]
        count[top] += 1
        steps.append((filling, _use(count, filling)))
    return steps


def by_parts(count: np.ndarray, capacity: int = CAPACITY) -> Iterator[list[tuple[list[int], int]]]:
    """Packings of many alike parts: a part's best-fit packing as often as there are parts, and what is left best-fit."""
    for n in sorted({int(np.gcd.reduce(count)), *(1 << k for k in range(1, int(count.max()).bit_length()))} - {1}):
        yield [(f, t * n) for f, t in best_fit(count // n, capacity)] + best_fit(count % n, capacity)


def _use(count: np.ndarray, filling: list[int], times: int | None = None) -> int:
    """Takes the pieces of ``times`` bins, of as many as there can be if not given, from ``count``."""
    lengths, mult = np.unique(filling, return_counts=True)
    times = int((count[lengths] // mult).min()) if times is None else times
    count[lengths] -= mult * times
    return times


def fillings(count: np.ndarray, room: int, slack: int) -> Iterator[list[int]]:
    """All fillings of ``room`` that waste ``slack`` at most, longer pieces first."""
    lengths, copies, reach = _reach(count, room)
    slack = min(slack, room)
    window = (1 << (slack + 1)) - 1
    fits = lambda at, r: (reach[at] >> (r - slack) if r >= slack else reach[at] << (slack - r)) & window
    if not fits(0, room):
        return
    chosen, r = [], room  # by place: copies
    while True:
        while len(chosen) < len(lengths):  # down
            k = min(copies[len(chosen)], r // lengths[len(chosen)])
            while not fits(len(chosen) + 1, r - k * lengths[len(chosen)]):
                k -= 1
            chosen.append(k)
            r -= k * lengths[len(chosen) - 1]
        yield [n for n, k in zip(lengths, chosen) for _ in range(k)]
        while chosen:  # back to the last place where fewer copies can do
            k, n = chosen.pop(), lengths[len(chosen)]
            r += k * n
            k -= 1
            while k >= 0 and not fits(len(chosen) + 1, r - k * n):
                k -= 1
            if k >= 0:
                chosen.append(k)
                r -= k * n
                break
        else:
            return


def dominated(count: np.ndarray, room: int, filling: list[int]) -> bool:
    """Whether a piece that is left over could stand for a subset (or nothing) that it is at least as long as.

    Those pieces would fit where it stood, so a packing with this filling is no better than one with the other.
    """
    left = count[: room + 1].copy()
    lengths, mult = np.unique(np.array(filling, np.int64), return_counts=True)
    left[lengths] -= mult
    spare, have = room - sum(filling), np.flatnonzero(left[1:]) + 1
    one, more = 0, 0  # sums of one piece; of two or more
    for n, k in zip(lengths.tolist(), mult.tolist()):
        for _ in range(k):
            more |= (one | more) << n
            one |= 1 << n
    sums = [0, *(n for n in lengths.tolist())]
    at_least = np.searchsorted(have, np.array(sums) + 1)
    if any(i < len(have) and have[i] <= s + spare for i, s in zip(at_least.tolist(), sums)):
        return True
    return any(more >> max(0, y - spare) & ((1 << (min(y, spare) + 1)) - 1) for y in have.tolist())


def _children(count: np.ndarray, capacity: int, slack: int) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """(filling, bins, counts left) of undominated fillings around the largest piece, least waste first; all bins alike, then halves of them."""
    top = int(np.flatnonzero(count)[-1])
    count[top] -= 1
    found = [f for f in islice(fillings(count, capacity - top, slack), LOOKED_AT) if not dominated(count, capacity - top, f)]
    count[top] += 1
    for f in sorted(found, key=sum, reverse=True):
        left = count.copy()
        times = _use(left, [top, *f])
        while times:
            yield [top, *f], times, left
            times, left = times // 2, count.copy()
            _use(left, [top, *f], times)


def plan(count: np.ndarray, capacity: int = CAPACITY, work: int = WORK) -> list[tuple[list[int], int]]:
    """[(lengths of one bin, number of such bins)] that use up ``count``; never more bins than best-fit decreasing.

    Depth first; a branch goes where its bins and the lower bound of what is left are no fewer than the incumbent's. Each
    node's rest is packed best-fit too, so that the search gives packings long before its leaves.
    """
    size = lambda steps: sum(t for _, t in steps)
    least, best = lower_bound(count, capacity), best_fit(count, capacity)
    if size(best) > least:
        best = min(best, dive(count, capacity), *by_parts(count, capacity), key=size)
    tokens = int((count * np.arange(len(count))).sum())
    open_nodes = [(None, 0, tokens, _children(count.copy(), capacity, (size(best) - 1) * capacity - tokens))] if size(best) > least else []
    while open_nodes and work > 0 and size(best) > least:
        before, used, held, children = open_nodes[-1]
        if (child := next(children, None)) is None:
            open_nodes.pop()
            continue
        filling, times, left = child
        work -= 20 + np.count_nonzero(left)
        path, bins, rest = (before, filling, times), used + times, held - times * sum(filling)
        if bins + lower_bound(left, capacity) >= size(best):
            continue
        steps = best_fit(left, capacity)
        if bins + size(steps) < size(best):
            best, at = steps, path
            while at:
                at, filling, times = at
                best.append((filling, times))
        if left.any():
            open_nodes.append((path, bins, rest, _children(left, capacity, (size(best) - 1 - bins) * capacity - rest)))
    return best


def _places(steps: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces of that length a bin, offset of the first), sorted."""
    rows, used, bins = [], {}, 0
    for filling, times in steps:
        offset = 0
        for length in dict.fromkeys(filling):
            k = filling.count(length)
            rows.append((length, used.get(length, 0), bins, k, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, length, ...) rows; lengths are 1 to ``capacity``.

    A piece's rank among those of its length is its rank in its salted group plus the rows of the groups before. The counts of
    groups, at most ``capacity`` times ``SALTS`` longs (1 MB at 2,048 and 64), go to the driver and out again with the plan.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    sizes = np.zeros((capacity + 1, SALTS), np.int64)
    for length, salt, n in salted.groupBy("length", "__salt").count().collect():  # at most capacity * SALTS rows
        sizes[length, salt] = n
    before = np.cumsum(sizes, axis=1) - sizes
    places = _places(plan(sizes.sum(1), capacity))
    key = places[:, 0] * (1 << 44) + places[:, 1]
    shared = spark.sparkContext.broadcast((key, places, before))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("__n", within)

    def make():
        key, places, before = shared.value

        def batch(rows: pa.RecordBatch) -> dict:
            length, salt, n = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__salt", "__n"))
            rank = before[length, salt] + n - 1
            row = places[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            return {c: rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length}

        return batch

    return arrow_map(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    return pack(materialise(pieces_of(docs, capacity, folder), "pieces"), capacity)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
