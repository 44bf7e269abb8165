"""Pairs of texts with a Jaccard index of their character shingles of a threshold or more: all of them, no pair of sets written before it is likely.

Pigeonring over boxes. Two sets of `a` and `b` members with an index of `t` differ
in (1 - t) / (1 + t) * (a + b) members at most. Shingles fall into more boxes by
their hash than that, so the sets have a box in common that is equal, and of all
such boxes one from which on (as a ring) the first `l` boxes differ in no more than
`l` times the mean, for each `l`. A box is kept as a few bits, the parity of the
members that fall on each: it is equal where the members are, and differs in no
more bits than members. So the test on the bits loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import settle, tidy

#: Character shingles' length; bits of a box; boxes whose runs one task finds, and boxes after them that it tests with.
GRAM, BITS, SPAN, AFTER = 5, 16, 64, 4
#: Characters of texts that are hashed at once, pairs that are tested at once.
PORTION = 1 << 20
#: Pairs that are compared in one call, about, where places are small, and at most; pairs up to which the table of the texts wanted is sent to all tasks.
LOT, MOST, FEW = 500, 200_000, 100_000
_FACTORS = np.random.default_rng(20240517).integers(1, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.dtype(f"uint{BITS}")
SKETCHED = "cls int, part int, id bigint, n int, boxes binary"


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, ascending, text after text, and the bounds of the texts; a text shorter than a shingle is its own."""
    lengths = np.array([max(len(t), GRAM) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(t.ljust(GRAM, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    for i, t in enumerate(texts):
        if len(t) < GRAM:
            codes[ends[i] - GRAM + len(t) : ends[i]] = 0  # no character is 0
    hashes = np.zeros(len(codes) - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        hashes += codes[i : len(hashes) + i] * _FACTORS[i]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0x94D049BB133111EB)
    hashes ^= hashes >> np.uint64(32)
    within = np.ones(len(hashes), dtype=bool)
    for i in range(1, GRAM):
        within[ends[:-1] - i] = False
    hashes = hashes[within]
    bounds = np.concatenate([[0], np.cumsum(lengths - GRAM + 1)])
    for start, end in zip(bounds[:-1], bounds[1:]):
        hashes[start:end].sort()
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[bounds[:-1]] = True
    return hashes[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def differ_most(sizes: np.ndarray | int, threshold: float) -> np.ndarray | float:
    """In how many members two sets differ at most, from the sum of their sizes."""
    return (1 - threshold) / (1 + threshold) * sizes + 1e-9


def ladder(largest: int, threshold: float) -> list[int]:
    """The least sizes of the classes up to one beyond `largest`: a set is alike to such of its own class and of its neighbours only."""
    steps = [1]
    while steps[-1] <= largest or len(steps) < 2:
        steps.append(int(steps[-1] / threshold + 1e-9) + 1)
    steps.append(int(steps[-1] / threshold + 1e-9) + 1)
    return steps


def boxes_of(steps: list[int], cls: int, threshold: float) -> int:
    return int(differ_most(2 * (steps[cls + 1] - 1), threshold)) + 1


def portions(texts: list[str]) -> Iterator[slice]:
    start = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > PORTION:
            yield slice(start, i)
            start, chars = i, 0
        chars += max(len(t), GRAM)
    if start < len(texts):
        yield slice(start, len(texts))


def sketches(hashes: np.ndarray, bounds: np.ndarray, boxes: int) -> np.ndarray:
    """A row of boxes for each set."""
    sets = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = sets * boxes + ((hashes >> np.uint64(32)) * np.uint64(boxes) >> np.uint64(32)).astype(np.int64)
    counts = np.bincount(at, minlength=(len(bounds) - 1) * boxes)
    ends = np.cumsum(counts)
    parity = np.zeros(len(hashes) + 1, dtype=_KIND)
    np.bitwise_xor.accumulate(np.left_shift(1, (hashes & np.uint64(BITS - 1)).astype(_KIND), dtype=_KIND), out=parity[1:])
    return (parity[ends] ^ parity[ends - counts]).reshape(-1, boxes)


def sketch_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Turns `id, low` into rows `SKETCHED`: for the class of the set's size, and the next if it may have such as are alike, its boxes in parts of `SPAN`."""
    for batch in batches:
        ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for portion in portions(texts):
            hashes, bounds = gram_hashes(texts[portion])
            sizes = np.diff(bounds)
            steps = ladder(int(sizes.max()), threshold)
            own = np.searchsorted(steps, sizes, side="right") - 1
            out: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            for cls in np.unique(np.concatenate([own, own + 1])).tolist():
                chosen = np.flatnonzero((own == cls) | ((own == cls - 1) & (sizes >= threshold * steps[cls] - 1e-9)))
                if not len(chosen):
                    continue
                boxes = boxes_of(steps, cls, threshold)
                some = np.concatenate([hashes[bounds[i] : bounds[i + 1]] for i in chosen])
                rows = sketches(some, np.concatenate([[0], np.cumsum(sizes[chosen])]), boxes)
                rows = np.concatenate([rows, rows[:, : min(AFTER, boxes - 1)]], axis=1)
                out += [(chosen, cls, p, rows[:, p * SPAN : (p + 1) * SPAN + AFTER]) for p in range(-(-boxes // SPAN))]
            which = np.concatenate([x[0] for x in out])
            ends = np.cumsum(np.concatenate([np.full(len(x[0]), x[3].shape[1] * _KIND.itemsize) for x in out]))
            data = pa.py_buffer(b"".join(np.ascontiguousarray(x[3]).tobytes() for x in out))
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(x[0]), x[1], dtype=np.int32) for x in out])), pa.array(np.concatenate([np.full(len(x[0]), x[2], dtype=np.int32) for x in out])),
                pa.array(ids[portion][which]), pa.array(sizes[which].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(which), [None, offsets, data]),
            ], ["cls", "part", "id", "n", "boxes"])


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    values = np.sort(np.concatenate(parts))
    return values[np.concatenate([np.ones(min(len(values), 1), dtype=bool), values[1:] != values[:-1]])]


def likely(ids: np.ndarray, sizes: np.ndarray, boxes: np.ndarray, cls: int, part: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids, the smaller first, that may be alike by the boxes of one part of one class."""
    steps = ladder(int(sizes.max()), threshold)
    total = boxes_of(steps, cls, threshold)
    _, kept = np.unique(ids, return_index=True)  # copies of a text
    kept = kept[np.argsort(sizes[kept], kind="stable")]
    ids, sizes, boxes = ids[kept], sizes[kept].astype(np.int64), np.ascontiguousarray(boxes[kept].T)
    ranks = np.arange(len(ids), dtype=np.uint64)
    half = BITS // 2
    found = [np.zeros(0, dtype=np.int64)]
    for start in range(min(SPAN, total - part * SPAN)):
        keys = [boxes[start].astype(np.uint64)]
        if len(boxes) > start + 1:
            # Two boxes differ in one member at most, so half of the second is equal too.
            after = boxes[start + 1].astype(np.uint64)
            keys = [keys[0] << np.uint64(half) | (after & np.uint64((1 << half) - 1)), keys[0] << np.uint64(half) | after >> np.uint64(half)]
        for nth, key in enumerate(keys):
            placed = np.sort(key << np.uint64(32) | ranks)
            order, key = (placed & np.uint64(0xFFFFFFFF)).astype(np.int64), placed >> np.uint64(32)
            # Runs of equal keys, in them the sizes ascend, and the last is of this class: each with the next, then the next but one.
            at, step, held, some = np.flatnonzero(key[:-1] == key[1:]), 1, 0, []
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            at = at[sizes[order[last[np.searchsorted(last, at)]]] >= steps[cls]]
            while len(at):
                at = at[sizes[order[at]] >= threshold * sizes[order[at + step]] - 1e-9]
                mine = at[sizes[order[at + step]] >= steps[cls]]  # pairs of smaller ones are the class before's
                a, b = order[mine], order[mine + step]
                # Where the box before is equal, the pair was found from there; where the first half is, by the first key.
                new = boxes[start - 1][a] != boxes[start - 1][b] if start else np.ones(len(a), dtype=bool)
                if nth:
                    new &= keys[0][a] != keys[0][b]
                some.append((a[new], b[new]))
                held += np.count_nonzero(new)
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                if held > PORTION or not len(at):
                    a, b = (np.concatenate(x) for x in zip(*some))
                    found.append(close(boxes[start:], sizes, a, b, total, threshold))
                    held, some = 0, []
                    if sum(map(len, found[1:])) > PORTION + 2 * len(found[0]):
                        found = [distinct(found)]
    a, b = (ids[i] for i in np.divmod(distinct(found), max(len(ids), 1)))
    return np.minimum(a, b), np.maximum(a, b)


def close(boxes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, total: int, threshold: float) -> np.ndarray:
    """Of the pairs `a, b` (positions), as single numbers, those whose first `l` boxes differ in no more than `l` times the mean, for each `l`."""
    mean = differ_most(sizes[a] + sizes[b], threshold) / total
    differ = np.zeros(len(a), dtype=np.int64)
    for i, box in enumerate(boxes):
        if not len(a):
            break
        differ += np.bitwise_count(box[a] ^ box[b])
        ok = differ <= (i + 1) * mean
        a, b, mean, differ = a[ok], b[ok], mean[ok], differ[ok]
    return a * len(sizes) + b


def indices(a: np.ndarray, b: np.ndarray, ids: list[int], texts: list[str]) -> np.ndarray:
    """The Jaccard index of each pair `a, b` of `ids`, whose `texts` are given; `a` ascends."""
    parts = [gram_hashes(texts[p]) for p in portions(texts)]
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(bounds) for _, bounds in parts]))])
    values, codes = np.unique(np.concatenate([hashes for hashes, _ in parts]), return_inverse=True)
    order = np.argsort(ids)
    a, b = (order[np.searchsorted(ids, x, sorter=order)] for x in (a, b))
    marked, shared = np.zeros(len(values), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    for first, end in zip(edges[:-1], edges[1:]):
        own = codes[starts[a[first]] : starts[a[first] + 1]]
        marked[own] = 1
        for at in range(first, end, LOT):
            others = b[at : min(at + LOT, end)]
            bounds = np.concatenate([[0], np.cumsum(starts[others + 1] - starts[others])])
            shared[at : at + len(others)] = np.add.reduceat(marked[np.concatenate([codes[starts[x] : starts[x + 1]] for x in others])], bounds[:-1])
        marked[own] = 0
    return shared / (starts[a + 1] - starts[a] + starts[b + 1] - starts[b] - shared)


def links(texts: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """`a, b`: all pairs of ids of `texts` (`doc_id, id, low`; equal texts have one id) that are alike, the smaller first.

    `firsts` has `id, doc_id`, the record that each text is read from. Texts of
    likely pairs are brought together once for each neighbourhood (the least id
    that a pair's texts meet), not once for each pair.
    """
    spark = texts.sparkSession

    def meet(group: pa.Table) -> pa.Table:
        boxes = np.frombuffer(b"".join(group.column("boxes").to_pylist()), dtype=_KIND).reshape(group.num_rows, -1)
        a, b = likely(np.asarray(group.column("id")), np.asarray(group.column("n")), boxes, group.column("cls")[0].as_py(), group.column("part")[0].as_py(), threshold)
        return pa.table({"a": a, "b": b})

    def judge(pairs: pa.Table, held: pa.Table) -> pa.Table:
        text = dict(zip(held.column("id").to_pylist(), held.column("low").to_pylist()))
        pairs = pairs.sort_by("a")
        index = indices(np.asarray(pairs.column("a")), np.asarray(pairs.column("b")), list(text), list(text.values()))
        return pairs.select(["a", "b"]).filter(pa.array(index >= threshold))

    sketched = texts.select("id", "low").mapInArrow(lambda batches: sketch_batches(batches, threshold), SKETCHED)
    met = settle(sketched.groupBy("cls", "part").applyInArrow(meet, "a bigint, b bigint").distinct(), "met")
    del sketched
    tidy(spark)
    ways = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    placed = met.join(least.withColumnRenamed("least", "la"), "a").join(least.select(F.col("a").alias("b"), F.col("least").alias("lb")), "b")
    placed = settle(placed.select("a", "b", F.least("la", "lb").alias("place")), "places")
    # A place of many pairs is cut into blocks, so many of texts by so many.
    cuts = placed.groupBy("place").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / MOST)).cast("int").alias("cuts"))
    total = placed.count()
    cut = [F.pmod(F.xxhash64(c), F.col("cuts")) for c in ("a", "b")]
    lot = F.pmod(F.xxhash64("place", *cut), F.lit(total // LOT + 1))
    pairs = settle(placed.join(cuts, "place").select(lot.alias("lot"), "a", "b"), "pairs")
    tidy(spark)
    wanted = pairs.select("lot", F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = (F.broadcast(wanted) if total <= FEW else wanted).join(firsts, "id")
    held = texts.join(F.broadcast(wanted) if total <= FEW else wanted, ["id", "doc_id"]).select(F.col("lot").alias("at"), "id", "low")
    return settle(pairs.groupBy("lot").cogroup(held.groupBy("at")).applyInArrow(judge, "a bigint, b bigint"), "links")
