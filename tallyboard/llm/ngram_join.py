"""N-gram Jaccard join by a count-vector R-tree.

A document's set holds the hashes of its distinct word n-grams. Hashes fall into groups; the numbers
in each group are a point, and the sum of the smaller coordinates of two points bounds the overlap
of their sets. A larger set has more groups, a power of two; of two points the finer one is folded to
the other's groups. The join runs in these steps, all on Spark:

1. sketch: each text's set size, two 64-bit fingerprints and point, and how often each hash bucket
   occurs. Texts with equal size and fingerprints become one class, so exact copies are settled here.
2. cells: sets that reach the threshold share one of their rarest hashes (rare by bucket counts), so
   classes meet in the cells of these hashes. Cells with the same members become one meeting.
3. search: in a meeting, points are packed into an R-tree (nodes hold coordinate maxima and the range
   of sizes). A pair survives if its sizes allow the threshold and the summed minima do, first of point
   and node, then of both points.
4. verify: survivors' sets are compared exactly; links join components.

Survivors are mostly links. So the first round verifies only a spanning forest of each meeting's
survivors, best bounds first, between neighbours in the tree's leaves. Each later round looks at
meetings whose members are still in different components, and verifies the best survivors between any
two of these, `WIDEN` times as many as the round before. When no meeting has survivors left to name,
every pair has been linked, refuted or joined by other links: components are exact, and a group of
near copies costs about a link a document rather than all pairs.

A meeting of more than `block` members is dealt by its own count. In the first round its members go to
blocks; then rounds with one member per component and meeting gather the blocks' components for as
long as they halve their number. Only what is still apart then meets again in pairs of blocks, in
which every pair of members does. Meetings are read one at a time from sorted partitions, so a task holds the
points of at most two blocks, and Spark's sort spills what is larger.

Cases: a null, empty or blank text has an empty set, links with nothing and is its own component. A
text of fewer words than n has the whole sequence as its one n-gram. Repeated rows are copies; rows
without id count as the largest id. An empty table gives an empty result. Only id and text are read,
so other columns' names never clash. Texts are read whole, whatever their length: a task holds a few
texts, their words' hashes and the sets of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import discard, mix64, saved, slices, text_digest

WORDS, PERCENT = 5, 80
#: Groups of a small set's point, members per group of a larger one's, and most groups.
GROUPS, PER_GROUP, MOST_GROUPS = 256, 2, 8192
BUCKET_BITS = 16
#: Members of a meeting that one task searches together, and the blocks that this is cut into where each is searched alone.
BLOCK, CUTS = 1_024, 4
#: Children that one task compares with their parent set.
CHILDREN = 1_024
#: Points in a leaf and children of a node; cells up to TINY are searched without a tree.
LEAF, TINY = 16, 64
WIDEN = 64
#: Ids up to this many (8 bytes each) may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64) + np.uint64(1))
_BYTE[_BLANK] = 0


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, A-Z lower-cased."""
    data = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    starts_of_text = np.cumsum([0, *(len(d) + 1 for d in data)])
    blank = _BLANK[raw]
    first = np.nonzero(~blank & np.concatenate([[True], blank[:-1]]))[0]
    empty = np.zeros(0, dtype=np.uint64)
    if not len(first):
        return [empty] * len(texts)
    word_start = np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(raw)]])))
    inside = np.arange(len(raw), dtype=np.int64) - word_start
    longest = int(inside[~blank].max())
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _STEP)]))
    word = mix64(np.add.reduceat(_BYTE[raw] * power[np.minimum(inside, longest)], first))
    bounds = np.searchsorted(first, starts_of_text)
    grams = word[: max(0, len(word) - n + 1)].copy()
    for k in range(1, n):
        grams = grams * _STEP + word[k : k + len(grams)]
    grams = mix64(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                short = mix64(short * _STEP + word[i : i + 1])
            out.append(short)
        else:
            out.append(empty)
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    fp, check = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist()
    return fp, check


def groups_of(size: int) -> int:
    """Number of groups of a set's point, a power of two."""
    return min(MOST_GROUPS, max(GROUPS, 1 << (size // PER_GROUP).bit_length() - 1)) if size >= GROUPS * PER_GROUP else GROUPS


def point(s: np.ndarray) -> tuple[int, bytes]:
    """Unit and coordinates: a group's count, in units, rounded up to a byte."""
    groups = groups_of(len(s))
    counts = np.bincount(((s >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    unit = max(1, -(-int(counts.max()) // 255))
    return unit, (-(-counts // unit)).astype(np.uint8).tobytes()


def folded(data: bytes, unit: int, groups: int) -> np.ndarray:
    """Counts of a point in so many groups, at most as many as it has."""
    counts = np.frombuffer(data, dtype=np.uint8).astype(np.int32) * unit
    return counts.reshape(-1, groups).sum(axis=0)


def prefix_length(size: int, percent: int) -> int:
    """Rarest hashes of a set, one of which any set that reaches the threshold shares."""
    return size - -(-percent * size // 100) + 1


class CountTree:
    """R-tree over count vectors of one cell: packed leaves, nodes with maxima and ranges of sizes.

    Only pairs with a member of `own` count; those of other members belong to a finer tree. Where sides
    are given, only pairs of different sides count; a side's own pairs are searched elsewhere.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray, own: np.ndarray, percent: int, side: np.ndarray | None = None):
        self.points, self.sizes, self.component, self.own, self.percent, self.side = points, sizes, component, own, percent, side
        # tiles: large components apart, then by size, then by the two coordinates that vary most
        members = np.bincount(component)[component]
        apart = np.where(members > LEAF, component + 1, 0)
        spread = np.argsort(-points.var(axis=0), kind="stable")[:2]
        tiles = max(1, int(np.sqrt(len(sizes) / LEAF)))
        by_size = np.empty(len(sizes), dtype=np.int64)
        by_size[np.argsort(sizes, kind="stable")] = np.arange(len(sizes)) * tiles // len(sizes)
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], by_size, apart))
        self.levels = []
        high, low_n, high_n = points[self.order], sizes[self.order], sizes[self.order]
        same = component[self.order]
        while not self.levels or len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            least, most = np.minimum.reduceat(same, at), np.maximum.reduceat(same, at)
            same = np.where(least == most, least, -1)  # -1: members of several components
            self.levels.append((high, low_n, high_n, same))

    def survivors(self, query: np.ndarray, other: np.ndarray, high: np.ndarray, low_n: np.ndarray, high_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of (query, box) pairs that may reach the threshold, and their bounds."""
        n, t = self.sizes[query], self.percent
        fits = (100 * high_n[other] >= t * n) & (t * low_n[other] <= 100 * n)
        bound = np.zeros(len(query), dtype=np.int64)
        step = max(1, (1 << 22) // self.points.shape[1])
        at = np.nonzero(fits)[0]
        for i in range(0, len(at), step):
            part = at[i : i + step]
            bound[part] = np.minimum(self.points[query[part]], high[other[part]]).sum(axis=1, dtype=np.int64)
        least = np.maximum(low_n[other], -(-t * n // 100))
        return fits & ((100 + t) * bound >= t * (n + least)), bound

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(later, earlier, bound) of surviving pairs between components, by place in the tree's order."""
        everyone = np.arange(len(self.sizes))
        out = []
        step = max(16, (1 << 22) // len(everyone))
        for start in range(0, len(everyone), step):
            place = everyone[start : start + step]
            top = self.levels[-1]
            query, node = np.repeat(place, len(top[0])), np.tile(np.arange(len(top[0])), len(place))
            for depth in range(len(self.levels) - 1, -1, -1):
                high, low_n, high_n, same = self.levels[depth]
                ahead = node * LEAF ** (depth + 1) < query  # the node holds earlier places
                query, node = query[ahead], node[ahead]
                new = (same[node] == -1) | (same[node] != self.component[self.order[query]])
                query, node = query[new], node[new]
                keep, _ = self.survivors(self.order[query], node, high, low_n, high_n)
                query, node = query[keep], node[keep]
                below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
                query, node = np.repeat(query, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                query, node = query[node < below], node[node < below]
            ahead = node < query
            query, node = self.order[query[ahead]], self.order[node[ahead]]
            out.append(self.passing(query, node))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def passing(self, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of points between components whose bound allows the threshold, with the bound."""
        new = (self.component[query] != self.component[node]) & (self.own[query] | self.own[node])
        if self.side is not None:
            new &= self.side[query] != self.side[node]
        query, node = query[new], node[new]
        keep, bound = self.survivors(query, node, self.points, self.sizes, self.sizes)
        return query[keep], node[keep], bound[keep]

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Surviving pairs whose places in the tree differ by one leaf at most."""
        k = np.arange(len(self.sizes))
        query = np.concatenate([k[d:] for d in range(1, LEAF + 1)])
        node = np.concatenate([k[:-d] for d in range(1, LEAF + 1)])
        query, node = self.order[query], self.order[node]
        return self.passing(query, node)


def forest(query: np.ndarray, node: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """A spanning forest of the pairs, best bounds first, and whether it leaves any pair out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    picked = []
    for i in np.lexsort((node, query, -bound)).tolist():
        a, b = find(int(query[i])), find(int(node[i]))
        if a != b:
            root[a] = b
            picked.append(i)
    return query[picked], node[picked], len(picked) < len(query)


def best_between(query: np.ndarray, node: np.ndarray, bound: np.ndarray, component: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The `most` pairs of highest bound between any two components, and whether some pair has more."""
    x, y = np.minimum(component[query], component[node]), np.maximum(component[query], component[node])
    order = np.lexsort((node, query, -bound, y, x))
    query, node, x, y = query[order], node[order], x[order], y[order]
    places = np.arange(len(query))
    first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(query)]
    at = places - np.maximum.accumulate(np.where(first, places, 0)) if len(query) else places
    return query[at < most], node[at < most], bool((at >= most).any())


def search_cell(data: list[bytes], units: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of rows to verify in one meeting, and whether more are left. most 0 asks for the first round's forest.

    component: small numbers from 0; side: with it, only pairs of different sides.
    """
    groups = np.array([len(d) for d in data])
    found, more = [], False
    # sizes that allow the threshold have points at most so many times as fine
    finer = 1 << (-(-100 // percent) - 1).bit_length()
    for g in np.unique(groups):
        rows = np.nonzero((groups >= g) & (groups <= finer * g))[0]
        own = groups[rows] == g
        if len(rows) < 2 or not own.any():
            continue
        points = np.stack([folded(data[i], int(units[i]), int(g)) for i in rows])
        if points.max() < 256:
            points = points.astype(np.uint8)
        tree = CountTree(points, sizes[rows], component[rows], own, percent, None if side is None else side[rows])
        if len(rows) <= TINY:
            q, r, bound = tree.passing(*np.tril_indices(len(rows), -1))
        elif most == 0:
            q, r, bound = tree.near()
            more = True
        else:
            q, r, bound = tree.pairs()
        found.append((rows[q], rows[r], bound))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
    query, node, bound = (np.concatenate(x) for x in zip(*found, strict=True))
    q, r, rest = forest(query, node, bound) if most == 0 else best_between(query, node, bound, component, most)
    return q, r, more or rest


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows sorted by key (a long), cut so that each key's rows stand in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(key)[0].as_py() != keys[-1]):
            ready = [*held, *([batch.slice(0, cut)] if cut else [])]
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (doc_id, digest, size, fp, check, unit, point), and of each task a row per hash bucket (bucket, hits)."""
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "digest", "size", "fp", "check", "unit", "point", "bucket", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, kind = np.zeros(1 << BUCKET_BITS, dtype=np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type, batch.schema.field(2).type
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                whole = np.concatenate(sets)
                hits += np.bincount((whole >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(hits))
                points = [point(s) if len(s) else (None, None) for s in sets]
                prints = [fingerprint(s) if len(s) else (None, None) for s in sets]
                longs = [[len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], [p[0] for p in points]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(x, type=pa.int64()) for x in longs), pa.array([p[1] for p in points], type=pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int64())], names)
        at = np.nonzero(hits)[0]
        if k := len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind[0]), pa.nulls(k, kind[1]), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, pa.binary()), pa.array(at, type=pa.int32()), pa.array(hits[at], type=pa.int64())], names)

    schema = f"doc_id {id_type.simpleString()}, digest string, size long, fp long, check long, unit long, point binary, bucket int, hits long"
    return docs.mapInArrow(run, schema)


def _with_ids(classes: DataFrame) -> tuple[DataFrame, bool]:
    """classes with a long id, and whether any share a first fingerprint: then ids are this and numbers counted up from it."""
    if classes.groupBy("fp").count().filter("count > 1").isEmpty():
        return classes.withColumn("id", F.col("fp")), False
    w = Window.partitionBy("fp").orderBy("check", "size")
    return saved(classes.withColumn("id", F.col("fp").bitwiseXOR((F.row_number().over(w) - 1).cast("long"))), "classes"), True


def _cells(docs: DataFrame, hits: np.ndarray, n: int, percent: int) -> DataFrame:
    """(cell, fp): each task's different sets under their rarest hashes."""
    order = np.argsort(hits, kind="stable")
    rank = np.empty(len(hits), dtype=np.uint64)
    rank[order] = np.arange(len(hits), dtype=np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, low = sent.value, np.uint64(64 - BUCKET_BITS)
        below = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                cells, fps = [], []
                for s in shingle_sets(texts[a:b], n):
                    if not len(s) or (fp := fingerprint(s)) in seen:
                        continue
                    seen.add(fp)
                    key = (rank[(s >> low).astype(np.int64)] << low) | (s & below)
                    length = prefix_length(len(s), percent)
                    cells.append(np.partition(key, length - 1)[:length])
                    fps.append(np.full(length, fp[0], dtype=np.int64))
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(fps))], ["cell", "fp"])

    return docs.select("text").mapInArrow(run, "cell long, fp long")


def _meetings(cells: DataFrame) -> DataFrame:
    """(meeting, fp): the members of cells with two or more; cells with equal members are one meeting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "cell"):
            cell, fp = _numbers(table, "cell"), _numbers(table, "fp")
            new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])])
            cell, fp = cell[new], fp[new]
            first = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
            count = np.diff(np.append(first, len(cell)))
            name = mix64(np.add.reduceat(mix64(fp.astype(np.uint64)), first) + count.astype(np.uint64)).astype(np.int64)
            keep = np.repeat(count > 1, count)
            rows = np.unique(np.stack([np.repeat(name, count)[keep], fp[keep]], axis=1), axis=0)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in (0, 1)], ["meeting", "fp"])

    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "meeting long, fp long").distinct()


def _dealt(members: DataFrame, large: DataFrame, across: bool) -> DataFrame:
    """members (meeting, id, component) with part, where they are searched together, and side, their block in a pair of blocks.

    large: (meeting, blocks) of meetings that are dealt, to blocks or, across, to pairs of blocks.
    """
    blocks = F.col("blocks") if across else CUTS * F.col("blocks")
    rows = members.join(large, "meeting", "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    if across:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
        part = F.xxhash64("meeting", F.least("own", "other"), F.greatest("own", "other"))
        side = F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(-1)
    else:
        part, side = F.xxhash64("meeting", "own"), F.lit(-1)
    return rows.select(F.when(F.col("blocks").isNull(), F.col("meeting")).otherwise(part).alias("part"), F.coalesce(side, F.lit(-1)).cast("long").alias("side"), "meeting", "id", "component")


def _search(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b) to verify with a < b; rows with only a meeting name those that have more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "part"):
            part, side, meeting, node, size, unit, component = (_numbers(table, c) for c in ("part", "side", "meeting", "id", "size", "unit", "component"))
            data = table.column("point").to_pylist()
            first = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
            left, right, more = [], [], []
            for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True):
                own = component[a:b]
                if (own == own[0]).all():
                    continue
                q, r, rest = search_cell(data[a:b], unit[a:b], size[a:b], np.unique(own, return_inverse=True)[1], percent, most, side[a:b] if side[a] >= 0 else None)
                left.append(node[a:b][q])
                right.append(node[a:b][r])
                if rest:
                    more += np.unique(meeting[a:b]).tolist()
            x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (left, right))
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            columns = [pa.array(np.append(pairs[:, i], np.zeros(len(more), dtype=np.int64)), mask=np.arange(len(pairs) + len(more)) >= len(pairs)) for i in (0, 1)]
            names = pa.array(np.append(np.zeros(len(pairs), dtype=np.int64), np.array(more, dtype=np.int64)), mask=np.arange(len(pairs) + len(more)) < len(pairs))
            yield pa.RecordBatch.from_arrays([*columns, names], ["a", "b", "meeting"])

    return members.repartition("part").sortWithinPartitions("part", "id").mapInArrow(run, "a long, b long, meeting long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, linked) by the exact overlap of the sets.

    Sets are made from the texts of the classes' representatives and sent once to each parent a that
    they are compared with; a parent with many children is sent to several tasks.
    """
    parts = F.pmod(F.xxhash64("b"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("a")) / CHILDREN).cast("long"))
    children = saved(pairs.withColumn("part", parts), "pairs")
    parents = children.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"), F.lit(False).alias("child"))
    wanted = parents.unionByName(children.select("a", "part", F.col("b").alias("id"), F.lit(True).alias("child")))
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("a", "part", "child")).alias("at"))
    wanted = saved(wanted.join(classes.select("id", "fp", "check", "rep"), "id"), "wanted")
    few = wanted.count() <= MOST_BROADCAST and children.count() <= 4 * MOST_BROADCAST
    rows = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("id", "fp", "check", "text", F.col("at.a").alias("a"), F.col("at.part").alias("part"), F.col("at.child").alias("child"))
    names = ["a", "part", "child", "id", "hashes"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, check, texts, *at = (c.to_pylist() for c in batch.columns)
            for x, y in slices(texts):
                out = []
                for i, s in zip(range(x, y), shingle_sets(texts[x:y], n), strict=True):
                    # rows that share the representative's id but not its set are not meant
                    if len(s) and fingerprint(s) == (fp[i], check[i]):
                        data = s.tobytes()
                        out += [(a, p, c, node[i], data) for a, p, c in zip(*(v[i] for v in at), strict=True)]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b, linked = [], [], []
            for at, child, node, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                s = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if not child:
                    parent, own = at, s
                elif at == parent:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    a.append(at)
                    b.append(node)
                    linked.append(100 * common >= percent * (len(own) + len(s) - common))
                else:
                    raise ValueError("a parent set is missing")
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.array(linked, type=pa.bool_())], ["a", "b", "linked"])

    sets = rows.mapInArrow(make, "a long, part long, child boolean, id long, hashes binary")
    out = saved(sets.repartition("a", "part").sortWithinPartitions("a", "part", "child").mapInArrow(compare, "a long, b long, linked boolean"), "checked")
    discard(children, wanted)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b); a component is its smallest node.

    Each task joins the links it holds and names each node's root. Roots that share a node are linked
    in turn, and the components of these fewer links settle the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = list(root)
        for i in range(0, len(nodes), 1 << 16):
            part = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.int64()), pa.array([find(x) for x in part], type=pa.int64())], ["node", "root"])

    stars = saved(links.select("a", "b").mapInArrow(run, "node long, root long"), "stars")
    best = stars.groupBy("node").agg(F.min("root").alias("best"), F.max("root").alias("last"))
    split = best.filter("best < last").select("node", "best")
    roots = saved(stars.join(split, "node").filter("root > best").select(F.col("best").alias("a"), F.col("root").alias("b")).distinct(), "roots")
    if roots.isEmpty():
        out = saved(best.select("node", F.col("best").alias("component")), "components")
        discard(stars, roots)
        return out
    # a root stands for itself too, so its own star joins it to a smaller one elsewhere
    upper = components(roots)
    above = upper.withColumnRenamed("node", "best")
    out = saved(best.join(above, "best", "left").select("node", F.coalesce("component", "best").alias("component")), "components")
    discard(stars, roots, upper)
    return out


def _components_of(members: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(node, component) of the classes that have links, by rounds of search and verification."""
    points = classes.select("id", "size", "unit", "point")

    def too_large(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("meeting").count().filter(F.col("count") > block)
        return saved(counts.select("meeting", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "large")

    comp = saved(docs.sparkSession.createDataFrame([], "node long, component long"), "components")
    active, most, gather, apart, checked = members.withColumn("component", F.col("id")), 0, False, None, []
    large = none = too_large(active)
    dealt, looked_at = not large.isEmpty(), None
    while True:
        found = saved(_search(_dealt(active, large, across=most > 0).join(points, "id"), percent, most), "found")
        pairs = found.filter("a IS NOT NULL").select("a", "b")
        for old in checked:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        if not found.filter("a IS NOT NULL").isEmpty():
            checked.append(_verified(pairs, docs, classes, n, percent))
            if not checked[-1].filter("linked").isEmpty():
                old, comp = comp, components(reduce(DataFrame.union, checked).filter("linked"))
                discard(old)
        # meetings with more to name; blocks and representatives leave all that they looked at
        named = apart if gather else found.filter("meeting IS NOT NULL").select("meeting")
        named = named.unionByName(large.select("meeting")) if most == 0 and not gather else named
        where = members.join(comp, members["id"] == comp["node"], "left").select("meeting", "id", F.coalesce("component", "id").alias("component"))
        spread = where.join(named.distinct(), "meeting", "left_semi").groupBy("meeting").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        still = saved(spread.filter("low < high").select("meeting"), "apart")
        discard(found, *(x for x in (apart, large) if x is not None and x is not none))
        apart = still
        if apart.isEmpty():
            discard(apart, none, *checked)
            return comp
        active = where.join(apart, "meeting", "left_semi")
        gather = dealt and most == 0
        if gather:
            heads = active.groupBy("meeting", "component").agg(F.min("id").alias("id")).select("meeting", "id", "component")
            before, looked_at = looked_at, heads.count()
            gather = before is None or 2 * looked_at <= before
        if gather:
            active = heads
        else:
            most = max(1, most) * WIDEN
        large = too_large(active) if dealt else none


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and class_size (documents with its very set).

    Documents link when 100 * intersection >= percent * union of their n-gram sets; component_id is
    the smallest id reachable by links.
    """
    return _joined(docs, id_col, text_col, n, percent, block).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "class_size")


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """near_duplicates with each row's digest and whether it is its component's first (by id, then digest; null ids last)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_digest(F.col(text_col)).alias("digest"))
    sketch = saved(_sketch(docs, n), "sketch")
    counted = sketch.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("hits").alias("hits"))
    hits = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for row in counted.collect():  # a row per bucket, of which there are 65,536
        hits[row["bucket"]] = row["hits"]
    rows = sketch.filter("bucket IS NULL").select("doc_id", "digest", "size", "fp", "check", "unit", "point")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    shape = [F.any_value(c).alias(c) for c in ("unit", "point")]
    classes = saved(rows.filter("fp IS NOT NULL").groupBy("fp", "check", "size").agg(smallest["doc_id"].alias("rep"), smallest["digest"].alias("rep_digest"), F.count(F.lit(1)).alias("class_size"), *shape), "classes")
    written = [classes]
    classes, clash = _with_ids(classes)
    written += [classes] if clash else []
    members = _meetings(_cells(docs, hits, n, percent))
    if clash:
        # a meeting counts first fingerprints, so classes that share one also meet by themselves
        alike = classes.select(F.col("fp").alias("meeting"), "id").join(classes.groupBy(F.col("fp").alias("meeting")).count().filter("count > 1"), "meeting", "left_semi")
        members = members.join(classes.select("fp", "id"), "fp").select("meeting", "id").unionByName(alike)
    else:
        members = members.select("meeting", F.col("fp").alias("id"))
    members = saved(members, "members")
    comp = _components_of(members, docs, classes, n, percent, block)
    discard(members)
    labelled = classes.join(comp, classes["id"] == comp["node"], "left").select("fp", "check", "size", "rep", "rep_digest", "class_size", F.coalesce("component", "id").alias("component"))
    head = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_digest"))
    ids = labelled.groupBy("component").agg(head["rep"].alias("component_id"), head["rep_digest"].alias("component_digest"))
    by_class = labelled.join(ids, "component").select("fp", "check", "size", "class_size", "component_id", "component_digest")
    out = rows.select("doc_id", "digest", "size", "fp", "check").join(by_class, ["fp", "check", "size"], "left")
    first = F.col("fp").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("component_digest")))
    own = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = saved(out.select("doc_id", "digest", F.col("size").alias("n_shingles"), own.alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), first.alias("first")), "joined")
    discard(sketch, comp, *written)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, that of its smallest id (then digest; null ids last); all columns as they were.

    Rows are told apart by id and text. Of rows that repeat both exactly one stays; texts without words all stay.
    """
    found = _joined(docs, id_col, text_col, **options)
    digest = text_digest(docs[text_col])

    def pairs(which: str) -> tuple[DataFrame, Column]:
        rows = found.filter(which).groupBy("doc_id", "digest").count().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "count")
        return rows, docs[id_col].eqNullSafe(rows["_id"]) & (digest == rows["_digest"])

    gone, same = pairs("NOT first")
    left = docs.join(gone, same, "left_anti")
    kept, same = pairs("first AND n_shingles > 0")
    twice = kept.filter("count > 1")
    if twice.isEmpty():
        return left
    mark = "_" + "_".join(docs.columns)
    once = left.join(twice, same, "left_semi").withColumn(mark, digest).dropDuplicates([id_col, mark]).drop(mark)
    return left.join(twice, same, "left_anti").union(once)
