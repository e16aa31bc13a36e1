"""One large JSON document read by many tasks: the objects of an array that stands under a key of the document.

Text up to each closing brace is a record, so Spark cuts the file into splits by bytes. A split does not know
whether it begins inside a string or how deep; so a first pass reports, for either start, where it ends - the
number of quotes and the change of depth - and putting these together in the file's order gives each split its
start. A second pass cuts the objects: an object of an array under a key ends where a brace brings the depth
back to two. What a split's first object began before it, and what its last one goes on after it, are put
together from at most two texts of each split.

The document may also lie in several files of a folder, one after the other by name, so that many tasks can write it; each
file but the last has to end with a closing brace.

The driver sees a few numbers and two partial objects of each split, never the objects themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.sources import scratch

#: Bytes of a split; of a document that would have more than MOST_SPLITS the splits are larger.
SPLIT = 32 << 20
MOST_SPLITS = 2_048
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*$', re.S)
_EMPTY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*\]', re.S)
_ESCAPE = re.compile(r"\\.", re.S)


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _ends(text: str, inside: bool) -> tuple[bool, int]:
    """Whether the text ends inside a string, and its change of depth, if it begins inside one or not."""
    parts = _ESCAPE.sub("", text).split('"')
    return inside ^ (len(parts) % 2 == 0), sum(map(_depth, parts[int(inside) :: 2]))


def _object_start(text: str, inside: bool, depth: int) -> int:
    """Place of the brace that opens an object at depth two; -1 if there is none."""
    i = 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            if c == "{" and depth == 2:
                return i
            depth += 1
        elif c in "}]":
            depth -= 1
        i += 1
    return -1


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the document's files in its order."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    return sorted((r["path"].rsplit("/", 1)[-1], r["length"]) for r in found)


def _fragments(spark: SparkSession, path: str, files: list[tuple[str, int]]) -> DataFrame:
    """(block, value): texts up to each closing brace, with the place of their split in the whole document."""
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("block"), "value")
    if len(files) < 2:
        return rows.select("block", "value")
    starts = accumulate((length for _, length in files), initial=0)
    known = spark.createDataFrame([(name, at) for (name, _), at in zip(files, starts, strict=False)], "_name string, _at long")
    return rows.join(F.broadcast(known), "_name").select((F.col("_at") + F.col("block")).alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield block, value + "}"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: of either start, whether it ends inside a string and the change of depth."""
    found: dict[int, list] = {}
    for block, text in _by_block(batches):
        ends = found.setdefault(block, [(False, 0), (True, 0)])
        for k, (inside, depth) in enumerate(ends):
            inside, more = _ends(text, inside)
            ends[k] = inside, depth + more
    if found:
        rows = [(block, *outside, *inside) for block, (outside, inside) in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "in0", "d0", "in1", "d1"), r, strict=True)) for r in rows], pa.schema([("block", pa.int64()), ("in0", pa.bool_()), ("d0", pa.int64()), ("in1", pa.bool_()), ("d1", pa.int64())]))


_PIECES = "block long, n int, kind string, text string"


def _cutter(starts: dict[int, tuple[bool, int]]):
    """Pieces of each split: `object` with its number, `change` of the array's key before it, key of an `empty` array, `head` and `tail`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n, inside, depth, first = None, [], 0, False, 0, True
        out: list[tuple[int, int, str, str]] = []

        def whole(text: str, at: int) -> None:
            nonlocal n
            lead = text[:at]
            if lead.strip() != ",":
                key = _KEY.search(lead)
                out.extend((block, n, "empty", e) for e in _EMPTY.findall(lead))
                out.append((block, n, "change", key[1] if key else ""))
            out.append((block, n, "object", text[at:]))
            n += 1

        for b, text in _by_block(batches):
            if b != block:
                if held:
                    out.append((block, n, "tail", "".join(held)))
                block, held, n, first = b, [], 0, True
                inside, depth = starts[b]
                began = (inside, depth)
            if not held:
                began = (inside, depth)
            held.append(text)
            inside, more = _ends(text, inside)
            depth += more
            if not inside and depth == 2:
                joined = "".join(held)
                if first:
                    out.append((block, 0, "head", joined))
                else:
                    whole(joined, _object_start(joined, *began))
                held, first = [], False
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if held:
            out.append((block, n, "tail", "".join(held)))
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["block", "n", "kind", "text"])


def array_objects(spark: SparkSession, path: str, key: str, split: int = SPLIT) -> DataFrame:
    """(pos, text): the objects of the array under `key` of the document at path, in order. ValueError if it has no such array."""
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    files = _files(spark, path)
    spark.conf.set(conf, str(max(split, sum(length for _, length in files) // MOST_SPLITS)))
    try:
        rows = _fragments(spark, path, files)
        ends = sorted(tuple(r) for r in rows.mapInArrow(_summaries, "block long, in0 boolean, d0 long, in1 boolean, d1 long").collect())
        starts, inside, depth = {}, False, 0
        for block, in0, d0, in1, d1 in ends:
            starts[block] = inside, depth
            inside, depth = (in1, depth + d1) if inside else (in0, depth + d0)
        pieces = scratch.kept(rows.mapInArrow(_cutter(starts), _PIECES), "pieces")
    finally:
        spark.conf.set(conf, before)
    # partial objects of neighbouring splits make whole ones; keys and numbers go on from split to split
    partial: dict[int, dict[str, str]] = {block: {} for block in starts}
    for r in pieces.filter("kind IN ('head', 'tail')").collect():
        partial[r["block"]][r["kind"]] = r["text"]
    counts = {r["block"]: r["n"] for r in pieces.filter("kind = 'object'").groupBy("block").agg(F.count("*").alias("n")).collect()}
    last = {r["block"]: r["text"] for r in pieces.filter("kind = 'change'").groupBy("block").agg(F.max_by("text", "n").alias("text")).collect()}
    open_text, open_at, now, total = "", (False, 0), None, 0
    there = not pieces.filter((F.col("kind") == "empty") & (F.col("text") == key)).isEmpty()
    spans, stitched = [], []
    for block in sorted(starts):
        if not open_text:
            open_at = starts[block]  # of a head that nothing came before
        if "head" in partial[block]:
            text = open_text + partial[block]["head"]
            at = _object_start(text, *open_at)
            lead = text[:at]
            if lead.strip() != ",":
                found = _KEY.search(lead)
                now = found[1] if found else ""
                there |= key in _EMPTY.findall(lead)
            if now == key:
                stitched.append((total, text[at:]))
                total += 1
            open_text = ""
        spans.append((block, now or "", total))
        there |= now == key
        changes = [r for r in pieces.filter(F.col("kind") == "change").filter(F.col("block") == block).orderBy("n").collect()] if block in last else []
        at, own = 0, 0
        for r in changes:
            own += (r["n"] - at) if now == key else 0
            at, now = r["n"], r["text"]
            there |= now == key
        own += (counts.get(block, 0) - at) if now == key else 0
        total += own
        if "tail" in partial[block]:
            if not open_text:
                # it begins after an object, or with the split if no object ended in that
                open_at = (False, 2) if "head" in partial[block] else starts[block]
            open_text += partial[block]["tail"]
    there |= key in _EMPTY.findall(open_text)
    if not there:
        raise ValueError(f"the document has no array under {key!r}")
    return _placed(spark, pieces, spans, stitched, key)


def _placed(spark: SparkSession, pieces: DataFrame, spans: list[tuple[int, str, int]], stitched: list[tuple[int, str]], key: str) -> DataFrame:
    """The key's objects with their place: a split's first place, and within it the number among the key's own objects."""
    known = spark.createDataFrame(spans, "block long, start_key string, first long")
    order = Window.partitionBy("block").orderBy("n", "kind")
    marked = pieces.filter("kind IN ('object', 'change')").withColumn("_key", F.last(F.when(F.col("kind") == "change", F.col("text")), ignorenulls=True).over(order))
    own = marked.filter("kind = 'object'").join(known, "block").filter(F.coalesce("_key", "start_key") == key)
    placed = own.withColumn("pos", F.col("first") + F.row_number().over(Window.partitionBy("block").orderBy("n")) - 1).select("pos", "text")
    return placed.unionByName(spark.createDataFrame(stitched, "pos long, text string")) if stitched else placed
