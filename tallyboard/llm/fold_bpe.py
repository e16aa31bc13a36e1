"""Byte-level BPE by ranks, encoding and decoding with Spark's higher-order functions.

The vocabulary is a literal rank map: an array of small maps from a piece's bytes (as hexadecimal digits)
to its rank, the place in the array being the CRC of the bytes; a bitmap keeps most ranges without a rank away
from it. A word starts as its byte array, `<74><68><65>`. Its ranked merges are the ranks of all
its byte ranges that are in the map, ascending; a fold over them replaces the two pieces that make up the
token by the token, `<74><=258>`. `read_ranks` finds these two pieces for each token and proves that they are
the only ones the token can come from, and so that no merge makes a pair of a rank that has been passed.

Distinct words are counted over the whole corpus; the frequent ones, at most DISTINCT of at most MOST_BYTES
bytes each, are folded and decoded once and become a dictionary, word -> ids, of bounded size, that has only
words which their ids decode to. It is broadcast; a worker cuts a text into words and puts in the ids of those
that the dictionary has. The other words come back with the runs between them and are folded where they stand,
so nothing is shuffled but the counts, and no result depends on the dictionary. Decoding looks up each id's
binary piece and concatenates them. The rank map is a one-row table that a scalar subquery brings to the
expressions as one block of bytes: as a plain literal of so many entries it would be copied object by object
into plans and tasks.

Cases: a null text is encoded as an empty one (no ids; the digests are those of no bytes). Special
tokens are not known. Repeated rows give repeated results; an empty table gives an empty one; columns
other than id and text are not read. A text's words are held in memory together, about 200 bytes for
each; a single word costs its length times the number of its different ranks. Letters and numbers are
those of the Java runtime's Unicode version.
"""

from __future__ import annotations

import base64
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import discard, saved, slices

#: Words of the literal dictionary, and bytes of the longest one.
DISTINCT = 1 << 19
MOST_BYTES = 48
#: Rank maps; a map is searched from end to end, so each has a few entries.
RANK_MAPS = 1 << 14
#: Places of the bitmap.
PLACES = 1 << 18
#: Bytes of the longest token that a vocabulary may have.
MOST_TOKEN = 128


def read_ranks(vocabulary: str) -> dict[bytes, tuple[int, tuple[bytes, ...]]]:
    """Rank and the two pieces (of a single byte: none) of each token of a .tiktoken file on the driver.

    Raises ValueError where a byte has no rank, or where the merges of lower ranks do not leave a token's
    bytes in two pieces. Where they do, a token's bytes in any word whose borders the merges have kept are in
    just these two pieces when its turn comes; so no later merge can make up a token of lower rank.
    """
    ranks = {}
    with open(vocabulary, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                ranks[base64.b64decode(piece)] = int(rank)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs a rank")
    if max(map(len, ranks)) > MOST_TOKEN:
        raise ValueError(f"tokens must not be longer than {MOST_TOKEN} bytes")
    out: dict[bytes, tuple[int, tuple[bytes, ...]]] = {}
    for token, rank in ranks.items():
        pieces = () if len(token) == 1 else tuple(merged(token, ranks, rank - 1))
        if len(pieces) not in (0, 2):
            raise ValueError(f"{token!r} is not reached by merges in the order of ranks")
        out[token] = rank, pieces
    return out


def merged(word: bytes, ranks: dict[bytes, int], most: int) -> list[bytes]:
    """Pieces of a token's bytes after all merges of ranks up to most; for the check of a vocabulary."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 2:
        rank, at = min((ranks.get(pieces[i] + pieces[i + 1], math.inf), i) for i in range(len(pieces) - 1))
        if rank > most:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


def java_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, which Java's \\s does not mean, and its endings tried at a ' only."""
    pattern = pattern.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:s|t|re|ve|m|ll|d)|")
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Type of a vocabulary's row: rank maps; by rank the two pieces, the token and its bytes; bitmap.
TABLES = "struct<ranks:array<map<string,int>>,pairs:array<string>,made:array<string>,pieces:array<binary>,there:array<boolean>>"


def rank_tables(spark: SparkSession, vocabulary: str) -> DataFrame:
    """One row, `tables`: what a RankFold needs of a .tiktoken file on the driver."""
    tokens = read_ranks(vocabulary)
    most = max(rank for rank, _ in tokens.values()) + 1
    maps: list[dict[str, int]] = [{} for _ in range(RANK_MAPS)]
    pieces: list[str | None] = [None] * most
    pairs = ["-"] * most  # of single bytes and unused ranks: occurs in no word
    there = [False] * PLACES
    for piece, (rank, two) in tokens.items():
        maps[zlib.crc32(piece) % RANK_MAPS][piece.hex().upper()] = rank
        pieces[rank] = base64.b64encode(piece).decode()
        if two:
            there[zlib.crc32(piece) % PLACES] = True
            pairs[rank] = "".join(f"<{p.hex().upper()}>" if len(p) == 1 else f"<={tokens[p][0]}>" for p in two)
    spec = {"ranks": maps, "pairs": pairs, "made": [f"<={rank}>" for rank in range(most)], "pieces": pieces, "there": there}
    return spark.range(1).select(F.from_json(F.lit(json.dumps(spec)), TABLES).alias("tables"))


class RankFold:
    """Expressions that encode and decode words by a row of TABLES."""

    def __init__(self, tables: Column):
        self.ranks, self.pairs, self.made, self.pieces, self.there = (tables[k] for k in ("ranks", "pairs", "made", "pieces", "there"))

    def rank(self, piece: Column) -> Column:
        """Rank of a binary piece, null where it has none."""
        return F.try_element_at(F.get(self.ranks, (F.crc32(piece) % RANK_MAPS).cast("int")), F.hex(piece))

    def ranked_merges(self, data: Column, size: Column) -> Column:
        """Ascending ranks of all ranges of two and more bytes that are tokens."""

        def at(start: Column) -> Column:
            ranges = F.transform(F.sequence(F.lit(2), F.least(size - start, F.lit(MOST_TOKEN))), lambda n: F.substring(data, start + 1, n))
            likely = F.filter(ranges, lambda x: F.get(self.there, (F.crc32(x) % PLACES).cast("int")))
            # a merge that has no place in the word does nothing, so rank 0 may stand for none
            return F.transform(likely, lambda x: F.coalesce(self.rank(x), F.lit(0)))

        return F.sort_array(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), size - 2), at))))

    def ids(self, word: Column) -> Column:
        """Decimal ids of a word, joined by commas."""
        data = word.cast("binary")
        start = F.regexp_replace(F.hex(data), F.lit("(..)"), F.lit("<$1>"))
        left = F.aggregate(self.ranked_merges(data, F.octet_length(word)), start, lambda s, r: F.replace(s, F.get(self.pairs, r), F.get(self.made, r)))
        pieces = F.split(F.btrim(left, F.lit("<>")), "><")
        folded = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("="), F.substring(p, 2, 10)).otherwise(self.rank(F.unhex(p)).cast("string"))), ",")
        return F.when(word == "", F.lit("")).otherwise(F.coalesce(self.rank(data).cast("string"), folded))

    def decoded(self, ids: Column) -> Column:
        """Bytes of ids: their pieces one after another. An id without a piece adds nothing."""
        # the strings are only carriers of bytes here: joining them copies the bytes as they are
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i).cast("string")), "").cast("binary")

    def part(self, word: Column) -> Column:
        """struct<ids: decimal ids joined by commas, back: decoded bytes as a string>."""
        return _let(self.ids(word), lambda ids: F.struct(ids.alias("ids"), self.decoded(F.split(ids, ",").cast("array<int>")).cast("string").alias("back")))


def frequent_words(docs: DataFrame, pattern: str, text_col: str, most: int = DISTINCT) -> DataFrame:
    """A saved table of at most `most` words that occur twice or more, no longer than MOST_BYTES: those that save most.

    All words are counted. A fold looks at all ranges of a word, so a word saves its count times its bytes squared; the
    least saving is a step of a scale of eighths of powers of two, so no sort is needed.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(java_pattern(pattern)), F.lit(0))).alias("word"))
    counts = saved(words.filter(F.octet_length("word") <= MOST_BYTES).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"), "word-counts")
    saving = F.col("n") * F.pow(F.octet_length("word") + 1.0, 2)
    step = F.floor(F.log2(saving) * 8).cast("int")
    sizes = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        if (total := total + n) > most:
            break
        least = at
    found = saved(counts.filter(F.lit(False) if least is None else step >= least).select("word", saving.alias("saving")), "frequent-words")
    discard(counts)
    return found


def dictionary(tables: DataFrame, words: DataFrame) -> bytes:
    """(word, ids) of a bounded number of words, each folded once and decoded, as an Arrow stream."""
    parts = words.select("word", tables.scalar().alias("_tables")).select("word", _let(F.col("_tables"), lambda t: RankFold(t).part(F.col("word"))).alias("part"))
    found = parts.filter(F.col("part.back") == F.col("word")).select("word", F.col("part.ids").alias("ids")).toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as stream:
        stream.write_table(found)
    return out.getvalue().to_pybytes()


#: The dictionary that a worker has read, by its broadcast's name.
_read: dict[str, dict[str, str]] = {}


def _known(name: str, sent: Broadcast) -> dict[str, str]:
    if name not in _read:
        _read.clear()
        table = pa.ipc.open_stream(sent.value).read_all()
        _read[name] = dict(zip(table["word"].to_pylist(), table["ids"].to_pylist(), strict=True))
    return _read[name]


def _looked_up(docs: DataFrame, words: bytes, pattern: str) -> DataFrame:
    """_id, rare (words that the dictionary lacks), and of the runs between them ids and back (null where empty), one more."""
    sent, name = docs.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = _known(name, sent).get, regex.compile(pattern).findall
        strings = pa.list_(pa.string())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                rare, ids, back = [], [], []
                for text in texts[a:b]:
                    own = cut(text or "")
                    found = [*map(known, own)]
                    at = [i for i, x in enumerate(found) if x is None]
                    runs = [*zip([0, *(i + 1 for i in at)], [*at, len(own)], strict=True)]
                    rare.append([own[i] for i in at])
                    ids.append([",".join(found[i:j]) if i < j else None for i, j in runs])
                    back.append(["".join(own[i:j]) if i < j else None for i, j in runs])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, strings) for x in (rare, ids, back))], ["_id", "rare", "ids", "back"])

    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, rare array<string>, ids array<string>, back array<string>"
    return docs.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), most: int = DISTINCT) -> DataFrame:
    """One row per document: its id and the chosen outputs.

    vocabulary: path of a .tiktoken file on the driver. pattern: regular expression that cuts a text into words,
    each encoded by itself. outputs: n_tokens long, ids array<int>, decoded binary, ids_sha256 (of decimal ids joined
    by commas) and decoded_sha256 (of the decoded bytes), lowercase hex. most: words of the dictionary.
    """
    tables = saved(rank_tables(docs.sparkSession, vocabulary), "ranks")
    words = frequent_words(docs, pattern, text_col, most)
    known = dictionary(tables, words)
    discard(words)

    def parts(t: Column) -> Column:
        def joined(rare: Column) -> Column:
            def between(runs: str, name: str, sign: str) -> Column:
                return F.array_join(F.flatten(F.zip_with(runs, rare, lambda r, x: F.array(r, x[name]))), sign)

            return F.struct(between("ids", "ids", ",").alias("ids"), between("back", "back", "").alias("back"))

        return _let(F.transform("rare", RankFold(t).part), joined)

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = _looked_up(texts, known, pattern).withColumn("_tables", tables.scalar())
    rows = found.select(F.col("_id").alias(id_col), _let(F.col("_tables"), parts).alias("_parts"))
    ids, back = F.col("_parts")["ids"], F.col("_parts")["back"].cast("binary")
    made = {
        "n_tokens": F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(","), F.lit(""))) + 1).cast("long"),
        "ids": F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, ",").cast("array<int>")),
        "decoded": back,
        "ids_sha256": F.sha2(ids.cast("binary"), 256),
        "decoded_sha256": F.sha2(back, 256),
    }
    return rows.select(id_col, *(made[k].alias(k) for k in outputs))


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column `decoded` (binary): the bytes of the ids in ids_col; null ids give null."""
    tables = saved(rank_tables(rows.sparkSession, vocabulary), "ranks")
    decoded = _let(F.col("_tables"), lambda t: RankFold(t).decoded(F.col(ids_col)))
    return rows.withColumn("_tables", tables.scalar()).withColumn("decoded", decoded).drop("_tables")
