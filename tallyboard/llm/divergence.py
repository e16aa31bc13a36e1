"""Source divergence audit: how far the word shares of each language's sources lie apart, and by which terms.

Terms are runs of ASCII letters and of all code points beyond ASCII, A-Z lower-cased. A language keeps the
terms that LEAST_DOCS of its documents have. With V kept terms, a group (language, source) with N occurrences
of them gives a term that it has c times the share p = 1 + floor(SCALE * (c + PRIOR) / (N + PRIOR * V));
a language as a whole does so too. Two sources' divergence is the sum of |p - q| over the kept terms.

Each kept term has a column of counts, one for each source that has it. Terms with the same sparse column
add the same to every pair of sources, so the columns are made distinct with their multiplicity; each pair
of sources is evaluated once for a distinct column, multiplied and summed. Columns are dealt out in blocks of
about BLOCK, so a language with most of the terms is many tasks; a block gives one partial sum for a pair.
The terms that a source has more of than its language are ranked as they are, term by term.

All arithmetic is in whole numbers. A column is as long as the language has sources at most, and the result
has a row for each ordered pair of a language's sources, so sources should be thousands at most, terms may be
any number.

Cases: null text, language and source count as ''. Repeated rows are documents of their own. An empty table
gives an empty result; a group without terms, or a language that keeps none, has its pairs all the same (value
0 if the language keeps none). Equal values are ranked by the item's bytes. A very long text is one list of
words in a worker. Columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import discard, saved

#: Documents of its language that a kept term is in.
LEAST_DOCS = 30
PRIOR, SCALE = 5, 1_000_000_000
#: Terms reported for each group.
MOST_TERMS = 50
#: Distinct columns of a block, and shares that are in memory at once there.
BLOCK, CELLS = 1 << 10, 1 << 21
#: Languages up to this many (a name and a number each) may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000
#: Counts that a task gathers before it passes them on.
GATHER = 1 << 18

#: Each byte of a term as it is, A-Z lower-cased, and a space for every other one.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): partial sums of tasks, to be summed up."""

    def rows(gathered: dict) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, docs_of) in gathered.items():
            size = len(n)
            if size:
                columns = [pa.array([a] * size, pa.string()), pa.array([b] * size, pa.string()), pa.array(list(n), pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs_of[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = t.as_py().translate(_TERM_BYTES).split()
                n, docs_of = gathered.setdefault((a, b), (Counter(), Counter()))
                n.update(words)
                docs_of.update(set(words))
            if sum(len(n) for n, _ in gathered.values()) > GATHER:
                yield from rows(gathered)
                gathered = {}
        yield from rows(gathered)

    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang, source)), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"))
    found = own.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "_text").mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def columns_of(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term and its column (source and n, by source) of each kept term."""
    # dealt by term alone, so that sums over sources and the column need no second exchange
    dealt = counts.repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    column = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column")
    return summed.groupBy("lang", "term").agg(column, F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (size + PRIOR * terms)), exact for any long."""
    wide = "decimal(28,0)"
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast(wide)
    return F.call_function("div", whole, (size + PRIOR * terms).cast(wide)) + 1


def _shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same for arrays: long division by 1000 three times keeps each step within 64 bits."""
    rest, out = counts + PRIOR, np.zeros(len(counts), dtype=np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the block's columns of |p - q| for each pair of the language's sources."""
    right = right.sort_by("source")
    names, terms = right["source"].combine_chunks(), right["terms"][0].as_py()
    below = right["size"].to_numpy() + PRIOR * terms
    n_sources = len(names)
    sums = np.zeros((n_sources, n_sources), dtype=np.int64)
    step = max(1, CELLS // n_sources)
    for start in range(0, len(left), step):
        part = left.slice(start, step)
        column = part["column"].combine_chunks()
        entry, times = column.flatten(), part["times"].to_numpy()
        at = pc.index_in(entry.field("source"), value_set=names).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(part)), pc.list_value_length(column).to_numpy())
        shares = np.tile(_shares(np.zeros(n_sources, dtype=np.int64), below), (len(part), 1))
        shares[row, at] = _shares(entry.field("n").to_numpy(), below[at])
        for i in range(n_sources - 1):
            sums[i, i + 1 :] += times @ np.abs(shares[:, i + 1 :] - shares[:, i : i + 1])
    a, b = np.triu_indices(n_sources, 1)
    return pa.table({"lang": pa.array([right["lang"][0].as_py()] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(sums[a, b], pa.int64())})


def pair_values(columns: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, a, b (a < b) and value for each pair of sources of a language.

    columns: lang, column, times (distinct). groups: lang, source, size, terms.
    """
    blocks = columns.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # else a language with most of the columns would be one task of the join
    blocks = F.broadcast(blocks) if blocks.count() <= MOST_BROADCAST else blocks
    dealt = columns.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("column"), F.col("blocks")).cast("int"))
    known = groups.join(blocks, "lang", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    sums = dealt.select("lang", "block", "column", "times").groupBy("lang", "block").cogroup(known.select("lang", "block", "source", "size", "terms").groupBy("lang", "block"))
    return sums.applyInArrow(_block_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, most: int = MOST_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: item is each other source of the language, value the divergence. Part `term`: item is a kept
    term of the group whose share there is above the language's, value the difference; the first `most` ranks.
    """
    terms = saved(columns_of(count_terms(docs, text, lang, source), least), "term-columns")
    entries = terms.select("lang", "term", F.aggregate("column", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("whole"), F.inline("column"))
    there = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    groups = there.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = saved(groups.select("lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("terms", zero).alias("terms")), "source-sizes")
    columns = saved(terms.groupBy("lang", "column").agg(F.count("*").alias("times")), "distinct-columns")

    pairs = pair_values(columns, groups, block)
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", sides, "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    whole = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"))
    above = entries.join(groups.join(whole, "lang"), ["lang", "source"])
    gain = share(F.col("n"), F.col("size"), F.col("terms")) - share(F.col("whole"), F.col("lang_size"), F.col("terms"))
    above = above.select("lang", "source", F.col("term").alias("item"), gain.alias("value")).filter("value > 0")
    above = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= most)
    out = saved(pairs.unionByName(above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")), "divergence")
    discard(terms, groups, columns)
    return out
