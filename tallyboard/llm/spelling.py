"""Spelling variant grouping: words at one error from each other, found with forward and backward automata.

Two words at one inserted, deleted or replaced code point agree in the first or in the second half of the
shorter one's length l (h = l // 2). So each word is dealt to at most four groups, by l (its own length and
one less) and by the half that is taken as exact. The words of a group's block go into minimal acyclic
automata, forward if their first half is exact and of the reversed words if it is the second; each state
knows how many words lead on from it, so a path adds up to the word's number in sorted order (a perfect
hash). A search walks the exact half, then completes the word with one error, for a whole block at a time.

A pair whose common prefix has p code points belongs to the half that holds place p, and is kept only
there: nothing is found twice. A group of more than GROUP words is not searched but halved again around the
places where the error may be: what lies outside becomes part of the key. At a single place left a group has
no more words than the alphabet of 126 letters allows, so no group grows with the vocabulary.

A word's form is its near word of largest n, if that is RATIO times its own n or more; n grows along forms,
so a chain has at most log(n) steps and is followed by doubling.

Cases: a null text has no runs; a null id counts as '' where an id is hashed. Ties between near words go to
the smaller one in code-point order. Repeated rows count again. An empty table gives an empty result. A run
of any length is one word; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import discard, mix64, saved

#: Runs of the Latin letters that are read; one code point of each EVERYth by hash is dropped.
RUN, EVERY = r"[A-Za-zÀ-ÿ]", 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a group that is searched as it is. More than 126 * 127, the most that differ at one place.
GROUP = 1 << 14
#: Rows and code points of a block that a worker searches at once.
BLOCK, BLOCK_CHARS = 1 << 15, 1 << 23
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of LEAST_LENGTH code points that occur LEAST_COUNT times, after the hashed deletions."""
    # greedy: where a run is long enough its match is the whole run
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("run"))
    runs = runs.select("_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")).alias("hash"))
    at = (F.col("hash") % F.length("run")).cast("int")
    word = F.when(F.col("hash") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: its error among the first or the second half of the places first..last-1, with the key of what is exact."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    halves = F.inline(F.array(F.struct(F.col("first").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("last").alias("b"))))
    out = rows.select("word", "n", "base", halves).withColumnsRenamed({"a": "first", "b": "last"})
    exact = F.xxhash64("base", "first", "last", F.substring("word", F.lit(1), F.col("first")), F.right("word", F.col("base") - F.col("last")))
    return out.withColumn("key", exact)


class Automaton:
    """Minimal acyclic automaton of sorted, distinct words of one length (rows of bytes), a layer for each place."""

    def __init__(self, words: np.ndarray):
        n, length = words.shape
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [()] * length
        differ = words[1:] != words[:-1]
        # place at which each word first differs from the one before
        split = np.concatenate([[-1], differ.argmax(axis=1)]) if n > 1 else np.array([-1])
        below, state, accepted = np.arange(n), np.zeros(n, dtype=np.int64), np.ones(1, dtype=np.int64)
        for d in range(length - 1, -1, -1):
            # the prefixes of d places, in order; each has a run of transitions to the prefixes of d + 1 places
            here = np.nonzero(split < d)[0]
            start = np.searchsorted(below, here)
            size = np.diff(np.append(start, len(below)))
            letter = words[below, d].astype(np.int64)
            rows = state << 8 | letter
            sign = np.add.reduceat(mix64(rows.astype(np.uint64) + np.uint64(1)), start)
            _, chosen, own = np.unique(sign, return_index=True, return_inverse=True)
            if not self._same(rows, start, size, chosen[own]):
                chosen = own = np.arange(len(here))
            at = np.repeat(start[chosen] - np.concatenate([[0], np.cumsum(size[chosen])[:-1]]), size[chosen]) + np.arange(size[chosen].sum())
            first = np.concatenate([[0], np.cumsum(size[chosen])])
            reach = accepted[state[at]]
            before = np.cumsum(reach) - reach
            before -= np.repeat(before[first[:-1]], size[chosen])
            keys = np.repeat(np.arange(len(chosen)), size[chosen]) << 8 | letter[at]
            self.layers[d] = first, keys, state[at], before
            accepted = np.add.reduceat(reach, first[:-1])
            below, state = here, own

    @staticmethod
    def _same(rows: np.ndarray, start: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
        """Whether each prefix has the transitions of the one it is merged with."""
        if (size != size[like]).any():
            return False
        inside = np.arange(len(rows)) - np.repeat(start, size)
        return bool((rows == rows[np.repeat(start[like], size) + inside]).all())

    def step(self, d: int, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the states at place d go on by their letter; to which state, and past how many words."""
        _, keys, target, before = self.layers[d]
        asked = state << 8 | letter
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        on = np.nonzero(keys[at] == asked)[0]
        return on, target[at[on]], before[at[on]]

    def others(self, d: int, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All transitions of the states at place d by other letters: index of the state, target, words passed."""
        first, keys, target, before = self.layers[d]
        size = first[state + 1] - first[state]
        whose = np.repeat(np.arange(len(state)), size)
        at = np.repeat(first[state] - (np.cumsum(size) - size), size) + np.arange(len(whose))
        on = (keys[at] & 0xFF) != letter[whose]
        return whose[on], target[at[on]], before[at[on]]


def with_one_error(automaton: Automaton, length: int, words: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of words, number in the automaton) of all its words at one error from `exact` places on.

    length: of the automaton's words, that of words (a replaced letter) or one more (an inserted letter).
    """
    n, own = words.shape
    longer = length - own
    words = words.astype(np.int64)
    nothing = np.empty(0, dtype=np.int64)
    row, state, number = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    hit, hit_state, hit_number = nothing, nothing, nothing
    for d in range(length):
        if len(hit):
            on, target, passed = automaton.step(d, hit_state, words[hit, d - longer])
            hit, hit_state, hit_number = hit[on], target, hit_number[on] + passed
        if d >= exact and len(row):
            whose, target, passed = automaton.others(d, state, words[row, d] if d < own else np.full(len(row), -1))
            hit, hit_state, hit_number = np.append(hit, row[whose]), np.append(hit_state, target), np.append(hit_number, number[whose] + passed)
        if d < own and len(row):
            on, target, passed = automaton.step(d, state, words[row, d])
            row, state, number = row[on], target, number[on] + passed
    return hit, hit_number


def _matrix(words: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words.tolist()), dtype=np.uint8).reshape(len(words), length)


def _common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that rows of a and b have in common from the first on; a's width bounds them."""
    differ = a != b[:, : a.shape[1]]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_pairs(words: np.ndarray, base: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (rows of words) at one error whose common prefix ends at first..last-1, or at base if last is base.

    words: distinct, sorted byte strings of base or base + 1 letters.
    """
    lengths = np.char.str_len(words)
    short, long = np.nonzero(lengths == base)[0], np.nonzero(lengths == base + 1)[0]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(short):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    backward = first < base - last
    asked = _matrix(words[short], base)
    for found, length in ((short, base), (long, base + 1)):
        if not len(found):
            continue
        known = _matrix(words[found], length)
        if backward:
            # the automaton wants its words in order, also when they are read from the end
            turned = known[:, ::-1]
            order = np.lexsort(turned.T[::-1])
            row, number = with_one_error(Automaton(turned[order]), length, asked[:, ::-1], base - last)
            number = order[number]
        else:
            row, number = with_one_error(Automaton(known), length, asked, first)
        prefix = _common_prefix(asked[row], known[number])
        own = (prefix >= first) & ((prefix < last) | (last == base))
        a, b = short[row[own]], found[number[own]]
        pairs.append((a, b))
        if length > base:
            pairs.append((b, a))
    if not pairs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a block of whole groups: its near words there, and the best of them."""

    def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = np.stack([block[c].to_numpy() for c in ("base", "first", "last")], axis=1)
        words = np.array([w.encode("latin-1") for w in block["word"].to_pylist()], dtype=object)
        counts = block["n"].to_numpy()
        kinds, own = np.unique(kind, axis=0, return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(own.ravel(), minlength=len(kinds)))
        for (base, first, last), rows in zip(kinds.tolist(), np.split(order, ends[:-1]), strict=True):
            part, at = np.unique(words[rows].astype(bytes), return_index=True)
            n = counts[rows][at]
            a, b = near_pairs(part, base, first, last)
            if len(a):
                a, b = (x[np.lexsort((b, -n[b], a))] for x in (a, b))
                start = np.nonzero(np.append(True, a[1:] != a[:-1]))[0]
                best, near = b[start], np.diff(np.append(start, len(a)))
                text = [[w.decode("latin-1") for w in part[x].tolist()] for x in (a[start], best)]
                yield pa.RecordBatch.from_arrays([pa.array(text[0], pa.string()), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), pa.array(text[1], pa.string())], ["word", "n_near", "near_n", "near"])

    held, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
        size += batch.num_rows + pc.sum(pc.utf8_length(batch["word"])).as_py() * BLOCK // BLOCK_CHARS
        if size >= BLOCK:
            keys = held["key"].to_numpy()
            if keys[0] != keys[-1]:
                whole = int(np.searchsorted(keys, keys[-1]))
                yield from found(held.slice(0, whole))
                held, size = held.slice(whole).combine_chunks(), 0
    if held is not None:
        yield from found(held)


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, near_n, near: near words of each word that has any, and the best of them. words: word, n (distinct)."""
    length = F.length("word")
    bases = F.explode(F.filter(F.array(length, length - 1), lambda x: x >= LEAST_LENGTH)).alias("base")
    rows = words.select("word", "n", bases)
    rows = _halved(rows.select("word", "n", "base", F.lit(0).alias("first"), F.col("base").alias("last")))
    found, work = [], []

    def search(part: DataFrame) -> DataFrame:
        dealt = part.select("key", "base", "first", "last", "word", "n").repartition("key").sortWithinPartitions("key")
        return saved(dealt.mapInArrow(_search, "word string, n_near long, near_n long, near string"), "near-words")

    while True:
        large = rows.filter("last - first > 1").groupBy("key").agg(F.count("*").alias("words")).filter(F.col("words") > group)
        hot = saved(large.select("key"), "large-groups")
        work.append(hot)
        if hot.isEmpty():
            found.append(search(rows))
            break
        found.append(search(rows.join(hot, "key", "left_anti")))
        work.append(saved(rows.join(hot, "key", "left_semi"), "large-rows"))
        rows = _halved(work[-1])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    out = saved(every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near"), "best-near-words")
    discard(*found, *work)
    return out


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form)."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        then = saved(further, "roots")
        discard(now)
        now = then.drop("moved")
        now._saved_at = then._saved_at
        if then.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word that count_words gives."""
    words = saved(count_words(docs, id_col, text_col), "spelled-words")
    near = near_words(words, group)
    is_form: Column = F.col("near_n") >= RATIO * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    known = saved(known, "forms")
    discard(words, near)
    roots = _rooted(known.filter("form IS NOT NULL"))
    out = saved(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    discard(known, roots)
    return out
