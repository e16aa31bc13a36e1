"""Byte-level BPE encoding and decoding.

Each pre-token's merges run on a segment tree: leaf i holds (rank, i) of the pair that starts at
symbol i, an inner node the minimum of its children, so the root names the leftmost pair of lowest
rank. A merge changes three leaves and their paths. Short pre-tokens share one array of trees, a row
each, and step together; a long one has a tree of its own.

Cases: a null text is encoded as an empty one (no ids; the digests are those of no bytes). Special
tokens' strings in a text become their ids, as in the tokenizers library. Repeated rows give
repeated results; an empty table gives an empty one; columns other than id and text are not read. A text's
pre-tokens are held together; ids of pre-tokens beyond CACHED characters are not remembered, and the tree of
a long one takes about 60 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import slices

#: Fixed value: how byte-level BPE splits a text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers within a task, and the longest of them; at this number it forgets them all.
CACHE, CACHED = 150_000, 64
#: Pre-tokens of more symbols than this have a tree of their own.
ROW_TREE = 256
#: Leaves of all trees of one array.
ARRAY_LEAVES = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character by which the vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class ByteBpe:
    """Ids, pair ranks and bytes of a vocabulary file (its text, in the tokenizers library's JSON form)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, sign = data["model"], byte_symbols()
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError("not a byte-level BPE without normalizer")
        if data["pre_tokenizer"]["add_prefix_space"] or not data["pre_tokenizer"]["use_regex"]:
            raise ValueError("unsupported pre-tokenizer settings")
        vocab: dict[str, int] = model["vocab"]
        back = {c: b for b, c in enumerate(sign)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c in sign], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        order = np.argsort((left << 32) | right, kind="stable")
        self.pair_keys = ((left << 32) | right)[order]
        self.pair_ranks = order
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = dict(zip(self.pair_keys.tolist(), order.tolist(), strict=True))
        self.none = len(pairs)
        self.cuts = regex.compile(SPLIT)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; self.none where there is no merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most width bytes, width a power of two: a row of the array is a tree."""
        n, dead = len(words), self.none * width + width
        lengths = np.array([len(w) for w in words])
        flat = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        column = np.arange(width)
        filled = column < lengths[:, None]
        symbol = np.full((n, width + 1), -1, dtype=np.int64)
        symbol[:, :width][filled] = flat
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), dead, dtype=np.int64)
        pair = filled & ((column + 1) < lengths[:, None])
        rank = self.ranks(symbol[:, :-1][pair], symbol[:, 1:][pair])
        tree[:, width:][pair] = np.where(rank < self.none, rank * width + np.nonzero(pair)[1], dead)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.nonzero(tree[:, 1] < dead)[0]
        while len(row):
            rank, at = np.divmod(tree[row, 1], width)
            gone = after[row, at]
            onward = after[row, gone]
            symbol[row, at] = self.merged[rank]
            symbol[row, gone] = -1
            after[row, at] = onward
            before[row, np.minimum(onward, width)] = at
            prior = before[row, at]
            next_symbol = np.where(onward < width, symbol[row, np.minimum(onward, width)], -1)
            forward = np.where(next_symbol >= 0, self.ranks(symbol[row, at], np.maximum(next_symbol, 0)), self.none)
            tree[row, width + at] = np.where(forward < self.none, forward * width + at, dead)
            tree[row, width + gone] = dead
            has = prior >= 0
            back = self.ranks(symbol[row[has], prior[has]], symbol[row[has], at[has]])
            tree[row[has], width + prior[has]] = np.where(back < self.none, back * width + prior[has], dead)
            changed = (width + at, width + gone, width + np.maximum(prior, 0))
            for _ in range(width.bit_length() - 1):
                changed = tuple(c >> 1 for c in changed)
                for c in changed:
                    tree[row, c] = np.minimum(tree[row, 2 * c], tree[row, 2 * c + 1])
            row = row[tree[row, 1] < dead]
        left = symbol[:, :width]
        return [left[i][left[i] >= 0] for i in range(n)]

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one long word, by a tree of its own: an array of the leaves' and nodes' rank * width + place."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        start = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        dead = self.none * width + width
        leaves = np.full(width, dead, dtype=np.int64)
        rank = self.ranks(start[:-1], start[1:])
        leaves[: n - 1] = np.where(rank < self.none, rank * width + np.arange(n - 1), dead)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        # arrays of machine numbers: one by one access is as fast as a list's and takes 8 bytes for each
        tree = [array("q", level.tobytes()) for level in levels]
        symbol, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (start, np.arange(1, n + 1), np.arange(-1, n - 1)))

        def put(place: int, value: int) -> None:
            tree[0][place] = value
            for k in range(1, len(tree)):
                place >>= 1
                below = tree[k - 1]
                best = min(below[2 * place], below[2 * place + 1])
                if tree[k][place] == best:
                    break
                tree[k][place] = best

        def pair(left: int, right: int, place: int) -> int:
            rank = self.rank_of.get((symbol[left] << 32) | symbol[right])
            return dead if rank is None else rank * width + place

        top = tree[-1]
        while top[0] < dead:
            rank, at = divmod(top[0], width)
            gone = after[at]
            onward = after[gone]
            symbol[at], symbol[gone] = int(self.merged[rank]), -1
            after[at] = onward
            put(gone, dead)
            if onward < n:
                before[onward] = at
            put(at, pair(at, onward, at) if onward < n else dead)
            if (prior := before[at]) >= 0:
                put(prior, pair(prior, at, prior))
        out = np.frombuffer(symbol, dtype=np.int64)
        return out[out >= 0]

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of tokens into the cache, as little-endian 32-bit integers."""
        if len(self.cache) + len(tokens) > CACHE:
            self.cache.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for token in tokens:
            word = token.encode()
            if len(word) > ROW_TREE:
                self.cache[token] = self.merge_one(word).astype("<u4").tobytes()
            else:
                by_width.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append((token, word))
        for width, own in by_width.items():
            step = max(1, ARRAY_LEAVES // width)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                for (token, _), ids in zip(part, self.merge_rows([w for _, w in part], width), strict=True):
                    self.cache[token] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split: list[list[str | int]] = []
        for text in texts:
            if self.marks is not None and self.marks.search(text):
                parts: list[str | int] = []
                at = 0
                for m in self.marks.finditer(text):
                    parts += self.cuts.findall(text[at : m.start()])
                    parts.append(self.special[m[0]])
                    at = m.end()
                split.append(parts + self.cuts.findall(text[at:]))
            else:
                split.append(self.cuts.findall(text))
        missing = {t for parts in split for t in parts if t not in self.cache and not isinstance(t, int) and len(t) <= CACHED}
        if missing:
            if len(self.cache) + len(missing) > CACHE:
                missing = {t for parts in split for t in parts if not isinstance(t, int) and len(t) <= CACHED}
            self.learn(missing)
        known = self.cache

        def ids(t: str | int) -> bytes:
            if isinstance(t, int):
                return t.to_bytes(4, "little")
            return known[t] if t in known else self.one(t.encode()).astype("<u4").tobytes()

        return [np.frombuffer(b"".join([known[t] if t in known else ids(t) for t in parts]), dtype="<u4") for parts in split]

    def one(self, word: bytes) -> np.ndarray:
        """Ids of one word that is not remembered."""
        return self.merge_one(word) if len(word) > ROW_TREE else self.merge_rows([word], 1 << max(1, (len(word) - 1).bit_length()))[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _tokenizer(spec: str) -> ByteBpe:
    return ByteBpe(spec)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per document: its id and the chosen outputs.

    vocabulary: path of the tokenizer's file on the driver; its content, of fixed size, is broadcast.
    outputs: n_tokens long, ids array<long>, decoded string, ids_sha256 (of ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the decoded text in UTF-8), lowercase hex.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<long>", pa.list_(pa.int64())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                columns: dict[str, list] = {k: [] for k in outputs}
                for ids in bpe.encode([t or "" for t in texts[a:b]]):
                    text = bpe.decode(ids) if {"decoded", "decoded_sha256"} & {*outputs} else ""
                    for k, out in columns.items():
                        if k == "n_tokens":
                            out.append(len(ids))
                        elif k == "ids":
                            out.append(ids.astype(np.int64))
                        elif k == "decoded":
                            out.append(text)
                        elif k == "ids_sha256":
                            out.append(hashlib.sha256(ids.tobytes()).hexdigest())
                        else:
                            out.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(v, type=kinds[k][1]) for k, v in columns.items())], ["_id", *columns])
        bpe.cache.clear()  # the worker lives on and does other tasks

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, ", ".join([f"_id {id_type}", *(f"{k} {kinds[k][0]}" for k in outputs)])).withColumnRenamed("_id", id_col)
