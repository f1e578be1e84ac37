"""Operator 3, packing: first-fit decreasing in randomised groups of documents.

A document's ids are its tokens and an end id.  Documents longer than a sequence
give full pieces and a remainder.  A hash deals the pieces to groups of about
`group_pieces`, equal ones as well: the hash takes in the task that cut the piece
and how many like it the task had before.  In each group first-fit decreasing puts them into bins, and a
tournament tree over the bins' free room finds the first bin that fits in a
logarithm of their number.  Groups never see each other, so memory is bounded.

Null and empty texts have the end id alone.  A null doc_id is a document like
any other; repeated rows are packed each on their own.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import chunks, release

_loaded: dict[object, object] = {}


def tokenizer(path: str):
    """The tokenizer in the file, loaded once a process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def word_codes(path: str) -> "WordCodes":
    if (path, "words") not in _loaded:
        _loaded[path, "words"] = WordCodes(tokenizer(path))
    return _loaded[path, "words"]


class WordCodes:
    """Ids of the words met so far, by word hash; it starts anew when it holds `most` words."""

    def __init__(self, tok, most: int = 600_000):
        self.tok, self.most = tok, most
        self.mark = tok.encode("|", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known, self.begin, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 20, np.uint16), 0

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.  Words go through the tokenizer as one text, a mark between them: words are encoded apart anyway."""
        texts = [w.decode("utf-8", "replace") for w in words]
        odd = {i for i, w in enumerate(words) if b"|" in w or b"<" in w or len(w) > 200}
        if len(self.mark) != 1:
            odd = set(range(len(words)))
        plain = [i for i in range(len(words)) if i not in odd]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        for s in range(0, len(plain), 2000):
            part = plain[s : s + 2000]
            ids = np.array(self.tok.encode(" | ".join(texts[i] for i in part) + " |", add_special_tokens=False).ids, np.uint32)
            pieces = np.split(ids, np.flatnonzero(ids == self.mark[0]) + 1)
            if len(pieces) != len(part) + 1:
                odd.update(part)
                continue
            for i, x in zip(part, pieces, strict=False):
                out[i] = x[:-1]
        for i in odd:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def places(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in flat, how many ids) for each of the sorted hashes, whose words are raw[starts : ends]."""
        if len(self.known) + len(hashes) > self.most:
            self.clear()
        at = np.searchsorted(self.known, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != hashes[inside]
        new = np.flatnonzero(fresh)
        if len(new):
            codes = self.encode([raw[starts[i] : ends[i]] for i in new])
            length = np.fromiter(map(len, codes), np.int64, len(codes))
            total = int(length.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            joined = np.concatenate(codes) if codes else np.empty(0, np.uint32)
            if len(joined) and joined.max() > 0xFFFF and self.flat.dtype == np.uint16:
                self.flat = self.flat.astype(np.uint32)
            self.flat[self.used : self.used + total] = joined
            begin = self.used + np.concatenate([[0], np.cumsum(length)[:-1]])
            self.used += total
            self.known, self.begin, self.length = (np.insert(x, at[new], y) for x, y in ((self.known, hashes[new]), (self.begin, begin), (self.length, length)))
            at = np.searchsorted(self.known, hashes)
        return self.begin[at], self.length[at]


def chunk_ids(c, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, len(words) + 1 offsets)."""
    if not len(c.starts):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    hashes, first, inverse = np.unique(c.word_hashes(), return_index=True, return_inverse=True)
    begin, length = codes.places(hashes, c.data.tobytes(), c.starts[first], c.ends[first])
    n = length[inverse]
    at = np.concatenate([[0], np.cumsum(n)])
    return codes.flat[np.repeat(begin[inverse] - at[:-1], n) + np.arange(at[-1])].astype(np.uint32), at


def document_ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids with the end id) of each row of (doc_id, text)."""
    codes = word_codes(path)
    for b in batches:
        names = b.column(0).to_pylist()
        for c in chunks(b.column(1)):
            ids, at = chunk_ids(c, codes)
            for i in range(c.n):
                yield names[c.first + i], np.append(ids[at[c.doc_words[i]] : at[c.doc_words[i + 1]]], np.uint32(end_id))


class Tournament:
    """Free room of bins in opening order; finds the first with enough."""

    def __init__(self, most: int, room: int):
        self.size = 1 << max(0, (most - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def take(self, need: int) -> int:
        """The first bin with room for `need`, which is then less; an unopened bin counts as empty."""
        t, i = self.tree, 1
        while i < self.size:
            i *= 2
            if t[i] < need:
                i += 1
        bin_ = i - self.size
        t[i] -= need
        while i > 1:
            i //= 2
            t[i] = max(t[2 * i], t[2 * i + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], room: int) -> list[int]:
    """The bin of each length; lengths come in descending order and fit a bin."""
    tree = Tournament(max(1, len(lengths)), room)
    return [tree.take(n) for n in lengths]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 2, group_pieces: int = 4096, seed: int = 17, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): where it starts, its length, its sequence and its place there."""
    # a piece at least for each row, and one more for what its bytes may fill: long documents are many pieces
    pieces_of = F.lit(1) + F.floor(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) / (4 * max_tokens))
    groups = max(1, round((docs.select(F.sum(pieces_of)).first()[0] or 0) / group_pieces))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        # a task's rows are the same in a rerun, and equal pieces are alike whichever comes first
        task, seen = TaskContext.get().partitionId(), Counter()
        for name, ids in document_ids(batches, tokenizer_path, end_id):
            for s in range(0, len(ids), max_tokens):
                part = ids[s : s + max_tokens].astype("<u4")
                crc = zlib.crc32(part)
                like = hash((name, s, crc)) & 0xFFFF
                rows.append((name, s, len(part), crc, len(ids), part.tobytes() if with_ids else None, task << 32 | seen[like]))
                seen[like] += 1
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
        release()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=[*columns, "salt"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, salt long")
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "salt"), F.lit(groups)).cast("long")).drop("salt")

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_pylist()
        bins = np.array(first_fit_decreasing(lengths, max_tokens), np.int64)
        order = np.argsort(bins, kind="stable")
        length = np.array(lengths, np.int64)[order]
        before = np.concatenate([[0], np.cumsum(length)[:-1]])
        first = np.searchsorted(bins[order], bins[order])
        out = table.take(pa.array(order)).select(columns)
        return out.append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + bins[order], pa.int64())).append_column("offset", pa.array(before - before[first], pa.int64()))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    out = dealt.groupBy("grp").applyInArrow(fill, schema)
    return out if with_ids else out.drop("ids")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
