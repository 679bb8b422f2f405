"""Token-id output: documents become ids, ids become files of coded blocks, and the files are read back.

The file format is a Parquet container, so that Spark's committer makes writes whole under lost executors. A
row is one block: ``shard`` and ``seq`` place it, ``docs`` lists the pieces of documents in it (doc_id, number
of ids, whether the document ends here), ``coded`` holds the coded ids (see ``coder``), ``start`` the model that this
block and those behind it begin with, up to the next one that has its own. Shards are ranges of
doc_id, so shard, seq and piece order give ascending doc_id order. A long document spans blocks of its shard.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Collection, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm import coder
from emberline.session import remove, scratch, shared_dir, stored

TOKENIZER, END = "byte_bpe_50k.json", 2
FILE = "shard int, seq int, docs array<struct<doc_id:bigint,n:int,ends:boolean>>, coded binary, start binary"
FIELDS = ["shard", "seq", "docs", "coded", "start"]
_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int32()), ("ends", pa.bool_())]))


#: Fixed value: how a byte-level tokenizer with its own pattern cuts a text into the pieces that are encoded alone.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts with any other character, or with the beginning of a special token, are encoded whole.
OTHER = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u024f]|<\\|")
ASIDE = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
KNOWN = 1 << 20  # keys that a worker remembers before it forgets them all


def _tokenizer(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path)


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from ``at`` on, in twice the room where there is too little."""
    if at + len(values) > len(array):
        array = np.concatenate([array, np.empty(at + len(values), array.dtype)])
    array[at : at + len(values)] = values
    return array


class Ids:
    """The ids of texts by a tokenizer of the tokenizers library, which encodes each different piece of a text once.

    A blank or line feed between two characters that are neither always begins a piece, so texts are cut there and the ids of what
    lies between are remembered by a key: the word behind a blank, a line feed with the word behind it, or a null character and any text.
    """

    def __init__(self, path: str | None):
        self.tok = _tokenizer(path)
        made = json.loads(self.tok.to_str())
        before = made.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.total = 0
        self.size, self.start, self.flat = (np.empty(1 << 10, np.int32) for _ in range(3))

    def _learn(self, keys: list[str]) -> None:
        """Remember the ids of ``keys``: of one piece from the tokenizer, of several from those of the pieces."""
        words, alone, several = [], {}, {}
        for key in keys:
            if key.isalpha():
                words.append(key)
                continue
            text = key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key
            pieces = PIECES.findall(text)
            if len(pieces) < 2:
                alone[key] = text
            else:
                several[key] = [p[1:] if p[0] == " " and p[1:].isalpha() else "\0" + p for p in pieces]
        more = set(chain.from_iterable(several.values())).difference(self.place, words, alone)
        words += [w for w in more if w[0] != "\0"]
        alone |= {w: w[1:] for w in more if w[0] == "\0"}
        self._keep(alone, [e.ids for e in self.tok.encode_batch_fast(list(alone.values()), add_special_tokens=False)])
        # words behind blanks stay apart when they are put together, so one call encodes many
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            e = self.tok.encode(" " + " ".join(some), add_special_tokens=False)
            size = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            if len(size) != len(some):
                raise RuntimeError("the tokenizer cut a piece")
            self._keep(some, [e.ids], size)
        ids, size = self._ids([p for pieces in several.values() for p in pieces])
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum([len(x) for x in several.values()])).astype(np.int64)]
        self._keep(several, [ids], np.diff(ends))

    def _keep(self, keys: Collection[str], found: Sequence[Sequence[int]], size: np.ndarray | None = None) -> None:
        if size is None:
            size = np.fromiter(map(len, found), np.int64, len(found))
        n = len(self.place)
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))
        more = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        self.start = _put(self.start, n, self.total + np.cumsum(size) - size)
        self.size = _put(self.size, n, size)
        self.flat = _put(self.flat, self.total, more)
        self.total += len(more)

    def _ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known keys, one behind the other, and how many each has."""
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        size = self.size[at]
        at = self.start[at] - np.cumsum(size, dtype=np.int32) + size
        at = np.repeat(at, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], size

    def of(self, some: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        cut = [_cut(x) if self.by_piece and not OTHER.search(x) else None for x in some]
        whole = iter([e.ids for e in self.tok.encode_batch_fast([x for x, c in zip(some, cut, strict=True) if c is None], add_special_tokens=False)])
        keys = list(chain.from_iterable(c for c in cut if c is not None))
        fresh = set(keys).difference(self.place)
        if len(self.place) + len(fresh) > KNOWN:
            self.forget()
            fresh = set(keys)
        if fresh:
            self._learn(list(fresh))
        ids, size = self._ids(keys)
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum([len(c or ()) for c in cut], dtype=np.int64))].tolist()
        return [np.array(next(whole), np.int32) if c is None else ids[i:k] for c, (i, k) in zip(cut, itertools.pairwise(ends), strict=True)]


def _cut(text: str) -> list[str]:
    """The keys of a text: cut at lone blanks and line feeds, or by the pattern where blanks stand side by side."""
    if any(x in text for x in ASIDE):
        return ["\0" + p for p in PIECES.findall(text)]
    return ("\0" + text.replace("\n", " \n")).split(" ")


_HELD: dict[str | None, Ids] = {}


def ids_of(path: str | None) -> Ids:
    """The tokenizer of this worker, with the pieces that it has met."""
    if path not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _HELD[path] = Ids(path)
    return _HELD[path]


def shards_of(docs: DataFrame) -> int:
    """As many shards as keep each at some 64 MB of input, and no fewer than Spark's shuffle partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # Spark's stand-in for an unknown size is larger
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // (64 << 20))


def write_ids(docs: DataFrame, path: str, shards: int, tokenizer: str | None = None, order: Sequence[Column | str] = ("doc_id",)) -> None:
    """Encode every text of ``docs`` (doc_id, text), append the end id and write the ids to ``path``, in ``order``.

    A null text counts as empty; repeated rows are written again; of equal order, ascending doc_id and then the hash of
    the text decide, and rows without a doc_id come first.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("_h"), *[k.alias(f"_o{i}") for i, k in enumerate(keys)])
    names = [*[f"_o{i}" for i in range(len(keys))], "doc_id", "_h"]
    rows = rows.repartitionByRange(shards, *names).sortWithinPartitions(*names).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = ids_of(tokenizer), TaskContext.get().partitionId(), 0
        blocks: list[np.ndarray] = []
        lists: list[list[dict]] = []
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        room = coder.BLOCK

        def flush() -> pa.RecordBatch:
            nonlocal seq
            start = coder.Start.of(blocks)
            coded = coder.encode(blocks, start)
            seq += len(coded)
            numbers = pa.array(range(seq - len(coded), seq), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array([shard] * len(coded), pa.int32()), numbers, pa.array(lists, _PIECES), pa.array(coded, pa.binary()), pa.array([start.pack()] + [None] * (len(coded) - 1), pa.binary())], FIELDS)
            blocks.clear()
            lists.clear()
            return batch

        for batch in batches:
            names = batch.column(0).to_pylist()
            found = chain.from_iterable(encoder.of([x or "" for x in batch.column(1).slice(k, 256).to_pylist()]) for k in range(0, batch.num_rows, 256))
            for name, ids in zip(names, found, strict=True):
                ids = np.append(ids, np.int32(END))
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    held.append(part)
                    pieces.append({"doc_id": name, "n": len(part), "ends": not len(ids)})
                    room -= len(part)
                    if not room:
                        blocks.append(np.concatenate(held))
                        lists.append(pieces)
                        held, pieces, room = [], [], coder.BLOCK
                        if len(blocks) == coder.LANES:
                            yield flush()
        if held:
            blocks.append(np.concatenate(held))
            lists.append(pieces)
        if blocks:
            yield flush()

    rows.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the files, in no particular order."""
    rows = spark.read.schema(FILE).parquet(path).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, crc, n, shard, start = 0, 0, 0, None, None
        for batch in batches:
            own = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for k, end in itertools.pairwise(sorted({0, *own, batch.num_rows})):
                part = batch.slice(k, end - k)
                if part.column(4)[0].is_valid:
                    start = coder.Start.unpack(part.column(4)[0].as_py())
                found = []
                decoded = coder.decode(part.column(3).to_pylist(), start)
                for s, listed, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), decoded, strict=True):
                    if s != shard:
                        at, shard = 0, s
                    done = 0
                    for piece in listed:
                        crc = zlib.crc32(ids[done : done + piece["n"]].tobytes(), crc)
                        done += piece["n"]
                        n += piece["n"]
                        if piece["ends"]:
                            found.append((s, piece["doc_id"], at, n, crc))
                            at, crc, n = at + n, 0, 0
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = stored(rows.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"), "read")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = read.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = read.join(sums, "shard")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, order: Sequence[Column | str] = ("doc_id",)) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder, give what ``read_ids`` finds in them and delete them."""
    spark = docs.sparkSession
    shards = shards_of(docs)
    path = f"{shared_dir(spark)}/ids/{uuid.uuid4().hex}"
    with scratch(spark) as own:
        write_ids(docs, path, shards, tokenizer, order)
        found = own.result(read_ids(spark, path, shards))
    remove(spark, path)
    return found
