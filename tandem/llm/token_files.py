"""Token-id files with Elias-Fano coded document boundaries.

A data set is a folder of shards in the order of the documents. A shard has two
files: `.ids`, its token ids as little-endian unsigned integers one after
another (16 bits wide if the vocabulary allows it, else 32), and `.idx`, an Elias-Fano code of the document boundaries (0,
the end of the first document, ...) with the document ids. The offset of a
document is one select on the code, in about 2 + log2(mean length) bits a
document; no table of 64-bit offsets is kept or built.

Tasks write their shard under a name of its own and then rename it, so a task
that runs twice leaves one whole shard. The folder is opened through the file
system of its address, by the executors themselves.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tandem.llm.common import HELD, stored, task, texts
from tandem.llm.elias_fano import EliasFano, encode

#: Tokens of a shard, about.
SHARD_TOKENS = 16_000_000
#: Parts and pieces of texts whose ids a worker remembers, about 160 bytes each.
KNOWN_PARTS, KNOWN_PIECES = 1_000_000, 100_000
END_ID = 0
_LETTERS = re.compile(r"[^\W\d_]+")


class Parts(dict):
    """Numbers of the clean parts of texts, and the ids of each behind a space, end to end in one array."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        #: Parts that have a number but no ids yet.
        self.fresh: list[str] = []
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, kind)
        self.clean, self.used = np.empty(0, bool), np.empty(0, np.int64)

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.fresh.append(part)
        return number

    def add(self, ids: list[bytes], clean: list[bool]) -> None:
        """Ids of the fresh parts, in the order of their numbers."""
        self.fresh = []
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(size)]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)]
        self.clean = np.r_[self.clean, np.array(clean, bool)]
        self.used = np.r_[self.used, np.zeros(len(ids), np.int64)]

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of parts, and where those of each part end."""
        size = self.begin[numbers + 1] - self.begin[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[at], ends

    def shrink(self) -> None:
        """Let go of the less used half; parts met once go first."""
        keep = self.used > max(1, np.median(self.used))
        ids, ends = self.joined(np.flatnonzero(keep))
        left = [part for part, stays in zip(self, keep.tolist(), strict=True) if stays]
        self.clear()
        self.update(zip(left, range(len(left)), strict=True))
        self.ids, self.begin, self.clean = ids, np.r_[0, ends], self.clean[keep]
        self.used = np.zeros(len(left), np.int64)


class Encoder:
    """Ids of whole texts by the tokenizers library, with the ids of repeated parts remembered.

    Merges don't cross the pieces that the pre-tokenizer cuts, so a text may be
    encoded in parts where it always cuts: before a single space between two
    characters that are not white space, before and after a single line end
    between two such characters, and after a run of letters. Parts that other
    white space touches are encoded together with their neighbours. That holds for
    byte-level vocabularies with their own pattern and no normaliser; texts for
    any other vocabulary are encoded whole.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a task on each core; threads of the library's own would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The narrowest width that holds all ids.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cuts = _cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.parts = Parts(self.kind)
        #: Ids of pieces that have no space before them.
        self.pieces: dict[str, bytes] = {}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of the encoder's width."""
        if not self.cuts:
            return self._ids(batch)
        # Millions of short strings and no cycles: the collector would only walk through them.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(batch)
        finally:
            if collects:
                gc.enable()

    def _encode(self, batch: list[str]) -> list[bytes]:
        heads, rows = [], []
        for text in batch:
            head, *parts = text.split(" ")
            heads.append(head)
            rows.append(np.fromiter(map(self.parts.__getitem__, parts), np.int32, len(parts)))
        self._learn()
        own = {}
        for i, (text, row) in enumerate(zip(batch, rows, strict=True)):
            if any(x in text for x in self.special):
                own[i] = [text]
            elif not (_clean(heads[i]) and self.parts.clean[row].all()):
                own[i] = _odd(text)
        first = {i: _pieces("", head) for i, head in enumerate(heads) if i not in own}
        self._piece_ids({x for pieces in first.values() for x in pieces})
        strange = list({x for pieces in own.values() for x in pieces})
        once = dict(zip(strange, self._ids(strange), strict=True))
        every = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.parts.used += np.bincount(every, minlength=len(self.parts))
        ids, ends = self.parts.joined(every)
        # Where the ids of each text begin and end.
        cut = np.r_[0, ends][np.cumsum([0, *map(len, rows)])].tolist()
        out = []
        for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if i in own:
                out.append(b"".join(map(once.__getitem__, own[i])))
            else:
                out.append(b"".join(map(self.pieces.__getitem__, first[i])) + ids[lo:hi].tobytes())
        if len(self.parts) > KNOWN_PARTS:
            self.parts.shrink()
        if len(self.pieces) > KNOWN_PIECES:
            self.pieces.clear()
        return out

    def _learn(self) -> None:
        """Ids of the fresh parts. A part of more pieces than one is put together from them."""
        fresh, known = self.parts.fresh, self.parts
        plans, at = {}, 0
        while at < len(fresh):
            part = fresh[at]
            at += 1
            if not part.isalpha() and _clean(part):
                plans[part] = found = _pieces(" ", part)
                if len(found) > 1:
                    # May add a fresh part.
                    known[found[0][1:]]
        self._piece_ids({x for found in plans.values() for x in found[1:]})
        alone = [p for p in fresh if p.isalpha() or len(plans.get(p, "12")) == 1]
        ids = dict(zip(alone, self._ids([" " + p for p in alone]), strict=True))
        old = len(known) - len(fresh)

        def behind_space(part: str) -> bytes:
            number = known[part]
            if number < old:
                return known.ids[known.begin[number] : known.begin[number + 1]].tobytes()
            if part not in ids:
                found = plans[part]
                ids[part] = behind_space(found[0][1:]) + b"".join(map(self.pieces.__getitem__, found[1:]))
            return ids[part]

        for part in plans:
            behind_space(part)
        known.add([ids.get(p, b"") for p in fresh], [p in ids for p in fresh])

    def _piece_ids(self, wanted: set[str]) -> None:
        new = [x for x in wanted if x not in self.pieces]
        self.pieces.update(zip(new, self._ids(new), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind == "<u2" else "I"
        out = []
        for lo in range(0, len(texts), 4096):
            for found in self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False):
                ids = array(code, found.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                out.append(ids.tobytes())
        return out


def _odd(text: str) -> list[str]:
    """Pieces of a text with other white space around a space: parts that it touches stay together."""
    parts = text.split(" ")
    joined, open_ = [parts[0]], not _ends_clean(parts[0])
    for part in parts[1:]:
        if open_ or not _begins_clean(part):
            joined[-1] += " " + part
        else:
            joined.append(" " + part)
        open_ = not _ends_clean(part)
    return joined


def _cuts_at_spaces(config: dict) -> bool:
    """Whether the vocabulary is byte-level with the usual pattern, and nothing changes texts before it."""
    cutter = config.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    return plain and config.get("normalizer") is None and (config.get("model") or {}).get("type") == "BPE"


def _pieces(space: str, part: str) -> tuple[str, ...] | list[str]:
    """A clean part, after a space or none, cut at its single line ends and after the letters that begin a line."""
    if part.isalpha():
        return (space + part,)
    if part[:-1].isalpha() and not part[-1].isspace():
        return space + part[:-1], part[-1]
    lines = part.split("\n")
    if not all(map(_clean, lines)):
        return (space + part,)
    found = []
    for line in lines:
        letters = _LETTERS.match(line)
        end = letters.end() if letters else 0
        if 0 < end < len(line):
            found += [space + line[:end], line[end:], "\n"]
        else:
            found += [space + line, "\n"]
        space = ""
    return found[:-1]


def _begins_clean(part: str) -> bool:
    return part != "" and not part[0].isspace()


def _ends_clean(part: str) -> bool:
    return part != "" and not part[-1].isspace()


def _clean(part: str) -> bool:
    return part != "" and not part[0].isspace() and not part[-1].isspace()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    HELD["token_files"] = _ENCODERS.clear
    return _ENCODERS[path]


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts in ascending id order to shards in `folder`; the manifest, one row a shard.

    Each document ends with END_ID. Null texts are empty, null ids come first, and
    rows of one id are ordered by their texts. An empty table writes no shard.
    The manifest (part, first_id, n_docs, n_tokens) is stored, so the
    files are written when this returns.
    """
    kind = "bigint" if docs.schema[id_col].dataType.simpleString() in ("bigint", "int") else "string"
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))

    @task("token_files")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, ids, found, size, n = encoder(vocabulary), [], [], 0, 0
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], known.kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                for doc, body in zip(some.column(0).to_pylist(), known.encode(texts(some.column(1))), strict=True):
                    ids.append(doc)
                    found.append(body + end)
                    size += len(found[-1]) // len(end)
                    if size >= SHARD_TOKENS:
                        yield shard(part, n, ids, found)
                        ids, found, size, n = [], [], 0, n + 1
        if ids:
            yield shard(part, n, ids, found)

    def shard(part: int, n: int, ids: list, found: list[bytes]) -> pa.RecordBatch:
        name = f"{part:06d}-{n:04d}"
        width = 2 if encoder(vocabulary).kind == "<u2" else 4
        ends = np.cumsum([len(x) // width for x in found])
        _put(folder, f"{name}.ids", b"".join(found))
        _put(folder, f"{name}.idx", _index(np.r_[0, ends], ids, kind, width))
        row = [[name], [str(ids[0])], [len(ids)], [int(ends[-1])]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["part", "first_id", "n_docs", "n_tokens"],
        )

    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    return stored(ordered.mapInArrow(run, "part string, first_id string, n_docs bigint, n_tokens bigint"), "manifest")


def _index(bounds: np.ndarray, ids: list, kind: str, width: int) -> bytes:
    code = encode(bounds)
    sink = pa.BufferOutputStream()
    column = pa.array(ids, pa.int64() if kind == "bigint" else pa.string())
    with pa.ipc.new_stream(sink, pa.schema([("id", column.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([column], names=["id"]))
    return struct.pack("<QQ", width, len(code)) + code + sink.getvalue().to_pybytes()


def _put(folder: str, name: str, data: bytes) -> None:
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    own = f"{root}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    system, root = pafs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{name}") as source:
        return source.read()


class Shard:
    """One shard: boundaries by select on the packed code, ids mapped as they are."""

    def __init__(self, folder: str, name: str) -> None:
        index = _get(folder, f"{name}.idx")
        width, size = struct.unpack_from("<QQ", index)
        self.bounds = EliasFano(index[16 : 16 + size])
        self.ids = pa.ipc.open_stream(index[16 + size :]).read_all().column(0)
        self.tokens = np.frombuffer(_get(folder, f"{name}.ids"), f"<u{width}")

    def offsets(self, document: np.ndarray) -> np.ndarray:
        """Where documents, given by their number in the shard, begin."""
        return self.bounds.access(document).astype(np.int64)

    def document(self, number: int) -> np.ndarray:
        begin, end = self.offsets(np.array([number, number + 1]))
        return self.tokens[begin:end]


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files.

    The manifest has a row for each shard; its running sum gives the ids before
    a shard.
    """
    before = (F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")).alias("before")
    parts = manifest.select("part", before)

    @task("token_files")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["part"])
                bounds = shard.offsets(np.arange(len(shard.ids) + 1))
                sums = [zlib.crc32(shard.tokens[a:b].astype("<u4")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        shard.ids.combine_chunks(),
                        pa.array(bounds[:-1] + row["before"]),
                        pa.array(np.diff(bounds)),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    n = max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 4))
    return parts.repartition(n, "part").mapInArrow(run, schema)
