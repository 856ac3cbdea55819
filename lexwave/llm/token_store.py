"""Token ids to byte-plane files and back.

Texts are ranged by doc_id, and each range's task encodes its documents in order. Ids are cut into blocks of BLOCK ids;
a block is transposed into its four byte planes, each plane is compressed with zstandard, and a chunk (whole documents,
CHUNK ids or more) carries the index of its planes, documents and first id. The container is Spark's own Parquet writer
(one row a chunk): its commit protocol keeps files whole when executors are lost, and it writes to any store.

Null texts are empty; a null doc_id sorts first; repeated rows and doc_ids are all written, side by side; an empty table
gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, partitions, table
from .words import blocks, release, utf8

#: TEXT_BLOCK: bytes of text encoded at once; what is held beside the ids is some twenty times that.
BLOCK, CHUNK, END, LEVEL, TEXT_BLOCK = 1 << 16, 1 << 18, 2, 1, 1 << 20
_CACHE_PIECES = 220_000
#: Put before a piece that no blank stands before, and a line feed on its own.
MARK = "\x01"
FEED = MARK + "\n"
#: Fixed value: how byte-level vocabularies of this kind split a text, here for ASCII.
_ASCII_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
STORE = "part int, chunk int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, frames array<int>, planes binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with the tokenizers library as one plain call a text does, each distinct piece of text once.

    The vocabulary's splitter always begins anew at a blank between non-blanks, at a comma or full stop after a letter
    or digit, and before and after a line feed between non-blanks. So a text is cut there, and its ids are its pieces'
    ids in a row. Texts where such a place is not as described (runs of blanks, `..`) or that hold one of the
    vocabulary's added tokens (`<|endoftext|>`) are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.foreign = [MARK, *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(rest) for b in range(256)}
        self.blank = chr(self.alphabet[32])
        self.clear()

    def clear(self):
        #: piece -> number; MARK before a piece: no blank stands before it. Number 0: only with its whole text.
        self.known: dict[str, int] = {}
        self.ids, self.at, self.n = np.empty(1 << 18, np.int32), np.zeros(1 << 16, np.int64), 1
        self.ends, self.stops = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)

    def _add(self, pieces: list[str]) -> None:
        known, tokenize, blank, alphabet = self.known, self.tokenize, self.blank, self.alphabet
        ids, size, ends, stops, slow, n = array("i"), [], [], [], [], self.n
        for x in pieces:
            if x.isascii() and (x.isalpha() or x.isdigit()):  # a run of letters or digits is one word to the vocabulary's splitter
                got = tokenize(blank + x)
            else:
                lead = x[:1] != MARK
                bare = x if lead else x[1:]
                if not bare or MARK in bare or (bare[0].isspace() or bare[-1].isspace()) and x != FEED:
                    known[x] = 0
                    continue
                u = " " + bare if lead else bare
                if u.isascii():
                    got = [t for w in _ASCII_WORDS.findall(u) for t in tokenize(w.translate(alphabet))]
                elif bare.isalpha():
                    got = tokenize(u.encode().decode("latin-1").translate(alphabet))
                else:
                    slow.append((n, x, u))
                    continue
            known[x] = n
            n += 1
            ids.extend([t.id for t in got])
            size.append(len(got))
            ends.append(x[-1].isalnum())
            stops.append(x[0] == MARK and x[1] in ",.")
        for lo in range(0, len(slow), 4096):
            some = slow[lo : lo + 4096]
            for (_, x, _), e in zip(some, self.tok.encode_batch_fast([u for _, _, u in some], add_special_tokens=False), strict=True):
                known[x] = n
                n += 1
                ids.extend(e.ids)
                size.append(len(e.ids))
                ends.append(x[-1].isalnum())
                stops.append(x[0] == MARK and x[1] in ",.")
        if n == self.n:
            return
        end = self.at[self.n] + len(ids)
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.at) < n + 1:
            self.at, self.ends, self.stops = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.ends, self.stops))
        self.ids[self.at[self.n] : end] = np.frombuffer(ids, np.int32)
        self.at[self.n + 1 : n + 1] = self.at[self.n] + np.cumsum(size)
        self.ends[self.n : n], self.stops[self.n : n] = ends, stops
        self.n = n

    def _numbers(self, names: list[str]) -> np.ndarray:
        got = list(map(self.known.get, names))
        if None in got:
            self._add(list(dict.fromkeys(x for x, n in zip(names, got, strict=True) if n is None)))
            got = list(map(self.known.__getitem__, names))
        return np.array(got, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text)."""
        if len(self.known) > _CACHE_PIECES:
            self.clear()
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        cut = texts
        for a, b in ((",", f" {MARK},"), (".", f" {MARK}."), ("\n", f" {FEED} {MARK}")):
            cut = pc.replace_substring(cut, a, b)
        split = pc.split_pattern(cut, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        flat = split.flatten()
        off -= off[0]
        pieces = flat.dictionary_encode()
        number = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        number[off[:-1]] = self._numbers([MARK + x for x in flat.take(pa.array(off[:-1])).to_pylist()])
        odd = number == 0
        wrong = self.stops[number[1:]] & ~self.ends[number[:-1]]
        odd[1:] |= wrong
        size = self.at[number + 1] - self.at[number]
        ids, _ = ragged(self.ids, self.at[number], size)
        out_off = np.concatenate([[0], np.cumsum(size)])[off]
        for x in self.foreign:
            odd[off[:-1]] |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        bad = np.flatnonzero(np.add.reduceat(odd.astype(np.int64), off[:-1]))
        if len(bad):
            size, parts = np.diff(out_off), [ids[a:b] for a, b in zip(out_off[:-1], out_off[1:], strict=True)]
            got = self.tok.encode_batch_fast([texts[int(i)].as_py() for i in bad], add_special_tokens=False)
            for i, e in zip(bad, got, strict=True):
                parts[i] = np.array(e.ids, np.int32)
                size[i] = len(e.ids)
            ids, out_off = np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])
        return ids, out_off


def ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start:start+size] of each, one after the other."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    step = np.ones(total, np.int64)
    full = np.flatnonzero(size)
    if len(full):
        s, n = start[full], size[full]
        step[0] = s[0]
        step[np.cumsum(n)[:-1]] = s[1:] - s[:-1] - n[:-1] + 1
    return data[np.cumsum(step)] if total else data[:0], size


def pack(ids: np.ndarray, compress) -> tuple[list[int], bytes]:
    """Each block's four byte planes, each compressed; their lengths."""
    frames: list[bytes] = []
    for a in range(0, len(ids), BLOCK):
        planes = np.ascontiguousarray(ids[a : a + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T)
        frames += [compress(p.tobytes()) for p in planes]
    return [len(f) for f in frames], b"".join(frames)


def unpack(frames, planes: bytes, decompress) -> np.ndarray:
    """The inverse of pack."""
    out, at, view = [], 0, memoryview(planes)
    for i in range(0, len(frames), 4):
        rows = []
        for n in frames[i : i + 4]:
            rows.append(np.frombuffer(decompress(view[at : at + n]), np.uint8))
            at += n
        out.append(np.ascontiguousarray(np.stack(rows, 1)).reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.empty(0, "<u4")


_encoders: dict[str, Encoder] = {}


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        if path not in _encoders:  # a worker keeps it from task to task
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal chunk, first, held
            frames, planes = pack(np.concatenate(parts) if parts else np.empty(0, np.int32), compress)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "frames": pa.array([frames], pa.list_(pa.int32())), "planes": pa.array([planes], pa.binary())})
            chunk, first, held = chunk + 1, first + held, 0
            for x in (docs, sizes, parts):
                x.clear()
            return row

        for batch in batches:
            text = batch.column("text").fill_null("")
            _, off = utf8(text)
            for a, b in blocks(off, TEXT_BLOCK):
                ids, at = encoder(text.slice(a, b - a))
                at_end = at[1:] + np.arange(1, b - a + 1)
                out = np.empty(len(ids) + b - a, np.int32)
                ends = np.zeros(len(out), bool)
                ends[at_end - 1] = True
                out[ends], out[~ends] = END, ids
                keys, lo = batch.column("doc_id").slice(a, b - a).to_pylist(), 0
                size, start = np.diff(at) + 1, np.concatenate([[0], at_end])
                while lo < b - a:
                    hi = max(lo + 1, int(np.searchsorted(start, start[lo] + max(1, CHUNK - held), "left")))
                    hi = min(hi, b - a)
                    docs += keys[lo:hi]
                    sizes += size[lo:hi].tolist()
                    parts.append(out[start[lo] : start[hi]])
                    held += int(start[hi] - start[lo])
                    lo = hi
                    if held >= CHUNK:
                        yield flush()
                release()
        if docs:
            yield flush()
        encoder.clear()  # the worker may serve others next
        release()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            ids = unpack(row["frames"].as_py(), row["planes"].as_buffer(), decompress)
            size = np.array(row["n_tokens"].as_py(), np.int64)
            end = np.cumsum(size)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end, size, strict=True)]
            yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(row["base"].as_py() + row["first"].as_py() + end - size), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Ranges are cut by doc_id, then by the text's hash and the row's place, so that rows of one doc_id may fill many."""
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "place"]
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(_write(tokenizer or tokenizer_path()), STORE).write.option("compression", "none").option("parquet.block.size", str(32 << 20)).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    store = spark.read.schema(STORE).parquet(path)
    total, base = 0, []
    for part, n in sorted((r.part, r.n) for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # one row a file
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base, "part int, base long")
    return store.join(F.broadcast(bases), "part").select("base", "first", "doc_ids", "n_tokens", "frames", "planes").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    write_store(spark, docs, path := new_path(spark, "token-store"), tokenizer)
    return read_store(spark, path)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(spark, table(spark, sf_dir, "documents"))
