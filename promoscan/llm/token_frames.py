"""Token ids in binary shards: one zstandard frame per document and a trailing seek table.

A shard holds, in this order:

* a zstandard frame for each document: its ids as little-endian unsigned 32-bit integers;
* a skippable frame with the document ids (signed 64-bit) and one byte each that is 0 for a null id;
* a skippable frame with the seek table of the public seekable format: for each frame its compressed
  size, its decompressed size and the low 32 bits of the XXH64 of its content, then the number of
  frames, a flag byte (checksums present) and the magic number.

A reader fetches the tail, then only the frames it wants. Shards follow each other in ascending order
of document id. Ordinary zstandard tools read a whole shard as one stream of ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promoscan.llm.common import new_dir, row_keys, slices, stored

#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER, _HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
END_ID, LEVEL, CACHED_PIECES = 1, 3, 1_200_000
#: Pieces of more characters than these are forgotten after the texts that brought them; all others
#: when the cache is estimated to hold more bytes than these.
LONGEST_KEPT, CACHE_BYTES, ENTRY_BYTES = 64, 300_000_000, 200
MANIFEST = "path string, first_key long, n_docs long, n_tokens long"


#: How the cached kind of tokenizer splits normalised text, and what the classes of the
#: pattern hold among the first 256 characters.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, NUMBERS, SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
#: The same pattern with its most frequent alternative first; no two of the alternatives moved begin alike.
_PIECE = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{LETTERS}{NUMBERS}]+")


#: The signs by which byte-level tokenizers write the bytes that have no sign of their own.
BYTE_SIGNS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class TokenCache:
    """Ids of texts; each distinct piece of them is encoded once and kept as bytes.

    A tokenizer that lower-cases, splits by ``SPLIT_PATTERN`` and marks ends of words never joins
    characters of two pieces, so texts of Latin-1 characters are cut into pieces here. Of other texts
    the chunks between white space are taken. Any other tokenizer gets whole texts, without a cache.
    The cache holds ``CACHED_PIECES`` pieces of ``LONGEST_KEPT`` characters at most, and longer ones
    (whole paragraphs, in text without spaces) only while the texts at hand are encoded. Beyond
    ``CACHE_BYTES`` it is emptied.
    """

    def __init__(self, tokenizer_file: str):
        # Spark shares out the cores; the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.ids: dict[str, bytes] = {}
        self.long: list[str] = []
        self.held = 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        spec = json.loads(self.tokenizer.to_str())
        normalizers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        splits = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split"]
        signs = [x["add_prefix_space"] or x["use_regex"] for x in steps if x["type"] == "ByteLevel"]
        self.by_piece = bool(suffix) and normalizers == ["NFC", "Replace", "Lowercase"] and splits == [SPLIT_PATTERN] and signs == [False] and len(steps) == 2
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text. New pieces of all texts are encoded together."""
        if not self.by_piece:
            yield from (self._ids(text).tobytes() if text else b"" for text in texts)
            return
        pieces = [self._pieces(text) if text else [] for text in texts]
        self._learn(set().union(*pieces))
        for x in pieces:
            yield b"".join(map(self.ids.__getitem__, x))
        for piece in self.long:
            del self.ids[piece]
        self.long.clear()

    def _plain(self, text: str) -> bool:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        lower = text.lower()
        return not any(t in lower for t in self.added)

    def _pieces(self, text: str) -> list[str]:
        if self._plain(text):
            return _PIECE.findall(text.lower())
        chunks = [c.decode() for c in text.encode().split()]
        return [p for c in chunks for p in (_PIECE.findall(c.lower()) if self._plain(c) else [c])]

    def _learn(self, pieces: set[str]) -> None:
        new = pieces - self.ids.keys()
        if len(self.ids) + len(new) > CACHED_PIECES or self.held > CACHE_BYTES:
            self.ids.clear()
            self.held = 0
            new = pieces
        plain = list(new) if self._plain(" ".join(new)) else [p for p in new if self._plain(p)]
        for low in range(0, len(plain), 1000):
            self._learn_plain(plain[low : low + 1000])
        for piece in new - self.ids.keys():
            self.ids[piece] = self._ids(piece).tobytes()
        self.long = [p for p in new if len(p) > LONGEST_KEPT]
        kept = new.difference(self.long)
        self.held += ENTRY_BYTES * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, map(self.ids.__getitem__, kept)))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_plain(self, pieces: list[str]) -> None:
        """Encode pieces, already normalised and split, by the library's model alone.

        The last one also goes through the whole tokenizer; on a difference nothing is learnt.
        """
        tokenize = self.tokenizer.model.tokenize
        found = {p: array("I", [t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes() for p in pieces}
        if pieces and found[pieces[-1]] == self._ids(pieces[-1]).tobytes():
            self.ids.update(found)


_caches: dict[str, TokenCache] = {}


def token_cache(tokenizer_file: str) -> TokenCache:
    if tokenizer_file not in _caches:
        _caches[tokenizer_file] = TokenCache(tokenizer_file)
    return _caches[tokenizer_file]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard; documents come one by one and aren't held."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.entries, self.ids, self.valid = bytearray(), [], bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.stream.write(frame)
        self.entries += _ENTRY.pack(len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)

    def finish(self) -> None:
        index = np.array(self.ids, "<i8").tobytes() + bytes(self.valid)
        self.stream.write(_HEAD.pack(SKIPPABLE, len(index)) + index)
        table = bytes(self.entries) + _FOOTER.pack(len(self.ids), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.stream.write(_HEAD.pack(SKIPPABLE, len(table)) + table)


class ShardReader:
    """Random access to a shard; reads and decompresses only the frames asked for."""

    def __init__(self, uri: str):
        filesystem, path = _filesystem(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        n, _, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - _FOOTER.size - n * _ENTRY.size
        entries = np.frombuffer(self._at(table_at, n * _ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.n_tokens, self.checks = entries[:, 0], entries[:, 1] // 4, entries[:, 2]
        self.offsets = np.cumsum(self.sizes) - self.sizes
        index = self._at(table_at - _HEAD.size - 9 * n, 9 * n)
        valid = np.frombuffer(index, np.uint8, offset=8 * n).astype(bool)
        self.doc_ids = [i if v else None for i, v in zip(np.frombuffer(index, "<i8", n).tolist(), valid, strict=True)]

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def read(self, i: int) -> bytes:
        """Ids of document number i of the shard. Raises ValueError on a wrong checksum."""
        import xxhash
        import zstandard

        ids = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[i]), int(self.sizes[i])))
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i} is damaged")
        return ids

    def find(self, doc_ids: Iterable[int | None]) -> dict[int | None, bytes]:
        wanted = set(doc_ids)
        return {d: self.read(i) for i, d in enumerate(self.doc_ids) if d in wanted}

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer_file: str):
    def run(batches):
        cache, end = token_cache(tokenizer_file), np.array([END_ID], "<u4").tobytes()
        writer, first, n_docs, n_tokens = None, None, 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                keys, doc_ids, texts = (part.column(c).to_pylist() for c in ("k", "id", "text"))
                for key, doc_id, found in zip(keys, doc_ids, cache.encode_all(texts), strict=True):
                    if writer is None:
                        # a name of its own for each attempt: only the manifest makes a shard count
                        path, first = f"{folder}/{uuid.uuid4().hex}.ids.zst", key
                        filesystem, local = _filesystem(path)
                        filesystem.create_dir(local.rpartition("/")[0], recursive=True)
                        writer = ShardWriter(filesystem.open_output_stream(local, compression=None))
                    ids = found + end
                    writer.add(doc_id, ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4
        if writer:
            writer.finish()
            writer.stream.close()
            row = {"path": [path], "first_key": [first], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            yield pa.RecordBatch.from_pydict(row)

    return run


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending id order; returns the manifest.

    Manifest: (path, first_key, n_docs, n_tokens), one row per shard, stored; the order of
    ``first_key`` is the order of the shards. Each document ends with id 1; a null text has that id
    alone. Special tokens in a text are taken as the tokenizers library takes them. Null ids come last and
    repeated ones in the order of :func:`common.row_keys`. An empty table writes no shard. ``folder``
    must be reachable by all executors under the same URI (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    keyed = row_keys(docs, id_col, text_col)
    rows = keyed.select(F.col("_row_key").alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k")
    return stored(ordered.mapInArrow(_write(folder or new_dir(spark, "shards"), tokenizer_file), MANIFEST), "manifest")


def _read(batches):
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            shard = ShardReader(path)
            start = base + np.cumsum(shard.n_tokens) - shard.n_tokens
            for low in range(0, len(start), 1000):
                some = range(low, min(low + 1000, len(start)))
                crcs = [zlib.crc32(shard.read(i)) for i in some]
                columns = ([shard.doc_ids[i] for i in some], start[some.start : some.stop], shard.n_tokens[some.start : some.stop], crcs)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            shard.close()


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards of a manifest.

    Every frame is decompressed and held against its checksum. The window over all shards has one
    row per shard.
    """
    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(manifest.count(), 1)
    return based.select("path", "base").repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
