"""Token-id files: Simple-8b word-aligned coding with escapes and per-block offsets.

A word has 64 bits: the top four name a selector, the lower sixty hold as many ids as the selector says.

======== ===== ====== | ======== ===== ======
selector  ids   bits  | selector  ids   bits
======== ===== ====== | ======== ===== ======
1         60    1     | 8         8     7
2         30    2     | 9         7     8
3         20    3     | 10        6     10
4         15    4     | 11        5     12
5         12    5     | 12        4     15
6         10    6     | 13        3     20
7 (unused in files written here)  | 14  2  30
0         escape: the next word is one id of up to 64 bits | 15  1  60
======== ===== ====== | ======== ===== ======

Selectors are chosen greedily: as many ids as fit.  The choice is computed for all positions at once (running maxima of
bit lengths over every selector's span), only following the chosen positions is a loop over words.

File: ``QS8B`` magic, then blocks (each up to ``BLOCK_IDS`` ids, padded by zeros to whole words), then an index: per
block its offset, ids, words and escapes; per document its id, null flag and number of ids; then the index's length and
the magic again.  A block starts with the positions of its escaped words, so all its words decode without a loop.

Job: documents are range partitioned by id and sorted, every task writes one file, the small table of files gives each
file the number of ids before it.  Retried tasks write new files; only committed rows name files.

Defined results: a null or empty text is just the end id; documents with a null id come first; rows that repeat an id
follow one another, ordered by text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import fixed_schema, shared_folder, small_batches, stored
from quillstone.llm.files import create, new_file, open_file

MAGIC = b"QS8B"
BLOCK_IDS = 1 << 16
#: selector -> (ids, bits); fixed by the format.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
_SPAN = np.array([SELECTORS.get(s, (1, 64))[0] for s in range(16)], np.int64)
_LENGTHS = np.array([0] + [(1 << b) for b in range(63)], np.uint64)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits needed by each id (0 for 0)."""
    if ids.size and int(ids.max()) < 1 << 32:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # exact below 2**53
    return np.searchsorted(_LENGTHS, ids, side="right").astype(np.uint8) - 1 + (ids >= np.uint64(1 << 63)).astype(np.uint8) if ids.size else np.zeros(0, np.uint8)


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block and the positions of its escaped words."""
    n = len(ids)
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(60, np.uint64)])
    bits = bit_lengths(ids)
    m = {1: bits}

    def wider(a: int, b: int) -> None:
        size = min(len(m[a]), len(m[b]) - a)
        m[a + b] = np.maximum(m[a][:size], m[b][a : a + size])

    for a, b in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (8, 2), (8, 4), (8, 7), (12, 8), (15, 15), (30, 30)):
        wider(a, b)
    chosen = np.zeros(n, np.uint8)  # escape unless something fits
    for selector in sorted(SELECTORS, reverse=True):
        count, width = SELECTORS[selector]
        chosen[m[count][:n] <= width] = selector
    following = (np.arange(n) + _SPAN[chosen]).tolist()
    at, taken = 0, []
    while at < n:
        taken.append(at)
        at = following[at]
    taken = np.array(taken, np.int64)
    used = chosen[taken]
    raw = used == 0
    place = np.arange(len(taken)) + np.cumsum(raw) - raw
    words = np.zeros(len(taken) + int(raw.sum()), np.uint64)
    for selector, (count, width) in SELECTORS.items():
        mine = np.flatnonzero(used == selector)
        if mine.size:
            value = np.full(mine.size, selector << 60, np.uint64)
            for k in range(count):
                value |= ids[taken[mine] + k] << np.uint64(k * width)
            words[place[mine]] = value
    escapes = place[raw] + 1
    words[escapes] = ids[taken[raw]]
    return words, escapes.astype(np.uint32)


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    coded = np.ones(len(words), bool)
    coded[escapes] = False
    lead = words[coded]
    used = (lead >> np.uint64(60)).astype(np.uint8)
    ends = np.cumsum(_SPAN[used])
    starts = ends - _SPAN[used]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    out[starts[used == 0]] = words[escapes]
    for selector, (count, width) in SELECTORS.items():
        mine = np.flatnonzero(used == selector)
        if mine.size:
            keep = np.uint64((1 << width) - 1)
            for k in range(count):
                out[starts[mine] + k] = (lead[mine] >> np.uint64(k * width)) & keep
    return out[:n]


class TokenFileWriter:
    """Appends documents to one file."""

    def __init__(self, sink):
        self.sink, self.offset = sink, len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for lo in range(0, whole, BLOCK_IDS):
            part = ids[lo : min(lo + BLOCK_IDS, whole)]
            words, escapes = encode_block(part)
            data = escapes.astype("<u4").tobytes() + words.astype("<u8").tobytes()
            self.sink.write(data)
            self.blocks.append((self.offset, len(part), len(words), len(escapes)))
            self.offset += len(data)
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = struct.pack("<qq", len(self.blocks), len(self.docs))
        index += np.array(self.blocks, "<i8").reshape(-1, 4).tobytes()
        index += np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        index += np.array([d is None for d, _ in self.docs], "u1").tobytes()
        index += np.array([n for _, n in self.docs], "<i8").tobytes()
        self.sink.write(index + struct.pack("<q", len(index)) + MAGIC)
        self.sink.close()


class TokenFileReader:
    """Documents of one file in order; holds one block and the index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = struct.unpack("<q", tail[:8])[0]
        source.seek(size - 12 - length)
        index = source.read(length)
        n_blocks, n_docs = struct.unpack_from("<qq", index)
        at = 16
        self.blocks = np.frombuffer(index, "<i8", 4 * n_blocks, at).reshape(-1, 4)
        at += 32 * n_blocks
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        self.nulls = np.frombuffer(index, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(index, "<i8", n_docs, at + 9 * n_docs)

    def block(self, number: int) -> np.ndarray:
        offset, n, n_words, n_escapes = self.blocks[number].tolist()
        self.source.seek(offset)
        data = self.source.read(4 * n_escapes + 8 * n_words)
        return decode_block(np.frombuffer(data, "<u8", n_words, 4 * n_escapes), np.frombuffer(data, "<u4", n_escapes), n)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document's position, ids) block by block; a document may come in several pieces, an empty one in one."""
        doc, need, n_docs = 0, None, len(self.lengths)
        for number in range(len(self.blocks)):
            ids, at = self.block(number), 0
            while doc < n_docs:
                need = int(self.lengths[doc]) if need is None else need
                part = ids[at : at + need]
                yield doc, part
                at, need = at + len(part), need - len(part)
                if need:
                    break
                doc, need = doc + 1, None
        while doc < n_docs:
            yield doc, np.zeros(0, np.uint64)
            doc += 1


#: A word of lower-case Latin letters, which normalisation leaves alone, and a stop or comma at most.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+[.,]?")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: Words whose ids a Python worker remembers: this many recent ones and as many before (about 200 bytes each).
REMEMBERED = 150_000


class WordEncoder:
    """Ids of whole texts by the ``tokenizers`` library, asked once per new word.

    The tokenizer never joins characters across white space, so a text's ids are those of its words.  A word of Latin
    letters is one piece after lower-casing, so the library's model is asked for it directly, its bytes spelled as the
    library spells them; a full stop or comma after such letters is a piece of its own.  All other words take the library's whole way, many in one call, held apart by a
    special token.
    """

    def __init__(self, path: str, joint: str = "<|startoftext|>"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.joint, self.joint_id = joint, self.tokenizer.token_to_id(joint)
        whole = "".join(map(chr, range(0x80, 0x800)))  # their UTF-8 has every byte but ASCII's that Latin letters need
        spelled = "".join(p for p, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(whole))
        self.letters = dict(zip(whole.encode(), spelled))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.recent[word.encode()] = np.array(found.ids, "<u4").tobytes()

    def _whole_way(self, words: list[str]) -> None:
        plain = [w for w in words if self.joint not in w]
        self._alone([w for w in words if self.joint in w])
        for lo in range(0, len(plain), 64):
            some = plain[lo : lo + 64]
            ids = np.array(self.tokenizer.encode_batch_fast([self.joint.join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.joint_id)
            if len(cuts) != len(some) - 1:  # a word made the special token by some other spelling
                self._alone(some)
                continue
            data, start = ids.tobytes(), 0
            for word, cut in zip(some, [*cuts.tolist(), len(ids)]):
                self.recent[word.encode()] = data[start : 4 * cut]
                start = 4 * cut + 4

    def _piece(self, small: str) -> bytes:
        """Ids of one lower-case piece of Latin letters."""
        spelled = small if small.isascii() else small.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {}, self.recent
        recent, older, latin = self.recent, self.older, _LATIN.fullmatch
        fresh = [*filterfalse(recent.__contains__, words)]
        for word in filter(older.__contains__, fresh):
            recent[word] = older[word]
        fresh = [*filterfalse(recent.__contains__, fresh)]
        text, rest = b"\n".join(fresh).decode(), []
        for word, plain, small in zip(fresh, text.split("\n"), text.lower().split("\n")):
            if not latin(small):
                rest.append(plain)
                continue
            tail = b""
            if small[-1] in ".,":
                small, tail = small[:-1], self._tail(word[-1:])
            elif small == plain:
                recent[word] = self._piece(small)
                continue
            stem = small.encode()
            ids = recent.get(stem) or older.get(stem)
            if ids is None:
                ids = recent[stem] = self._piece(small)
            recent[word] = ids + tail
        self._whole_way(rest)

    def _tail(self, mark: bytes) -> bytes:
        if mark not in self.recent:
            self._alone([mark.decode()])
        return self.recent[mark]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text (UTF-8) as little-endian 32-bit integers."""
        parts = [t.split() for t in texts]  # at ASCII white space
        self._learn(set().union(*parts))
        return [b"".join(map(self.recent.__getitem__, words)) for words in parts]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


FILES = "shard int, path string, n_docs bigint, n_ids bigint"
DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string"


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the files; returns the table of files with the number of ids before each (``offset``)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode = struct.pack("<I", end_id), encoder(vocabulary).encode
        shard, writer, path = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            keys = batch["doc_id"].to_pylist()
            for lo in range(0, len(keys), 1000):
                texts = [t or b"" for t in batch["text"].slice(lo, 1000).cast(pa.binary()).to_pylist()]
                for key, data in zip(keys[lo : lo + 1000], encode(texts)):
                    if writer is None:
                        path = new_file(folder, f"shard-{shard:05d}", ".s8b")
                        writer = TokenFileWriter(create(path))
                    writer.add(key, np.frombuffer(data + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip((shard, path, len(writer.docs), writer.total), fixed_schema(FILES))], schema=fixed_schema(FILES)
            )

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    made = stored(ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, FILES), "files")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return made.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``file`` of every document, from the files alone."""
    small = files.select("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = fixed_schema(DOCS)
        for batch in batches:
            for path, offset in zip(batch["path"].to_pylist(), batch["offset"].to_pylist()):
                with open_file(path) as source:
                    reader = TokenFileReader(source)
                    checks = np.zeros(len(reader.lengths), np.int64)
                    for doc, ids in reader.pieces():
                        checks[doc] = zlib.crc32(ids.astype("<u4").tobytes(), int(checks[doc]))
                starts = offset + np.cumsum(reader.lengths) - reader.lengths
                name = path.rsplit("/", 1)[-1]
                columns = [pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls), starts, reader.lengths, checks, [name] * len(starts)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    count = max(1, files.count())
    return small.repartition(count).mapInArrow(run, DOCS)
