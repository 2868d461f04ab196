"""Token ids of whole texts by a tokenizer file of the tokenizers library, in Arrow batches.

The tokenizer never joins characters across ASCII white space: its normaliser works on characters and their
combining marks, and its words never hold white space. So a text's ids are those of its white-space-separated chunks, one after
another, and each worker keeps the ids of chunks it has seen. The memory of a worker's chunk table is bounded; beyond the bound it
starts anew, which costs time only.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: Chunks of a worker's table, and the longest chunk it keeps in bytes.
TABLE = 200_000
LONGEST = 128
#: Texts that are encoded together, and their bytes.
BATCH = 2048
BATCH_BYTES = 4 << 20


#: A chunk that is one word of Latin letters, which are their own NFC form, and then signs without an apostrophe: two words to the tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
LATIN = re.compile(f"([{LETTERS}]+)([!-&(-/:-@[-`{{-~]*)")
#: The same signs, and letters that have all the bytes of such words.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
BYTES = "".join(c for c in map(chr, range(0x17F)) if c.isalpha())


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Chunks(dict):
    """chunk: its ids. A chunk that isn't there comes from the table before, so what is used again moves over, or is made; long ones aren't kept."""

    def __init__(self, make: Callable[[bytes], bytes], older: _Chunks | None = None):
        super().__init__()
        self.make, self.older = make, {}
        if older is not None:
            older.older, self.older = {}, older

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found


class ChunkEncoder:
    """encode(texts as UTF-8) gives each text's ids as little-endian unsigned 32-bit numbers, those that the library gives with its default settings.

    The library cuts a text at the strings of the tokenizer's added tokens, as they stand, before anything else is done to it, and so does encode();
    an added token is a chunk with a space in front, which no chunk of text has. Chunks of a Latin word and signs go straight to the
    vocabulary's merges; all others through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens of whole words, or of normalised text, are not supported")
        self.added = {b" " + t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.marks = sorted((k[1:] for k in self.added), key=len, reverse=True)
        self.at_marks = re.compile(b"(" + b"|".join(map(re.escape, self.marks)) + b")")
        self.tokenizer.encode_special_tokens = True  # for chunks that spell an added token only once they are lower case
        self.merge = self.tokenizer.model.tokenize
        self.shown = byte_characters()
        self.table = _Chunks(self._ids)

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _ids(self, chunk: bytes) -> bytes:
        if chunk in self.added:
            return self.added[chunk]
        if chunk.isalpha() and chunk.islower():
            return array("I", [t.id for t in self.merge(chunk.decode())]).tobytes()
        text = chunk.decode("utf-8", "replace")
        parts = LATIN.fullmatch(text)
        if parts is None:
            return self._whole(text)
        word, signs = parts.groups()
        if signs:
            return self.table[word.lower().encode()] + self.table[signs.encode()]
        low = word.lower()
        if low != word:
            return self.table[low.encode()]
        if not word.isascii():
            word = chunk.decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def _chunks(self, text: bytes) -> list[bytes]:
        if not any(m in text for m in self.marks):
            return (text.lower() if text.isascii() else text).split()  # ASCII text has no marks that case could part
        out = []
        for k, part in enumerate(self.at_marks.split(text)):
            out += [b" " + part] if k % 2 else (part.lower() if part.isascii() else part).split()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each distinct word and each distinct run of signs of the texts is looked up once; cutting up, numbering and joining are left to Arrow."""
        if len(self.table) > TABLE:
            self.table = _Chunks(self._ids, self.table)
        marked = {k: b"".join(map(self.table.__getitem__, self._chunks(t))) for k, t in enumerate(texts) if any(m in t for m in self.marks)}
        plain = pa.array([b"" if k in marked else t for k, t in enumerate(texts)], pa.binary()).view(pa.string())
        plain = pc.if_else(pc.string_is_ascii(plain), pc.ascii_lower(plain), plain)
        lists = pc.ascii_split_whitespace(plain)  # its empty strings have no ids
        chunks = lists.flatten().dictionary_encode()
        own = chunks.dictionary
        core = pc.ascii_rtrim(own, SIGNS)
        two = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        made = self._looked_up(pc.if_else(two, core, own))
        made = pc.binary_join_element_wise(made, self._looked_up(pc.if_else(two, pc.ascii_ltrim(own, BYTES), "")), pa.scalar(b"", pa.large_binary()))
        made = made.take(chunks.indices)
        ends = np.frombuffer(made.buffers()[1] or bytes(8), np.int64)[lists.offsets.to_numpy()].tolist()
        data = (made.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return [marked[k] if k in marked else data[ends[k] : ends[k + 1]] for k in range(len(texts))]

    def _looked_up(self, chunks: pa.Array) -> pa.Array:
        distinct = chunks.dictionary_encode()
        found = map(self.table.__getitem__, distinct.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        return pa.array(list(found), pa.large_binary()).take(distinct.indices)


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(tokenizer_json: bytes) -> ChunkEncoder:
    """One per worker process and tokenizer: workers are reused from task to task."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(tokenizer_json)
    return _encoders[key]


def tokenizer_bytes(path: str | None = None) -> bytes:
    """The tokenizer file, read on the driver; a few MB whatever the data."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


def batches_of(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in bounded batches, whole texts each."""
    binary = texts if pa.types.is_binary(texts.type) else texts.cast(pa.binary())
    part, at, held = [], 0, 0
    for k, t in enumerate(binary):
        t = t.as_py() or b""
        part.append(t)
        held += len(t)
        if len(part) >= BATCH or held >= BATCH_BYTES:
            yield at, part
            part, at, held = [], k + 1, 0
    if part:
        yield at, part


def map_ids(docs: DataFrame, text_col: str, others: list[str], start: Callable[[], Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch]], schema: str, tokenizer: str | None = None) -> DataFrame:
    """make(rows of the others, their texts' ids) over all rows, where start() gives each task its make; null texts count as empty."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, make = _encoder(shared.value), start()
        for b in rows:
            own = b.select(range(1, b.num_columns))
            for at, texts in batches_of(b.column(0)):
                yield make(own.slice(at, len(texts)), encoder.encode(texts))
        encoder.table.older = {}  # a worker between tasks keeps one table

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    return map_arrow(docs.select(text, *[F.col(c) for c in others]), run, schema)


def id_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
