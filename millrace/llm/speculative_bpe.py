"""BPE encoding by speculation and verification, and decoding.

Encoding a word takes two steps. Greedy longest matches over the vocabulary propose its tokens, for all new words of a batch in one
run of an automaton. Then every adjacent pair of proposed tokens is tested at once in numpy: a pair stands if no merge across its border would come before
the merges that make the two tokens. Words all of whose pairs stand have their ids; the others (and those that the greedy matches don't cover) are merged exactly.

Why the test is enough: take a proposed sequence of tokens, each of which is the encoding of its own string, and let the first merge across a border
be that of x, the last symbol of the left token's part, and y, the first symbol of the right one's. Until then the two parts went through their own merges by
rank, as they do side by side without the rest of the word, so the same merge crosses in the pair alone. It needs merges whose ranks are above those of their
parts, and one merge a token; a tokenizer file without these is refused.

Decoding gives what the library's decode() gives for a file without a decoder: the tokens, joined by a space.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import literal
from .common import table
from .word_tokens import LATIN, LONGEST, ChunkEncoder, batches_of, tokenizer_bytes

#: Chunks, and words, that a worker keeps; beyond it the table starts anew, which costs time only.
KEPT = 250_000
#: Ends a word in the automaton; no symbol of a byte-level vocabulary is white space.
END = "\n"
NEVER = np.int64(1) << 40


class Merges:
    """The merge list of a tokenizer file as arrays by token: rank of the merge that makes it (-1: a single symbol) and its two parts."""

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], model["merges"]
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            t = vocab[a + b]
            if self.rank[t] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
        made = np.flatnonzero(self.rank >= 0)
        if np.any(np.maximum(self.rank[self.left[made]], self.rank[self.right[made]]) >= self.rank[made]):
            raise ValueError("a merge comes before the merges of its parts")
        order = made[np.argsort(self._key(self.left[made], self.right[made]))]
        self.keys, self.key_ranks = self._key(self.left[order], self.right[order]), self.rank[order]
        # A token is its own encoding if its parts are theirs and no merge across their border comes first.
        alone = np.ones(size, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], below=True)
        for t in made[np.argsort(self.rank[made])]:
            alone[t] = alone[t] and alone[self.left[t]] and alone[self.right[t]]
        self.alone = alone

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a << 32 | b

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, NEVER if they don't merge."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = self._key(a, b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: bool = False) -> np.ndarray:
        """Whether a and b next to each other stay as they are. below: but for their own merge.

        Walks back in time, all pairs at once: x and y are the symbols at the border, until is the rank at which each goes into its parent (equal ranks
        merge leftmost first, so x's own merge comes before one across the border, and y's after it). The one made last is taken apart next.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        good, at = np.ones(len(x), bool), np.arange(len(x))
        first = below
        while len(at):
            if not first:
                r = self._rank_of(x, y)
                crossed = (r < until_x) & (r <= until_y) & (r < NEVER)
                good[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            first = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~crossed & ((rank_x >= 0) | (rank_y >= 0))
            take_x = rank_x > rank_y
            until_x, until_y = np.where(take_x, rank_x, until_x)[go], np.where(take_x, until_y, rank_y)[go]
            x, y, at = np.where(take_x, self.right[x], x)[go], np.where(take_x, y, self.left[y])[go], at[go]
        return good


class Speculator(ChunkEncoder):
    """encode(texts as UTF-8) gives each text's ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: bytes):
        import ahocorasick

        super().__init__(tokenizer_json)
        model = json.loads(tokenizer_json)["model"]
        suffix = model["end_of_word_suffix"] or ""
        if not suffix or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.merges = Merges(model)
        self.length = np.zeros(len(self.merges.rank), np.int64)
        self.automaton = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            shown = token.removesuffix(suffix) + END if token.endswith(suffix) else token
            self.length[i] = len(shown)
            if self.merges.alone[i]:
                self.automaton.add_word(shown, i)
        self.automaton.make_automaton()
        self.of_chunk: dict[bytes, bytes] = {}
        self.of_word: dict[str, bytes] = {}
        self.tried = self.merged = 0

    def _words(self, chunk: bytes) -> list[str]:
        """The words of a chunk in byte characters, as the file's normaliser and splitter give them."""
        if chunk.isalpha() and chunk.islower():
            return [chunk.decode()]
        text = chunk.decode("utf-8", "replace")
        parts = LATIN.fullmatch(text)
        if parts is None:
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        word, signs = parts.groups()
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        return [word, signs] if signs else [word]

    def speculate(self, words: list[str]) -> list[bytes]:
        """The ids of each word that isn't empty."""
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        found = np.array(list(self.automaton.iter_long(END.join([*words, ""]))), np.int64).reshape(-1, 2)
        end, ids = found[:, 0], found[:, 1]
        word = np.searchsorted(ends, end)
        sound = np.bincount(word, self.length[ids], len(words)) == np.diff(ends, prepend=-1)  # matches don't overlap, so they cover the word
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            pairs, of = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
            sound[word[inner[~self.merges.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[of]]]] = False
        starts = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        raw = ids.astype("<u4").tobytes()
        self.tried, self.merged = self.tried + len(words), self.merged + int((~sound).sum())
        return [raw[starts[k] : starts[k + 1]] if ok else self._merged(w) for k, (w, ok) in enumerate(zip(words, sound.tolist(), strict=True))]

    def _merged(self, word: str) -> bytes:
        """Exact merging."""
        return np.array([t.id for t in self.merge(word)], "<u4").tobytes()

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that aren't in the table; short ones go into it."""
        words = {c: self._words(c) for c in chunks if c not in self.added}
        new = [w for w in set(chain.from_iterable(words.values())) if w not in self.of_word]
        ids = dict(zip(new, self.speculate(new), strict=True)) if new else {}
        known = self.of_word
        made = {c: b"".join([ids[w] if w in ids else known[w] for w in ws]) for c, ws in words.items()}
        made |= {c: self.added[c] for c in chunks if c in self.added}
        self.of_word.update((w, i) for w, i in ids.items() if len(w) <= LONGEST)
        self.of_chunk.update((c, i) for c, i in made.items() if len(c) <= LONGEST)
        return made

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if max(len(self.of_chunk), len(self.of_word)) > KEPT:
            self.of_chunk, self.of_word = {}, {}
        chunks = [self._chunks(t) for t in texts]
        known = self.of_chunk
        here = self._learn({c for c in chain.from_iterable(chunks) if c not in known})
        long = {c: i for c, i in here.items() if len(c) > LONGEST}
        if not long:
            return [b"".join(map(known.__getitem__, cs)) for cs in chunks]
        return [b"".join([long[c] if c in long else known[c] for c in cs]) for cs in chunks]


_speculators: dict[int, Speculator] = {}


def _speculator(tokenizer_json: bytes) -> Speculator:
    """One per worker process and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _speculators:
        _speculators.clear()
        _speculators[key] = Speculator(tokenizer_json)
    return _speculators[key]


def encode_texts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, into: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The columns of keep and an array<int> of ids, one row for each row of docs, in one scan and without a shuffle.

    Null texts count as empty, and empty ones have no ids. Repeated rows stay. A string of an added token in a text is that token, as in the library
    with its default settings. Extra columns take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))  # a file of a few MB whatever the data
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _speculator(shared.value)
        for b in batches:
            own = b.select(range(1, b.num_columns))
            for at, texts in batches_of(b.column(0)):
                ids = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                part = own.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "_ids"])

    schema = ", ".join([f"_keep{i} {rows.schema[f'_keep{i}'].dataType.simpleString()}" for i in range(len(kept))] + ["_ids array<int>"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])], F.col("_ids").alias(into))


def decoder(tokenizer: str | None = None) -> Callable[[Column], Column]:
    """ids as array<int> to the library's decode(ids, skip_special_tokens=False): the tokens joined by a space. Null for null; ids of no token give nothing."""
    file = json.loads(tokenizer_bytes(tokenizer))
    if file.get("decoder"):
        raise ValueError("files with a decoder of their own are not supported")
    pieces = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
    tokens = literal([pieces.get(i) for i in range(max(pieces) + 1)], "array<string>")
    return lambda ids: F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), " ")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents."""
    made = encode_texts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    ids = F.col("ids")
    return made.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"), F.sha2(decoder()(ids), 256).alias("decoded_sha256"))
