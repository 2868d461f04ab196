"""Byte-level BPE encoding and decoding with Spark higher-order functions over a rank file.

A word (a match of the splitting pattern) is an array of its bytes; a fold merges the adjacent pair of lowest rank, leftmost first, until no
pair has a rank. The rank map is a literal: pairs of token ids are hashed to one of two slots each, so a look-up reads two array elements; pairs of bytes have an array of their own.

Words repeat, so the fold runs over distinct words: counts are taken over all documents, and the words above a count that at most
`dictionary` of them reach are folded once each. That table (word, ids) has a bounded size whatever the corpus, and goes to every task; texts are
split there and the distinct words of some megabytes of text looked up in place, so no token occurrence is ever shuffled. Words outside the table go back to the plan as they stand, and
the same fold makes their ids there. Only a word of more than LONG bytes, a run without a break, is merged by a heap
with the same ranks: the cost of a fold is the square of a word's length.

Decoding looks up each id's bytes in a literal array and concatenates the binary pieces.
"""

from __future__ import annotations

import base64
import heapq
import io
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, slices, table

#: Words of the table of frequent words, and the longest of them in bytes: the bound of what goes to every task, about 50 bytes a word in a worker.
DICTIONARY = 1 << 20
SHORT = 64
#: Longest word in bytes that is folded.
LONG = 8192
#: Words and pieces between spaces that a task counts at a time.
COUNTED = 1 << 19
#: Texts that are cut up together, and their bytes.
CUT_ROWS = 4096
CUT_BYTES = 6 << 20
#: White space but for the space and the line feed; Python takes more for it than patterns do.
OTHER_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
NONE = 1 << 30
#: An id that no token has and no pair of the rank map.
EDGE = 65535
#: Slots of the rank table, and the two primes whose remainders are a pair's places in it.
RANK_SLOTS = 1 << 18
PRIMES = (249989, 255049)


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def literal(values: list, kind: str) -> Column:
    """A constant array: the JSON is parsed once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"), ensure_ascii=False)), kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def place(keys: list, slots: int, hashes: Callable[[object], list[int]]) -> list:
    """Cuckoo hashing: keys[i] goes to one of its places; the list of slots has key numbers or None."""
    at: list[int | None] = [None] * slots
    for k in range(len(keys)):
        cur, last = k, -1
        for _ in range(5000):
            spots = hashes(keys[cur])
            free = next((s for s in spots if at[s] is None), None)
            if free is not None:
                at[free] = cur
                break
            spot = next((s for s in spots if s != last), spots[0]) if last >= 0 else spots[0]
            cur, at[spot], last = at[spot], cur, spot
        else:
            raise ValueError("too many keys for the slots")
    return at


# ------------------------------------------------------------------------------------------------- rank look-up


def _pair_spots(key: int) -> list[int]:
    return [key % p for p in PRIMES]


class Codec:
    """The literals of a rank file and the expressions over them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        keys, merged = [], []
        for piece, rank in ranks.items():  # every way to make a token of two
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    merged.append(rank)
        packed = [-1 if k is None else keys[k] << 16 | merged[k] for k in place(keys, RANK_SLOTS, _pair_spots)]
        self.table = literal(packed, "array<bigint>")
        # By bytes: a byte's id, and the rank of each two bytes, times 2 ** 32.
        self.bytes = literal([ranks[bytes([b])] for b in range(256)], "array<bigint>")
        self.pairs = literal([ranks.get(bytes([a, b]), NONE) << 32 for a in range(256) for b in range(256)], "array<bigint>")
        self.parts = literal([base64.b64encode(p).decode() for p in self.pieces], "array<binary>").cast("array<string>")

    def pair_rank(self, ranks: Column, key: Column) -> Column:
        """The rank of two adjacent tokens' merge by the table of ranks, NONE if they don't merge. key: the first id times 2 ** 16 and the second."""

        first, second = (F.get(ranks, (key % F.lit(p)).cast("int")) for p in PRIMES)
        entry = F.when(F.shiftright(first, 16) == key, first).when(F.shiftright(second, 16) == key, second)
        return F.coalesce(entry.bitwiseAND(F.lit(65535).cast("long")), F.lit(NONE).cast("long"))

    def encode_word(self, word: Column) -> Column:
        """array<int>: the ids of one word that isn't empty."""
        return self.with_tables(lambda tables: self._fold(word, tables))

    def with_tables(self, body: Callable[[Column], Column]) -> Column:
        """body with the tables bound once: plans print their literals."""
        return let(F.struct(self.table.alias("r"), self.bytes.alias("b"), self.pairs.alias("p")), body)

    def _fold(self, word: Column, tables: Column) -> Column:
        """State: an entry for each token, with edges at both ends: the rank of its pair with the next token (NONE at the edges) times 2 ** 32 and its id; and the least rank times 2 ** 20 with
        the leftmost place that has it. So a merge cuts and joins one array, and its place needs no search."""
        chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # a character for each byte
        codes = F.transform(F.split(chars, ""), lambda c: F.ascii(c))
        low, edge = F.lit(65535).cast("long"), F.lit(NONE << 32 | EDGE)

        def state(entries: Column) -> Column:
            least = lambda z: F.array_min(F.transform(z, lambda x, i: F.shiftleft(F.shiftright(x, 32), 20).bitwiseOR(i.cast("long"))))
            return let(entries, lambda z: F.struct(z.alias("z"), least(z).alias("m")))

        def start(c: Column) -> Column:
            pair = lambda x, i: F.coalesce(F.get(tables["p"], x * 256 + F.get(c, i + 1)), F.lit(NONE << 32))
            return state(F.concat(F.array(edge), F.transform(c, lambda x, i: pair(x, i).bitwiseOR(F.get(tables["b"], x))), F.array(edge)))

        def step(acc: Column, _: Column) -> Column:
            z, m = acc["z"], acc["m"]

            def merged(i: Column) -> Column:
                """i: place of the pair's first token among the entries, from 0; never 0, which is the edge."""
                made = F.shiftright(m, 20)
                keys = F.array(F.shiftleft(F.get(z, i - 1).bitwiseAND(low), 16).bitwiseOR(made), F.shiftleft(made, 16).bitwiseOR(F.get(z, i + 2).bitwiseAND(low)))
                near = F.transform(keys, lambda key: F.shiftleft(self.pair_rank(tables["r"], key), 32).bitwiseOR(F.shiftright(key, 16)))
                return state(F.concat(F.slice(z, F.lit(1), i - 1), near, F.slice(z, i + 3, F.size(z))))

            return F.when(m < NONE << 20, let(m.bitwiseAND(F.lit((1 << 20) - 1).cast("long")).cast("int"), merged)).otherwise(acc)

        ids = lambda acc: F.transform(F.slice(acc["z"], F.lit(2), F.size(acc["z"]) - 2), lambda x: x.bitwiseAND(low).cast("int"))
        return let(codes, lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), start(c), step, ids))

    def word_ids(self, word: Column) -> Column:
        """The ids of one word, comma-joined."""
        return F.array_join(self.encode_word(word), ",")

    def ids_of(self, runs: Column, words: Column, places: Column) -> Column:
        """Comma-joined ids: those of a run of known words, of the word after it, of the next run and so on. places has the number in words of the word after each run but the last."""
        folded = self.with_tables(lambda tables: F.transform(words, lambda w: F.array_join(self._fold(w, tables), ",")))
        joined = let(folded, lambda made: F.array_join(F.filter(F.flatten(F.zip_with(runs, places, lambda r, k: F.array(r, F.get(made, k)))), lambda x: x != ""), ","))
        return F.when(F.size(words) > 0, joined).otherwise(F.get(runs, F.lit(0)))

    def decode(self, ids: Column) -> Column:
        """binary: the concatenated pieces of array<int> ids."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.parts, i)), "").cast("binary")


# --------------------------------------------------------------------------------------------- frequent words


def spaced(text: str) -> list[str] | None:
    """The text cut at its spaces, if each of them stands between two other characters that are no white space: no word reaches over such a space, and each but the first piece's
    words are those of the piece with a space before it. None for other texts. Holds for patterns in which a space may only start a word."""
    return text.split(" ") if _free(text) else None


def _free(text: str) -> bool:
    return not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(w in text for w in OTHER_SPACES))


def _objects(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class _CutUp:
    """Texts as units, each of which is one or more words: a piece between spaces, or the first piece of a text, or a whole text that spaced() doesn't cut.

    order: the texts' numbers; ends: where the units of each of these texts end, from 0; codes: their units. pieces: the distinct pieces, which are the first units; others: the words of each other unit.
    """

    def __init__(self, texts: pa.Array, split: Callable[[str], list[str]], free: bool):
        cut_up = np.array([free and _free(t.as_py()) for t in texts], bool)
        self.order = np.append(np.flatnonzero(cut_up), np.flatnonzero(~cut_up))
        lists = pc.split_pattern(texts.filter(pa.array(cut_up)), " ")
        found = lists.flatten().dictionary_encode()
        codes, ends, n = found.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64), int(cut_up.sum())
        ends -= ends[0] if len(ends) else 0
        self.pieces = _objects(found.dictionary)
        self.others = [split(self.pieces[c]) for c in codes[ends[:n]]] + [split(texts[int(k)].as_py()) for k in self.order[n:]]
        codes[ends[:n]] = len(self.pieces) + np.arange(n)  # the first piece has no space before it
        self.codes = np.append(codes, len(self.pieces) + np.arange(n, len(texts)))
        self.ends = np.append(ends if len(ends) else 0, (ends[-1] if len(ends) else 0) + 1 + np.arange(len(texts) - n))


def word_counts(texts: DataFrame, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(w, count) over all rows. A task counts its own occurrences, about COUNTED words at a time, so a thin row for each of its words is all that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, free = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN

        def counted(words: pa.ChunkedArray | pa.Array, n: pa.ChunkedArray | pa.Array) -> pa.Table:
            return pa.table([words, n], ["w", "n"]).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])

        def rows(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            out = [t for t in held if t.column_names == ["w", "n"]]
            pieces = pa.concat_tables([t.rename_columns(["w", "n"]) for t in held if t.column_names != ["w", "n"]])
            for b in counted(pieces["w"], pieces["n"]).to_batches(COUNTED // 8 + 1):
                words = [split(" " + p) for p in _objects(b.column(0))]
                n = np.repeat(b.column(1).to_numpy(), list(map(len, words)))
                out.append(counted(pa.array(list(chain.from_iterable(words)), pa.string()), pa.array(n, pa.int64())))
            every = pa.concat_tables(out)
            yield from counted(every["w"], every["n"]).combine_chunks().to_batches()

        held, size = [], 0
        for b in slices(batches, 0, CUT_ROWS, CUT_BYTES):
            cut_up = _CutUp(b.column(0), split, free)
            n = np.bincount(cut_up.codes, minlength=len(cut_up.pieces))[: len(cut_up.pieces)]
            there = np.flatnonzero(n)
            own = [cut_up.pieces[k] for k in there]
            loose = pa.array(list(chain.from_iterable(cut_up.others)), pa.string())
            held += [pa.table([pa.array(own, pa.string()), pa.array(n[there], pa.int64())], ["piece", "n"]), counted(loose, pa.array(np.ones(len(loose), np.int64)))]
            size += len(own) + held[-1].num_rows
            if size > COUNTED:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)
        held.clear()
        give_back()

    return texts.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("count"))


def frequent_words(texts: DataFrame, codec: Codec, dictionary: int = DICTIONARY, pattern: str = public_tokenizers.PATTERN) -> pa.Table:
    """(w, ids comma-joined): the words of SHORT bytes at most whose count over all rows exceeds the least count that at most `dictionary` words exceed."""
    counts = cut(word_counts(texts, pattern).where("count > 1"))
    left, least, parts = dictionary, 1 << 62, 4 * texts.sparkSession.sparkContext.defaultParallelism
    # Counts of counts, largest first; those beyond 2 ** 20 share a row, so this is bounded.
    for r in counts.groupBy(F.least("count", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).toLocalIterator():
        if r["n"] > left:
            break
        left, least = left - r["n"], r["c"]
    chosen = counts.where(F.col("count") >= least).where(F.octet_length("w") <= SHORT)
    return chosen.repartition(parts).select("w", codec.word_ids(F.col("w")).alias("ids")).toArrow()  # dictionary rows at most


# ------------------------------------------------------------------------------------------------ whole texts


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for long words."""
    if word in ranks:
        return [ranks[word]]
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
    heap = [(r, i, 2) for i in range(len(part) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, n = heapq.heappop(heap)
        j = right[i] if part[i] is not None else len(part)
        if part[i] is None or j >= len(part) or part[j] is None or len(part[i]) + len(part[j]) != n:
            continue  # an old entry
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[i] < len(part):
            left[right[i]] = i
            if (r := ranks.get(part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[right[i]])))
        if (k := left[i]) >= 0 and (r := ranks.get(part[k] + part[i])) is not None:
            heapq.heappush(heap, (r, k, len(part[k]) + len(part[i])))
    return [ranks[p] for p in part if p is not None]


def _packed(known: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, known.schema) as stream:
        stream.write_table(known.combine_chunks())
    return out.getvalue()


class _Known:
    """The table of frequent words as it came, in Arrow, with the words' hashes in order. Equal hashes of two words of the table cost the second its place: it counts as unknown."""

    def __init__(self, packed: bytes):
        with pa.ipc.open_stream(packed) as stream:
            batches = list(stream)
        self.words, self.ids = batches[0].columns if batches else (pa.array([], pa.string()), pa.array([], pa.string()))
        keys = np.empty(len(self.words), np.int64)
        for at in range(0, len(keys), 1 << 16):
            part = _objects(self.words.slice(at, 1 << 16))
            keys[at : at + len(part)] = np.fromiter(map(hash, part), np.int64, len(part))
        self.at = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.at]

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's row in the table, -1 for unknown words."""
        if not len(self.keys) or not words:
            return np.full(len(words), -1, np.int32)
        keys = np.fromiter(map(hash, words), np.int64, len(words))
        order = np.argsort(keys)
        spot = np.empty(len(keys), np.int64)
        spot[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        row = self.at[spot]
        same = pc.equal(self.words.take(pa.array(row)), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        return np.where(same, row, -1)


_tables: dict[str, _Known] = {}


def _unpacked(name: str, shared) -> _Known:
    """The table, made once in a worker process; the one before goes."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = _Known(shared.value)
    return _tables[name]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, dictionary: int = DICTIONARY, pattern: str = public_tokenizers.PATTERN, long: int = LONG) -> tuple[DataFrame, Codec]:
    """((id, ids): one row per row of docs, ids comma-joined; the codec). Null texts count as empty; empty texts have no ids. Special tokens' strings are ordinary text."""
    codec = Codec(load_ranks(path))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared, name = docs.sparkSession.sparkContext.broadcast(_packed(frequent_words(rows, codec, dictionary, pattern))), uuid.uuid4().hex
    ranks = codec.ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known, split = _unpacked(name, shared), regex.compile(pattern).findall
        free, text = pattern == public_tokenizers.PATTERN, pa.list_(pa.string())

        def offsets(sizes: np.ndarray) -> np.ndarray:
            return np.append(0, np.cumsum(sizes))

        def lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

        for b in slices(batches, 1, CUT_ROWS, CUT_BYTES):
            cut_up = _CutUp(b.column(1), split, free)
            units = [split(" " + p) for p in cut_up.pieces] + cut_up.others
            words = list(chain.from_iterable(units))
            row = known.find(words)
            rare, heaped, number = {}, {}, np.full(len(words), -1, np.int64)  # number: that of a word without ids among rare
            for k in np.flatnonzero(row < 0).tolist():
                w = words[k]
                raw = w.encode("utf-8", "replace") if len(w) * 4 > long else b""
                if len(raw) > long:
                    heaped[k] = ",".join(map(str, heap_merge(raw, ranks)))
                else:
                    number[k] = rare.setdefault(w, len(rare))
            ids = known.ids.take(pa.array(row, mask=row < 0))
            if heaped:
                mask = np.zeros(len(words), bool)
                mask[list(heaped)] = True
                ids = pc.replace_with_mask(ids, pa.array(mask), pa.array(heaped.values(), pa.string()))

            # The words of all texts, one after another, by their places in words.
            first, n = offsets(list(map(len, units))), np.array(list(map(len, units)), np.int64)[cut_up.codes]
            ends = offsets(n)
            at = np.arange(ends[-1]) + np.repeat(first[cut_up.codes] - ends[:-1], n)
            per_text = np.diff(ends[cut_up.ends])
            texts = np.repeat(np.arange(len(per_text)), per_text)
            lost = number[at] >= 0
            lost_ends = offsets(np.bincount(texts[lost], minlength=len(per_text)))
            run_of = texts + np.cumsum(lost)  # of a known word: a text has a run more than it has words without ids
            made = pc.binary_join(lists(offsets(np.bincount(run_of[~lost], minlength=len(per_text) + int(lost.sum()))), ids.take(pa.array(at[~lost]))), ",")
            pairs, inverse = np.unique(texts[lost] * max(1, len(rare)) + number[at[lost]], return_inverse=True)
            own = np.searchsorted(pairs, np.arange(len(per_text) + 1) * max(1, len(rare)))
            columns = [
                b.column(0).take(pa.array(cut_up.order)),
                lists(np.arange(len(per_text) + 1) + lost_ends, made),
                lists(own, pa.array(list(rare), pa.string()).take(pa.array(pairs % max(1, len(rare))))),
                lists(lost_ends, pa.array(inverse - own[texts[lost]], pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(text) if k in (1, 2) else c for k, c in enumerate(columns)], ["id", "runs", "words", "places"])
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, runs array<string>, words array<string>, places array<int>")
    return made.select("id", codec.ids_of(F.col("runs"), F.col("words"), F.col("places")).alias("ids")), codec


def id_array(ids: Column) -> Column:
    """array<int> of comma-joined ids."""
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, ",").cast("array<int>"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents."""
    made, codec = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = id_array(F.col("ids"))
    made = made.select("id", "ids", ids.alias("a"))
    return made.select(F.col("id").alias("doc_id"), F.size("a").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(codec.decode(F.col("a")), 256).alias("decoded_sha256"))


