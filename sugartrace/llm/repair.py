"""Token ids in a binary format: Re-Pair grammars of blocks, with random access by expansion lengths.

A shard is a range of documents in key order; a block is a run of documents of a shard with about BLOCK ids.
The ids of a block become a grammar: in each round the most frequent pairs of neighbouring symbols turn into
new symbols, until no pair is frequent, a round gains little, or the symbols no longer fit in 16 bits. Pairs never cross documents.

File format: Parquet rows (shard, block, shard_start, n_tokens, keys, payload). `payload` is little-endian:

    4 bytes  b"RPR1"
    4 x u32  first rule symbol, number of rules R, number of symbols S, number of documents D
    R x 2 u32  rules: left and right symbol of each; a rule only uses earlier rules and ids
    R x u32  expansion lengths of the rules
    S x u16 (u32 if the largest symbol needs it)  the symbols of the block
    D x u64  place of each document's first symbol, D x u64  its first id, counted in the block
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sugartrace.llm.common import small_batches
from sugartrace.session import scratch_path

END = 2  # id that closes a document
BLOCK = 1 << 20
PAIRS = 4096  # pairs replaced in a round at most
FREQUENT = 16  # a rule takes 12 bytes and saves 2 at each place
GAIN = 64  # a round that shortens the block by less than this part is the last
NARROW = 1 << 16
TABLE = 20  # bits of the table that finds chosen pairs
CACHED = 1_000_000  # encoded pieces a worker keeps; only speed depends on it

_tokenizers: dict[str, Tokenizer] = {}
_pieces: dict[str, dict[str, bytes]] = {}
_older: dict[str, dict[str, bytes]] = {}
_lowered: dict[str, Tokenizer] = {}
_closing: dict[str, np.ndarray] = {}


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian u32, without the closing id.

    The tokenizer never joins characters across a space or line break, so texts are cut there and equal pieces
    are encoded once. It lowers case itself; where all characters are Latin-1, lowering first changes nothing and
    makes more pieces equal.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
    if path not in _tokenizers:
        tokenizer = _tokenizers[path] = Tokenizer.from_file(path)
        _lowered[path] = Tokenizer.from_file(path)
        _lowered[path].normalizer = None  # for lower-case Latin-1, which it would leave as it is
        closes = np.zeros(tokenizer.get_vocab_size(), bool)
        closes[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        _pieces[path], _older[path], _closing[path] = {}, {}, closes
    cut = []
    for text in texts:
        text = (text or "").replace("\n", " ")
        cut.append(text.lower() if latin(text) else text)
    lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    octets = looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), path)
    sizes = np.fromiter(map(len, octets), np.int64, len(octets)) // 4
    begins = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    width = sizes[codes]
    upto = np.append(0, np.cumsum(width))
    places = np.repeat(begins[codes] - upto[:-1], width)
    places += np.arange(upto[-1])
    ids = np.frombuffer(b"".join(octets), "<u4")[places].tobytes()
    ends = (4 * upto[lists.offsets.to_numpy()]).tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:])]


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def looked_up(pieces: list[str], path: str) -> list[bytes]:
    """Ids of each piece. What is known is kept in two halves: pieces met since the newer one was begun are in it, and
    when it is full the older one goes, so pieces that come again and again stay.
    """
    known, older = _pieces[path], _older[path]
    if len(known) > CACHED // 2:
        older, known = known, {}
        _older[path], _pieces[path] = older, known
    found = list(map(known.get, pieces))
    missing = [i for i, octets in enumerate(found) if octets is None]
    if older:
        for i in missing:
            if (octets := older.get(pieces[i])) is not None:
                found[i] = known[pieces[i]] = octets
        missing = [i for i in missing if found[i] is None]
    learn([pieces[i] for i in missing], path)
    for i in missing:
        found[i] = known[pieces[i]]
    return found


def learn(pieces: list[str], path: str) -> None:
    """Encode new pieces. Words of letters only are one word to the tokenizer: many are encoded as one text and told
    apart by the ids that close a word. ASCII marks after such a word, however many, are one word of their own, if the word is
    still of letters only once it is normalised: after a combining mark they would join the mark.
    """
    tokenizer, lowered, known, closes = _tokenizers[path], _lowered[path], _pieces[path], _closing[path]
    marked, words, others = [], [], []
    stems, tails = set(), set()
    for piece in pieces:
        if piece.isalpha():
            words.append(piece)
        elif len(stem := piece.rstrip(punctuation)) < len(piece) and stem.isalpha() and unicodedata.normalize("NFC", stem).lower().isalpha():
            marked.append((piece, stem, tail := piece[len(stem) :]))
            if stem not in known:
                stems.add(stem)
            if tail not in known:
                tails.add(tail)
        else:
            others.append(piece)
    others += tails.difference(others)
    words = [*words, *stems.difference(words)]
    for begin in range(0, len(words), 5000):
        part = words[begin : begin + 5000]
        text = " ".join(part)
        used = lowered if latin(text) and text == text.lower() else tokenizer
        ids = np.array(used.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(closes[ids]) + 1)).tolist()
        if len(ends) != len(part):
            others += part
            continue
        octets, at = ids.tobytes(), 0
        for word, end in zip(part, ends):
            known[word] = octets[at:end]
            at = end
    for begin in range(0, len(others), 5000):
        part = others[begin : begin + 5000]
        for piece, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            known[piece] = array("I", found.ids).tobytes()
    for piece, stem, tail in marked:
        known[piece] = known[stem] + known[tail]


def _place(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)


def grammar(ids: np.ndarray, starts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: rules (pairs of symbols), symbols, and the place of each document's first symbol."""
    most = NARROW if first < NARROW else 1 << 20
    kind = np.uint32 if most == NARROW else np.uint64
    shift = kind(16 if most == NARROW else 32)
    symbols, starts = ids.astype(kind), starts.copy()
    rules: list[np.ndarray] = []
    count = 0
    while len(symbols) > 1 and first + count < most:
        codes = (symbols[:-1] << shift) | symbols[1:]
        inside = np.ones(len(codes), bool)
        ends = starts[1:] - 1
        inside[ends[(ends >= 0) & (ends < len(codes))]] = False
        in_order = np.sort(codes[inside])
        if not len(in_order):
            break
        edge = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        times = np.diff(np.concatenate([edge, [len(in_order)]]))
        often = np.flatnonzero(times >= FREQUENT)
        if not len(often):
            break
        often = often[np.argsort(-times[often], kind="stable")][: min(PAIRS, most - first - count)]
        chosen = np.sort(in_order[edge[often]])
        # A pair whose place in the table a later one took waits for another round.
        table = np.zeros(1 << TABLE, np.int16)
        table[_place(chosen)] = np.arange(len(chosen))
        at = table[_place(codes)]
        hit = (chosen[at] == codes) & inside
        # Of neighbouring hits every other one is replaced, from the left.
        places = np.flatnonzero(hit)
        run = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
        offset = np.arange(len(places)) - np.repeat(run, np.diff(np.concatenate([run, [len(places)]])))
        places = places[offset % 2 == 0]
        symbols[places] = (first + count + at[places].astype(np.int64)).astype(kind)
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        before = np.concatenate([[0], np.cumsum(stays)])
        starts = before[starts]
        symbols = symbols[stays]
        rules.append(np.stack([chosen >> shift, chosen & ((kind(1) << shift) - kind(1))], 1))
        count += len(chosen)
        if GAIN * len(places) < len(symbols):
            break
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return pairs.astype("<u4"), symbols, starts


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids each rule stands for; a rule is longer than the rules it uses, so a few sweeps settle them."""
    lengths = np.full(len(rules), 2, np.int64)
    while len(rules):
        used = rules.astype(np.int64) - first
        part = np.where(used >= 0, lengths[np.maximum(used, 0)], 1).sum(1)
        if (part == lengths).all():
            break
        lengths = part
    return lengths.astype("<u4")


def pack(documents: list[bytes], first: int) -> bytes:
    """A block's payload from the ids of its documents."""
    counts = np.array([len(d) // 4 for d in documents], np.int64)
    first_ids = np.cumsum(counts) - counts
    ids = np.frombuffer(b"".join(documents), "<u4")
    rules, symbols, starts = grammar(ids, first_ids, first)
    kind = "<u2" if first + len(rules) <= NARROW else "<u4"
    head = struct.pack("<4s4I", b"RPR1", first, len(rules), len(symbols), len(documents))
    parts = (rules, lengths_of(rules, first), symbols.astype(kind), starts.astype("<u8"), first_ids.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        magic, self.first, rules, symbols, documents = struct.unpack_from("<4s4I", payload)
        if magic != b"RPR1":
            raise ValueError("not a block of this format")
        at = 20
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(payload, "<u4", rules, at := at + 8 * rules)
        kind = np.dtype("<u2" if self.first + rules <= NARROW else "<u4")
        self.symbols = np.frombuffer(payload, kind, symbols, at := at + 4 * rules)
        self.starts = np.frombuffer(payload, "<u8", documents, at := at + kind.itemsize * symbols).astype(np.int64)
        self.first_ids = np.frombuffer(payload, "<u8", documents, at + 8 * documents).astype(np.int64)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, then the ids of every rule; where each symbol's begin."""
        flat = self.rules.ravel()
        while len(rules := np.flatnonzero(flat >= self.first)):
            pairs = self.rules[flat[rules] - self.first]
            width = np.ones(len(flat), np.int64)
            width[rules] = 2
            at = np.cumsum(width) - width
            flat = np.repeat(flat, width)
            flat[at[rules]], flat[at[rules] + 1] = pairs[:, 0], pairs[:, 1]
        lengths = self.lengths.astype(np.int64)
        begins = np.concatenate([np.arange(self.first), self.first + np.cumsum(lengths) - lengths])
        return np.concatenate([np.arange(self.first, dtype=np.uint32), flat.astype(np.uint32)]), begins

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begins = self._expansions()
        width = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])[symbols]
        shift = begins[symbols] - (np.cumsum(width) - width)
        return flat[np.repeat(shift, width) + np.arange(width.sum())]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document begins, with the end added."""
        ids = self.expand(self.symbols)
        return ids, np.concatenate([self.first_ids, [len(ids)]])

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids [begin, end) of the block, expanding only the symbols that hold them."""
        width = np.ones(len(self.symbols), np.int64)
        rules = self.symbols >= self.first
        width[rules] = self.lengths[self.symbols[rules].astype(np.int64) - self.first]
        upto = np.cumsum(width)
        a, b = np.searchsorted(upto, begin, "right"), np.searchsorted(upto, end, "left") + 1
        return self.expand(self.symbols[a:b])[begin - (upto[a - 1] if a else 0) :][: end - begin]


def write(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocab: str | None = None) -> None:
    """Write all documents, in ascending key order, null keys first.

    Null and empty texts are documents of the closing id alone. Rows with equal keys are ordered by a hash of
    their text; equal rows are written as often as they occur. A document is never cut, so a very long one is a block.
    """
    vocab = vocab or vocabulary()
    spark = docs.sparkSession
    small_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "key", "tie")
    rows = rows.sortWithinPartitions("key", "tie").select("key", "text")
    end = np.array([END], "<u4").tobytes()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        first = Tokenizer.from_file(vocab).get_vocab_size() if vocab not in _tokenizers else _tokenizers[vocab].get_vocab_size()
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            columns = [[shard], [number], [start], [size], [keys], [pack(held, first)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FORMAT)], schema=FORMAT)

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), vocab)):
                keys.append(k)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= BLOCK:
                    yield block()
                    number, start = number + 1, start + size
                    keys, held, size = [], [], 0
        if held:
            yield block()

    rows.mapInArrow(build, COLUMNS).write.parquet(path)


COLUMNS = "shard int, block int, shard_start long, n_tokens long, keys array<long>, payload binary"
FORMAT = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("shard_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def read_back(spark, path: str) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark, 4)
    blocks = spark.read.schema(COLUMNS).parquet(path)
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row a shard, and as many shards as the writer had partitions.
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "keys", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, at = Block(batch.column(2)[i].as_py()).documents()
                octets, cuts = ids.astype("<u4").tobytes(), at.tolist()
                sums = [zlib.crc32(octets[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                start = batch.column(0)[i].as_py() + at[:-1]
                keys = batch.column(1)[i].values
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(start), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path)
    return read_back(docs.sparkSession, path)
