"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model has two levels, contexts and their successors, with absolute discounting over the add-half unigram
distribution: p(w | v) = max(c(v w) - D, 0) / c(v .) + D * N(v .) / c(v .) * p(w). It grows with the corpus, so
it is never held in one place. It lives in shards, each owning a range of context hashes:

1. A scanning task packs its documents into chunks of bounded size, which are written compressed.
2. A chunk sends each shard its distinct contexts and successors with their counts in training documents.
3. A shard adds up the counts, compiles its trie and answers every chunk's distinct n-grams from it. In a trie
   the contexts are an Elias-Fano sequence of hashes, a second monotone sequence points to the successors, and
   the successors' hashes, relative to their context, are a third. Discounted probabilities and back-off weights
   are quantised to one byte each. The levels are one block of bytes, memory-mapped; look-ups are successor
   searches within a context's range.
4. Answers return to their chunks, where every document is scored in its own word order.

Defined cases: a null or empty text has one token, its end; a null doc_id belongs to the training set; repeated
rows count as often as they occur; with no training document at all, every token is unknown and gets
probability 1 in the base model and the score; an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import column_words, mix, text_bytes

#: Bytes of text in a chunk (a longer text is a chunk of its own), and for each shard, about.
CHUNK_BYTES, SHARD_BYTES = 8 << 20, 12 << 20
DISCOUNT = 0.75
#: Bits of a successor's hash, which need only tell it from the others of its context.
LOW = 40
START, END = (mix(np.array([x], np.uint64))[0] for x in (0xA11CE, 0xB0B))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


# --- Elias-Fano sequences -------------------------------------------------------------------------------------


def _ef_pack(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """A monotone sequence: the low bits of all values packed, the high bits in unary."""
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    bits = np.zeros(n + (universe >> low) + 1, bool)
    bits[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    if low and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        part = values & np.uint64((1 << low) - 1)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(packed, word, part << shift)
        over = shift + np.uint64(low) > 64
        np.bitwise_or.at(packed, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    high = np.packbits(bits, bitorder="little")
    return [np.array([n, low, len(bits)], "<u8"), packed, np.append(high, np.zeros(-len(high) % 8, np.uint8)).view("<u8")]


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit (from 0) of each word."""
    at, left = np.zeros(len(words), np.uint64), n.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count((words >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
        on = left >= below
        left -= np.where(on, below, 0)
        at += np.where(on, np.uint64(width), np.uint64(0))
    return at.astype(np.int64)


class EliasFano:
    """The bits stay packed as they are mapped; beside them only counts of ones and zeros before each 64 of them."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.low, size = (int(x) for x in head)
        self.packed, self.high = low, high
        self.ones = np.zeros(len(high) + 1, np.int32)
        np.cumsum(np.bitwise_count(high), out=self.ones[1:])
        self.zeros = (64 * np.arange(len(high) + 1) - self.ones).astype(np.int32)
        #: High parts that the sequence may have.
        self.top = size - self.n

    def _select(self, before: np.ndarray, words, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one (or zero)."""
        at = np.searchsorted(before, k, side="right") - 1
        return 64 * at + _nth_bit(words(self.high[at]), k - before[at])

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        k = np.minimum(high[some], self.top) - 1
        out[some] = self._select(self.zeros, np.invert, k) - k
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.packed[word] >> shift
        # a shift by 64 is undefined: two shifts do it
        value |= (self.packed[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return value & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(self.ones, lambda w: w, i) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(i) if self.low else high.astype(np.uint64)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The index of the first value >= x, within [lo, hi) where they are given."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        a, b = self.below(high), self.below(high + 1)
        if lo is not None:
            a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        if not self.low or not self.n:
            return a
        want = x & np.uint64((1 << self.low) - 1)
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < want)
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a


# --- the trie of a shard ----------------------------------------------------------------------------------------


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte each for positive values (never 0, which means none), and what the bytes stand for."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256, "<f4")
    logs = np.log(values)
    lo, hi = float(logs.min()), float(logs.max())
    step = max((hi - lo) / 254, 1e-9)
    code = (1 + np.rint((logs - lo) / step)).astype(np.uint8)
    # a byte stands for the mean of its values, so frequent ones are exact
    many = np.bincount(code, minlength=256)
    book = np.bincount(code, weights=values, minlength=256) / np.maximum(many, 1)
    return code, book.astype("<f4")


def compile_trie(contexts: np.ndarray, of: np.ndarray, successor: np.ndarray, count: np.ndarray) -> bytes:
    """contexts sorted; the successors of context i are successor[of[i]:of[i+1]] (sorted, LOW bits), seen count times."""
    n = len(contexts)
    many = np.diff(of)
    total = np.add.reduceat(count, of[:-1]) if n else np.zeros(0)
    seen = np.maximum(count - DISCOUNT, 1e-9) / np.repeat(total, many)
    p_code, p_book = _codes(seen)
    b_code, b_book = _codes(DISCOUNT * many / np.maximum(total, 1))
    relative = (np.repeat(np.arange(n, dtype=np.uint64), many) << np.uint64(LOW)) | successor
    parts = [
        *_ef_pack(contexts, 1 << 64), *_ef_pack(of.astype(np.uint64), int(of[-1]) + 1), *_ef_pack(relative, max(n, 1) << LOW),
        p_code, p_book, b_code, b_book,
    ]
    raw = [p.tobytes() for p in parts]
    raw = [r + b"\0" * (-len(r) % 8) for r in raw]
    return np.array([x for p, r in zip(parts, raw, strict=True) for x in (len(p), len(r))], "<u8").tobytes() + b"".join(raw)


class Trie:
    """Look-ups in a memory-mapped shard."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing is left behind
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        kinds = ["<u8", "<u8", "<u8"] * 3 + ["u1", "<f4", "u1", "<f4"]
        sizes, at, parts = np.frombuffer(self.map, "<u8", 2 * len(kinds)).reshape(-1, 2), 16 * len(kinds), []
        for (n, size), kind in zip(sizes.tolist(), kinds, strict=True):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += size
        self.contexts, self.pointers, self.successors = (EliasFano(*parts[i : i + 3]) for i in (0, 3, 6))
        self.p_code, self.p_book, self.b_code, self.b_book = parts[9:]

    def context(self, hashes: np.ndarray) -> np.ndarray:
        """Each context's place, or -1."""
        i = self.contexts.successor(hashes)
        ok = i < self.contexts.n
        ok[ok] = self.contexts.get(i[ok]) == hashes[ok]
        return np.where(ok, i, -1)

    def backoff(self, place: np.ndarray) -> np.ndarray:
        """Codes; 0 for a context that is not there."""
        out = np.zeros(len(place), np.uint8)
        out[place >= 0] = self.b_code[place[place >= 0]]
        return out

    def seen(self, place: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of the discounted probabilities of successors within their contexts; 0 where there is none."""
        out = np.zeros(len(place), np.uint8)
        at = np.flatnonzero(place >= 0)
        p = place[at]
        lo, hi = self.pointers.get(p).astype(np.int64), self.pointers.get(p + 1).astype(np.int64)
        x = (p.astype(np.uint64) << np.uint64(LOW)) | successor[at]
        i = self.successors.successor(x, lo, hi)
        ok = i < hi
        ok[ok] = self.successors.get(i[ok]) == x[ok]
        out[at[ok]] = self.p_code[i[ok]]
        return out


# --- chunks -----------------------------------------------------------------------------------------------------


def _zip(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<u8").tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, "<u8", len(kinds), 8).tolist()
    out, at = [], 8 * (len(kinds) + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_CHUNK = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_string())])


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, docs): whole documents packed into compressed blocks, written once."""

    def pack(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch]).cast(_CHUNK).to_batches()
            for whole in rows:
                _, at = text_bytes(whole.column("text"))
                i = 0
                while i < whole.num_rows:
                    j = min(whole.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES - size, side="right")) - 1))
                    held.append(whole.slice(i, j - i))
                    size += int(at[j] - at[i])
                    i = j
                    if size >= CHUNK_BYTES * 3 // 4:
                        yield out(part, k, held)
                        k, held, size = k + 1, [], 0
        if held:
            yield out(part, k, held)

    def out(part, k, held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_pydict({"chunk": pa.array([f"{part}-{k}"]), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    packed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(pack, "chunk string, docs binary")
    return written(packed, "lm-chunks")


class Chunk:
    """A chunk's documents as token sequences, its distinct words, and its distinct n-grams in the order of their
    context's and their successor's hash. Both the question to a shard and its answer follow that order."""

    def __init__(self, blob: bytes):
        self.rows = pa.ipc.open_stream(blob).read_all()
        hashes, of = column_words(self.rows.column("text"), lower=True)
        self.count = np.diff(of) + 1  # with the end
        start = np.cumsum(self.count) - self.count
        self.start = start
        size = int(self.count.sum())
        last = start + self.count - 1
        tokens = np.empty(size, np.uint64)
        inner = np.ones(size, bool)
        inner[last] = False
        tokens[inner], tokens[last] = hashes, END
        self.words, index = np.unique(np.concatenate([tokens, np.array([START], np.uint64)]), return_inverse=True)
        del tokens, hashes, inner
        self.token = index[:-1].astype(np.int32)
        self.context = np.empty(size, np.int32)
        self.context[1:] = self.token[:-1]
        self.context[start] = index[-1]
        self.held = self.rows.column("held_out").to_numpy()
        train = np.repeat(~self.held, self.count)
        # successors are ordered by the part of their hash that is sent
        low = self.words & np.uint64((1 << LOW) - 1)
        order = np.argsort(low, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pair, gram = np.unique(self.context.astype(np.int64) * len(order) + rank[self.token], return_inverse=True)
        self.gram = gram.astype(np.int32)
        self.gram_context = pair // len(order)
        self.gram_low = low[order[pair % len(order)]]
        self.gram_train = np.bincount(self.gram, weights=train, minlength=len(pair)).astype("<u4")
        self.word_train = np.bincount(self.token, weights=train, minlength=len(order)).astype("<u4")

    def shard_cuts(self, shards: int) -> np.ndarray:
        """Words (and the n-grams they begin) of shard s: from cut s to cut s + 1."""
        shard = ((self.words >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
        return np.searchsorted(shard, np.arange(shards + 1))

    def questions(self, shards: int):
        cut = self.shard_cuts(shards)
        gram_cut = np.searchsorted(self.gram_context, cut)
        for s in range(shards):
            a, b, x, y = cut[s], cut[s + 1], gram_cut[s], gram_cut[s + 1]
            if a == b:
                continue
            many = np.bincount(self.gram_context[x:y] - a, minlength=b - a).astype("<u4")
            low = self.gram_low[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            yield s, _zip(self.words[a:b].astype("<u8"), self.word_train[a:b], many, low, self.gram_train[x:y])


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """A shard: adds up what the chunks count, compiles the trie, and looks their n-grams up in it."""
    asked = []
    for blob in group["question"]:
        words, count, many, low, train = _unzip(blob, "<u8", "<u4", "<u4", "u1", "<u4")
        wide = np.zeros((len(low) // 5, 8), np.uint8)
        wide[:, :5] = low.reshape(-1, 5)
        asked.append((words, count, many, wide.view("<u8").ravel(), train))
    words, index = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    count = np.bincount(index, weights=np.concatenate([a[1] for a in asked]), minlength=len(words)).astype("<u4")
    ends = np.cumsum([len(a[0]) for a in asked])
    own = [index[e - len(a[0]) : e] for e, a in zip(ends, asked, strict=True)]
    keys = [(np.repeat(o, a[2]).astype(np.uint64) << np.uint64(LOW)) | a[3] for o, a in zip(own, asked, strict=True)]
    fresh = [k[a[4] > 0] for k, a in zip(keys, asked, strict=True)]
    pairs, at = np.unique(np.concatenate(fresh), return_inverse=True)
    times = np.bincount(at, weights=np.concatenate([a[4][a[4] > 0] for a in asked]), minlength=len(pairs))
    place = (pairs >> np.uint64(LOW)).astype(np.int64)
    used, of = np.unique(place, return_index=True)
    trie = Trie(compile_trie(words[used], np.append(of, len(pairs)).astype(np.int64), pairs & np.uint64((1 << LOW) - 1), times))
    out = []
    for o, a in zip(own, asked, strict=True):
        p = trie.context(np.ascontiguousarray(a[0], np.uint64))
        out.append(_zip(count[o], trie.backoff(p), trie.seen(np.repeat(p, a[2]), a[3]), trie.p_book, trie.b_book))
    first = np.arange(len(out)) == 0
    return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "shard": group["shard"].to_numpy(), "answer": out, "tokens": np.where(first, count.sum(dtype=np.int64), 0), "types": np.where(first, (count > 0).sum(), 0)})


def scores(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to the columns of the query."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    packed = chunks(docs)

    def ask(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                rows = list(Chunk(blob.as_buffer()).questions(shards))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.string()), pa.array([q for _, q in rows], pa.binary())], names=["shard", "chunk", "question"])

    asked = packed.mapInArrow(ask, "shard int, chunk string, question binary")
    answers = written(asked.groupBy("shard").applyInPandas(_answer, "chunk string, shard int, answer binary, tokens long, types long"), "lm-answers")
    total = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = int(total.n or 0), int(total.v or 0)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        right = right.sort_values("shard")
        got = [_unzip(b, "<u4", "u1", "u1", "<f4", "<f4") for b in right["answer"]]
        for blob in left["docs"]:
            c = Chunk(pa.py_buffer(blob))
            count = np.concatenate([g[0] for g in got]).astype(float)
            back = np.concatenate([np.where(g[1] == 0, 1.0, g[4][g[1]].astype(float)) for g in got])
            seen = np.concatenate([g[3][g[2]].astype(float) for g in got])
            unigram = (count + 0.5) / (n + 0.5 * (v + 1))
            base = np.add.reduceat(np.log10(unigram)[c.token], c.start)
            p = seen[c.gram] + back[c.context] * unigram[c.token]
            frames.append(pd.DataFrame({
                "doc_id": c.rows.column("doc_id").to_pandas().astype("Int64"), "held_out": c.held, "n_tokens": c.count, "n_known": np.add.reduceat((count > 0)[c.token].astype(np.int64), c.start),
                "train_tokens": n, "base_score": base, "score": np.add.reduceat(np.log10(np.minimum(p, 1.0)), c.start),
            }))
        return pd.concat(frames)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("chunk").cogroup(answers.select("chunk", "shard", "answer").groupBy("chunk")).applyInPandas(score, schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
