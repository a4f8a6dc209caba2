"""Byte-level BPE encoding and decoding with a transducer lexicon.

The most frequent pre-tokens of the corpus, each encoded once by the exact merge procedure, are compiled into a
minimal acyclic automaton: words share prefixes and suffixes, and the numbers of words below each edge give a
word its place in the table of id outputs. The automaton is a few flat arrays in one block of bytes of bounded
size (at most `LEXICON` words), sent to the workers once and memory-mapped there. A pre-token that it lacks is
merged exactly. Results equal the public tokenizers library's.

A worker takes some texts at a time: pre-tokens that it doesn't know yet walk the automaton together, and what the
automaton lacks is merged together, one step of all words at a time. For the lexicon, words are counted in the JVM,
and only distinct ones are split into pre-tokens.

Defined cases: a null or empty text has no ids and decodes to the empty text; the special token's string in a
text becomes its id, as in the library; very long pre-tokens are merged with a heap, in n log n time.
"""

from __future__ import annotations

import heapq
import json
import mmap
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, mapped, table, written

TOKENIZER = "byte_bpe_50k.json"
#: Words in the transducer at most; pre-tokens that a worker remembers; characters of text that it takes together.
LEXICON, REMEMBERED, TOGETHER = 32_768, 400_000, 1 << 21
_S = r"\t-\r \x85\xa0  -     　"
_NONE = np.int32(1 << 30)


PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Bpe:
    """The exact procedure: byte ids, then always the pair of the lowest merge rank, leftmost first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(shown[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = {b: vocab[c] for c, b in shown.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        # the same for many words at once
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int32)
        self.merged_ids, self.byte_ids = np.array(self.merged, np.int32), np.array([self.byte_id[b] for b in range(256)], np.int32)

    def merge(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, none = self.rank, 1 << 30
        near = [rank.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while near and (best := min(near)) < none:
            i = near.index(best)
            ids[i] = self.merged[best]
            del ids[i + 1]
            del near[i]
            if i:
                near[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(near):
                near[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge of each word, one step of all words at a time."""
        out: list[list[int]] = [[]] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= 48), key=lambda i: len(words[i]))
        for k in range(0, len(short), 4096):
            some = short[k : k + 4096]
            for i, ids in zip(some, self._merge_rows([words[i] for i in some]), strict=True):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > 48:
                out[i] = self.merge(w)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; _NONE where there is none, or no second part (-1)."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((b >= 0) & (self.pair_keys[at] == key), self.pair_rank[at], _NONE)

    def _merge_rows(self, words: list[bytes]) -> list[list[int]]:
        size = np.array([len(w) for w in words])
        wide = int(size.max()) if len(size) else 0
        ids = np.full((len(words), wide + 1), -1, np.int32)
        ids[:, :wide][np.arange(wide) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        rows, at = np.arange(len(words)), np.arange(wide + 1)
        while wide:
            best = ranks[rows].min(1)
            rows, best = rows[best < _NONE], best[best < _NONE]
            if not len(rows):
                break
            own, rank = ids[rows], ranks[rows]
            pos = rank.argmin(1)
            take = np.minimum(at + (at > pos[:, None]), wide)  # what follows the merged pair moves up
            own = np.take_along_axis(own, take, 1)
            rank = np.take_along_axis(rank, np.minimum(take[:, :-1], wide - 1), 1)
            rank[:, -1] = _NONE
            r = np.arange(len(rows))
            own[r, pos] = self.merged_ids[best]
            rank[r, pos] = self._ranks(own[r, pos], own[r, pos + 1])
            before = pos > 0
            rank[r[before], pos[before] - 1] = self._ranks(own[r[before], pos[before] - 1], own[r[before], pos[before]])
            ids[rows], ranks[rows] = own, rank
        return [row[:n] for row, n in zip(ids.tolist(), (ids >= 0).sum(1).tolist(), strict=True)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            new = self.merged[r]
            j = right[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[j] < n:
                left[right[j]] = i
                if (r := rank.get((new, ids[right[j]]))) is not None:
                    heapq.heappush(heap, (r, i, new, ids[right[j]]))
            if left[i] >= 0 and (r := rank.get((ids[left[i]], new))) is not None:
                heapq.heappush(heap, (r, left[i], ids[left[i]], new))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words (built over them in sorted order, equal suffix states shared),
    as flat arrays: per state its first edge and whether a word ends; per edge a label, a target and how many
    words sort before it; per word its ids."""
    root: list = [{}, False]
    register: dict[tuple, list] = {}

    def close(path: list[tuple[list, int, list]], keep: int) -> None:
        while len(path) > keep:
            parent, label, node = path.pop()
            key = (node[1], tuple((k, id(v)) for k, v in node[0].items()))
            parent[0][label] = register.setdefault(key, node)

    path: list[tuple[list, int, list]] = []
    before = b""
    order = sorted(w for w in words if w)
    for word in order:
        same = next((i for i, (a, b) in enumerate(zip(word, before, strict=False)) if a != b), min(len(word), len(before)))
        close(path, same)
        node = path[-1][2] if path else root
        for c in word[same:]:
            new: list = [{}, False]
            node[0][c] = new
            path.append((node, c, new))
            node = new
        node[1], before = True, word
    close(path, 0)
    number, states, stack = {id(root): 0}, [root], [root]
    while stack:
        for child in stack.pop()[0].values():
            if id(child) not in number:
                number[id(child)] = len(states)
                states.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def count(node: list) -> int:
        todo = [node]
        while todo:
            top = todo[-1]
            missing = [c for c in top[0].values() if id(c) not in below]
            if missing:
                todo += missing
            else:
                below[id(todo.pop())] = top[1] + sum(below[id(c)] for c in top[0].values())
        return below[id(node)]

    count(root)
    first, final, labels, targets, skips = [0], [], bytearray(), [], []
    for node in states:
        skip = int(node[1])
        for label, child in node[0].items():
            labels.append(label)
            targets.append(number[id(child)])
            skips.append(skip)
            skip += below[id(child)]
        first.append(len(labels))
        final.append(node[1])
    ids = [i for w in order for i in words[w]]
    at = np.concatenate([[0], np.cumsum([len(words[w]) for w in order])]) if order else np.zeros(1)
    parts = [np.array(first, "<u4"), np.array(final, "<u1"), np.frombuffer(bytes(labels), "<u1"), np.array(targets, "<u4"), np.array(skips, "<u4"), at.astype("<u4"), np.array(ids, "<u4")]
    head = np.array([len(p) for p in parts], "<u8")
    return b"".join([head.tobytes(), *(p.tobytes() for p in parts)])


class Lexicon:
    """Look-ups in a memory-mapped automaton."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing is left behind
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, views = 56, []
        for n, kind in zip(np.frombuffer(self.map, "<u8", 7).tolist(), ("<u4", "u1", "u1", "<u4", "<u4", "<u4", "<u4"), strict=True):
            views.append(np.frombuffer(self.map, kind, n, at))
            at += views[-1].nbytes
        first, self.final, labels, self.targets, self.skips, self.at, self.ids = views
        #: State and label of each edge, in order.
        self.keys = (np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64))) << 8) | labels

    def get(self, word: bytes) -> list[int] | None:
        return self.get_many([word])[0]

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None: all words walk the automaton together, byte by byte."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(size) - size
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        walking, done = np.flatnonzero(size), np.zeros(len(words), bool)
        step = 0
        while len(walking) and len(self.keys):
            key = (state[walking] << 8) | data[at[walking] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            walking, edge = walking[ok], edge[ok]
            place[walking] += self.skips[edge]
            state[walking] = self.targets[edge]
            step += 1
            ended = size[walking] == step
            done[walking[ended]] = self.final[state[walking[ended]]] == 1
            walking = walking[~ended]
        ids, first = self.ids, self.at
        return [ids[first[p] : first[p + 1]].tolist() if ok else None for ok, p in zip(done.tolist(), place.tolist(), strict=True)]


class Encoder:
    """Encodes and decodes texts. What it remembers of a pre-token are its ids in decimal and their bytes."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        size = max(bpe.bytes_of) + 1
        self.shown, self.raw = [str(i) for i in range(size)], [bpe.bytes_of.get(i, b"") for i in range(size)]
        self.known: dict[str, tuple[str, bytes]] = {}

    def ids(self, words: list[str]) -> list[list[int]]:
        """Each pre-token's ids: from the lexicon, or merged."""
        raw = [w.encode() for w in words]
        found = self.lexicon.get_many(raw)
        missing = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(missing, self.bpe.merge_many([raw[i] for i in missing]), strict=True):
            found[i] = ids
        return found

    def _learn(self, words: list[str]) -> None:
        shown, raw = self.shown, self.raw
        for word, ids in zip(words, self.ids(words), strict=True):
            self.known[word] = ",".join([shown[i] for i in ids]), b"".join([raw[i] for i in ids])

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[str, bytes]]]:
        """For each text, its pre-tokens' ids in decimal and the bytes these stand for."""
        i, special = 0, self.bpe.special
        while i < len(texts):
            some, size = [], 0
            while i < len(texts) and size < TOGETHER:
                some.append(_split(texts[i], special))
                size += len(texts[i])
                i += 1
            tokens = [[(mark, PRETOKEN.findall(part)) for mark, part in parts] for parts in some]
            words = {w for parts in tokens for _, x in parts for w in x}
            if len(self.known) + len(words) > REMEMBERED:
                self.known = {w: x for w in words if (x := self.known.get(w)) is not None}
            self._learn(list(words - self.known.keys()))
            known = self.known
            for parts in tokens:
                out = []
                for mark, x in parts:
                    if mark is not None:
                        out.append((self.shown[mark], self.raw[mark]))
                    out += [known[w] for w in x]
                yield out

    def encode(self, text: str) -> list[int]:
        return [int(i) for found in self.pieces([text]) for shown, _ in found for i in shown.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")


def _split(text: str, special: dict[str, int]):
    """(None or the id of the special token before it, ordinary text), in order."""
    marks = sorted(special, key=len, reverse=True)
    if not any(m in text for m in marks):
        return [(None, text)]
    found = regex.split("(" + "|".join(map(regex.escape, marks)) + ")", text)
    return [(None, found[0])] + [(special[m], t) for m, t in zip(found[1::2], found[2::2], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, block: bytes) -> Encoder:
    key = f"{path}:{sha256(block).hexdigest()}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Bpe(path), Lexicon(block))
    return _encoders[key]


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent pre-tokens, `most` at most (no part of a tie is taken), among those that follow a space, up
    to 63 characters long. Every word of every text is counted."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word")).filter(F.length("word").between(1, 62))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def split(batches):
        for batch in batches:
            of, tokens = [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                found = PRETOKEN.findall(" " + word)
                tokens += found
                of += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), batch.column("n").take(pa.array(of, pa.int32()))], names=["word", "n"])

    counted = mapped(words, split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = written(counted, "bpe-words")
    # the least count of which there are `most` words at most above it: only those words come to the driver
    above = F.sum("words").over(W.orderBy(F.desc("n")))
    least = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("above", above).filter(F.col("above") <= most).agg(F.min("n")).first()[0]
    words = [] if least is None else [r.word for r in counted.filter(F.col("n") >= least).select("word").collect()]
    forget(counted)
    return words


def encode(docs: DataFrame, lexicon: int = LEXICON, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) with n_tokens, ids (decimal, comma-joined) and decoded text digests."""
    spark, path = docs.sparkSession, path or default_path()
    bpe = Bpe(path)
    words = [w.encode() for w in frequent_words(docs, lexicon)]
    block = spark.sparkContext.broadcast(compile_lexicon(dict(zip(words, bpe.merge_many(words), strict=True))))

    def run(batches):
        own = encoder(path, block.value)
        for batch in batches:
            n, ids, back = [], [], []
            for found in own.pieces([text or "" for text in batch.column("text").to_pylist()]):
                shown = ",".join([x for x, _ in found])
                n.append(shown.count(",") + 1 if found else 0)
                ids.append(sha256(shown.encode()).hexdigest())
                back.append(sha256(b"".join([x for _, x in found]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
