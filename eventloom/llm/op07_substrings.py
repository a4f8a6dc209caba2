"""Removal of word windows that start earlier in the corpus.

Every window of `WINDOW` consecutive words has a 64-bit fingerprint. A scanning task keeps the earliest of the
windows of equal fingerprint among its own documents, marks the others, and sends the kept ones to the shards
that own their fingerprint ranges, packed in arrays: about 8 bytes a window, and however common a window is,
one entry from each task's batch. A shard marks all but the earliest. Marks come back to buckets of documents, a
document's marked windows cover the words to remove, and what is left is joined by single spaces.

The order that decides "earlier" is the document's id, then the window's start. Broadcasting suffix automata of
reference shards would need every document to be streamed past every shard when the corpus is its own
reference, work that grows with the square of the input; `SuffixAutomaton` does that job where the reference
is bounded (see `remove_known`).

Defined cases: a null text has no words; a text shorter than a window loses nothing; rows of one id count as
one place, so neither is earlier than the other; a null id is smaller than any other; an empty table gives an
empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import pieces, text_bytes, window_hashes, word_hashes

WINDOW = 20
#: Bytes of text for each shard of fingerprints, about.
SHARD_BYTES = 12 << 20
#: Bytes of text in a bucket of documents that get their marks together, about.
BUCKET_BYTES = 4 << 20
#: Bytes of text whose windows a scanning task keeps together; a longer text stays whole.
BATCH_BYTES = 16 << 20


def _ranges(values: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each fingerprint by its leading 24 bits."""
    return ((values >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """The low 56 bits of each fingerprint; the shard knows the leading ones."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _late(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, order: np.ndarray) -> np.ndarray:
    """True for windows with an earlier one of equal fingerprint (another place: equal places tie). doc indexes order,
    the documents' ids."""
    late = np.zeros(len(h), bool)
    by = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[by[1:]] == h[by[:-1]])
    some = np.unique(np.concatenate([by[same], by[same + 1]]))
    del by
    if len(some):
        o, at = order[doc[some]], pos[some]
        to = np.lexsort((at, o, h[some]))
        some, o, at = some[to], o[to], at[to]
        new = np.concatenate([[True], h[some[1:]] != h[some[:-1]]])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        late[some] = (o != o[head]) | (at != at[head])
    return late


def _keyed(docs: DataFrame) -> DataFrame:
    """o is a row's place in the order; with digest, of its text, it names all that matters of the row."""
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("o"), F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("digest"), "doc_id", "text")


def _steps(doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Documents (sorted, from 0) and starts (sorted in each) as small steps, compressed."""
    step = np.diff(doc, prepend=0)
    back = pos.astype(np.int64)
    back[1:] -= np.where(step[1:] == 0, pos[:-1], 0)
    return zstandard.compress(np.concatenate([step, back]).astype("<u4").tobytes(), 1)


def _places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, pos = np.frombuffer(zstandard.decompress(blob), "<u4").reshape(2, -1).astype(np.int64)
    total, begin = np.cumsum(pos), np.flatnonzero(np.concatenate([[True], step[1:] != 0]))
    return np.cumsum(step), total - np.repeat(total[begin] - pos[begin], np.diff(np.append(begin, len(pos))))


def _message(shard: int, o: np.ndarray, digest: np.ndarray, doc: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None) -> tuple:
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    used = doc[new]
    ids = zstandard.compress(np.diff(o[used], prepend=0).astype("<i8").tobytes(), 1)
    return shard, ids, digest[used].astype("<i4").tobytes(), None if hashes is None else _pack(hashes), _steps(np.cumsum(new) - 1, pos)


_SENT = {"shard": pa.int32(), "ids": pa.binary(), "digests": pa.binary(), "windows": pa.binary(), "places": pa.binary()}


def _bucket(o: np.ndarray, digest: np.ndarray, buckets: int) -> np.ndarray:
    return ((o % buckets + digest % buckets) % buckets).astype(np.int32)


def _zip_marks(o: np.ndarray, digest: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Documents and the starts of their late windows, one row for all that a shard tells a bucket."""
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    used, many = doc[cut], np.diff(np.append(cut, len(doc)))
    parts = [np.array([len(cut)], "<i8"), o[used].astype("<i8"), digest[used].astype("<i8"), many.astype("<i8"), pos.astype("<u4")]
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def _unzip_marks(blob: bytes):
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    o, digest, many = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
    return zip(o.tolist(), digest.tolist(), np.split(np.frombuffer(raw, "<u4", -1, 8 + 24 * n), np.cumsum(many)[:-1]), strict=True)


def marked(docs: DataFrame, shards: int, buckets: int, window: int = WINDOW) -> DataFrame:
    """(bucket, marks): the windows to remove of the documents in a bucket; a row from each shard that has any."""

    def messages(o, digest, hashes, count):
        """One for each shard: its documents, their fingerprints and the windows' places. Windows that are late
        already travel without fingerprints, to be passed on."""
        doc = np.repeat(np.arange(len(o), dtype=np.int32), count)
        pos = (np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        late = _late(hashes, doc, pos, o)
        shard = _ranges(hashes, shards).astype(np.int32)
        fresh = np.flatnonzero(~late)
        fresh = fresh[np.argsort(shard[fresh], kind="stable")]
        cut = np.searchsorted(shard[fresh], np.arange(shards + 1))
        for s in range(shards):
            if len(at := fresh[cut[s] : cut[s + 1]]):
                yield _message(s, o, digest, doc[at], pos[at], hashes[at])
        if len(at := np.flatnonzero(late)):
            yield _message(int(shard[at[0]]), o, digest, doc[at], pos[at], None)

    def send(batches):
        held, size = [], 0

        def flush():
            rows = list(messages(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_SENT.values())], names=list(_SENT))

        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            o, digest = batch.column("o").to_numpy(), batch.column("digest").to_numpy()
            for i, j, some, own in pieces(data, at):
                hashes, of = window_hashes(*word_hashes(some, own), window)
                held.append((o[i:j], digest[i:j], hashes, np.diff(of)))
                size += len(some)
                if size >= BATCH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def resolve(group: pa.Table) -> pa.Table:
        o, digest, doc, pos, prints, late, n = [], [], [], [], [], [], 0
        for ids, digests, win, places in zip(*(group.column(c).to_pylist() for c in list(_SENT)[1:]), strict=True):
            local, start = _places(places)
            o.append(np.cumsum(np.frombuffer(zstandard.decompress(ids), "<i8")))
            digest.append(np.frombuffer(digests, "<i4"))
            doc.append((local + n).astype(np.int32))
            pos.append(start.astype(np.int32))
            prints.append(np.zeros(0, np.uint64) if win is None else _unpack(win))
            late.append(np.full(len(start), win is None))
            n += len(o[-1])
        o, digest, doc, pos, prints, late = map(np.concatenate, (o, digest, doc, pos, prints, late))
        fresh = np.flatnonzero(~late)
        late[fresh] = _late(prints, doc[fresh], pos[fresh], o)
        at = np.flatnonzero(late)
        to = _bucket(o, digest, buckets)[doc[at]]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(at) else np.zeros(1, int)
        packed = [_zip_marks(o, digest, doc[at[a:b]], pos[at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"bucket": pa.array(to[cut[:-1]], pa.int32()), "marks": pa.array(packed, pa.binary())})

    schema = "shard int, ids binary, digests binary, windows binary, places binary"
    return docs.select("o", "digest", "text").mapInArrow(send, schema).groupBy("shard").applyInArrow(resolve, "bucket int, marks binary")


def remove_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_removed and kept_sha256."""
    docs = _keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    marks = marked(docs, max(4, -(-size // SHARD_BYTES)), buckets, window)
    names = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}

    def cut(own: pa.Table, told: pa.Table) -> pa.Table:
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for blob in told.column("marks").to_pylist():
            for o, digest, some in _unzip_marks(blob):
                starts.setdefault((o, digest), []).append(some)
        out = []
        for doc_id, key, text in zip(own.column("doc_id").to_pylist(), zip(own.column("o").to_pylist(), own.column("digest").to_pylist(), strict=True), own.column("text").to_pylist(), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if key in starts:
                edge = np.zeros(n + 1, np.int64)
                first = np.concatenate(starts[key]).astype(np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + window, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            out.append((doc_id, n, n - len(words), sha256(b" ".join(words)).hexdigest()))
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(names.items())})

    bucket = F.pmod(F.pmod("o", F.lit(buckets)) + F.pmod("digest", F.lit(buckets)), F.lit(buckets)).cast("int")
    left = docs.withColumn("bucket", bucket).groupBy("bucket")
    return left.cogroup(marks.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


class SuffixAutomaton:
    """All word sequences of a reference of bounded size; streams texts for matching statistics."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes | int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, words in enumerate(texts):
            for w in [*words, k]:  # a number ends each text and matches nothing
                last = self._extend(last, w)

    def _extend(self, last: int, w: bytes | int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def matches(self, words: list[bytes]) -> list[int]:
        """For each place, how many words ending there occur in a row in the reference."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                state, n = 0, 0
            out.append(n)
        return out


#: Words that the automata of a reference may have in all: they are sent to every worker.
REFERENCE_WORDS = 2_000_000


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_removed, text without the spans of `window` words or more that occur
    in reference(text). The reference is cut into shards, each a suffix automaton built in a task; a reference of
    more than REFERENCE_WORDS words is refused."""
    words = reference.select(F.coalesce("text", F.lit("")).alias("text"))
    total = words.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if total > REFERENCE_WORDS:
        raise ValueError(f"the reference has {total} words; at most {REFERENCE_WORDS} can be sent to every worker")
    texts = [r.text.encode().split() for r in words.collect()]
    shards, size = [[]], 0
    for t in texts:
        if size >= shard_words:
            shards, size = [*shards, []], 0
        shards[-1].append(t)
        size += len(t)
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        automata = [SuffixAutomaton(s) for s in sent.value]
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                w = (text or "").encode().split()
                keep = [True] * len(w)
                for a in automata:
                    free = len(w)
                    for i in range(len(w) - 1, -1, -1) if (m := a.matches(w)) else ():
                        if m[i] >= window:
                            for j in range(i - m[i] + 1, min(i + 1, free)):
                                keep[j] = False
                            free = min(free, i - m[i] + 1)
                out.append((len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_windows(table(spark, sf_dir, "documents"))
