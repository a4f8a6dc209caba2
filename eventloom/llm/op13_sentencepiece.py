"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

The texts of an Arrow batch become words (a run of spaces and what follows it; no piece reaches over the start of
the next word, which `Pieces` verifies). Distinct words are merged together: one flat array holds the symbols of all
words, another the rank of each adjacent pair. A round takes the least rank of every word (a segmented minimum),
merges that pair wherever it stands in the word, from the left and without overlap, and compacts the arrays; words
without a pair left drop out. Merging all places of a pair at once is the same as one after the other where no
piece that the merge makes has a pair of the same or a better rank; ranks without that property (runs of spaces,
which share one score) are merged at the leftmost place only. Results equal the public sentencepiece library's.

Work is per batch, memory is bounded by a batch (8 MB of text, or one longer text), and no state is shared, so a lost
executor costs its batches alone.

Defined cases: a null or empty text has the begin and end ids only and decodes to the empty text; U+2581 in a text
is a space, as in the library; a character without a piece becomes its UTF-8 bytes; words of more than `LONG`
characters are merged with a heap in n log n time, with the same result; rows keep their number and their doc_id
(also null or repeated); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table
from .tokens import text_bytes

MODEL = "piece_bpe_32k.model"
#: Words longer than this are merged by a heap: the rounds of a word may be as many as its symbols.
LONG = 256
_SPACE = "▁"
_BITS = np.int64(21)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """The model's pieces as arrays. A symbol is a piece's id, or `size` + code point for a character without one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end = model.get_piece_size(), model.bos_id(), model.eos_id()
        every = range(self.size)
        special = {i for i in every if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        text = {i: model.id_to_piece(i) for i in every}
        normal = {text[i]: i for i in every if i not in special}
        if any(_SPACE in piece.lstrip(_SPACE) for piece in normal):
            raise ValueError("a piece of this model reaches over the start of a word")
        self.unknown = {i for i in every if model.is_unknown(i)}
        self.byte = np.zeros(256, np.int32)
        raw: list[bytes] = []
        for i in every:
            if model.is_byte(i):
                value = int(text[i][3:5], 16)
                self.byte[value] = i
                raw.append(bytes([value]))
            elif model.is_unknown(i):
                raw.append(model.decode([i]).encode())
            else:
                raw.append(b"" if model.is_control(i) else text[i].replace(_SPACE, " ").encode())
        self.is_byte = np.array([model.is_byte(i) for i in every])
        self.raw = pa.array(raw, pa.large_binary())
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        #: The symbol of each code point; the space is that of U+2581.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[32] = self.symbol[ord(_SPACE)]
        # every way to put a piece together from two symbols
        symbol_of = lambda part: int(self.symbol[ord(part)]) if len(part) == 1 else normal.get(part)
        scores = {i: model.get_score(i) for i in normal.values()}
        rank_of = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(a, b, i) for piece, i in normal.items() for k in range(1, len(piece)) if (a := symbol_of(piece[:k])) is not None and (b := symbol_of(piece[k:])) is not None]
        left, right, result = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = (left << _BITS) | right
        order = np.argsort(keys)
        self.keys, self.result = keys[order], result[order].astype(np.int32)
        self.rank = np.array([rank_of[scores[i]] for i in self.result.tolist()], np.int32)
        self.none = np.int32(len(rank_of))
        # a rank is safe if what it makes has only worse pairs
        made = np.full(self.size, self.none, np.int32)
        made[self.result] = self.rank
        self.safe = np.ones(len(rank_of) + 1, bool)
        for part in (left[order], right[order]):
            known = part < self.size
            before = made[part[known]]
            self.safe[before[self.rank[known] <= before]] = False

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols in the table, or -1."""
        key = (a.astype(np.int64) << _BITS) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1).astype(np.int32)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many words, one word after the other, merged; and how many each word has left."""
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank_at = np.append(self.rank, self.none)  # -1 finds the last: no pair
        pair = np.full(len(symbols), -1, np.int32)
        if len(symbols) > 1:
            same = np.flatnonzero(own[1:] == own[:-1])
            pair[same] = self.find(symbols[same], symbols[same + 1])
        while len(symbols):
            rank = rank_at[pair]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            many = np.diff(np.append(first, len(own)))
            best = np.minimum.reduceat(rank, first)
            going = best < self.none
            if not going.all():
                stay = np.repeat(going, many)
                done.append((own[~stay], symbols[~stay]))
                symbols, own, pair, rank = symbols[stay], own[stay], pair[stay], rank[stay]
                best, many = best[going], many[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, many))
            if len(hit) > len(best):
                # from the left, without overlap: every other place of a run; one place only where the rank isn't safe
                new = np.append(True, hit[1:] != hit[:-1] + 1)
                at = np.arange(len(hit))
                take = (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
                leftmost = np.append(True, own[hit[1:]] != own[hit[:-1]])
                hit = hit[take & (leftmost | self.safe[rank[hit]])]
            symbols[hit] = self.result[pair[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, own, pair = symbols[keep], own[keep], pair[keep]
            hit -= np.arange(len(hit))
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            pair[changed] = -1
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[own[changed] == own[changed + 1]]
            pair[changed] = self.find(symbols[changed], symbols[changed + 1])
        if not done:
            return symbols, np.zeros(len(sizes), np.int64)
        own, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(sizes))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """merge of one word, by a heap."""
        ids, n = symbols.tolist(), len(symbols)
        table = self.table
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := table.get((a, b)))]
        # (rank, place) orders; the result isn't compared before the place
        heap = [(rank, i, result, a, b) for rank, result, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, result, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = result, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (found := table.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    @property
    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right): (rank, result), made when a long word first needs it."""
        if not hasattr(self, "_table"):
            keys = zip((self.keys >> _BITS).tolist(), (self.keys & ((1 << 21) - 1)).tolist(), strict=True)
            self._table = dict(zip(keys, zip(self.rank.tolist(), self.result.tolist(), strict=True), strict=True))
        return self._table

    def words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, one word after the other, and where each begins (and the last ends)."""
        data, at = text_bytes(words)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character's bytes
        sizes = np.diff(np.searchsorted(first, at))
        symbols = self.symbol[points]
        long = sizes > LONG
        of = np.repeat(long, sizes)
        short, left = self.merge(symbols[~of], np.where(long, 0, sizes))
        if long.any():
            ends = np.cumsum(sizes)
            parts = {int(w): self.merge_long(symbols[ends[w] - sizes[w] : ends[w]]) for w in np.flatnonzero(long)}
            starts, found, before = np.cumsum(left) - left, [], 0
            for w, part in parts.items():
                found += [short[before : starts[w]], part]
                before, left[w] = starts[w], len(part)
            short = np.concatenate([*found, short[before:]])
        return self.bytes_for_unknown(short, left)

    def bytes_for_unknown(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their bytes."""
        at = np.append(0, np.cumsum(sizes))
        alone = np.flatnonzero(symbols >= self.size)
        if not len(alone):
            return symbols, at
        points = symbols[alone] - self.size
        many = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        width = np.ones(len(symbols), np.int64)
        width[alone] = many
        place = np.append(0, np.cumsum(width))
        ids = np.repeat(symbols, width)
        raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(place[alone] - (np.cumsum(many) - many), many) + np.arange(len(raw))] = self.byte[raw]
        return ids, place[at]

    def batch(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """For each text, its ids without begin and end as little-endian unsigned 32-bit numbers, and the bytes that
        they stand for."""
        data, at = text_bytes(texts)
        if b"\xe2\x96\x81" in data.tobytes():
            data, at = text_bytes(pa.array([t.as_py().replace(_SPACE, " ") if t.is_valid else "" for t in texts], pa.large_string()))
        full = at[1:] > at[:-1]
        # a space before each text that isn't empty; a word begins at the first space of a run
        begin = at[:-1][full]
        data = np.insert(data, begin, 32)
        at = at + np.append(0, np.cumsum(full))
        space = data == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[at[:-1][full]] = True
        first = np.flatnonzero(head)
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(data))
        words = words.dictionary_encode()
        ids, of = self.words(words.dictionary)
        spelt = np.append(0, np.cumsum(self.raw_size[ids]))[of]
        raw = text_bytes_of(self.raw.take(pa.array(ids)))
        of_text = np.searchsorted(first, at)
        shown = _taken(ids.astype("<u4").view(np.uint8), of * 4, words.indices)
        back = _taken(raw, spelt, words.indices)
        for i, ok in enumerate(full.tolist()):
            if not ok:
                yield b"", b""
                continue
            a, b = of_text[i], of_text[i + 1]
            yield shown[0][shown[1][a] : shown[1][b]].tobytes(), back[0][back[1][a] + 1 : back[1][b]].tobytes()

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        ids, _ = next(self.batch(pa.array([text], pa.string())))
        return [self.begin, *np.frombuffer(ids, "<u4").tolist(), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the first space goes, and a byte that isn't part of a character becomes U+FFFD."""
        out, run, first = [], [], True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run.append(self.raw[i].as_py())
                first = False
                continue
            if run:
                out.append(_lenient(b"".join(run)))
                run = []
            if i is not None:
                piece = self.raw[i].as_py().decode()
                out.append(piece.removeprefix(" ") if first and i not in self.unknown else piece)
                first = first and not piece
        return "".join(out)


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode() + "�"
            raw = raw[e.start + 1 :]
    return out


def text_bytes_of(column: pa.LargeBinaryArray) -> np.ndarray:
    """The bytes of all values in a row."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]


def _taken(data: np.ndarray, at: np.ndarray, index: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values at the given indexes: their bytes in a row, and where each begins (and the last ends)."""
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    out = values.take(index)
    offsets = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1]
    return text_bytes_of(out), offsets


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) to doc_id, ids (all ids as little-endian unsigned 32-bit numbers, begin and end included)
    and decoded (the text that the ids stand for)."""
    path = path or default_path()

    def run(batches):
        own = pieces(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (own.begin, own.end))
        for batch in batches:
            found = list(own.batch(batch.column("text")))
            ids, back = pa.array([begin + ids + end for ids, _ in found], pa.binary()), pa.array([raw for _, raw in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids, back.cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
